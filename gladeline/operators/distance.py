"""A raster band of distances: for every cell, how far the nearest loss cell is, exactly and up to a cap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.grid import WORD_SHIFT

#: 512 x 512 cells per tile.
TILE_SHIFT = 9
_BAND = "row long, col long, d2 long"


def _bits(words: np.ndarray) -> np.ndarray:
    """64 columns of booleans per word."""
    return np.unpackbits(words.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)


def squared_distances(loss: np.ndarray, reach: int) -> np.ndarray:
    """Squares of the distances to the nearest loss cell, for the cells at least ``reach`` from the border.

    Two passes: within each column to the nearest loss above or below, then along each row over the columns within
    reach. Columns are taken by growing distance until none can be nearer. Beyond ``reach`` values are larger than
    its square, but not exact.
    """
    rows, cols = loss.shape
    far = 4 * (reach + 1)
    at = np.arange(rows)[:, None]
    above = np.maximum.accumulate(np.where(loss, at, -far), axis=0)
    below = np.minimum.accumulate(np.where(loss, at, rows + far)[::-1], axis=0)[::-1]
    column = np.minimum(np.minimum(at - above, below - at)[reach : rows - reach], far).astype(np.int64) ** 2
    width = cols - 2 * reach
    best = column[:, reach : reach + width].copy()
    for step in range(1, reach + 1):
        if step * step >= best.max(initial=0):
            break
        for first in (reach - step, reach + step):
            np.minimum(best, column[:, first : first + width] + step * step, out=best)
    return best


def distance_band(raster_words: DataFrame, reach: int, tile_shift: int = TILE_SHIFT) -> DataFrame:
    """``row, col, d2`` for every valid cell: squared distance in cells to the nearest loss, NULL beyond ``reach``.

    ``raster_words`` are bits ``(row, word, valid, loss)``, one row per 64 cells. Words with loss go to every tile
    that their cells can reach as well, so a tile has all it needs and its work is bounded by its size and the
    reach. The only shuffle is that of the words.
    """
    if reach < 1:
        raise ValueError("the reach must be at least one cell")
    if tile_shift < WORD_SHIFT:
        raise ValueError("a tile must hold whole words")
    row, word = F.col("row").cast("long"), F.col("word").cast("long")
    first_col = F.shiftleft(word, WORD_SHIFT)
    mine = raster_words.filter(F.col("valid") != 0).select(
        row.alias("row"), word.alias("word"), F.col("valid").alias("bits"), F.lit(False).alias("source"),
        F.shiftright(row, tile_shift).alias("tr"), F.shiftright(first_col, tile_shift).alias("tc"),
    )
    lost = raster_words.filter(F.col("loss") != 0)
    lost = lost.withColumn("tr", F.explode(F.sequence(F.shiftright(row - reach, tile_shift), F.shiftright(row + reach, tile_shift))))
    tiles = F.sequence(F.shiftright(first_col - reach, tile_shift), F.shiftright(first_col + 63 + reach, tile_shift))
    lost = lost.withColumn("tc", F.explode(tiles)).select(
        row.alias("row"), word.alias("word"), F.col("loss").alias("bits"), F.lit(True).alias("source"), "tr", "tc"
    )

    def tile(part: pa.Table) -> pa.Table:
        size = 1 << tile_shift
        halo = -(-reach // 64) * 64  # whole words around the tile
        top, left = part["tr"][0].as_py() * size, part["tc"][0].as_py() * size
        rows, words, source = (np.asarray(part[c]) for c in ("row", "word", "source"))
        bits = _bits(np.asarray(part["bits"]))
        seen = np.zeros((size + 2 * halo, (size + 2 * halo) // 64, 64), bool)
        # a word may reach the tile although some of its cells do not
        y, x = rows - top + halo, words - (left - halo) // 64
        near = source & (y >= 0) & (y < seen.shape[0]) & (x >= 0) & (x < seen.shape[1])
        seen[y[near], x[near]] = bits[near]
        loss = seen.reshape(seen.shape[0], -1)
        d2 = squared_distances(loss[halo - reach : halo + size + reach, halo - reach : halo + size + reach], reach)
        own, place = np.nonzero(bits & ~source[:, None])
        r, c = rows[own], words[own] * 64 + place
        found = d2[r - top, c - left]
        return pa.table({"row": pa.array(r), "col": pa.array(c), "d2": pa.array(found, mask=found > reach * reach)})

    return mine.unionByName(lost).groupBy("tr", "tc").applyInArrow(tile, _BAND)


def distance_metres(band: DataFrame, cell_m: float, cap_m: float) -> DataFrame:
    """``row, col, dist_to_defo_m``: metres to one decimal, the cap where nothing is nearer."""
    metres = F.least(F.sqrt("d2") * F.lit(float(cell_m)), F.lit(float(cap_m)))
    return band.select("row", "col", F.coalesce(F.bround(metres, 1), F.lit(float(cap_m))).alias("dist_to_defo_m"))
