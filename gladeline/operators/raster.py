"""Operators on ``cells(row, col, bands...)``: one row per valid cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gladeline.grid import WORD_SHIFT, has_bit, low_bits, word_of
from gladeline.operators.joins import join_to_unique
from gladeline.operators.words import runs_to_words
from gladeline.session import cut_lineage

TILE_SHIFT = 10  # 1024 x 1024 cells per tile when cells are pruned
MOST_TILES = 100_000  # tiles of a region that are broadcast, 16 bytes each
LOSS_SINCE = 21  # loss year 21 = 2021, the first year after the forest map


def scenes_between(scenes: DataFrame, start: str, end: str) -> DataFrame:
    """Scenes acquired in ``[start, end)``; the comparison reaches the file scan."""
    at = F.col("acquired_at")
    return scenes.filter((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz")))


def band(cells: DataFrame, name: str) -> DataFrame:
    """One band; cells where it is masked are left out."""
    return cells.select("row", "col", name).filter(F.col(name).isNotNull())


def threshold(cells: DataFrame, name: str, t: float) -> DataFrame:
    """Cells whose band is strictly above ``t``; masked cells drop."""
    return cells.filter(F.col(name) > F.lit(t))


def mosaic(scenes: DataFrame, order_cols: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """One value per cell and band: the last valid value by ``order_cols`` wins; a masked one hides nothing.

    An aggregate rather than a ranked window, so a cell that many scenes cover shrinks before the shuffle. One
    numeric or time column as the order keeps it a hash aggregate; several columns make it sort.
    """
    order = F.col(order_cols[0]) if len(order_cols) == 1 else F.struct(*order_cols)
    last = [F.max_by(b, F.when(F.col(b).isNotNull(), order)).alias(b) for b in bands]
    return scenes.groupBy("row", "col").agg(*last)


def clip(cells: DataFrame, region_runs: DataFrame, pruned: bool = True) -> DataFrame:
    """Cells inside a region given as runs ``(row, col_lo, col_hi)``.

    The region becomes one bit word per 64 columns, so every cell meets at most one region row. Cells far from
    the region are left out before they are shuffled, for a pass over the runs; cells that ``read_touching`` took
    from a tiled raster need no such pass (``pruned=False``).
    """
    region = runs_to_words(region_runs, []).select("row", "word", F.col("bits").alias("region_bits"))
    inside = has_bit(F.col("region_bits"), low_bits(F.col("col"), WORD_SHIFT))
    near = prune(cells, region_runs) if pruned else cells
    marked = near.withColumn("word", word_of(F.col("col")))
    return join_to_unique(marked, region, ["row", "word"]).filter(inside).select(*cells.columns)


def clip_box(cells: DataFrame, row_lo: int, row_hi: int, col_lo: int, col_hi: int) -> DataFrame:
    """Cells inside a box; four constants that reach the file scan."""
    return cells.filter(F.col("row").between(row_lo, row_hi) & F.col("col").between(col_lo, col_hi))


def prune(cells: DataFrame, runs: DataFrame, most_tiles: int = MOST_TILES) -> DataFrame:
    """Cells that may meet the runs ``(row, col_lo, col_hi)``; the others are dropped without a shuffle.

    The box around all runs reaches the file scan as four constants. The tiles that the runs touch are counted and
    broadcast up to ``most_tiles`` (16 bytes each); with more of them the box alone prunes. Either way a join with
    the runs themselves has to follow.
    """
    row, lo, hi = (F.col(c).cast("long") for c in ("row", "col_lo", "col_hi"))
    tile = F.explode(F.sequence(F.shiftright(lo, TILE_SHIFT), F.shiftright(hi, TILE_SHIFT)))
    spans = runs.select(row.alias("row"), lo.alias("lo"), hi.alias("hi"), tile.alias("__tcol")).withColumn(
        "__trow", F.shiftright("row", TILE_SHIFT)
    )
    tiles = cut_lineage(spans.groupBy("__trow", "__tcol").agg(
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("lo").alias("c0"), F.max("hi").alias("c1")
    ))
    box = tiles.agg(F.count(F.lit(1)).alias("n"), F.min("r0"), F.max("r1"), F.min("c0"), F.max("c1")).first()
    if box["n"] == 0:
        return cells.filter(F.lit(False))
    inside = clip_box(cells, *box[1:])
    if box["n"] > most_tiles:
        return inside
    placed = inside.withColumns({
        "__trow": F.shiftright(F.col("row").cast("long"), TILE_SHIFT), "__tcol": F.shiftright(F.col("col").cast("long"), TILE_SHIFT)
    })
    touched = tiles.select("__trow", "__tcol")
    return placed.join(F.broadcast(touched), ["__trow", "__tcol"], "left_semi").select(*cells.columns)


def is_loss(since: int = LOSS_SINCE) -> Column:
    """Lost since year ``since`` on land that was forest; NULL bands count as no loss."""
    return F.coalesce((F.col("lossyear") >= F.lit(since)) & (F.col("forest2020") == F.lit(1)), F.lit(False))


def loss_mask(cells: DataFrame, since: int = LOSS_SINCE) -> DataFrame:
    return cells.withColumn("loss", is_loss(since))


def with_bands(cells: DataFrame, **exprs: Column) -> DataFrame:
    """Add computed bands. Masks stay per band: a NULL in one band leaves the others alone."""
    return cells.withColumns(dict(exprs))


def loss_area_bands(cells: DataFrame, since: int = LOSS_SINCE) -> DataFrame:
    """The two bands summed per parcel: lost area and total area."""
    area = F.col("area_m2")
    return with_bands(cells, defo_m2=F.when(is_loss(since), area).otherwise(F.lit(0.0)), total_m2=area)


def resample(cells: DataFrame, k: int, aggs: Mapping[str, str]) -> DataFrame:
    """Bands on cells ``k`` times as wide; ``aggs`` maps a band to an aggregate such as ``avg`` or ``sum``."""
    coarse = [F.call_function(fn, F.col(b)).alias(b) for b, fn in aggs.items()]
    return cells.groupBy(
        F.floor(F.col("row") / F.lit(k)).cast("long").alias("row"),
        F.floor(F.col("col") / F.lit(k)).cast("long").alias("col"),
    ).agg(*coarse)
