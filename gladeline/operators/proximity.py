"""Distance from parcel centroids to the nearest loss cell.

Loss cells are packed level by level: 8 x 8 cells into a BIGINT *block*, 8 x 8 blocks into a BIGINT *sheet*
saying which blocks hold any loss, and, for a wide radius, 8 x 8 sheets into a *page*, and so on. A point probes
the widest squares, of which its radius touches 25 at most, keeps the squares inside them that can beat the best
upper bound, opens those, prunes again, and measures cells only in the few blocks left. So the work per point is
bounded however many loss cells lie around it, only squares that can still win are shuffled, and the raster side of
every join has one row per key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gladeline.functions.numbers import cap_distance
from gladeline.grid import BLOCK_SHIFT, bit_range, block_of, has_bit, low_bits, one_bit, without
from gladeline.operators.joins import join_to_unique
from gladeline.operators.raster import prune
from gladeline.session import cut_lineage

BLOCK = 1 << BLOCK_SHIFT  # cells along a block
MOST_STEPS = 3  # widest squares that a radius reaches from one end to the other
CAP_PX = 256  # search radius in cells


def loss_blocks(loss: DataFrame) -> DataFrame:
    """Loss cells ``(row, col)`` as ``(brow, bcol, bits)``."""
    return loss.groupBy(block_of(F.col("row")).alias("brow"), block_of(F.col("col")).alias("bcol")).agg(
        F.bit_or(one_bit(_place(F.col("row"), F.col("col")))).alias("bits")
    )


def _packed(squares: DataFrame) -> DataFrame:
    """Squares ``(row, col)`` as bits of the squares 8 times as wide, ``(row, col, bits)``."""
    row, col = F.col("row"), F.col("col")
    return squares.groupBy(block_of(row).alias("row"), block_of(col).alias("col")).agg(F.bit_or(one_bit(_place(row, col))).alias("bits"))


def own_blocks(farm_runs: DataFrame) -> DataFrame:
    """Footprints as ``(farm_id, brow, bcol, own)``."""
    lo, hi = F.col("col_lo").cast("long"), F.col("col_hi").cast("long")
    bcol = F.col("bcol")
    pieces = farm_runs.withColumn("bcol", F.explode(F.sequence(block_of(lo), block_of(hi))))
    first = F.greatest(lo, F.shiftleft(bcol, BLOCK_SHIFT))
    last = F.least(hi, F.shiftleft(bcol, BLOCK_SHIFT) + (BLOCK - 1))
    base = low_bits(F.col("row"), BLOCK_SHIFT) * BLOCK
    bits = bit_range(base + low_bits(first, BLOCK_SHIFT), base + low_bits(last, BLOCK_SHIFT))
    return pieces.groupBy("farm_id", block_of(F.col("row")).alias("brow"), "bcol").agg(F.bit_or(bits).alias("own"))


def own_loss_blocks(farm_runs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks where a parcel has loss of its own, ``(farm_id, brow, bcol, left)``: the loss left without it."""
    return (
        join_to_unique(own_blocks(farm_runs), blocks, ["brow", "bcol"])
        .filter(F.col("bits").bitwiseAND(F.col("own")) != 0)
        .select("farm_id", "brow", "bcol", without(F.col("bits"), F.col("own")).alias("left"))
    )


def _place(row: Column, col: Column) -> Column:
    """Bit position of a cell in its block, or of a block in its sheet."""
    return low_bits(row, BLOCK_SHIFT) * BLOCK + low_bits(col, BLOCK_SHIFT)


def _nearest2(first_row: Column, first_col: Column, size: int) -> Column:
    """Squared cell distance from the point to the closest cell of a square."""
    dr = F.greatest(first_row - F.col("prow"), F.col("prow") - (first_row + (size - 1)), F.lit(0))
    dc = F.greatest(first_col - F.col("pcol"), F.col("pcol") - (first_col + (size - 1)), F.lit(0))
    return dr * dr + dc * dc


def _least_farthest2(bits, prow, pcol, row, col, size: int) -> np.ndarray:
    """Per row, the least squared cell distance to the farthest cell of one of the squares of ``size`` cells whose bits are set; no bit gives the largest BIGINT."""
    def ends(at, first):
        starts = [((first << BLOCK_SHIFT) + i) * size for i in range(BLOCK)]
        return [np.maximum(np.abs(at - s), np.abs(at - (s + size - 1))) ** 2 for s in starts]

    rows, cols = ends(prow, row), ends(pcol, col)
    best = np.full(len(bits), np.iinfo(np.int64).max)
    for i in range(BLOCK * BLOCK):
        held = (bits >> i) & 1 == 1
        np.minimum(best, rows[i >> BLOCK_SHIFT] + cols[i & (BLOCK - 1)], out=best, where=held)
    return best


def _opened(squares: DataFrame, size: int, cap2: int) -> DataFrame:
    """The squares of ``size`` cells inside those of ``bits`` that can hold the nearest cell: ``farm_id, prow, pcol, row, col``.

    None closer than the best certain distance is lost. That distance is found before the squares become rows, so the
    window sorts a row per wider square, of which a point has few.
    """
    places = F.sequence(F.lit(0), F.lit(BLOCK * BLOCK - 1))

    def inner(axis: str, place: Column) -> Column:
        part = F.shiftright(place, BLOCK_SHIFT) if axis == "row" else low_bits(place, BLOCK_SHIFT)
        return F.shiftleft(F.col(axis), BLOCK_SHIFT) + part

    def corner(place: Column) -> tuple[Column, Column]:
        return inner("row", place) * size, inner("col", place) * size

    @F.arrow_udf("long")
    def certain(bits: pa.Array, *ends: pa.Array) -> pa.Array:
        return pa.array(_least_farthest2(bits.to_numpy(), *[e.to_numpy() for e in ends], size))

    best2, place = F.min("certain").over(Window.partitionBy("farm_id")), F.col("place")
    return (
        squares.withColumn("certain", certain("bits", "prow", "pcol", "row", "col"))
        .withColumn("best2", F.least(best2, F.lit(cap2)))
        .withColumn("place", F.explode(places))
        .filter(has_bit(F.col("bits"), place) & (_nearest2(*corner(place), size) <= F.col("best2")))
        .select("farm_id", "prow", "pcol", inner("row", place).alias("row"), inner("col", place).alias("col"))
    )


def _left_by_level(touched: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """Per level, the squares that a parcel's own loss changes and what is left in them, ``farm_id, row, col, left``."""
    row, col = F.col("row"), F.col("col")
    out = [touched.select("farm_id", F.col("brow").alias("row"), F.col("bcol").alias("col"), "left")]
    for level in levels[1:]:
        emptied = (
            out[-1].filter(F.col("left") == 0)
            .groupBy("farm_id", block_of(row).alias("row"), block_of(col).alias("col"))
            .agg(F.bit_or(one_bit(_place(row, col))).alias("emptied"))
        )
        left = without(F.col("bits"), F.col("emptied")).alias("left")
        out.append(join_to_unique(emptied, level, ["row", "col"]).select("farm_id", "row", "col", left))
    return out


def nearest_loss(
    points: DataFrame, loss: DataFrame, cap_px: float = CAP_PX, exclude: DataFrame | None = None, blocks: DataFrame | None = None,
) -> DataFrame:
    """``farm_id, dist_px``: cells to the nearest loss cell, NULL when none is within ``cap_px``.

    ``points`` has ``farm_id, crow, ccol``, one row per parcel. With ``exclude`` (footprint runs) the parcel's
    own cells do not count; all parcels still run in this one job. ``blocks`` are the :func:`loss_blocks` of
    ``loss``, for callers that need them more than once.
    """
    cap2 = math.floor(cap_px * cap_px)
    reach = math.floor(cap_px)
    blocks = loss_blocks(loss) if blocks is None else blocks
    at = points.select(
        "farm_id", F.col("crow").cast("long").alias("prow"), F.col("ccol").cast("long").alias("pcol")
    )

    levels, shift = [blocks.select(F.col("brow").alias("row"), F.col("bcol").alias("col"), "bits")], BLOCK_SHIFT
    while len(levels) < 2 or 2 * reach >> shift > MOST_STEPS:
        levels.append(_packed(levels[-1]))
        shift += BLOCK_SHIFT
    own = None if exclude is None else _left_by_level(own_loss_blocks(exclude, blocks), levels)

    def span(center: Column) -> Column:
        return F.explode(F.sequence(F.shiftright(center - reach, shift), F.shiftright(center + reach, shift)))

    found = at.withColumn("row", span(F.col("prow"))).withColumn("col", span(F.col("pcol")))
    found = found.filter(_nearest2(F.shiftleft("row", shift), F.shiftleft("col", shift), 1 << shift) <= cap2)
    for number, level in reversed(list(enumerate(levels))):
        found = join_to_unique(found, level, ["row", "col"])
        if own is not None:
            found = found.join(own[number], ["farm_id", "row", "col"], "left").withColumn("bits", F.coalesce("left", "bits")).drop("left")
            found = found.filter(F.col("bits") != 0)
        if number:
            found = _opened(found, 1 << number * BLOCK_SHIFT, cap2)

    place = F.col("place")
    dr = F.shiftleft("row", BLOCK_SHIFT) + F.shiftright(place, BLOCK_SHIFT) - F.col("prow")
    dc = F.shiftleft("col", BLOCK_SHIFT) + low_bits(place, BLOCK_SHIFT) - F.col("pcol")
    nearest = (
        found.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(BLOCK * BLOCK - 1))))
        .filter(has_bit(F.col("bits"), place))
        .select("farm_id", (dr * dr + dc * dc).alias("d2"))
        .filter(F.col("d2") <= cap2)
        .groupBy("farm_id")
        .agg(F.sqrt(F.min("d2").cast("double")).alias("dist_px"))
    )
    return points.select("farm_id").join(nearest, "farm_id", "left")


def distance_feature(
    points: DataFrame, loss: DataFrame, cell_m: float = 10.0, cap_m: float = 2560.0,
    exclude: DataFrame | None = None, name: str = "dist_to_defo_m", blocks: DataFrame | None = None,
) -> DataFrame:
    """``farm_id, <name>`` in metres, capped, 1 decimal."""
    found = nearest_loss(points, loss, cap_m / cell_m, exclude, blocks)
    return found.select("farm_id", cap_distance(F.col("dist_px"), cell_m, cap_m).alias(name))


def both_distances(
    points: DataFrame, loss: DataFrame, farm_runs: DataFrame, cell_m: float = 10.0, cap_m: float = 2560.0
) -> DataFrame:
    """``farm_id, dist_to_defo_m, dist_to_defo_m_masked``.

    Only parcels with loss of their own are measured a second time; for the others both distances agree. The blocks
    of loss are stored once for the three uses.
    """
    blocks = cut_lineage(loss_blocks(loss))
    plain = distance_feature(points, loss, cell_m, cap_m, blocks=blocks)
    affected = own_loss_blocks(farm_runs, blocks).select("farm_id").distinct()
    redone = distance_feature(
        points.join(affected, "farm_id", "left_semi"), loss, cell_m, cap_m,
        farm_runs.join(affected, "farm_id", "left_semi"), "masked", blocks,
    )
    return plain.join(redone, "farm_id", "left").select(
        "farm_id", "dist_to_defo_m", F.coalesce("masked", "dist_to_defo_m").alias("dist_to_defo_m_masked")
    )


def point_runs(points: DataFrame) -> DataFrame:
    """The cell of every point as a run ``(row, col_lo, col_hi)``."""
    return points.select(F.col("crow").alias("row"), F.col("ccol").alias("col_lo"), F.col("ccol").alias("col_hi"))


def sample_at(points: DataFrame, cells: DataFrame, name: str, pruned: bool = True) -> DataFrame:
    """``farm_id, <band>``: the band at the centroid cell, NULL where it is masked.

    Only raster cells in the tiles of the points are shuffled; ``pruned=False`` where the cells are such already.
    """
    near = prune(cells, point_runs(points)) if pruned else cells
    values = near.select(F.col("row").cast("long").alias("crow"), F.col("col").cast("long").alias("ccol"), name)
    at = points.select("farm_id", "crow", "ccol")
    return join_to_unique(at, values, ["crow", "ccol"], "left").select("farm_id", name)


def erase_own(loss: DataFrame, farm_runs: DataFrame, farm_id: int) -> DataFrame:
    """The loss mask without one parcel's cells.

    The parcel is one small footprint, so its cells are listed and anti-joined on ``(row, col)``.
    """
    own = farm_runs.filter(F.col("farm_id") == farm_id).select(
        "row", F.explode(F.sequence(F.col("col_lo"), F.col("col_hi"))).alias("col")
    )
    return loss.join(own, ["row", "col"], "left_anti")


def masked_distance(
    shares: DataFrame, distances: DataFrame, points: DataFrame, loss: DataFrame, farm_runs: DataFrame,
    cell_m: float = 10.0, cap_m: float = 2560.0,
) -> DataFrame:
    """``farm_id, dist_to_defo_m_masked``: clean parcels keep their distance, affected ones lose their own cells."""
    kept = distances.join(shares.filter(F.col("defo_pct") == 0).select("farm_id"), "farm_id", "left_semi").select(
        "farm_id", F.col("dist_to_defo_m").alias("dist_to_defo_m_masked")
    )
    affected = shares.filter(F.col("defo_pct") > 0).select("farm_id")
    redone = distance_feature(
        points.join(affected, "farm_id", "left_semi"), loss, cell_m, cap_m,
        farm_runs.join(affected, "farm_id", "left_semi"), "dist_to_defo_m_masked",
    )
    return kept.unionByName(redone)
