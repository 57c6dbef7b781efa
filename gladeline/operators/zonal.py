"""Sums of raster bands over parcels and over rings around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gladeline.functions.numbers import share_pct
from gladeline.grid import WORD_SHIFT, GridSpec, bit_range, low_bits, one_bit, run_bits_in_word, without, word_of
from gladeline.operators.footprints import reaching_pieces
from gladeline.operators.joins import join_to_unique
from gladeline.operators.raster import LOSS_SINCE, is_loss, prune
from gladeline.operators.words import cells_to_words, explode_words, runs_to_words
from gladeline.session import cut_lineage

TILE_ROWS, TILE_WORDS = 6, 2  # 64 rows of 4 words where buffers meet the raster
SPREAD = 8  # copies of a tile, so that many parcels on one spot are many tasks' work
PART_MARKS = 500_000  # words of buffers merged by a task: under 300 MB in hash maps


def _all_ids(farm_runs: DataFrame, parcels: DataFrame | None, id_col: str) -> DataFrame:
    """The ids that get a row: those of the parcel table, which may hold parcels too small to own a cell."""
    return (farm_runs if parcels is None else parcels).select(id_col).distinct()


def packed_words(cells: DataFrame, bands: Sequence[str]) -> DataFrame:
    """``row, word, cells, <band>...``: a bit per valid cell, and the bands' values in the order of the columns."""
    row, col = F.col("row").cast("long").alias("row"), F.col("col").cast("long")
    values = F.struct(col.alias("col"), *[F.col(b).cast("double").alias(b) for b in bands])
    whole = cells.groupBy(row, word_of(F.col("col")).alias("word")).agg(
        F.bit_or(one_bit(low_bits(F.col("col"), WORD_SHIFT))).alias("cells"), F.sort_array(F.collect_list(values)).alias("run")
    )
    return whole.select("row", "word", "cells", *[F.col("run")[b].alias(b) for b in bands])


def zonal_sum(
    farm_runs: DataFrame, cells: DataFrame, bands: Sequence[str], id_col: str = "farm_id", parcels: DataFrame | None = None,
    pruned: bool = True,
) -> DataFrame:
    """Sum of any numeric bands per parcel; parcels without valid cells keep a row with NULL sums.

    ``parcels`` names the parcels; without it only those that own a cell are known. A parcel's runs do not overlap.

    No footprint is taken apart into cells: a run has a part in each word of 64 columns it touches, and counting bits
    tells which of the word's values belong to it. The join has one raster row per key, and nothing is subtracted,
    so a sum is off by the rounding of its additions alone and sums of whole numbers are exact. ``pruned`` first drops
    raster cells far from all parcels, for a pass over the runs; it pays where parcels are few. For areas of masks,
    ``loss_shares`` does the same without values.
    """
    lo, hi = F.col("col_lo").cast("long"), F.col("col_hi").cast("long")
    runs = farm_runs.select(id_col, F.col("row").cast("long").alias("row"), lo.alias("col_lo"), hi.alias("col_hi"))
    parts = explode_words(runs, F.col("col_lo"), F.col("col_hi")).select(
        id_col, "row", "word", run_bits_in_word(F.col("col_lo"), F.col("col_hi"), F.col("word")).alias("part"),
        low_bits(F.greatest("col_lo", F.shiftleft("word", WORD_SHIFT)), WORD_SHIFT).alias("first"),
    )
    words = packed_words(prune(cells, farm_runs) if pruned else cells, bands)
    met = join_to_unique(parts, words, ["row", "word"])
    # valid cells before the part, and in it
    valid, first = F.col("cells"), F.col("first")
    earlier = F.when(first > 0, bit_range(F.lit(0), first - 1)).otherwise(F.lit(0).cast("long"))
    before = F.bit_count(valid.bitwiseAND(earlier)).cast("int")
    n = F.bit_count(valid.bitwiseAND(F.col("part"))).cast("int")

    def total(band: str):
        own = F.filter(F.slice(band, before + 1, n), lambda x: x.isNotNull())
        return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + x)).alias(band)

    sums = met.select(id_col, *[total(b) for b in bands]).groupBy(id_col).agg(*[F.sum(b).alias(b) for b in bands])
    return _all_ids(farm_runs, parcels, id_col).join(sums, id_col, "left")


def loss_words(cells: DataFrame, since: int = LOSS_SINCE) -> DataFrame:
    """The raster as ``(row, word, valid, loss)`` bits."""
    return cells_to_words(cells, valid=F.lit(True), loss=is_loss(since))


def _met_by_tile(farm_runs: DataFrame, raster_words: DataFrame, radii: Sequence[int], id_col: str) -> DataFrame:
    """``id, row, valid, loss, own, b_<R>...`` for the raster words that a footprint or its widest buffer may meet.

    The raster goes by tiles of 64 rows and 4 words, and outline pieces are sent to the tiles they reach. Buffers are
    widened there, beside the raster, and the overlaps of a parcel's pieces merge in place: of its thousand words none
    is shuffled or sorted. Parcels of one tile are dealt over ``SPREAD`` copies of it. The pieces are written once, as
    the words they will make are counted first: ``PART_MARKS`` of them are merged by a task at most, on average.
    """
    widest, across = max(radii), WORD_SHIFT + TILE_WORDS
    pieces = cut_lineage(reaching_pieces(farm_runs, radii, id_col))
    src, side, lo, hi, word = F.col("src_row"), F.col("side"), F.col("col_lo"), F.col("col_hi"), F.col("word")
    rows, words = F.col("last_row") - F.col("first_row") + 1, word_of(hi + widest) - word_of(lo - widest) + 1
    marks = pieces.agg(F.sum(rows * words)).first()[0] or 0
    parts = max(int(farm_runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-marks // PART_MARKS))
    tile, group = ["trow", "tcol", "copy"], [id_col, "trow", "tcol", "copy", "pos"]
    entry = F.struct(F.col("row").cast("long").alias("row"), "word", "valid", "loss")
    tiles = raster_words.select(
        F.shiftright(F.col("row").cast("long"), TILE_ROWS).alias("trow"), F.shiftright("word", TILE_WORDS).alias("tcol"), entry.alias("e")
    ).groupBy("trow", "tcol").agg(F.collect_list("e").alias("entries"))  # 256 words at most
    tiles = tiles.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).repartition(parts, *tile)
    trows = F.sequence(F.shiftright("first_row", TILE_ROWS), F.shiftright("last_row", TILE_ROWS))
    tcols = F.sequence(F.shiftright(lo - widest, across), F.shiftright(hi + widest, across))
    placed = pieces.withColumn("trow", F.explode(trows)).withColumn("tcol", F.explode(tcols))
    placed = placed.withColumn("copy", F.pmod(F.xxhash64(id_col), F.lit(SPREAD)).cast("int")).repartition(parts, *tile)
    met = placed.hint("merge").join(tiles, tile).select(*placed.columns, F.posexplode("entries").alias("pos", "e"))
    near = F.col("row").between(F.col("first_row"), F.col("last_row")) & word.between(word_of(lo - widest), word_of(hi + widest))
    met = met.select(*placed.columns, "pos", "e.*").filter(near)
    dr, zero = F.col("row") - src, F.lit(0).cast("long")

    def merged(condition: Column, widen: Column) -> Column:
        return F.bit_or(F.when(condition, run_bits_in_word(lo - widen, hi + widen, word)).otherwise(zero))

    square = {r: F.lit(r * r) - dr * dr for r in radii}
    buffers = [merged(square[r] >= 0, F.floor(F.sqrt(square[r].cast("double"))).cast("long")).alias(f"b_{r}") for r in radii]
    of_raster = [F.max("row").alias("row"), F.bit_or("valid").alias("valid"), F.bit_or("loss").alias("loss")]
    return met.groupBy(*group).agg(*of_raster, merged(dr == 0, zero).alias("own"), *buffers)


def loss_shares(
    farm_runs: DataFrame,
    raster_words: DataFrame,
    grid: GridSpec,
    radii: Sequence[int] = (),
    id_col: str = "farm_id",
    parcels: DataFrame | None = None,
) -> DataFrame:
    """Lost and total area of every parcel, and of the ring of each radius, in one pass.

    Columns: ``defo_m2, total_m2`` and, per radius in cells, ``defo_m2_<R>, total_m2_<R>``. The raster side of
    the join has one row per key, so the join never multiplies rows. Sums combine on the map side.
    """
    if radii:
        met = _met_by_tile(farm_runs, raster_words, radii, id_col)
    else:
        marks = runs_to_words(farm_runs, [id_col]).withColumnRenamed("bits", "own")
        met = join_to_unique(marks, raster_words, ["row", "word"])
    zones = {"": F.col("own")} | {f"_{r}": without(F.col(f"b_{r}"), F.col("own")) for r in radii}
    area = grid.pixel_area(F.col("row"))
    sums = []
    for suffix, bits in zones.items():
        valid = F.bit_count(bits.bitwiseAND(F.col("valid")))
        lost = F.bit_count(bits.bitwiseAND(F.col("loss")))
        sums.append(F.sum(F.when(valid > 0, lost * area)).alias(f"defo_m2{suffix}"))
        sums.append(F.sum(F.when(valid > 0, valid * area)).alias(f"total_m2{suffix}"))
    totals = met.groupBy(id_col).agg(*sums)
    return _all_ids(farm_runs, parcels, id_col).join(totals, id_col, "left")


def parcel_loss(farm_runs: DataFrame, raster_words: DataFrame, grid: GridSpec, parcels: DataFrame | None = None) -> DataFrame:
    """``farm_id, defo_m2, total_m2, defo_pct``; a row per row id of ``parcels``, if given."""
    sums = loss_shares(farm_runs, raster_words, grid, parcels=parcels)
    return sums.withColumn("defo_pct", share_pct(F.col("defo_m2"), F.col("total_m2")))


def ring_features(
    farm_runs: DataFrame, raster_words: DataFrame, grid: GridSpec, radii_m: Sequence[int] = (200, 500, 1000),
    parcels: DataFrame | None = None,
) -> DataFrame:
    """``farm_id, nb_defo_pct_<radius>...`` with radii in metres; no ring holds the parcel itself.

    With ``parcels``, those that own no cell keep a row, with NULL shares.
    """
    cells = {m: int(grid.cells(m)) for m in radii_m}
    sums = loss_shares(farm_runs, raster_words, grid, sorted(set(cells.values())), parcels=parcels)
    return sums.select(
        "farm_id",
        *[share_pct(F.col(f"defo_m2_{r}"), F.col(f"total_m2_{r}")).alias(f"nb_defo_pct_{m}") for m, r in cells.items()],
    )


def parcel_context(
    farm_runs: DataFrame, raster_words: DataFrame, grid: GridSpec, radii_m: Sequence[int] = (200, 500, 1000),
    parcels: DataFrame | None = None,
) -> DataFrame:
    """Own loss and ring shares together: one dilation, one join, one aggregate. ``parcels`` as in :func:`ring_features`."""
    cells = {m: int(grid.cells(m)) for m in radii_m}
    sums = loss_shares(farm_runs, raster_words, grid, sorted(set(cells.values())), parcels=parcels)
    return sums.select(
        "farm_id", "defo_m2", "total_m2",
        share_pct(F.col("defo_m2"), F.col("total_m2")).alias("defo_pct"),
        *[share_pct(F.col(f"defo_m2_{r}"), F.col(f"total_m2_{r}")).alias(f"nb_defo_pct_{m}") for m, r in cells.items()],
    )
