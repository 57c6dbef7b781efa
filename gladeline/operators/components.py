"""8-connected clusters of a mask, and parcels made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.operators.footprints import aoi_box, centroid
from gladeline.operators.graph import collapse
from gladeline.operators.ordering import number_rows
from gladeline.operators.words import cells_to_words, merge_pieces, words_to_pieces
from gladeline.session import cut_lineage

MIN_PIXELS = 50  # 0.5 ha at 10 m
MAX_PIXELS = 8500  # 85 ha at 10 m
HECTARES_PER_PIXEL = 0.01  # 10 m cells
ROW_SHIFT = 31


def component_runs(mask: DataFrame) -> DataFrame:
    """Label the cells ``(row, col)`` of a mask: ``comp_id, row, col_lo, col_hi`` run pieces.

    ``comp_id`` is the smallest run id of the cluster, ``row << 31 | col`` of its first cell in raster order.
    Pieces end at word borders, so each lies in one word, and neighbours are found by joining on
    ``(row, word)``: a word holds at most 32 pieces, so the join stays linear however dense the mask.
    """
    pieces = cut_lineage(_numbered_pieces(mask))
    home = collapse(_touching(pieces))
    return pieces.join(home, "id", "left").select(F.coalesce("home", "id").alias("comp_id"), "row", "col_lo", "col_hi")


def connected_components(mask: DataFrame) -> DataFrame:
    """One row per cell: ``row, col, comp_id``."""
    runs = component_runs(mask)
    return runs.select("row", F.explode(F.sequence("col_lo", "col_hi")).alias("col"), "comp_id")


def _numbered_pieces(mask: DataFrame) -> DataFrame:
    words = cells_to_words(mask, bits=F.lit(True))
    run_id = F.shiftleft(F.col("row"), ROW_SHIFT).bitwiseOR(F.col("col_lo"))
    return words_to_pieces(words, []).withColumn("id", run_id)


def _touching(pieces: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of neighbouring pieces, ``a > b``.

    Each piece looks at the words its own widened columns touch in the row above, and left in its own row.
    """
    word_lo = F.shiftright(F.col("col_lo") - 1, 6)
    word_hi = F.shiftright(F.col("col_hi") + 1, 6)
    above = pieces.select(
        F.col("id").alias("a"), (F.col("row") - 1).alias("row"), F.col("col_lo").alias("lo"), F.col("col_hi").alias("hi"),
        F.explode(F.sequence(word_lo, word_hi)).alias("word"),
    )
    left = pieces.filter(F.col("col_lo") % 64 == 0).select(
        F.col("id").alias("a"), "row", F.col("col_lo").alias("lo"), F.col("col_lo").alias("hi"), word_lo.alias("word")
    )
    other = pieces.select(
        F.col("id").alias("b"), "row", F.shiftright(F.col("col_lo"), 6).alias("word"),
        F.col("col_lo").alias("o_lo"), F.col("col_hi").alias("o_hi"),
    )
    near = (F.col("o_lo") <= F.col("hi") + 1) & (F.col("o_hi") >= F.col("lo") - 1)
    return above.unionByName(left).join(other, ["row", "word"]).filter(near).select("a", "b")


def component_size(runs: DataFrame) -> DataFrame:
    """``comp_id, n_cells``."""
    return runs.groupBy("comp_id").agg(F.sum(F.col("col_hi") - F.col("col_lo") + 1).alias("n_cells"))


def component_area_km2(runs: DataFrame, cell_area_m2) -> DataFrame:
    """``comp_id, area_km2``; ``cell_area_m2`` is a column expression of the row."""
    cells = F.col("col_hi") - F.col("col_lo") + 1
    return runs.groupBy("comp_id").agg((F.sum(cells * cell_area_m2) / F.lit(1e6)).alias("area_km2"))


def largest_component(areas: DataFrame) -> DataFrame:
    return areas.orderBy(F.col("area_km2").desc(), "comp_id").limit(1)


def filter_size(sizes: DataFrame, lo: int = MIN_PIXELS, hi: int = MAX_PIXELS) -> DataFrame:
    """Clusters of ``lo`` to ``hi`` cells, both included."""
    return sizes.filter(F.col("n_cells").between(lo, hi))


def assign_farm_id(components: DataFrame) -> DataFrame:
    """Sequential ``farm_id`` from 0 in the order of ``comp_id``."""
    return number_rows(components, [F.col("comp_id")], "farm_id")


def area_ha(n_cells):
    """Hectares from a cell count."""
    return n_cells * F.lit(HECTARES_PER_PIXEL)


def parcels(mask: DataFrame, lo: int = MIN_PIXELS, hi: int = MAX_PIXELS) -> tuple[DataFrame, DataFrame]:
    """Parcels of a crop mask: ``farms(farm_id, comp_id, n_cells, area_ha)`` and ``farm_runs``."""
    runs = cut_lineage(component_runs(mask))
    farms = assign_farm_id(filter_size(component_size(runs), lo, hi))
    farms = cut_lineage(farms.withColumn("area_ha", area_ha(F.col("n_cells"))))
    pieces = runs.join(farms.select("comp_id", "farm_id"), "comp_id").select("farm_id", "row", "col_lo", "col_hi")
    return farms, merge_pieces(pieces, ["farm_id"])


def study_area(coarse_mask: DataFrame, cell_area_m2, radius: float, k: int = 1) -> tuple[int, int, int, int] | None:
    """Box of ``radius`` fine cells around the exact centroid of the largest cluster of cells ``k`` times as wide.

    ``row_lo, row_hi, col_lo, col_hi`` in fine cells, both ends included. The four numbers come to the driver, so
    the clip that follows is a filter with constants.
    """
    runs = cut_lineage(component_runs(coarse_mask))
    largest = largest_component(component_area_km2(runs, cell_area_m2)).first()
    if largest is None:
        return None
    point = centroid(runs.filter(F.col("comp_id") == F.lit(largest["comp_id"])), "comp_id")
    return tuple(aoi_box(point, radius, k).first())
