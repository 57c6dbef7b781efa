"""Parcel footprints as runs: buffers, rings, centroids, and polygons to runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gladeline.grid import GridSpec, run_bits_in_word, without
from gladeline.operators.words import explode_words, runs_to_words, words_to_pieces, words_to_runs


BAND_SHIFT = 10  # 1024 raster rows per band
TILE_SHIFT = 10  # columns of a tile: whole words, wider than most parcels


def _sources(farm_runs: DataFrame, id_col: str) -> DataFrame:
    """Run pieces that can shape a buffer: ``(id, side, src_row, col_lo, col_hi)``.

    Seen from a row above, a cell counts only if the cell over it is not in the footprint, since that one would
    be closer; the same holds below. So the upper outline (``side`` -1) reaches up, the lower outline (1)
    reaches down, and whole rows (0) only widen in place.
    """
    words = runs_to_words(farm_runs, [id_col])
    down = Window.partitionBy(id_col, "word").orderBy("row")
    zero = F.lit(0).cast("long")
    bits, row = F.col("bits"), F.col("row")
    over = F.when(F.lag("row").over(down) == row - 1, F.lag("bits").over(down)).otherwise(zero)
    under = F.when(F.lead("row").over(down) == row + 1, F.lead("bits").over(down)).otherwise(zero)

    def part(side: int, mask):
        return F.struct(F.lit(side).alias("side"), mask.alias("bits"))

    parts = F.array(part(-1, without(bits, F.col("over"))), part(0, bits), part(1, without(bits, F.col("under"))))
    sided = (
        words.withColumns({"over": over, "under": under})
        .select(id_col, "row", "word", F.explode(parts).alias("part"))
        .select(id_col, "row", "word", "part.side", "part.bits")
    )
    return words_to_pieces(sided, [id_col, "side"]).withColumnRenamed("row", "src_row")


def reaching_pieces(farm_runs: DataFrame, radii: Sequence[int], id_col: str = "farm_id") -> DataFrame:
    """The pieces that shape the buffers, ``(id, side, src_row, col_lo, col_hi, first_row, last_row)``.

    ``first_row`` and ``last_row`` are the rows that a piece reaches with the widest radius: upwards from the upper
    outline (``side`` -1), downwards from the lower one (1), its own row otherwise (0).
    """
    if min(radii) < 1:
        raise ValueError("a buffer radius must be at least one cell")
    src, side, widest = F.col("src_row"), F.col("side"), max(radii)
    return _sources(farm_runs, id_col).withColumns({
        "first_row": F.when(side < 0, src - widest).otherwise(src), "last_row": F.when(side > 0, src + widest).otherwise(src),
    })


def dilate(farm_runs: DataFrame, radii: Sequence[int], id_col: str = "farm_id") -> DataFrame:
    """Footprint and its buffers as words: ``(id, row, word, own, b_<R>...)``, radii in cells.

    A cell belongs to ``b_R`` when some own cell is within ``R`` cells of it, centre to centre. Outline pieces
    are widened row by row up to the largest radius, all radii in one pass, and ``bit_or`` merges the overlaps.

    Pieces are shuffled before they are widened, not after: one piece becomes hundreds of words. They are
    placed by parcel, band of target rows and tile of target columns (a piece near a border goes to both sides),
    so the merge needs no second shuffle and a parcel of any height or width is spread over its tiles.
    """
    if min(radii) < 1:
        raise ValueError("a buffer radius must be at least one cell")
    widest = max(radii)
    dr, word, band, src, side = F.col("dr"), F.col("word"), F.col("band"), F.col("src_row"), F.col("side")
    square = {r: F.lit(r * r) - dr * dr for r in radii}
    half = {r: F.floor(F.sqrt(square[r].cast("double"))).cast("long") for r in radii}
    zero = F.lit(0).cast("long")
    # a fixed number of partitions: the work after this shuffle is far larger than its bytes suggest
    parts = int(farm_runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach_up = F.when(side < 0, F.lit(-widest)).otherwise(side)
    reach_down = F.when(side > 0, F.lit(widest)).otherwise(side)
    bands = F.sequence(F.shiftright(src + reach_up, BAND_SHIFT), F.shiftright(src + reach_down, BAND_SHIFT))
    tiles = F.sequence(F.shiftright(F.col("col_lo") - widest, TILE_SHIFT), F.shiftright(F.col("col_hi") + widest, TILE_SHIFT))
    placed = _sources(farm_runs, id_col).withColumn("band", F.explode(bands)).withColumn("tile", F.explode(tiles))
    placed = placed.repartition(parts, id_col, "band", "tile")
    first = F.greatest(reach_up, F.shiftleft(band, BAND_SHIFT) - src)
    last = F.least(reach_down, F.shiftleft(band, BAND_SHIFT) + F.lit((1 << BAND_SHIFT) - 1) - src)
    spread = placed.withColumn("dr", F.explode(F.sequence(first, last))).withColumn("reach", half[widest])
    tile_start = F.shiftleft(F.col("tile"), TILE_SHIFT)
    spread = spread.withColumns({
        "first_col": F.greatest(F.col("col_lo") - F.col("reach"), tile_start),
        "last_col": F.least(F.col("col_hi") + F.col("reach"), tile_start + F.lit((1 << TILE_SHIFT) - 1)),
    })
    pieces = explode_words(spread.filter("first_col <= last_col"), F.col("first_col"), F.col("last_col"))

    def marks(condition, widen):
        bits = run_bits_in_word(F.col("col_lo") - widen, F.col("col_hi") + widen, word)
        return F.bit_or(F.when(condition, bits).otherwise(zero))

    own = marks(dr == F.lit(0), F.lit(0)).alias("own")
    buffers = [marks(square[r] >= F.lit(0), half[r]).alias(f"b_{r}") for r in radii]
    return pieces.groupBy(id_col, "band", "tile", (src + dr).alias("row"), "word").agg(own, *buffers).drop("band", "tile")


def buffer_runs(farm_runs: DataFrame, r_cells: int, id_col: str = "farm_id") -> DataFrame:
    """The footprint widened by ``r_cells``, as runs."""
    words = dilate(farm_runs, [r_cells], id_col).select(id_col, "row", "word", F.col(f"b_{r_cells}").alias("bits"))
    return words_to_runs(words, [id_col])


def ring_runs(farm_runs: DataFrame, r_cells: int, id_col: str = "farm_id") -> DataFrame:
    """The buffer without the footprint, as runs."""
    ring = without(F.col(f"b_{r_cells}"), F.col("own")).alias("bits")
    words = dilate(farm_runs, [r_cells], id_col).select(id_col, "row", "word", ring)
    return words_to_runs(words, [id_col])


def centroid(runs: DataFrame, id_col: str = "farm_id") -> DataFrame:
    """Mean cell position, and the cell ``(crow, ccol)`` it falls in.

    Cell ``i`` covers ``[i - 0.5, i + 0.5)`` around its centre. All sums are integers, so no rounding error
    can move a centroid to the next cell.
    """
    n = F.col("col_hi").cast("long") - F.col("col_lo").cast("long") + F.lit(1)
    sums = runs.groupBy(id_col).agg(
        F.sum(n).alias("n_cells"),
        F.sum(n * F.col("row")).alias("row_sum"),
        F.sum(n * (F.col("col_lo") + F.col("col_hi"))).alias("col_sum2"),
    )
    n_all, row_sum, col_sum2 = F.col("n_cells"), F.col("row_sum"), F.col("col_sum2")
    return sums.select(
        id_col,
        "n_cells",
        (row_sum / n_all).alias("row_mean"),
        (col_sum2 / (F.lit(2) * n_all)).alias("col_mean"),
        _floor_div(F.lit(2) * row_sum + n_all, F.lit(2) * n_all).alias("crow"),
        _floor_div(col_sum2 + n_all, F.lit(2) * n_all).alias("ccol"),
    )


def parcel_points(parcels: DataFrame, farm_runs: DataFrame, grid: GridSpec, id_col: str = "farm_id") -> DataFrame:
    """:func:`centroid` for every row of ``parcels(id, rings)``; one that owns no cell gets its polygon's centroid.

    ``rings`` are in metres, holes run against their outer ring. A polygon without area has the mean of its
    corners, one without corners has no place and gets NULLs. ``n_cells`` is 0 for all of these.
    """
    owned = centroid(farm_runs, id_col)
    bare = parcels.select(id_col, "rings").dropDuplicates([id_col]).join(farm_runs.select(id_col), id_col, "left_anti")
    a, b = F.col("s.a"), F.col("s.b")
    cross = a["x"] * b["y"] - b["x"] * a["y"]
    sides = F.transform("rings", lambda r: F.arrays_zip(
        F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))).alias("a"), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))).alias("b")
    ))
    sums = bare.select(id_col, F.explode_outer(F.flatten(sides)).alias("s")).groupBy(id_col).agg(
        F.sum(cross).alias("twice"),
        F.sum((a["y"] + b["y"]) * cross).alias("y_sum"), F.avg(a["y"]).alias("y_mean"),
        F.sum((a["x"] + b["x"]) * cross).alias("x_sum"), F.avg(a["x"]).alias("x_mean"),
    )

    def place(axis: str) -> Column:
        whole = F.when(F.col("twice") != 0, F.col(f"{axis}_sum") / (3 * F.col("twice"))).otherwise(F.col(f"{axis}_mean"))
        return whole / F.lit(float(grid.cell_m))

    rest = sums.select(
        id_col, F.lit(0).cast("long").alias("n_cells"), (place("y") - 0.5).alias("row_mean"), (place("x") - 0.5).alias("col_mean"),
        F.floor(place("y")).alias("crow"), F.floor(place("x")).alias("ccol"),
    )
    return owned.unionByName(rest)


def _floor_div(a, b):
    """Whole-number division rounding down, for positive ``b``."""
    return F.call_function("div", a - F.pmod(a, b), b)


def aoi_box(points: DataFrame, radius: float, k: int = 1) -> DataFrame:
    """Bounding box of a circle of ``radius`` cells around each exact centroid, both ends included.

    A cell is inside when its centre lies in ``[centroid - radius, centroid + radius)``, so the box is two radii
    wide. With ``k`` the points are on cells ``k`` times as wide as those of the box and the radius.
    """
    def span(mean: str) -> tuple:
        centre = F.col(mean) * F.lit(float(k)) + F.lit((k - 1) / 2.0)
        return F.ceil(centre - F.lit(float(radius))).cast("long"), (F.ceil(centre + F.lit(float(radius))) - 1).cast("long")

    (row_lo, row_hi), (col_lo, col_hi) = span("row_mean"), span("col_mean")
    return points.select(row_lo.alias("row_lo"), row_hi.alias("row_hi"), col_lo.alias("col_lo"), col_hi.alias("col_hi"))


def polygon_runs(farms: DataFrame, grid: GridSpec, id_col: str = "farm_id") -> DataFrame:
    """Polygon rings to runs: a cell belongs to the polygon that contains its centre.

    ``farms`` has ``rings ARRAY<ARRAY<STRUCT<x, y>>>`` in metres, holes included (even-odd rule), each ring
    closed. Edge crossings with the centre line of every raster row are sorted and paired per row of a parcel.
    """
    size = F.lit(float(grid.cell_m))
    # of a bare column Spark would first ask whether it has elements, by evaluating what it is made of (texts parsed) again
    rings = F.filter("rings", lambda ring: ring.isNotNull())
    edges = (
        farms.select(id_col, F.explode(rings).alias("ring"))
        .select(
            id_col,
            F.explode(
                F.arrays_zip(
                    F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"),
                    F.slice("ring", F.lit(2), F.size("ring") - 1).alias("b"),
                )
            ).alias("e"),
        )
        .select(
            id_col,
            (F.col("e.a.x") / size).alias("x1"), (F.col("e.a.y") / size).alias("y1"),
            (F.col("e.b.x") / size).alias("x2"), (F.col("e.b.y") / size).alias("y2"),
        )
        .filter(F.col("y1") != F.col("y2"))
    )
    first = F.ceil(F.least("y1", "y2") - F.lit(0.5)).cast("long")
    last = (F.ceil(F.greatest("y1", "y2") - F.lit(0.5)) - F.lit(1)).cast("long")
    at = F.col("row") + F.lit(0.5)
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    crossings = (
        edges.withColumn("first", first).withColumn("last", last)
        .filter(F.col("first") <= F.col("last"))
        .withColumn("row", F.explode(F.sequence("first", "last")))
        .select(id_col, "row", (F.col("x1") + (at - F.col("y1")) * slope).alias("x"))
    )
    in_row = Window.partitionBy(id_col, "row").orderBy("x")
    return (
        crossings.withColumn("place", F.row_number().over(in_row))
        .withColumn("x_next", F.lead("x").over(in_row))
        .filter(F.col("place") % 2 == 1)
        .select(
            id_col, "row",
            F.ceil(F.col("x") - F.lit(0.5)).cast("long").alias("col_lo"),
            (F.ceil(F.col("x_next") - F.lit(0.5)) - F.lit(1)).cast("long").alias("col_hi"),
        )
        .filter(F.col("col_lo") <= F.col("col_hi"))
    )
