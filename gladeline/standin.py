"""Stand-in raster and parcels derived from the given tables.

Every line item is one scene pixel, every customer one rectangular parcel; the grid side grows with the
data, so the density of cells, loss and parcels stays the same at every scale.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gladeline.functions.labels import risk_class
from gladeline.grid import GridSpec
from gladeline.operators.components import area_ha
from gladeline.operators.footprints import centroid
from gladeline.operators.raster import is_loss, mosaic, threshold
from gladeline.operators.zonal import loss_words, parcel_context

GRID = GridSpec(10.0)
RADII_M = (20, 50, 100)
CAP_M = 150.0
SIZE = (3, 8)
CROP_T = 0.3
AS_OF = "2026-01-01 00:00:00"
ORDER = ("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
BANDS = ("crop_prob", "forest2020", "lossyear", "area_m2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_side(spark: SparkSession, sf_dir: str) -> int:
    """Side of the square grid; the row count comes from the file footers."""
    return math.ceil(math.sqrt(table(spark, sf_dir, "lineitem").count()))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.lit(grid_side(spark, sf_dir)).cast("long")
    lost = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % g).alias("row"),
        ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % g).alias("col"),
        F.col("l_shipdate").alias("acquired_at"),
        (F.greatest(F.lit(0.0), F.round(F.col("l_discount") * 100) - 6) / 8.0).alias("crop_prob"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("forest2020"),
        F.when(lost, F.year("l_shipdate") - 1978).otherwise(0).alias("lossyear"),
        F.lit(100.0).alias("area_m2"),
        *ORDER,
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mosaic(scenes(spark, sf_dir), ORDER, BANDS)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.lit(grid_side(spark, sf_dir) - 8).cast("long")
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    return table(spark, sf_dir, "customer").select(
        key.alias("farm_id"),
        ((key * 37) % span).alias("r0"),
        ((key * 101 + nation * 13) % span).alias("c0"),
        (2 + nation % 7).alias("height"),
        (2 + key % 5).alias("width"),
    )


def farm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last_row = F.col("r0") + F.col("height") - 1
    return boxes(spark, sf_dir).select(
        "farm_id", F.explode(F.sequence("r0", last_row)).alias("row"),
        F.col("c0").alias("col_lo"), (F.col("c0") + F.col("width") - 1).alias("col_hi"),
    )


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel polygons as closed rings in metres."""
    m = F.lit(GRID.cell_m)
    x1, y1 = F.col("c0") * m, F.col("r0") * m
    x2, y2 = (F.col("c0") + F.col("width")) * m, (F.col("r0") + F.col("height")) * m

    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))
    return boxes(spark, sf_dir).select("farm_id", F.array(ring).alias("rings"))


def farms(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.lit(GRID.cell_m)
    x1, y1 = F.col("c0") * m, F.col("r0") * m
    x2, y2 = (F.col("c0") + F.col("width")) * m, (F.col("r0") + F.col("height")) * m
    corners = [(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]
    ring = F.array(*[F.array(x, y) for x, y in corners])
    n_cells = F.col("height") * F.col("width")
    return boxes(spark, sf_dir).select(
        "farm_id", area_ha(n_cells).alias("area_ha"), n_cells.alias("n_cells"), F.lit("cocoa").alias("commodity"),
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))).alias("geometry"),
    )


def shares(spark: SparkSession, sf_dir: str, raster: DataFrame | None = None, radii_m=RADII_M) -> DataFrame:
    """Own loss and ring shares per parcel."""
    raster = cells(spark, sf_dir) if raster is None else raster
    return parcel_context(farm_runs(spark, sf_dir), loss_words(raster), GRID, radii_m)


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature per region: a square with a hole, and a triangle."""
    a = F.lit(grid_side(spark, sf_dir) // 10).cast("long")
    k = F.col("r_regionkey").cast("long")

    def ring(*corners):
        return F.array(*[F.array((F.lit(x) * GRID.cell_m).cast("double"), (F.lit(y) * GRID.cell_m).cast("double"))
                         for x, y in (*corners, corners[0])])

    square = ring((a, a), (a * 5, a), (a * 5, a * 5), (a, a * 5))
    hole = ring((a * 2, a * 2), (a * 2, a * 3 + k), (a * 4, a * 3 + k), (a * 4, a * 2))
    leg = a * 3 + 0.25
    triangle = ring((a * 6, a * 6 + k), (a * 6 + leg, a * 6 + k), (a * 6, a * 6 + k + leg))
    parts = F.array(F.array(square, hole), F.array(triangle))
    return table(spark, sf_dir, "region").select(
        F.col("r_name").alias("name"),
        F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))).alias("geometry"),
    )


def assessments(
    spark: SparkSession, sf_dir: str, context: DataFrame | None = None, widest: str = "nb_defo_pct_100"
) -> DataFrame:
    """Assessments whose score stands in for a model: the loss share of the widest ring."""
    context = shares(spark, sf_dir) if context is None else context
    return context.select(
        "farm_id", "defo_m2", "total_m2", "defo_pct", (F.col(widest) / 100.0).alias("risk_score"),
        risk_class(F.col("defo_pct")).alias("risk_class"), F.lit(AS_OF).cast("timestamp").alias("assessed_at"),
    )


def loss(spark: SparkSession, sf_dir: str, raster: DataFrame | None = None) -> DataFrame:
    raster = cells(spark, sf_dir) if raster is None else raster
    return raster.filter(is_loss()).select("row", "col")


def crop_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold(cells(spark, sf_dir), "crop_prob", CROP_T).select("row", "col")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid(farm_runs(spark, sf_dir))
