"""GeoJSON, CSV and Parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gladeline.functions.geojson import to_feature

_FEATURE = (
    "struct<type:string,geometry:string,"
    "properties:struct<farm_id:bigint,area_ha:double,count:bigint,commodity:string>>"
)
_BOUNDARY = "struct<type:string,geometry:string,properties:map<string,string>>"


def _features(spark: SparkSession, path: str, feature: str, layout: str) -> DataFrame:
    """GeoJSON features as ``f``, a struct of the given type."""
    if layout == "lines":
        line = F.regexp_replace(F.trim("value"), ",$", "")
        return spark.read.text(path).select(F.from_json(line, feature).alias("f")).filter(F.col("f.type") == "Feature")
    if layout == "collection":
        whole = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path)
        return whole.select(F.explode("features").alias("f"))
    raise ValueError(f"unknown layout {layout!r}")


def read_boundaries(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Any GeoJSON features as ``properties MAP<STRING, STRING>, geometry`` (text); layouts as in ``read_geojson``."""
    return _features(spark, path, _BOUNDARY, layout).select("f.properties", "f.geometry")


def read_boundary(boundaries: DataFrame, column: str, name: str) -> DataFrame:
    """Boundary features by attribute; the equality reaches the file scan. ``properties.<name>`` is a column too."""
    return boundaries.filter(F.col(column) == F.lit(name))


def read_geojson(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Parcels ``farm_id, area_ha, n_cells, commodity, geometry`` (geometry as GeoJSON text).

    ``lines``: one feature per line, alone or inside a collection written line by line; the file splits
    among tasks. ``collection``: one document of any layout, which one task has to parse.
    """
    return _features(spark, path, _FEATURE, layout).select(
        F.col("f.properties.farm_id").alias("farm_id"),
        F.col("f.properties.area_ha").alias("area_ha"),
        F.col("f.properties.count").alias("n_cells"),
        F.col("f.properties.commodity").alias("commodity"),
        F.col("f.geometry").alias("geometry"),
    )


def write_geojson(farms: DataFrame, path: str) -> None:
    """One feature per line, one file per partition."""
    properties = farms.withColumnRenamed("n_cells", "count")
    names = [c for c in properties.columns if c != "geometry"]
    to_feature(properties, names).select("feature").write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, its full schema given, cut down to ``columns``."""
    table = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return table.select(*columns) if columns else table


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A per-parcel table as Parquet, or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
