"""GeoJSON text from columns and back."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gladeline.session import cut_lineage

RINGS_TYPE = "array<array<struct<x:double,y:double>>>"
_POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
_MULTI = "struct<type:string,coordinates:array<array<array<array<double>>>>>"

MOST_FEATURES = 10_000  # of one collection text
FARM_PROPERTIES = ("farm_id", "area_ha", "defo_pct", "risk_score", "risk_class")


def _sides(ring: Column) -> Column:
    """Sides ``(a, b)`` of a closed ring."""
    return F.arrays_zip(
        F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b")
    )


def _ring_area2(ring: Column) -> Column:
    """Twice the signed area of a closed ring."""
    return F.aggregate(
        _sides(ring), F.lit(0.0), lambda acc, p: acc + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    )


def _inside_point(ring: Column) -> Column:
    """A point just beside the first side of a ring, on the ring's filled side for outer rings."""
    a, b = F.get(ring, 0), F.get(ring, 1)
    dx, dy = F.signum(b["x"] - a["x"]), F.signum(b["y"] - a["y"])
    return F.struct(
        (a["x"] + F.lit(0.5) * dx - F.lit(0.5) * dy).alias("x"), (a["y"] + F.lit(0.5) * dy + F.lit(0.5) * dx).alias("y")
    )


def _coordinates(rings: Column, scale: float) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"] * F.lit(scale), p["y"] * F.lit(scale))))


def geometry_texts(shapes: DataFrame, id_col: str = "farm_id", scale: float = 1.0) -> DataFrame:
    """``id, geometry`` from ``id, rings`` in cell corners: a Polygon, or a MultiPolygon of several outer rings.

    Outer rings have positive area (inside on the right, y down). A hole goes to the outer ring around it, the
    smallest one where they are nested. Only shapes with several outer rings need that search; it sweeps the rows that
    hold a point of a hole or a side once. Null or no rings
    give a null text. The shapes are written once, as they are read for both kinds.
    """
    shapes = cut_lineage(shapes.select(id_col, "rings"))
    outer = F.filter("rings", lambda r: _ring_area2(r) > 0)
    holes = F.filter("rings", lambda r: _ring_area2(r) < 0)
    counted = shapes.withColumn("n_outer", F.coalesce(F.size(outer), F.lit(0)))
    single = counted.filter(F.col("n_outer") <= 1).select(
        id_col, F.when(F.col("n_outer") == 1, _text("Polygon", _coordinates(F.concat(outer, holes), scale))).alias("geometry")
    )
    rings = counted.filter(F.col("n_outer") > 1).select(id_col, F.posexplode("rings").alias("place", "ring"))
    return single.unionByName(_multipolygons(rings.withColumn("area2", _ring_area2(F.col("ring"))), id_col, scale))


def _text(kind: str, coordinates: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))


def _swept(marks: DataFrame, id_col: str) -> DataFrame:
    """``id, place, home``: the smallest ring open at each hole's point.

    ``marks`` are, per row of a shape, the upright sides of outer rings (``home``) and the points of holes
    (``place``). A row is swept once from left to right: a side opens its ring or closes it, and what is open at a
    point lies around it. Only the open rings are held, which are nested, so a row may have any number of holes.
    """
    by = [id_col, "row"]
    ordered = marks.repartition(*by).sortWithinPartitions(*by, "x")
    kind = StructType([marks.schema[id_col], *StructType.fromDDL("place int, home int").fields])
    arrow = to_arrow_schema(kind)

    def sweep(batches):
        row, around = None, {}
        for batch in batches:
            found = []
            for key, at, home, area, place in zip(*(batch.column(c).to_pylist() for c in (id_col, "row", "home", "home_area2", "place"))):
                if (key, at) != row:
                    row, around = (key, at), {}
                if place is None:
                    if home in around:
                        del around[home]
                    else:
                        around[home] = area
                elif around:
                    found.append((key, place, min(around, key=lambda h: (around[h], h))))
            columns = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return ordered.mapInArrow(sweep, kind)


def _multipolygons(rings: DataFrame, id_col: str, scale: float) -> DataFrame:
    """``id, geometry`` of shapes given ring by ring ``(id, place, ring, area2)``."""
    outer, holes = rings.filter(F.col("area2") > 0), rings.filter(F.col("area2") < 0)
    sides = outer.select(
        id_col, F.col("place").alias("home"), F.col("area2").alias("home_area2"), F.explode(_sides(F.col("ring"))).alias("s")
    ).filter(F.col("s.a.y") != F.col("s.b.y"))
    rows = F.sequence(F.least("s.a.y", "s.b.y").cast("long"), F.greatest("s.a.y", "s.b.y").cast("long") - 1)
    upright = sides.select(
        id_col, F.explode(rows).alias("row"), F.col("s.a.x").alias("x"), "home", "home_area2", F.lit(None).cast("int").alias("place")
    )
    spot = _inside_point(F.col("ring"))
    spots = holes.select(
        id_col, F.floor(spot["y"]).alias("row"), spot["x"].alias("x"), F.lit(None).cast("int").alias("home"),
        F.lit(None).cast("double").alias("home_area2"), "place",
    )
    around = _swept(upright.unionByName(spots), id_col)
    inner = (
        holes.join(around, [id_col, "place"]).groupBy(id_col, F.col("home").alias("place"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "ring")))["ring"].alias("inner"))
    )
    parts = outer.join(inner, [id_col, "place"], "left").select(
        id_col, "place", F.when(F.col("inner").isNull(), F.array("ring")).otherwise(F.concat(F.array("ring"), "inner")).alias("part")
    )
    shapes = parts.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "part")))["part"].alias("parts"))
    return shapes.select(
        id_col, _text("MultiPolygon", F.transform("parts", lambda p: _coordinates(p, scale))).alias("geometry")
    )


def parse_rings(geometry: Column) -> Column:
    """All rings of a Polygon or MultiPolygon text as ``ARRAY<ARRAY<STRUCT<x, y>>>``."""
    kind = F.get_json_object(geometry, "$.type")
    single = F.from_json(geometry, _POLYGON)["coordinates"]
    several = F.flatten(F.from_json(geometry, _MULTI)["coordinates"])
    rings = F.when(kind == "Polygon", single).when(kind == "MultiPolygon", several)
    return F.transform(
        rings, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    )


def to_feature(df: DataFrame, properties: Sequence[str] = FARM_PROPERTIES) -> DataFrame:
    """Add ``feature``: one GeoJSON Feature text per row, NULL properties written as null."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"})
    text = F.concat(
        F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry", F.lit("null")), F.lit(',"properties":'), props,
        F.lit("}"),
    )
    return df.withColumn("feature", text)


def to_feature_collection(
    page: DataFrame, order: Column, properties: Sequence[str] = FARM_PROPERTIES, most: int = MOST_FEATURES
) -> DataFrame:
    """One FeatureCollection text from a page of rows.

    A page of more than ``most`` parcels is refused with an error once one too many is read; whole tables go out
    through ``write_geojson``.
    """
    rows = to_feature(page.limit(most + 1).withColumn("sort_key", order), properties).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("sort_key", "feature"))), lambda s: s["feature"]
        ).alias("features")
    )
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("features", ","), F.lit("]}"))
    refused = F.raise_error(F.lit(f"a collection holds at most {most} features"))
    return rows.select(F.when(F.size("features") > most, refused).otherwise(text).alias("collection"))
