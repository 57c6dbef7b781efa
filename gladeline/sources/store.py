"""The parcel store: ``farms`` and ``assessments``, each a list of Parquet parts that readers merge.

``<path>/<name>/part=/bucket=`` holds the parts: rows, or patches, which set some columns of all earlier rows of a
farm. A manifest lists the parts and buckets that make up one version of a table, and a pointer names the manifest
in force. A change writes its part, then a manifest, then one small pointer file: whatever fails on the way leaves
the version before in place, no file is ever rewritten, and a reader keeps the manifest it began with. One writer at
a time. Buckets go by ``farm_id``; only those with patches are merged when read, and compaction rewrites only those
that have patches or several parts.
"""

from __future__ import annotations

import time
import uuid
import zlib
from collections.abc import Sequence
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gladeline.operators.joins import join_to_unique
from gladeline.sources.schemas import ASSESSMENTS, FARMS

TABLES = {"farms": FARMS, "assessments": ASSESSMENTS}
DEFAULT_COMMODITY = "cocoa"
BUCKETS = 16  # of a new table
MOST_PATCHES = 100_000  # rows of patches up to which Spark may broadcast them, if their files are small as well
_POINTER = "version string, buckets int"
_ENTRY = "part string, patch boolean, bucket int, n_rows long"


class Entry(NamedTuple):
    """One bucket of one part. Parts sort by time, so the part tells which rows a patch comes after."""

    part: str
    patch: bool
    bucket: int
    n_rows: int


def _now() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def _publish(spark: SparkSession, path: str, name: str, entries: Sequence[Entry], buckets: int) -> None:
    """Make these entries the table. They are parts times buckets, which compaction keeps few."""
    version = _now()
    spark.createDataFrame(entries, _ENTRY).coalesce(1).write.parquet(f"{path}/{name}__manifest/{version}")
    pointer = spark.createDataFrame([(version, buckets)], _POINTER).coalesce(1)
    pointer.write.mode("append").parquet(f"{path}/{name}__current")


def _manifest(spark: SparkSession, path: str, name: str) -> tuple[list[Entry], int]:
    pointers = spark.read.schema(_POINTER).parquet(f"{path}/{name}__current")
    version, buckets = pointers.agg(F.max(F.struct("version", "buckets"))).first()[0]
    listed = spark.read.schema(_ENTRY).parquet(f"{path}/{name}__manifest/{version}")
    return [Entry(*r) for r in listed.collect()], buckets


def _bucket(farm_id: Column, buckets: int) -> Column:
    return F.coalesce(F.crc32(farm_id.cast("string").cast("binary")) % F.lit(buckets), F.lit(0)).cast("int")


def _write_part(df: DataFrame, path: str, name: str, buckets: int, patch: bool = False) -> list[Entry]:
    """A new part. Rows are rebalanced by bucket: a farm with very many rows is written by several tasks."""
    part = _now()
    folder = f"{path}/{name}/part={part}"
    df.withColumn("bucket", _bucket(F.col("farm_id"), buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
    written = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField("bucket", T.IntegerType())])).parquet(folder)
    counts = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    return [Entry(part, patch, r["bucket"], r["n"]) for r in sorted(counts)]


def _typed(df: DataFrame, name: str) -> DataFrame:
    """The columns of the table, matched by name and cast; missing ones become NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].fields
    ])


def _patch_schema(name: str) -> T.StructType:
    """Each column in a struct: no struct, not set; an empty one, set to NULL."""
    fields = [T.StructField(f.name, T.StructType([T.StructField("v", f.dataType)])) for f in TABLES[name] if f.name != "farm_id"]
    return T.StructType([T.StructField("farm_id", T.LongType()), *fields])


def reset_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Both tables again, empty."""
    for name in TABLES:
        _publish(spark, path, name, [], buckets)


def append_table(df: DataFrame, path: str, name: str) -> None:
    """Add rows; columns are matched by name and cast to the table's types, missing ones become NULL."""
    spark = df.sparkSession
    entries, buckets = _manifest(spark, path, name)
    _publish(spark, path, name, entries + _write_part(_typed(df, name), path, name, buckets), buckets)


def update_table(changes: DataFrame, path: str, name: str) -> None:
    """Set the columns of ``changes`` in every stored row of its farms; no stored file is rewritten.

    NULL is a value like any other. Of several changes of one farm the greatest row by the table's columns counts;
    farms that the table lacks change nothing, and rows appended later are not touched. Columns that the table does
    not have are refused.
    """
    spark = changes.sparkSession
    known = [f for f in TABLES[name] if f.name in changes.columns and f.name != "farm_id"]
    strange = set(changes.columns) - set(TABLES[name].names)
    if strange or not known:
        raise ValueError(f"columns to set: {[f.name for f in known]}, not in {name}: {sorted(strange)}")
    entries, buckets = _manifest(spark, path, name)
    new = F.max(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known])).alias("new")
    once = changes.filter(F.col("farm_id").isNotNull()).groupBy(F.col("farm_id").cast("long").alias("farm_id")).agg(new)
    given = {f.name for f in known}
    patch = once.select("farm_id", *[
        (F.struct(F.col("new")[f.name].alias("v")) if f.name in given else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in _patch_schema(name) if f.name != "farm_id"
    ])
    _publish(spark, path, name, entries + _write_part(patch, path, name, buckets, patch=True), buckets)


def _scan(spark: SparkSession, path: str, name: str, entries: Sequence[Entry], schema: T.StructType) -> DataFrame:
    """The rows of these entries with their ``part``."""
    whole = T.StructType([*schema, T.StructField("part", T.StringType()), T.StructField("bucket", T.IntegerType())])
    if not entries:
        return spark.createDataFrame([], whole).drop("bucket")
    folders = [f"{path}/{name}/part={e.part}/bucket={e.bucket}" for e in entries]
    return spark.read.schema(whole).option("basePath", f"{path}/{name}").parquet(*folders).drop("bucket")


def _merged(spark: SparkSession, path: str, name: str, entries: Sequence[Entry]) -> DataFrame:
    """Rows with the patches written after them, the last one per column."""
    schema = TABLES[name]
    patched = {e.bucket for e in entries if e.patch}
    plain = [e for e in entries if not e.patch]
    rest = _scan(spark, path, name, [e for e in plain if e.bucket not in patched], schema).drop("part")
    if not patched:
        return rest
    rows = _scan(spark, path, name, [e for e in plain if e.bucket in patched], schema)
    changes = [e for e in entries if e.patch]
    others = [f.name for f in schema if f.name != "farm_id"]
    # a farm has at most one row in a part
    patches = _scan(spark, path, name, changes, _patch_schema(name)).groupBy("farm_id").agg(
        F.sort_array(F.collect_list(F.struct("part", *others))).alias("patches")
    )
    if sum(e.n_rows for e in changes) <= MOST_PATCHES:
        both = rows.join(patches, "farm_id", "left")
    else:
        both = join_to_unique(rows, patches, ["farm_id"], "left")

    def value(column: str) -> Column:
        later = F.filter("patches", lambda p: (p["part"] > F.col("part")) & p[column].isNotNull())
        return F.when(F.size(later) > 0, F.element_at(later, -1)[column]["v"]).otherwise(F.col(column)).alias(column)

    merged = both.select(*[value(c) if c != "farm_id" else F.col(c) for c in schema.names])
    return merged.unionByName(rest)


def read_table(spark: SparkSession, path: str, name: str, farm_ids: Sequence[int] | None = None) -> DataFrame:
    """The current version of a table; a reader keeps the version it began with. ``farm_ids`` opens only their buckets."""
    entries, buckets = _manifest(spark, path, name)
    if farm_ids is not None:
        wanted = {zlib.crc32(str(int(i)).encode()) % buckets for i in farm_ids}
        entries = [e for e in entries if e.bucket in wanted]
    merged = _merged(spark, path, name, entries)
    return merged if farm_ids is None else merged.filter(F.col("farm_id").isin([int(i) for i in farm_ids]))


def compact_table(spark: SparkSession, path: str, name: str) -> None:
    """Fold patches into rows: a bucket with patches or several parts becomes one part, the others keep their files."""
    entries, buckets = _manifest(spark, path, name)
    parts = {}
    for e in entries:
        parts.setdefault(e.bucket, []).append(e)
    crowded = {b for b, es in parts.items() if len(es) > 1 or es[0].patch}
    if not crowded:
        return
    old = [e for e in entries if e.bucket in crowded]
    folded = _write_part(_merged(spark, path, name, old), path, name, buckets)
    _publish(spark, path, name, [e for e in entries if e.bucket not in crowded] + folded, buckets)


def register_views(farms: DataFrame, assessments: DataFrame) -> None:
    """Make the tables reachable from ``spark.sql``."""
    farms.createOrReplaceTempView("farms")
    assessments.createOrReplaceTempView("assessments")


def with_defaults(df: DataFrame, as_of: datetime | str) -> DataFrame:
    """Fill the columns the store fills by itself: the crop, and the load time given as ``as_of``."""
    when = F.lit(as_of).cast("timestamp")
    known = {c: F.col(c) for c in df.columns}
    commodity = F.coalesce(known.get("commodity", F.lit(None).cast("string")), F.lit(DEFAULT_COMMODITY))
    assessed = F.coalesce(known.get("assessed_at", F.lit(None).cast("timestamp")), when)
    return df.withColumn("commodity", commodity).withColumn("assessed_at", assessed)


def check_keys(farms: DataFrame, assessments: DataFrame) -> DataFrame:
    """Violations ``(problem, farm_id, n_rows)``: repeated or missing farm ids, assessments without a farm,
    and several assessments of one farm."""
    repeated = farms.groupBy("farm_id").agg(F.count(F.lit(1)).alias("n_rows"))
    per_farm = assessments.groupBy("farm_id").agg(F.count(F.lit(1)).alias("n_rows"))

    def rows(df: DataFrame, problem: str) -> DataFrame:
        return df.select(F.lit(problem).alias("problem"), "farm_id", "n_rows")

    return (
        rows(repeated.filter((F.col("n_rows") > 1) | F.col("farm_id").isNull()), "farm key")
        .unionByName(rows(per_farm.join(farms, "farm_id", "left_anti").filter(F.col("farm_id").isNotNull()), "no farm"))
        .unionByName(rows(per_farm.filter(F.col("n_rows") > 1), "many assessments"))
    )


def latest_assessments(assessments: DataFrame) -> DataFrame:
    """The newest row per farm; an aggregate, so a farm with very many rows shrinks before the shuffle."""
    others = [c for c in assessments.columns if c != "farm_id"]
    newest = F.max_by(F.struct(*others), F.struct("assessed_at", *[c for c in others if c != "assessed_at"]))
    return assessments.groupBy("farm_id").agg(newest.alias("r")).select("farm_id", *[f"r.{c}" for c in others])


def apply_scores(assessments: DataFrame, scores: DataFrame) -> DataFrame:
    """A new snapshot: every row of a scored farm takes the new score and class, other rows stay.

    A farm that ``scores`` holds several times takes the row with the highest score.
    """
    best = F.max(F.struct("risk_score", "risk_class")).alias("best")
    new = scores.groupBy("farm_id").agg(best).select(
        "farm_id", F.col("best.risk_score").alias("new_score"), F.col("best.risk_class").alias("new_class"),
        F.lit(True).alias("scored"),
    )
    joined = assessments.join(new, "farm_id", "left")
    pick = {"risk_score": "new_score", "risk_class": "new_class"}
    return joined.select(
        *[F.when(F.col("scored"), F.col(pick[c])).otherwise(F.col(c)).alias(c) if c in pick else F.col(c)
          for c in assessments.columns]
    )


def write_snapshot(df: DataFrame, path: str, name: str, buckets: int = BUCKETS) -> None:
    """Replace a table by a new version; ``df`` may read the version it replaces, whose files stay."""
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name].fields])
    _publish(df.sparkSession, path, name, _write_part(rows, path, name, buckets), buckets)
