"""The read queries: listings, lookup, statistics, early warning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gladeline.functions.labels import RISK_CLASSES, compliance_label
from gladeline.operators.ordering import number_rows

MAX_LIMIT = 10_000
MAX_WARNINGS = 4_100
PAGE_SIZE = 50
MAX_TOP = 20_000  # rows up to which a page is a top-k
RANGE_ROWS = 100_000  # rows of a range of a stored view


def check_parameters(
    risk_class: str | None = None, min_risk_score: float | None = None,
    limit: int = 1, offset: int = 0, max_limit: int = MAX_LIMIT,
) -> None:
    """Reject a bad request before any plan is built."""
    if risk_class is not None and risk_class not in RISK_CLASSES:
        raise ValueError(f"risk_class must be one of {RISK_CLASSES}")
    if min_risk_score is not None and not 0 <= min_risk_score <= 1:
        raise ValueError("min_risk_score must lie in [0, 1]")
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must lie in 1..{max_limit}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def parcels_view(farms: DataFrame, assessments: DataFrame, dated: bool = False) -> DataFrame:
    """The columns every parcel query serves; ``dated`` adds when each assessment was made."""
    return farms.join(assessments.drop("area_ha", "geometry"), "farm_id").select(
        "farm_id", "area_ha", "defo_pct", "risk_score", "risk_class", "geometry", *(["assessed_at"] if dated else [])
    )


def semi_filter(df: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose ``farm_id`` is (or is not) in ``ids``; the id set stays distributed."""
    return df.join(ids.select("farm_id"), "farm_id", "left_semi" if keep else "left_anti")


def _order(df: DataFrame) -> list:
    """By ``farm_id``, then by a hash of the row, so that several rows of one parcel have places too."""
    return [F.col("farm_id"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]


def page(df: DataFrame, limit: int, offset: int = 0, most_top: int = MAX_TOP) -> DataFrame:
    """Rows ``offset .. offset + limit - 1`` in order of ``farm_id``, then of a hash of the row.

    A page that ends within ``most_top`` rows is a top-k: every task keeps that many rows at most and nothing is
    written. Beyond it a task would have to hold too many, so rows are numbered in parallel and filtered; pages of a
    table that is read more than once come from :func:`store_pages`.
    """
    if offset + limit <= most_top:
        return df.orderBy(*_order(df)).offset(offset).limit(limit)
    numbered = number_rows(df, _order(df), "__place")
    return numbered.filter(F.col("__place").between(offset, offset + limit - 1)).orderBy("__place").drop("__place")


@dataclass(frozen=True)
class Pages:
    """A view in ranges of its order, a folder each, and a directory of how many rows of each class a range holds."""

    rows: DataFrame
    directory: DataFrame


def store_pages(view: DataFrame, path: str, rows_per_range: int = RANGE_ROWS) -> Pages:
    """Write ``view`` for paging, sorted once; ``rows_per_range`` is what a page has to read at least."""
    ranges = max(1, -(-view.count() // rows_per_range))
    order = _order(view)
    placed = view.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range_no", F.spark_partition_id())
    placed.write.partitionBy("range_no").parquet(f"{path}/rows")
    kind = StructType([*view.schema.fields, StructField("range_no", IntegerType())])
    rows = view.sparkSession.read.schema(kind).parquet(f"{path}/rows")
    rows.groupBy("range_no", "risk_class").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.parquet(f"{path}/directory")
    return open_pages(view.sparkSession, path, kind)


def open_pages(spark: SparkSession, path: str, kind: StructType | None = None) -> Pages:
    """Pages written before."""
    reader = spark.read if kind is None else spark.read.schema(kind)
    return Pages(reader.parquet(f"{path}/rows"), spark.read.schema("range_no int, risk_class string, n long").parquet(f"{path}/directory"))


def read_page(
    pages: Pages, limit: int, offset: int = 0, classes: Sequence[str] | None = None, min_risk_score: float | None = None,
) -> DataFrame:
    """The same rows as :func:`page` of the filtered view, from the ranges that hold them alone.

    The directory tells which these are. A score filter is not in the directory: its rows per range are counted over
    two narrow columns first. Nothing is written, and only the rows of one range, or of those the page spans, are sorted.
    """
    held = pages.rows.drop("range_no")
    wanted = F.lit(True) if classes is None else F.col("risk_class").isin(*classes)
    if min_risk_score is None:
        counts = pages.directory.filter(wanted).groupBy("range_no").agg(F.sum("n").alias("n"))
    else:
        wanted = wanted & (F.col("risk_score") >= min_risk_score)
        counts = pages.rows.filter(wanted).groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    start, picked, skipped = 0, [], 0
    for number, n in sorted((r["range_no"], r["n"]) for r in counts.collect()):  # one number per range
        if start < offset + limit and start + n > offset:
            skipped = skipped if picked else start
            picked.append(number)
        start += n
    if not picked:
        return held.filter(F.lit(False))
    near = pages.rows.filter(F.col("range_no").isin(*picked)).filter(wanted).drop("range_no")
    return near.orderBy(*_order(held)).offset(offset - skipped).limit(limit)


def page_after(df: DataFrame, limit: int, last_id: int) -> DataFrame:
    """The page that follows ``last_id``: a filter and a top-k, at any depth."""
    return df.filter(F.col("farm_id") > F.lit(last_id)).orderBy("farm_id").limit(limit)


def list_farms(
    view: DataFrame, risk_class: str | None = None, min_risk_score: float | None = None,
    limit: int = 100, offset: int = 0, max_limit: int = MAX_LIMIT,
) -> DataFrame:
    """Parcels of a class and with at least a score, paged by id; unscored parcels fail a score filter.

    A request for more than ``max_limit`` rows is refused.
    """
    check_parameters(risk_class, min_risk_score, limit, offset, max_limit)
    if risk_class is not None:
        view = view.filter(F.col("risk_class") == risk_class)
    if min_risk_score is not None:
        view = view.filter(F.col("risk_score") >= min_risk_score)
    return page(view, limit, offset)


def get_farm(view: DataFrame, farm_id: int) -> DataFrame:
    """One parcel, by its newest assessment where the view has ``assessed_at``; empty when the id is unknown."""
    newest = [F.desc_nulls_last("assessed_at")] if "assessed_at" in view.columns else []
    ties = [F.col(c) for c in view.columns if c not in ("farm_id", "assessed_at")]
    return view.filter(F.col("farm_id") == F.lit(farm_id)).orderBy(*newest, *ties).limit(1)


def early_warning(view: DataFrame, limit: int = 10, max_limit: int = MAX_WARNINGS) -> DataFrame:
    """Clean parcels by falling score; unscored ones last, ties by id. More than ``max_limit`` are refused."""
    check_parameters(limit=limit, max_limit=max_limit)
    return view.filter(F.col("risk_class") == "LOW").orderBy(F.desc_nulls_last("risk_score"), "farm_id").limit(limit)


def top_loss(view: DataFrame, k: int = 10) -> DataFrame:
    """Parcels by falling loss share; unknown shares last, ties by id."""
    return view.orderBy(F.desc_nulls_last("defo_pct"), "farm_id").limit(k)


def sort_by_score(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("risk_score"), "farm_id")


def browse(view: DataFrame, classes: Sequence[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 0) of the parcels in the chosen classes."""
    return page(view.filter(F.col("risk_class").isin(*classes)), size, number * size)


def class_stats(assessments: DataFrame) -> DataFrame:
    """Count and score summary per class, highest mean first."""
    score = F.col("risk_score")
    return (
        assessments.groupBy("risk_class")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg(score).alias("avg_risk_score"), F.min(score).alias("min_risk_score"), F.max(score).alias("max_risk_score"),
        )
        .orderBy(F.desc_nulls_last("avg_risk_score"), "risk_class")
    )


def totals(farms: DataFrame) -> DataFrame:
    """Parcel count and total area; 0 for an empty table."""
    return farms.agg(
        F.count(F.lit(1)).alias("total_parcels"),
        F.round(F.coalesce(F.sum("area_ha"), F.lit(0.0)), 2).alias("total_area_ha"),
    )


def stats_document(farms: DataFrame, assessments: DataFrame) -> DataFrame:
    """One nested row: totals, a list with one entry per class, and how many rows have no class.

    The list holds at most one entry per class name.
    """
    entry = F.struct(
        F.col("avg_risk_score").alias("sort_key"), "risk_class", "count",
        F.round("avg_risk_score", 4).alias("avg_risk_score"), "min_risk_score", "max_risk_score",
    )
    stats = class_stats(assessments)
    by_class = stats.agg(
        F.sort_array(F.collect_list(F.when(F.col("risk_class").isNotNull(), entry)), asc=False).alias("ranked"),
        F.coalesce(F.sum(F.when(F.col("risk_class").isNull(), F.col("count"))), F.lit(0)).alias("unclassified"),
    )
    listed = F.transform(
        "ranked",
        lambda e: F.struct(*[e[c].alias(c) for c in
                             ("risk_class", "count", "avg_risk_score", "min_risk_score", "max_risk_score")]),
    )
    both = totals(farms).unionByName(
        by_class.select(listed.alias("by_risk_class"), "unclassified"), allowMissingColumns=True
    )
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def class_tiles(assessments: DataFrame) -> DataFrame:
    """Count and wording per class present, HIGH first."""
    place = F.when(F.col("risk_class") == "HIGH", 0).when(F.col("risk_class") == "MEDIUM", 1).otherwise(2)
    return (
        assessments.filter(F.col("risk_class").isin(*RISK_CLASSES))
        .groupBy("risk_class")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(place.alias("place"), "risk_class", compliance_label(F.col("risk_class")).alias("label"), "count")
        .orderBy("place")
    )
