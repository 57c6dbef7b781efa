"""Summaries printed after each step, as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gladeline.operators.ordering import running_sums


def count_where(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with a count per condition; NULL counts as false."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def column_delta(df: DataFrame, a: str, b: str) -> DataFrame:
    """How many rows differ between two columns, and the largest absolute difference."""
    return df.agg(
        F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("n_changed"),
        F.max(F.abs(F.col(b) - F.col(a))).alias("max_abs_delta"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def head(df: DataFrame, n: int = 5, order: str = "farm_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value`` rows without NULLs and NaNs."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _placed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column with their count ``n`` and running count ``upto``, and the column's totals.

    The table is read once, counted by value and sorted across tasks with running counts, so no task ever
    holds all values of a column.
    """
    counts = _long(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, [F.col("column"), F.col("value")], {"seen": "n"})
    value, n = F.col("value"), F.col("n")
    # one row per summarised column
    groups = ranked.groupBy("column").agg(
        F.min(F.col("seen") - n).alias("start"), F.sum(n).alias("total"),
        (F.sum(value * n) / F.sum(n)).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    return ranked.join(F.broadcast(groups), "column").withColumn("upto", F.col("seen") - F.col("start"))


def _picks(probs: Mapping[str, float]) -> list[Column]:
    """Aggregates for the two neighbours of each quantile and the weight between them."""
    picks = []
    for name, p in probs.items():
        at = (F.col("total") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("upto") > F.floor(at), F.col("value"))).alias(f"lo_{name}"))
        picks.append(F.min(F.when(F.col("upto") > F.ceil(at), F.col("value"))).alias(f"hi_{name}"))
        picks.append(F.max(at - F.floor(at)).alias(f"w_{name}"))
    return picks


def _between(name: str) -> Column:
    lo, hi, weight = F.col(f"lo_{name}"), F.col(f"hi_{name}"), F.col(f"w_{name}")
    return (lo + (hi - lo) * weight).alias(name)


def quantiles(df: DataFrame, columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per column, one column per name in ``probs``."""
    picked = _placed(df, columns).groupBy("column").agg(*_picks(probs))
    return picked.select("column", *[_between(name) for name in probs])


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, count, mean, std, min, q25, q50, q75, max`` per column; sample deviation, exact quartiles."""
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    gap = F.col("value") - F.col("mean")
    picked = _placed(df, columns).groupBy("column", "total", "mean", "min", "max").agg(
        F.sqrt(F.try_divide(F.sum(F.col("n") * gap * gap), F.col("total") - 1)).alias("std"), *_picks(probs)
    )
    return picked.select(
        "column", F.col("total").alias("count"), "mean", "std", "min", *[_between(name) for name in probs], "max"
    )


def affected_quantiles(assessments: DataFrame) -> DataFrame:
    """Quantiles of the loss share of affected parcels."""
    affected = assessments.filter(F.col("defo_pct") > 0)
    return quantiles(affected, ["defo_pct"], {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}).drop("column")


def median_threshold(assessments: DataFrame) -> DataFrame:
    """One row: the median loss share of affected parcels, the border between MEDIUM and HIGH."""
    affected = assessments.filter(F.col("defo_pct") > 0)
    return quantiles(affected, ["defo_pct"], {"threshold": 0.5}).select("threshold")


def verify_scores(assessments: DataFrame, expected: int) -> DataFrame:
    """Is every parcel scored, and every score in [0, 1]?"""
    score = F.col("risk_score")
    return assessments.agg(
        F.count(score).alias("n_scored"), F.min(score).alias("min_score"), F.max(score).alias("max_score")
    ).withColumn(
        "ok", (F.col("n_scored") == F.lit(expected)) & F.coalesce(F.col("min_score") >= 0, F.lit(False))
        & F.coalesce(F.col("max_score") <= 1, F.lit(False))
    )


def score_summary(assessments: DataFrame) -> DataFrame:
    """Count and 4-decimal score summary per class."""
    score = F.col("risk_score")
    return assessments.groupBy("risk_class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 4).alias("avg_score"),
        F.round(F.min(score), 4).alias("min_score"), F.round(F.max(score), 4).alias("max_score"),
    )


def masking_report(shares: DataFrame, original: DataFrame, masked: DataFrame) -> DataFrame:
    """What masking did to affected parcels: how many, zeros before, zeros that became positive, median change."""
    before, after = F.col("dist_to_defo_m"), F.col("dist_to_defo_m_masked")
    pairs = (
        original.join(shares.filter(F.col("defo_pct") > 0).select("farm_id"), "farm_id", "left_semi")
        .join(masked, "farm_id")
        .withColumn("delta", F.bround(after - before, 1))
    )
    counts = pairs.agg(
        F.count(F.lit(1)).alias("n_affected"), F.count_if(before == 0).alias("n_was_zero"),
        F.count_if((before == 0) & (after > 0)).alias("n_now_positive"),
    )
    median = quantiles(pairs, ["delta"], {"median_delta": 0.5}).select(F.bround("median_delta", 1).alias("median_delta"))
    both = counts.unionByName(median, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
