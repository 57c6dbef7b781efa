"""Classification metrics as DataFrame jobs; ``by`` evaluates many model variants at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gladeline.operators.ordering import running_sums

_EXACT = "decimal(38,0)"


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` (ties count half) and ``pr_auc`` (step-wise average precision) of a 0/1 label.

    Rows with equal scores are counted first, so a score that a third of all rows share is one row before
    anything is sorted; counts then run down the scores across tasks.
    """
    groups = [F.col(c) for c in by] or [F.lit("all").alias("variant")]
    names = list(by) or ["variant"]
    positive = F.col(label).cast("long")
    levels = (
        df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*groups, F.col(score).alias("score"))
        .agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    )
    order = [F.col(c) for c in names] + [F.col("score").desc()]
    curve = running_sums(levels, order, {"all_pos": "pos", "all_neg": "neg"})
    # one row per model variant
    starts = curve.groupBy(*names).agg(
        F.min(F.col("all_pos") - F.col("pos")).alias("pos0"), F.min(F.col("all_neg") - F.col("neg")).alias("neg0"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
    )
    placed = curve.join(starts, names).select(
        *names, "pos", "neg", "p", "n",
        (F.col("all_pos") - F.col("pos0")).alias("tp"), (F.col("all_neg") - F.col("neg0")).alias("fp"),
    )
    pos, neg, tp, fp, p, n = (F.col(c) for c in ("pos", "neg", "tp", "fp", "p", "n"))
    beaten = pos.cast(_EXACT) * (F.lit(2) * (n - fp) + neg)  # twice the pairs won, ties half
    step = pos * F.try_divide(tp.cast("double"), (tp + fp).cast("double"))
    out = placed.groupBy(*names).agg(
        F.try_divide(F.sum(beaten).cast("double"), F.lit(2.0) * F.max(p) * F.max(n)).alias("roc_auc"),
        F.try_divide(F.sum(step), F.max(p).cast("double")).alias("pr_auc"),
    )
    return out if by else out.drop("variant")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return ranking_metrics(df, score, label).select("roc_auc")


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    return ranking_metrics(df, score, label).select("pr_auc")


def confusion_matrix(
    df: DataFrame, label: str, predicted: str, classes: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``label, predicted, n`` for every pair of classes, zeros included."""
    counts = (
        df.groupBy(*by, F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(c) for c in classes])
    base = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    pairs = base.select(*by, F.explode(names).alias("label")).withColumn("predicted", F.explode(names))
    return pairs.join(counts, [*by, "label", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _per_class(
    df: DataFrame, label: str, predicted: str, classes: Sequence[str], by: Sequence[str]
) -> DataFrame:
    matrix = confusion_matrix(df, label, predicted, classes, by)
    n = F.col("n")
    hit = F.when(F.col("label") == F.col("predicted"), n).otherwise(0)
    actual = matrix.groupBy(*by, "label").agg(F.sum(hit).alias("tp"), F.sum(n).alias("support"))
    guessed = matrix.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum(n).alias("guessed"))
    zero = F.lit(0.0)
    tp = F.col("tp").cast("double")
    return actual.join(guessed, [*by, "label"]).select(
        *by, "label", "tp", "guessed",
        F.coalesce(F.try_divide(tp, F.col("guessed")), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, F.col("guessed") + F.col("support")), zero).alias("f1"),
        "support",
    )


def classification_report(
    df: DataFrame, label: str, predicted: str, classes: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``label, precision, recall, f1, support`` per class; undefined values are 0."""
    return _per_class(df, label, predicted, classes, by).drop("tp", "guessed")


def report_averages(
    df: DataFrame, label: str, predicted: str, classes: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy, and the plain and support-weighted means of the per-class values."""
    rows = _per_class(df, label, predicted, classes, by).filter(F.col("support") + F.col("guessed") > 0)
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    return rows.groupBy(*by).agg(
        F.try_divide(F.sum("tp").cast("double"), total).alias("accuracy"),
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), total).alias(f"weighted_{c}") for c in names],
        total.alias("support"),
    )


def macro_f1(
    df: DataFrame, label: str, predicted: str, classes: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Unweighted mean of the F1 of every class that occurs as label or prediction."""
    rows = _per_class(df, label, predicted, classes, by).filter(F.col("support") + F.col("guessed") > 0)
    return rows.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))
