"""Risk models: folds, cross-validation, selection, scoring.

Regressions are fitted with ``pyspark.ml``; forests are grown together by :mod:`gladeline.plans.forests`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gladeline.operators.ordering import shuffled_rank
from gladeline.plans import forests
from gladeline.plans.lineage import sources_of
from gladeline.plans.metrics import classification_report, macro_f1, ranking_metrics
from gladeline.session import cut_lineage

SEED = 42
FOLDS = 5
#: Rows of a regression that a task holds: every iteration is a job, so a small fit is spread over few tasks.
FIT_TASK_ROWS = 100_000
MODELS = ("RF", "LR")

# fixed values: the feature sets compared, and those of the masking study
FEATURE_SETS = {
    "A: area+nb200 (baseline)": ["area_ha", "nb_defo_pct_200"],
    "B: nb200 only": ["nb_defo_pct_200"],
    "C: distance only": ["dist_to_defo_m"],
    "D: nb 200+500+1000": ["nb_defo_pct_200", "nb_defo_pct_500", "nb_defo_pct_1000"],
    "E: dist + nb multi": ["dist_to_defo_m", "nb_defo_pct_200", "nb_defo_pct_500", "nb_defo_pct_1000"],
    "F: E + area": ["area_ha", "dist_to_defo_m", "nb_defo_pct_200", "nb_defo_pct_500", "nb_defo_pct_1000"],
}
MASKING_SETS = {
    "C  orig  [dist only]": ["dist_to_defo_m"],
    "C  masked [dist only]": ["dist_to_defo_m_masked"],
    "F  orig  [area+dist+nb multi]": [
        "area_ha", "dist_to_defo_m", "nb_defo_pct_200", "nb_defo_pct_500", "nb_defo_pct_1000"],
    "F  masked [area+dist+nb multi]": [
        "area_ha", "dist_to_defo_m_masked", "nb_defo_pct_200", "nb_defo_pct_500", "nb_defo_pct_1000"],
}
# columns that state the parcel's own loss; none may become a feature
OWN_LOSS = ("defo_m2", "total_m2", "defo_pct", "risk_class", "risk_binary", "risk_score")


@dataclass(frozen=True)
class Framing:
    """A label column, its classes in index order, and the class whose probability is the score."""

    name: str
    label: str
    classes: tuple[str, ...]
    positive: str


BINARY = Framing("binary", "risk_binary", ("CLEAN", "AFFECTED"), "AFFECTED")
THREE_CLASS = Framing("3-class", "risk_class", ("HIGH", "LOW", "MEDIUM"), "HIGH")


@dataclass(frozen=True)
class Settings:
    """Every fit sees all labelled rows, unless a caller bounds them by ``fit_rows``; scoring has no bound."""

    trees: int = 300
    depth: int = 30
    max_iter: int = 1000
    folds: int = FOLDS
    seed: int = SEED
    parallel: int = 4  # fits in flight at a time
    fit_rows: int | None = None


def class_index(framing: Framing) -> Column:
    """Label text to its number; NULL for a missing or unknown label."""
    index = F.lit(None).cast("double")
    for i, name in enumerate(framing.classes):
        index = F.when(F.col(framing.label) == name, float(i)).otherwise(index)
    return index


def assemble(feats: Sequence[str]) -> VectorAssembler:
    """Feature vector; rows that miss a feature are left out of the fit."""
    return VectorAssembler(inputCols=list(feats), outputCol="raw", handleInvalid="skip")


def lr(settings: Settings, n_feats: int, n_rows: int) -> list:
    """Scaled logistic regression with an L2 penalty of strength 1 on the weighted loss sum.

    The scaler divides by the sample deviation, the penalty belongs to the population one: hence the factor.
    Balanced weights sum to the row count, and the solver minimises the weighted mean, so 1 becomes 1 / n.
    """
    factor = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
    return [
        StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="centred", outputCol="scaled", scalingVec=Vectors.dense([factor] * n_feats)),
        LogisticRegression(
            featuresCol="scaled", labelCol="y", weightCol="weight", maxIter=settings.max_iter,
            regParam=1.0 / n_rows, elasticNetParam=0.0, standardization=False, family="auto",
        ),
    ]


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Add ``weight = n / (k * n_class)``; unlabelled rows get NULL."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    # one entry per class
    classes = counts.agg(
        F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"), F.collect_list(F.struct(label, "n_class")).alias("c")
    )
    weights = classes.select("n", "k", F.explode("c").alias("c")).select(
        F.col(f"c.{label}").alias(label), (F.col("n").cast("double") / (F.col("k") * F.col("c.n_class"))).alias("weight")
    )
    return df.join(F.broadcast(weights), label, "left")


def stratified_folds(df: DataFrame, label: str, k: int = FOLDS, seed: int = SEED, key: str = "farm_id") -> DataFrame:
    """Add ``fold`` (0..k-1): every class is dealt out evenly, in an order that depends on ids alone."""
    ranked = shuffled_rank(df, label, key, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def stratified_split(df: DataFrame, label: str, share: float = 0.25, seed: int = SEED, key: str = "farm_id") -> DataFrame:
    """Add ``is_test``: the first ``ceil(share * n)`` rows of every class in shuffled order."""
    sizes = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("n_test"))
    ranked = shuffled_rank(df, label, key, seed)
    g = sizes.select(F.col(label).alias("g"), "n_test")
    # one row per class
    return (
        ranked.join(F.broadcast(g), F.col(label).eqNullSafe(F.col("g")))
        .withColumn("is_test", F.col("rank") <= F.col("n_test"))
        .drop("rank", "n_test", "g")
    )


def _training_rows(frame: DataFrame, framing: Framing) -> DataFrame:
    return frame.withColumn("y", class_index(framing)).filter(F.col("y").isNotNull())


def _weight(counts: Mapping[float, int]) -> Column:
    """Balanced weight from class counts already on the driver (two or three numbers)."""
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(None).cast("double")
    for y, n_class in counts.items():
        weight = F.when(F.col("y") == y, n / (k * n_class)).otherwise(weight)
    return weight


def _counts(rows: DataFrame, feats: Sequence[str]) -> dict[float, int]:
    """Usable rows per class."""
    usable = rows.dropna(subset=list(feats)).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return {r["y"]: r["n"] for r in usable.collect()}


def _bounded(
    train: DataFrame, feats: Sequence[str], counts: Mapping[float, int], settings: Settings
) -> tuple[DataFrame, Mapping[float, int]]:
    """All rows; if the caller gives ``fit_rows``, about so many, an equal share per class by a hash of the id, small classes whole."""
    if settings.fit_rows is None or sum(counts.values()) <= settings.fit_rows:
        return train, counts
    drawn = F.pmod(F.xxhash64(F.lit(settings.seed), "farm_id"), F.lit(1 << 30)) / float(1 << 30)
    keep = F.lit(False)
    for y, n in counts.items():
        keep = F.when(F.col("y") == y, drawn < settings.fit_rows / len(counts) / n).otherwise(keep)
    kept = train.filter(keep)
    return kept, _counts(kept, feats)


def _fit(train: DataFrame, feats: Sequence[str], counts: Mapping[float, int], settings: Settings) -> PipelineModel:
    train, counts = _bounded(train, feats, counts, settings)
    n = sum(counts.values())
    train = train.coalesce(max(1, -(-n // FIT_TASK_ROWS)))
    stages = lr(settings, len(feats), n)
    return Pipeline(stages=[assemble(feats), *stages]).fit(train.withColumn("weight", _weight(counts)))


@dataclass(frozen=True)
class Variant:
    """A feature set and a framing, by name; ``fold`` is the column of the fold to leave out, if any."""

    features: str
    feats: tuple[str, ...]
    framing: Framing
    fold: str | None = None


def _grown(frame: DataFrame, variants: Sequence[Variant], settings: Settings, scored: bool = True) -> tuple[forests.Grown, list[Variant]]:
    """The forests of all variants, one per fold or one on all rows, and the variant of each."""
    feats = sorted({f for v in variants for f in v.feats})
    labels = list(dict.fromkeys((v.framing, v.fold) for v in variants))
    marks = [(class_index(framing), F.col(fold) if fold else F.lit(None).cast("int")) for framing, fold in labels]
    matrix = forests.binned_matrix(frame, feats, marks, settings.fit_rows, settings.seed)
    grown, of = [], []
    for v in variants:
        label = labels.index((v.framing, v.fold))
        for held_out in range(settings.folds) if v.fold else [None]:
            weights = matrix.weights(label, len(v.framing.classes), held_out)
            if any(weights):
                grown.append(forests.Forest(tuple(feats.index(f) for f in v.feats), label, weights, held_out))
                of.append(v)
    return forests.grow(matrix, grown, settings.trees, settings.depth, settings.seed, scored), of


def forest_predictions(frame: DataFrame, variants: Sequence[Variant], settings: Settings) -> DataFrame:
    """``framing, features, farm_id, predicted, score``: each row from forests that never saw it, or from one on all rows.

    All variants are grown together and see the same rows, those with every feature.
    """
    grown, of = _grown(frame, variants, settings)
    at, picked, score = F.array_position("p", F.array_max("p")).cast("int") - 1, F.lit(None).cast("string"), F.lit(None).cast("double")
    for framing in dict.fromkeys(v.framing for v in variants):
        mine = F.col("framing") == framing.name
        picked = F.when(mine, F.get(F.array(*[F.lit(c) for c in framing.classes]), at)).otherwise(picked)
        score = F.when(mine, F.get("p", F.lit(framing.classes.index(framing.positive)))).otherwise(score)
    # a row per forest
    names = frame.sparkSession.createDataFrame(
        [(i, v.framing.name, v.features) for i, v in enumerate(of)], "forest int, framing string, features string"
    )
    rows = grown.scores.join(F.broadcast(names), "forest")
    return rows.select("framing", "features", "farm_id", picked.alias("predicted"), score.alias("score"))


def _scored(model: PipelineModel, df: DataFrame, framing: Framing, keep: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in framing.classes])
    at = framing.classes.index(framing.positive)
    return model.transform(df).select(
        *keep,
        F.get(names, F.col("prediction").cast("int")).alias("predicted"),
        F.get(vector_to_array("probability"), at).alias("score"),
    )


def _class_counts(rows: DataFrame, feats: Sequence[str]) -> dict[int, dict[float, int]]:
    """Usable rows per fold and class: folds x classes numbers."""
    whole = rows.dropna(subset=list(feats)).groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[int, dict[float, int]] = {}
    for r in whole.collect():
        counts.setdefault(r["fold"], {})[r["y"]] = r["n"]
    return counts


def _together(spark: SparkSession, jobs: Sequence, parallel: int) -> list:
    """Run independent fits side by side; each is a distributed job of its own."""
    inherit = inheritable_thread_target(spark)
    with ThreadPool(max(1, min(parallel, len(jobs)))) as pool:
        return pool.map(lambda job: job(), [inherit(j) for j in jobs])


def cross_val_predict(
    folded: DataFrame, kind: str, feats: Sequence[str], framing: Framing, settings: Settings = Settings()
) -> DataFrame:
    """``farm_id, label, predicted, score`` for every labelled row, each from a model that never saw it.

    ``folded`` carries ``fold``. One fit per fold gives both the class and the probability.
    """
    rows = _training_rows(folded, framing)
    if kind == "RF":
        predicted = forest_predictions(rows, [Variant("", tuple(feats), framing, "fold")], settings)
        labels = rows.select("farm_id", F.col(framing.label).alias("label"))
        return predicted.join(labels, "farm_id").select("farm_id", "label", "predicted", "score")
    return _stacked(_together(folded.sparkSession, _fold_fits(rows, feats, framing, settings), settings.parallel))


def _fold_fits(rows: DataFrame, feats: Sequence[str], framing: Framing, settings: Settings) -> list[Callable[[], DataFrame]]:
    """A job per fold, which fits a regression on the rows outside it and returns the predictions of those inside."""
    counts = _class_counts(rows, feats)

    def one(fold: int):
        def job():
            train: dict[float, int] = {}
            for other, per_class in counts.items():
                if other != fold:
                    for y, n in per_class.items():
                        train[y] = train.get(y, 0) + n
            model = _fit(rows.filter(F.col("fold") != fold), feats, train, settings)
            held_out = rows.filter(F.col("fold") == fold)
            return _scored(model, held_out, framing, ["farm_id", F.col(framing.label).alias("label")])
        return job

    return [one(f) for f in sorted(counts)]


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_all(frame: DataFrame, feats: Sequence[str], framing: Framing, settings: Settings = Settings()) -> PipelineModel:
    """A regression on all labelled rows."""
    rows = _training_rows(frame, framing)
    return _fit(rows, feats, _counts(rows, feats), settings)


def importances(model: PipelineModel, feats: Sequence[str]) -> list[tuple[str, float]]:
    """Long rows ``feature, importance``: how far a scaled feature moves the classes of a regression."""
    moves = model.stages[-1].coefficientMatrix
    return [(f, float(sum(abs(moves[c, i]) for c in range(moves.numRows)) / moves.numRows)) for i, f in enumerate(feats)]


def importance_table(
    frame: DataFrame, sets: Mapping[str, Sequence[str]] = FEATURE_SETS, settings: Settings = Settings(),
    kinds: Sequence[str] = MODELS,
) -> DataFrame:
    """``model, features, feature, importance`` of the binary models fitted on all rows that have every feature.

    A forest's importance is the share of impurity that the feature's splits take away.
    """
    spark = frame.sparkSession
    feats = sorted({f for names in sets.values() for f in names})
    frame = cut_lineage(frame.dropna(subset=feats))
    rows = []
    if "RF" in kinds:
        grown, of = _grown(frame, [Variant(n, tuple(f), BINARY) for n, f in sets.items()], settings, scored=False)
        found = {(r["forest"], r["feature"]): r["importance"] for r in forests.importances(grown.gains).collect()}
        rows += [("RF", v.features, f, found.get((i, feats.index(f)), 0.0)) for i, v in enumerate(of) for f in v.feats]
    if "LR" in kinds:
        jobs = [lambda n=n: importances(fit_all(frame, sets[n], BINARY, settings), sets[n]) for n in sets]
        for name, log in zip(sets, _together(spark, jobs, settings.parallel), strict=True):
            rows += [("LR", name, *row) for row in log]
    table = spark.createDataFrame(rows, "model string, features string, feature string, importance double")
    return table.withColumn("importance", F.round("importance", 3))


def variant_predictions(
    frame: DataFrame, sets: Mapping[str, Sequence[str]], framings: Sequence[Framing], settings: Settings = Settings(),
    kinds: Sequence[str] = MODELS,
) -> DataFrame:
    """``model, framing, features, farm_id, label, predicted, score``: out-of-fold predictions of all variants.

    Every variant sees the same rows, those with every feature. Forests are grown together; the regressions of all
    variants and folds wait in one line, of which ``parallel`` are fitted at a time.
    """
    frame = frame.dropna(subset=sorted({f for feats in sets.values() for f in feats}))
    fold = {framing: f"fold_{i}" for i, framing in enumerate(framings)}
    for framing in framings:
        frame = stratified_folds(frame, framing.label, settings.folds, settings.seed).withColumnRenamed("fold", fold[framing])
    frame = cut_lineage(frame)
    parts = []
    if "RF" in kinds:
        variants = [Variant(name, tuple(feats), framing, fold[framing]) for framing in framings for name, feats in sets.items()]
        labels = F.array(*[F.struct(F.lit(f.name).alias("framing"), F.col(f.label).alias("label")) for f in framings])
        labels = frame.select("farm_id", F.explode(labels).alias("l")).select("farm_id", "l.*").filter("label is not null")
        predicted = forest_predictions(frame, variants, settings).join(labels, ["farm_id", "framing"])
        parts.append(cut_lineage(predicted.withColumn("model", F.lit("RF"))))
    if "LR" in kinds:
        fits = {}
        for framing in framings:
            rows = _training_rows(frame.withColumnRenamed(fold[framing], "fold"), framing)
            fits |= {(framing.name, name): _fold_fits(rows, feats, framing, settings) for name, feats in sets.items()}
        fitted = iter(_together(frame.sparkSession, [job for jobs in fits.values() for job in jobs], settings.parallel))
        named = [
            _stacked([next(fitted) for _ in jobs]).withColumns({"model": F.lit("LR"), "framing": F.lit(framing), "features": F.lit(name)})
            for (framing, name), jobs in fits.items() if jobs
        ]
        parts += _together(frame.sparkSession, [lambda part=part: cut_lineage(part) for part in named], settings.parallel)
    columns = ["model", "framing", "features", "farm_id", "label", "predicted", "score"]
    return _stacked([part.select(*columns) for part in parts])


def _grid(
    frame: DataFrame, sets: Mapping[str, Sequence[str]], framings: Sequence[Framing], settings: Settings,
    kinds: Sequence[str],
) -> DataFrame:
    by = ["model", "features"]
    every = variant_predictions(frame, sets, framings, settings, kinds)
    tables = []
    for framing in framings:
        predictions = every.filter(F.col("framing") == framing.name)
        f1 = macro_f1(predictions, "label", "predicted", framing.classes, by)
        if len(framing.classes) == 2:
            hit = predictions.withColumn("hit", (F.col("label") == framing.positive).cast("long"))
            metrics = ranking_metrics(hit, "score", "hit", by).join(f1, by)
        else:
            missing = F.lit(None).cast("double")
            metrics = f1.withColumn("roc_auc", missing).withColumn("pr_auc", missing)
        tables.append(metrics.withColumn("framing", F.lit(framing.name)))
    table = tables[0]
    for more in tables[1:]:
        table = table.unionByName(more)
    return table.select(
        "model", "framing", "features", *[F.bround(c, 3).alias(c) for c in ("roc_auc", "pr_auc", "macro_f1")]
    )


def compare_models(
    frame: DataFrame, settings: Settings = Settings(), sets: Mapping[str, Sequence[str]] = FEATURE_SETS,
    kinds: Sequence[str] = MODELS,
) -> DataFrame:
    """``model, framing, features, roc_auc, pr_auc, macro_f1``: every family, feature set and framing.

    Metrics are taken over the pooled out-of-fold rows; the rank metrics are NULL for three classes. All variants
    see the same rows, those with every feature of every set; ``usable_rows`` counts what that leaves out.
    """
    return _grid(cut_lineage(frame), sets, (BINARY, THREE_CLASS), settings, kinds)


def sensitivity(frame: DataFrame, settings: Settings = Settings(), sets=MASKING_SETS, kinds=MODELS) -> DataFrame:
    """Binary metrics with the plain and the masked distance: ``model, variant, roc_auc, pr_auc, macro_f1``."""
    return _grid(cut_lineage(frame), sets, (BINARY,), settings, kinds).select(
        "model", F.col("features").alias("variant"), "roc_auc", "pr_auc", "macro_f1"
    )


def usable_rows(frame: DataFrame, sets: Mapping[str, Sequence[str]] = FEATURE_SETS) -> DataFrame:
    """``features, n_feats, n_rows, n_usable, n_common``: labelled rows, those with the set's features, with all sets'."""
    labelled = frame.filter(F.col(BINARY.label).isNotNull())

    def whole(feats) -> Column:
        present = F.lit(True)
        for f in feats:
            present = present & F.col(f).isNotNull()
        return present

    every = whole(sorted({f for feats in sets.values() for f in feats}))
    entries = F.array(*[
        F.struct(F.lit(n).alias("features"), F.lit(len(f)).cast("long").alias("n_feats"), whole(f).alias("usable"))
        for n, f in sets.items()
    ])
    return labelled.select(every.alias("common"), F.explode(entries).alias("e")).groupBy("e.features", "e.n_feats").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("e.usable").alias("n_usable"), F.count_if("common").alias("n_common")
    )


def select_best(table: DataFrame, sets: Mapping[str, Sequence[str]] = FEATURE_SETS) -> DataFrame:
    """The best binary variant: PR-AUC, then ROC-AUC, then fewer features, then name."""
    n_feats = F.lit(None).cast("int")
    for name, feats in sets.items():
        n_feats = F.when(F.col("features") == name, len(feats)).otherwise(n_feats)
    return (
        table.filter(F.col("framing") == "binary")
        .withColumn("n_feats", n_feats)
        .orderBy(F.desc_nulls_last("pr_auc"), F.desc_nulls_last("roc_auc"), "n_feats", "features", "model")
        .limit(1)
    )


def score_all(frame: DataFrame, kind: str, feats: Sequence[str], framing: Framing = BINARY,
              settings: Settings = Settings()) -> DataFrame:
    """``frame`` with ``risk_score``: the positive class's probability, 4 decimals, from a fit on all rows.

    Rows that miss a feature keep a NULL score.
    """
    frame = cut_lineage(frame)
    if kind == "RF":
        scored = forest_predictions(frame, [Variant("", tuple(feats), framing)], settings)
    else:
        scored = _scored(fit_all(frame, feats, framing, settings), frame, framing, ["farm_id"])
    return frame.join(scored.select("farm_id", F.bround("score", 4).alias("risk_score")), "farm_id", "left")


def out_of_fold_scores(frame: DataFrame, kind: str, feats: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """``farm_id, oof_score``: the score of each row from a model that never saw it."""
    folded = cut_lineage(stratified_folds(frame, BINARY.label, settings.folds, settings.seed))
    scored = cross_val_predict(folded, kind, feats, BINARY, settings)
    return scored.select("farm_id", F.bround("score", 4).alias("oof_score"))


def score_v2(frame: DataFrame, feats: Sequence[str] = ("area_ha", "nb_defo_pct_200"),
             settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The older scorer: a three-class forest on a 75/25 split.

    Returns the test report and ``farm_id, risk_class, risk_score`` with P(HIGH) for every parcel.
    """
    split = cut_lineage(stratified_split(frame, THREE_CLASS.label, seed=settings.seed))
    training = split.withColumn("risk_class", F.when(~F.col("is_test"), F.col("risk_class")))
    scored = cut_lineage(forest_predictions(training, [Variant("", tuple(feats), THREE_CLASS)], settings))
    tested = scored.join(_training_rows(split, THREE_CLASS).filter("is_test").select("farm_id", "risk_class"), "farm_id")
    report = classification_report(tested, "risk_class", "predicted", THREE_CLASS.classes)
    scores = scored.select("farm_id", F.bround("score", 4).alias("risk_score"))
    return report, split.select("farm_id", "risk_class").join(scores, "farm_id", "left")


def leakage_audit(frame: DataFrame, feats: Sequence[str]) -> DataFrame:
    """``feature, is_own_loss, derived_from, roc_auc, leaks``.

    A feature leaks by its name, by being computed from the parcel's own loss under whatever name (``derived_from``
    lists the columns, empty if none), or by separating the label perfectly.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats])
    affected = (F.col("risk_binary") == "AFFECTED").cast("long").alias("hit")
    rows = frame.select(affected, F.explode(pairs).alias("p")).select("hit", "p.feature", "p.value")
    auc = ranking_metrics(rows, "value", "hit", ["feature"]).select("feature", "roc_auc")
    come_from = sources_of(frame)
    derived = F.lit("")
    for f in feats:
        derived = F.when(F.col("feature") == f, ",".join(sorted(come_from[f] & set(OWN_LOSS) - {f}))).otherwise(derived)
    own = F.col("feature").isin(*OWN_LOSS)
    perfect = (F.col("roc_auc") == 1.0) | (F.col("roc_auc") == 0.0)
    leaks = own | (derived != "") | F.coalesce(perfect, F.lit(False))
    return auc.select("feature", own.alias("is_own_loss"), derived.alias("derived_from"), "roc_auc", leaks.alias("leaks"))
