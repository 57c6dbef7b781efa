"""Metrics by hand, folds, and models against small independent computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gladeline.plans import forests
from gladeline.plans import metrics as me
from gladeline.plans import modelling as mo
from gladeline.plans.lineage import sources_of
from gladeline.plans.scoring import scoring_run, watch_list
from gladeline.plans.screening import model_frame
from gladeline.session import cut_lineage
from gladeline.sources import store

FAST = mo.Settings(trees=10, depth=5, max_iter=100, folds=3, parallel=4)
SETS = {"A": ["x"], "B": ["x", "z"]}


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        affected = i % 10 == 0
        x = rng.gauss(2.0 if affected else 0.0, 1.0)
        pct = 0.0 if not affected else (2.0 if i % 20 == 0 else 9.0)
        rows.append((i, x, rng.random() * 50, pct, "LOW" if pct == 0 else "MEDIUM" if pct < 5 else "HIGH",
                     "AFFECTED" if affected else "CLEAN"))
    rows.append((1000, 1.0, 1.0, None, None, None))
    rows.append((1001, None, 1.0, 0.0, "LOW", "CLEAN"))
    df = spark.createDataFrame(rows, "farm_id long, x double, z double, defo_pct double, risk_class string, risk_binary string")
    return cut_lineage(df.repartition(4))


def brute_auc(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total, last, out = sum(y for _, y in pairs), 0.0, 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        hit = [y for s, y in pairs if s >= t]
        recall = sum(hit) / total
        out += (recall - last) * sum(hit) / len(hit)
        last = recall
    return out


def test_rank_metrics_with_ties(spark):
    rng = random.Random(6)
    sets = {v: [(round(rng.random(), 1 if v == "coarse" else 4), int(rng.random() < 0.3)) for _ in range(500)] for v in ("coarse", "fine")}
    rows = [(v, s, y) for v, pairs in sets.items() for s, y in pairs]
    df = spark.createDataFrame(rows, "variant string, s double, y int").repartition(5)
    got = {r["variant"]: (r["roc_auc"], r["pr_auc"]) for r in me.ranking_metrics(df, "s", "y", ["variant"]).collect()}
    for v, pairs in sets.items():
        assert got[v] == pytest.approx((brute_auc(pairs), brute_ap(pairs)))
    one = df.filter("variant = 'coarse'")
    assert me.roc_auc(one, "s", "y").first()[0] == pytest.approx(brute_auc(sets["coarse"]))
    assert me.average_precision(one, "s", "y").first()[0] == pytest.approx(brute_ap(sets["coarse"]))


def test_rank_metrics_of_one_class_are_undefined(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "s double, y int")
    assert tuple(me.ranking_metrics(df, "s", "y").first()) == (None, None)


def test_confusion_and_f1(spark):
    rows = [("A", "A")] * 5 + [("A", "B")] * 2 + [("B", "A")] + [("C", "A")]
    df = spark.createDataFrame(rows, "y string, p string")
    matrix = {(r["label"], r["predicted"]): r["n"] for r in me.confusion_matrix(df, "y", "p", ["A", "B", "C"]).collect()}
    assert len(matrix) == 9 and matrix["A", "A"] == 5 and matrix["C", "C"] == 0
    report = {r["label"]: r for r in me.classification_report(df, "y", "p", ["A", "B", "C"]).collect()}
    assert report["A"]["precision"] == pytest.approx(5 / 7) and report["A"]["recall"] == pytest.approx(5 / 7)
    assert tuple(report["C"][1:]) == (0.0, 0.0, 0.0, 1)
    assert me.macro_f1(df, "y", "p", ["A", "B", "C", "never"]).first()[0] == pytest.approx(5 / 7 / 3)
    averages = me.report_averages(df, "y", "p", ["A", "B", "C"]).first()
    assert averages["accuracy"] == pytest.approx(5 / 9) and averages["weighted_recall"] == pytest.approx(5 / 9)


def test_balanced_weights(frame):
    got = {(r["risk_binary"], round(r["weight"], 9)) for r in mo.balanced_weight(frame, "risk_binary").filter("weight is not null").collect()}
    assert got == {("AFFECTED", round(401 / 80, 9)), ("CLEAN", round(401 / 722, 9))}


def test_folds_are_even_and_stable(frame):
    a = mo.stratified_folds(frame, "risk_class", 5).select("farm_id", "risk_class", "fold").collect()
    b = mo.stratified_folds(frame.repartition(7), "risk_class", 5).select("farm_id", "fold").collect()
    assert {r["farm_id"]: r["fold"] for r in a} == {r["farm_id"]: r["fold"] for r in b}
    for cls in ("LOW", "MEDIUM", "HIGH"):
        sizes = [sum(r["fold"] == f and r["risk_class"] == cls for r in a) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    split = mo.stratified_split(frame, "risk_class").groupBy("risk_class").agg(F.count_if("is_test"), F.count("*")).collect()
    for r in split:
        assert r[1] == math.ceil(0.25 * r[2])


def test_regression_minimises_the_balanced_penalised_loss(frame):
    """Newton's method on population-scaled columns with balanced weights and penalty 1."""
    feats = ["x", "z"]
    rows = [r for r in frame.collect() if r["risk_binary"] is not None and r["x"] is not None]
    y = np.array([r["risk_binary"] == "AFFECTED" for r in rows], float)
    raw = np.array([[r[f] for f in feats] for r in rows])
    cols = np.c_[(raw - raw.mean(0)) / raw.std(0), np.ones(len(rows))]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge, beta = np.diag([1.0, 1.0, 0.0]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-cols @ beta))
        grad = cols.T @ (w * (p - y)) + ridge @ beta
        beta -= np.linalg.solve((cols * (w * p * (1 - p))[:, None]).T @ cols + ridge, grad)
    model = mo.fit_all(frame, feats, mo.BINARY, mo.Settings())
    last = model.stages[-1]
    assert [*last.coefficients, last.intercept] == pytest.approx(beta, abs=1e-3)
    assert mo.importances(model, feats) == [(f, abs(float(v))) for f, v in zip(feats, last.coefficients, strict=True)]


def test_out_of_fold_predictions_cover_every_usable_row(frame):
    folded = cut_lineage(mo.stratified_folds(frame, "risk_binary", 3))
    for kind in mo.MODELS:
        got = mo.cross_val_predict(folded, kind, ["x", "z"], mo.BINARY, FAST).collect()
        assert sorted(r["farm_id"] for r in got) == list(range(400))
        assert all(0 <= r["score"] <= 1 for r in got)
        assert brute_auc([(r["score"], r["label"] == "AFFECTED") for r in got]) > 0.8


def test_grid_best_and_scores(frame):
    table = mo.compare_models(frame, FAST, SETS).collect()
    assert len(table) == 2 * 2 * 2
    assert all((r["roc_auc"] is None) == (r["framing"] == "3-class") and 0 <= r["macro_f1"] <= 1 for r in table)
    spark = frame.sparkSession
    best = mo.select_best(spark.createDataFrame(table), SETS).first()
    top = max(r["pr_auc"] for r in table if r["framing"] == "binary")
    assert best["pr_auc"] == top
    scored = mo.score_all(frame, best["model"], SETS[best["features"]], settings=FAST).select("farm_id", "risk_score").collect()
    assert len(scored) == 402
    assert {r["farm_id"] for r in scored if r["risk_score"] is None} == {1001}


def test_selection_breaks_ties(spark):
    rows = [("RF", "binary", "B", 0.9, 0.8), ("LR", "binary", "A", 0.9, 0.8), ("RF", "binary", "A", 0.8, 0.8), ("RF", "3-class", "A", None, None)]
    table = spark.createDataFrame(rows, "model string, framing string, features string, roc_auc double, pr_auc double")
    assert mo.select_best(table, SETS).select("model", "features", "n_feats").first() == ("LR", "A", 1)


def test_older_scorer(frame):
    report, scores = mo.score_v2(frame, ["x", "z"], FAST)
    assert {r["label"] for r in report.collect()} == {"LOW", "MEDIUM", "HIGH"}
    rows = scores.collect()
    assert len(rows) == 402 and all(r["risk_score"] is None or 0 <= r["risk_score"] <= 1 for r in rows)


def test_leak_audit(frame):
    got = {r["feature"]: (r["is_own_loss"], r["leaks"]) for r in mo.leakage_audit(frame.filter("risk_binary is not null"), ["x", "z", "defo_pct"]).collect()}
    assert got == {"x": (False, False), "z": (False, False), "defo_pct": (True, True)}


def test_lineage_follows_values_and_not_names(frame, spark):
    base = frame.filter("risk_binary is not null").select("farm_id", "x", "z", "defo_pct", "risk_binary")
    made = base.withColumn("y", F.col("defo_pct") / 100).withColumn("mild", F.sqrt(F.col("y")) + F.col("x")).drop("y")
    sums = base.groupBy("farm_id").agg(F.max(F.col("defo_pct") * 2).alias("peak"), F.sum("z").alias("calm"))
    both = made.join(sums, "farm_id").withColumn("rank", F.row_number().over(Window.partitionBy("risk_binary").orderBy("peak")))
    listed = both.withColumn("some", F.explode(F.array("mild", "z"))).withColumnRenamed("z", "renamed")
    listed = listed.unionByName(listed.withColumn("calm", F.col("calm") + 1))
    found = sources_of(listed)
    own = {c: "defo_pct" in s for c, s in found.items()}
    assert own == {"farm_id": False, "x": False, "renamed": False, "defo_pct": True, "risk_binary": False, "mild": True, "peak": True, "calm": False, "rank": True, "some": True}
    python = base.select("farm_id", "defo_pct").mapInArrow(lambda batches: batches, "farm_id long, echo double")
    assert "defo_pct" in sources_of(python)["echo"]
    audit = {r["feature"]: (r["derived_from"], r["leaks"]) for r in mo.leakage_audit(made, ["x", "z", "mild"]).collect()}
    assert audit == {"x": ("", False), "z": ("", False), "mild": ("defo_pct", True)}


def test_ring_shares_are_not_derived_from_the_own_share(spark):
    from gladeline import standin

    shares = standin.shares(spark, "/root/testdata/sf0.001")
    found = sources_of(shares)
    assert not set(mo.OWN_LOSS) & found["nb_defo_pct_50"] and "defo_m2" in found["defo_pct"]


def test_model_frame_joins_and_labels(spark):
    farms = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 1.0)], "farm_id long, area_ha double")
    shares = spark.createDataFrame([(1, 0.0), (2, 7.0)], "farm_id long, defo_pct double")
    extra = spark.createDataFrame([(1, 5.0), (2, 6.0)], "farm_id long, nb_defo_pct_200 double")
    got = [tuple(r) for r in model_frame(farms, shares, extra).orderBy("farm_id").collect()]
    assert got == [(1, 2.0, 0.0, 5.0, "LOW", "CLEAN"), (2, 3.0, 7.0, 6.0, "HIGH", "AFFECTED")]


def test_a_fit_takes_a_bounded_number_of_rows(spark):
    """The frequent class is drawn from by a hash of the id, the rare one stays whole, and scoring has no bound."""
    rows = spark.range(4000).select(
        F.col("id").alias("farm_id"), (F.col("id") % 100 == 0).cast("double").alias("y"), (F.col("id") / 4000).alias("x"))
    counts = {0.0: 3960, 1.0: 40}
    kept, left = mo._bounded(rows, ["x"], counts, mo.Settings(fit_rows=400))
    assert left[1.0] == 40 and 140 < left[0.0] < 260 and kept.count() == sum(left.values())
    assert mo._bounded(rows, ["x"], counts, mo.Settings(fit_rows=4000)) == (rows, counts)
    frame = rows.select("farm_id", "x", F.when(F.col("y") == 1, "AFFECTED").otherwise("CLEAN").alias("risk_binary"))
    few = mo.Settings(trees=3, depth=3, folds=2, max_iter=20, fit_rows=400)
    assert mo.score_all(frame, "LR", ["x"], mo.BINARY, few).filter("risk_score is not null").count() == 4000


def test_usable_rows(frame):
    got = {r["features"]: tuple(r)[1:] for r in mo.usable_rows(frame, {**SETS, "Z": ["z"]}).collect()}
    assert got == {"A": (1, 401, 400, 400), "B": (2, 401, 400, 400), "Z": (1, 401, 401, 400)}


def test_the_scoring_run_stores_what_it_selects(spark, frame, tmp_path):
    path = str(tmp_path)
    store.reset_store(spark, path)
    store.append_table(frame.withColumn("assessed_at", F.lit("2026-01-01")).drop("risk_class"), path, "assessments")
    run = scoring_run(frame.withColumn("area_ha", F.lit(1.0)), path, FAST, SETS, ["LR"])
    best = mo.select_best(run.comparison, SETS).first()
    assert (run.model, run.features) == (best["model"], best["features"]) and run.comparison.count() == 4
    kept = {r["farm_id"]: r for r in store.read_table(spark, path, "assessments").collect()}
    scored = {r["farm_id"]: r for r in run.scored.collect()}
    assert kept.keys() == scored.keys() and len(kept) == 402
    assert all(kept[i]["risk_score"] == r["risk_score"] and kept[i]["risk_class"] == r["risk_class"] for i, r in scored.items())
    assert kept[1001]["risk_score"] is None and 0 <= kept[1000]["risk_score"] <= 1
    top = watch_list(run.scored, ["x"], 5).collect()
    clean = sorted(((-r["risk_score"], i) for i, r in scored.items() if r["risk_binary"] == "CLEAN" and r["risk_score"] is not None))
    assert [r["farm_id"] for r in top] == [i for _, i in clean[:5]]


def test_regressions_of_all_variants_wait_in_one_line_with_few_tasks_each(spark, monkeypatch):
    """A fit of few rows runs an iteration in one task, and no variant waits for another."""
    rng = random.Random(5)
    rows = [(i, rng.random(), rng.random(), "AFFECTED" if i % 3 else "CLEAN", ["LOW", "HIGH", "MEDIUM"][i % 3]) for i in range(240)]
    frame = spark.createDataFrame(rows, "farm_id long, a double, b double, risk_binary string, risk_class string").repartition(7)
    kind = type(frame)
    lines, parts, together, coalesce = [], [], mo._together, kind.coalesce
    monkeypatch.setattr(mo, "_together", lambda spark, jobs, parallel: (lines.append(len(jobs)), together(spark, jobs, parallel))[1])
    monkeypatch.setattr(kind, "coalesce", lambda self, n: (parts.append(n), coalesce(self, n))[1])
    settings = mo.Settings(max_iter=20, folds=3)
    got = mo.variant_predictions(frame, {"one": ["a"], "two": ["a", "b"]}, (mo.BINARY, mo.THREE_CLASS), settings, ("LR",))
    assert lines == [12, 4] and set(parts) == {1} and len(parts) == 12
    assert got.groupBy("framing", "features").agg(F.countDistinct("farm_id").alias("n")).filter("n = 240").count() == 4
    folded = mo.stratified_folds(frame, "risk_binary", 3)
    alone = mo.cross_val_predict(folded, "LR", ["a", "b"], mo.BINARY, settings)
    mine = got.filter("framing = 'binary' AND features = 'two'")
    far = mine.join(alone.select("farm_id", F.col("score").alias("s")), "farm_id").filter("abs(score - s) > 1e-6").count()
    assert far == 0 and alone.count() == mine.count() == 240


def test_a_fit_sees_every_labelled_row(spark):
    """More than a million rows, of which none is left out: the penalty and the weights of both models count them all."""
    from gladeline.catalog import queries

    n = 1_000_100
    assert queries.SETTINGS == mo.Settings()
    frame = spark.range(n).select(
        F.col("id").alias("farm_id"), (F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 10 == 0, "AFFECTED").otherwise("CLEAN").alias("risk_binary"))
    model = mo.fit_all(frame, ["x"], mo.BINARY, mo.Settings(max_iter=2))
    assert model.stages[-1].getRegParam() == pytest.approx(1.0 / n, rel=1e-12)
    matrix = forests.binned_matrix(frame, ["x"], [(mo.class_index(mo.BINARY), F.lit(None).cast("int"))], mo.Settings().fit_rows, mo.SEED)
    assert matrix.counts == {(0, -1, 0): 900_090, (0, -1, 1): 100_010} and matrix.n_rows == matrix.n_all == n
