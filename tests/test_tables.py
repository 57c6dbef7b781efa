"""Ordering, reports, labels, serving, store and files."""

import json
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gladeline.functions.geojson import to_feature, to_feature_collection
from gladeline.functions.labels import compliance_label, risk_binary, risk_class
from gladeline.grid import GridSpec
from gladeline.operators.footprints import dilate
from gladeline.operators.ordering import number_rows, running_sums, shuffled_rank
from gladeline.operators.raster import mosaic
from gladeline.operators.zonal import loss_words, parcel_loss, zonal_sum
from gladeline.plans import reports as rp
from gladeline.plans import serving as sv
from gladeline.plans.screening import clip_to_boundary
from gladeline.sources import files, schemas, store
from gladeline.sources.store import apply_scores

FARM = "farm_id long, area_ha double, n_cells long, commodity string, geometry string"
ASSESSMENT = "farm_id long, defo_m2 double, total_m2 double, defo_pct double, risk_score double, risk_class string"
SQUARE = '{"type":"Polygon","coordinates":[[[0.0,0.0],[10.0,0.0],[10.0,10.0],[0.0,10.0],[0.0,0.0]]]}'


@pytest.fixture(scope="module")
def tables(spark):
    farms = spark.createDataFrame([(i, i / 2, i * 50, "cocoa", SQUARE) for i in range(1, 9)], FARM)
    rows = [
        (1, 0.0, 10.0, 0.0, 0.2, "LOW"), (2, 0.0, 10.0, 0.0, 0.7, "LOW"), (3, 0.0, 10.0, 0.0, None, "LOW"),
        (4, 1.0, 10.0, 4.0, 0.6, "MEDIUM"), (5, 5.0, 10.0, 50.0, 0.9, "HIGH"), (6, 0.0, 10.0, 0.0, 0.7, "LOW"),
        (7, None, None, None, None, None), (8, 6.0, 10.0, 60.0, 1.0, "HIGH"),
    ]
    return farms, spark.createDataFrame(rows, ASSESSMENT)


# ---- ordering ---------------------------------------------------------------------------------------------

def test_running_sums_over_many_partitions(spark):
    rng = random.Random(2)
    values = [(k, rng.randrange(10)) for k in rng.sample(range(10_000), 3000)]
    df = spark.createDataFrame(values, "k long, v long").repartition(11)
    got = {r["k"]: r["s"] for r in running_sums(df, [F.col("k").desc()], {"s": "v"}).collect()}
    total, want = 0, {}
    for k, v in sorted(values, reverse=True):
        total += v
        want[k] = total
    assert got == want


def test_numbers_have_no_gap(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "k").repartition(9)
    got = number_rows(df, [F.col("k")], "n").collect()
    assert all(r["n"] * 3 == r["k"] for r in got) and len(got) == 1667


def test_shuffled_rank_is_exact_and_stable(spark):
    df = spark.range(4000).select(F.col("id").alias("farm_id"), F.when(F.col("id") % 50 == 0, "B").otherwise("A").alias("g"))
    a = {r["farm_id"]: (r["g"], r["rank"]) for r in shuffled_rank(df.repartition(3), "g", "farm_id", 42, 64).collect()}
    b = {r["farm_id"]: (r["g"], r["rank"]) for r in shuffled_rank(df.repartition(10), "g", "farm_id", 42).collect()}
    assert a == b
    assert sorted(r for g, r in a.values() if g == "B") == list(range(1, 81))
    assert sorted(r for g, r in a.values() if g == "A") == list(range(1, 3921))
    c = {r["farm_id"]: (r["g"], r["rank"]) for r in shuffled_rank(df, "g", "farm_id", 7).collect()}
    assert a != c


# ---- reports ----------------------------------------------------------------------------------------------

def test_describe_matches_numpy(spark):
    rng = random.Random(4)
    xs = [round(rng.random() * 5, 1) for _ in range(777)] + [0.0] * 400
    ys = [float(rng.randrange(100)) for _ in range(1000)] + [None] * 177
    df = spark.createDataFrame(list(zip(xs, ys, strict=True)), "x double, y double")
    got = {r["column"]: r for r in rp.describe(df, ["x", "y"]).collect()}
    for name, values in (("x", xs), ("y", [v for v in ys if v is not None])):
        v = np.array(values)
        want = [len(v), v.mean(), v.std(ddof=1), v.min(), *np.quantile(v, [0.25, 0.5, 0.75]), v.max()]
        assert list(got[name][1:]) == pytest.approx(want)


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert rp.quantiles(df, ["x"], {"m": 0.5, "q": 0.9}).select("m", "q").first() == pytest.approx((2.5, 7.9))


def test_counts_and_deltas(spark, tables):
    _, a = tables
    row = rp.count_where(a, hit=F.col("defo_pct") > 0, unknown=F.col("defo_pct").isNull()).first()
    assert tuple(row) == (3, 1)
    df = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (None, None), (2.0, 5.5)], "a double, b double")
    assert tuple(rp.column_delta(df, "a", "b").first()) == (2, 3.5)
    assert rp.median_threshold(a).first()["threshold"] == 50.0


def test_score_check(tables):
    _, a = tables
    assert rp.verify_scores(a, 6).first()["ok"]
    assert not rp.verify_scores(a, 8).first()["ok"]
    assert not rp.verify_scores(a.withColumn("risk_score", F.col("risk_score") + 0.5), 6).first()["ok"]
    assert not rp.verify_scores(a.withColumn("risk_score", F.lit(None).cast("double")), 0).first()["ok"]


# ---- labels -----------------------------------------------------------------------------------------------

def test_class_borders(spark):
    df = spark.createDataFrame([(0.0,), (5.3755,), (5.376,), (None,), (float("nan"),)], "p double")
    got = df.select(risk_class(F.col("p")).alias("c"), risk_binary(F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in got] == [
        ("LOW", "CLEAN"), ("MEDIUM", "AFFECTED"), ("HIGH", "AFFECTED"), (None, None), (None, None)]
    words = spark.createDataFrame([("LOW",), ("HIGH",), ("odd",)], "c string").select(compliance_label(F.col("c")))
    assert [r[0] for r in words.collect()] == ["Compliant", "Non-compliant", None]


# ---- serving ----------------------------------------------------------------------------------------------

def ids(df):
    return [r["farm_id"] for r in df.collect()]


def test_listing(tables):
    view = sv.parcels_view(*tables)
    assert ids(sv.list_farms(view)) == list(range(1, 9))
    assert ids(sv.list_farms(view, "LOW")) == [1, 2, 3, 6]
    assert ids(sv.list_farms(view, "LOW", 0.7)) == [2, 6]
    assert ids(sv.list_farms(view, limit=2, offset=3)) == [4, 5]
    assert ids(sv.get_farm(view, 4)) == [4] and ids(sv.get_farm(view, 99)) == []
    assert ids(sv.page_after(view, 2, 6)) == [7, 8]
    assert ids(sv.browse(view, ["HIGH", "MEDIUM"], 0)) == [4, 5, 8]
    assert ids(sv.browse(view, ["HIGH", "MEDIUM"], 1, 2)) == [8]


@pytest.mark.parametrize("offset", [0, 7, 333, 995, 2000])
def test_pages_at_any_offset_with_several_rows_a_parcel(spark, offset):
    df = spark.range(1000).select((F.col("id") % 500).alias("farm_id"), F.col("id").alias("assessment"))
    got = sv.page(df, 20, offset).collect()
    assert [r["farm_id"] for r in got] == sorted(2 * list(range(500)))[offset : offset + 20]
    assert len({r["assessment"] for r in got}) == len(got)


def test_lookup_takes_the_newest_assessment(spark):
    df = spark.createDataFrame([(1, 0.1, "2020"), (1, 0.9, "2022"), (1, 0.5, "2021")], "farm_id long, risk_score double, assessed_at string")
    assert sv.get_farm(df, 1).first()["risk_score"] == 0.9


def test_scores_that_repeat_a_farm_do_not_multiply_rows(spark):
    old = spark.createDataFrame([(1, 0.0, "LOW"), (2, 0.0, "LOW")], "farm_id long, risk_score double, risk_class string")
    new = spark.createDataFrame([(1, 0.4, "MEDIUM"), (1, 0.8, "HIGH")], "farm_id long, risk_score double, risk_class string")
    assert sorted(tuple(r) for r in apply_scores(old, new).collect()) == [(1, 0.8, "HIGH"), (2, 0.0, "LOW")]


def test_masked_values_hide_no_older_ones(spark):
    scenes = spark.createDataFrame([(0, 0, 1, 0.9, 5.0), (0, 0, 2, None, 6.0), (1, 0, 1, None, None)], "row long, col long, at int, a double, b double")
    assert sorted(tuple(r) for r in mosaic(scenes, ["at"], ["a", "b"]).collect()) == [(0, 0, 0.9, 6.0), (1, 0, None, None)]


def test_parcel_without_a_cell_centre_keeps_its_row(spark):
    runs = spark.createDataFrame([(1, 0, 0, 1)], "farm_id long, row long, col_lo long, col_hi long")
    cells = spark.createDataFrame([(0, 0, 1, 22, 100.0)], "row long, col long, forest2020 int, lossyear int, area_m2 double")
    all_parcels = spark.createDataFrame([(1,), (2,)], "farm_id long")
    got = {r["farm_id"]: r["total_m2"] for r in parcel_loss(runs, loss_words(cells), GridSpec(10.0), all_parcels).collect()}
    assert got == {1: 100.0, 2: None}
    assert {r["farm_id"] for r in zonal_sum(runs, cells, ["area_m2"], parcels=all_parcels).collect()} == {1, 2}


def test_a_wide_parcel_is_spread_over_tasks(spark):
    wide = spark.createDataFrame([(1, r, 0, 200_000) for r in range(8)], "farm_id long, row long, col_lo long, col_hi long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = dilate(wide, [2]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) > 4 and max(r["count"] for r in rows) < 0.5 * sum(r["count"] for r in rows)


def test_warnings_rank_unscored_last_and_break_ties_by_id(tables):
    view = sv.parcels_view(*tables)
    assert ids(sv.early_warning(view)) == [2, 6, 1, 3]
    assert ids(sv.top_loss(view, 3)) == [8, 5, 4]


@pytest.mark.parametrize("bad", [
    {"risk_class": "NONE"}, {"min_risk_score": 1.5}, {"limit": 0}, {"limit": 10_001}, {"offset": -1}])
def test_bad_requests(tables, bad):
    with pytest.raises(ValueError):
        sv.list_farms(sv.parcels_view(*tables), **bad)


def test_warning_limit(tables):
    with pytest.raises(ValueError):
        sv.early_warning(sv.parcels_view(*tables), 4101)


def test_stats_document(tables):
    farms, a = tables
    doc = sv.stats_document(farms, a).first()
    assert (doc["total_parcels"], doc["total_area_ha"], doc["unclassified"]) == (8, 18.0, 1)
    assert [(e["risk_class"], e["count"], e["avg_risk_score"]) for e in doc["by_risk_class"]] == [
        ("HIGH", 2, 0.95), ("MEDIUM", 1, 0.6), ("LOW", 4, 0.5333)]
    empty = sv.stats_document(farms.limit(0), a.limit(0)).first()
    assert (empty["total_parcels"], empty["total_area_ha"], empty["by_risk_class"]) == (0, 0.0, [])
    assert [(r["risk_class"], r["label"], r["count"]) for r in sv.class_tiles(a).collect()] == [
        ("HIGH", "Non-compliant", 2), ("MEDIUM", "Needs review", 1), ("LOW", "Compliant", 4)]


def test_features(tables):
    view = sv.parcels_view(*tables)
    doc = json.loads(to_feature(view).filter("farm_id = 7").first()["feature"])
    assert doc["geometry"] == json.loads(SQUARE)
    assert doc["properties"] == {"farm_id": 7, "area_ha": 3.5, "defo_pct": None, "risk_score": None, "risk_class": None}
    page = to_feature_collection(sv.list_farms(view, limit=3, offset=2), F.col("farm_id"))
    doc = json.loads(page.first()["collection"])
    assert doc["type"] == "FeatureCollection"
    assert [f["properties"]["farm_id"] for f in doc["features"]] == [3, 4, 5]
    none = to_feature_collection(sv.list_farms(view, "HIGH", 1.0, offset=5), F.col("farm_id")).first()["collection"]
    assert json.loads(none)["features"] == []
    whole = to_feature_collection(view, F.col("farm_id"), most=view.count()).first()["collection"]
    assert len(json.loads(whole)["features"]) == view.count()
    with pytest.raises(Exception, match="at most 3 features"):
        to_feature_collection(view, F.col("farm_id"), most=3).collect()


# ---- store and files --------------------------------------------------------------------------------------

def test_store_round_trip(spark, tables, tmp_path):
    farms, a = tables
    path = str(tmp_path)
    store.reset_store(spark, path)
    assert store.read_table(spark, path, "farms").count() == 0
    store.append_table(store.with_defaults(farms.drop("commodity"), "2026-01-02"), path, "farms")
    store.append_table(store.with_defaults(a, "2026-01-02"), path, "assessments")
    rows = store.read_table(spark, path, "assessments")
    assert rows.schema.simpleString() == schemas.ASSESSMENTS.simpleString()
    assert rows.count() == 8 and rows.filter("assessed_at is null").count() == 0
    assert {r[0] for r in store.read_table(spark, path, "farms").select("commodity").collect()} == {"cocoa"}
    scores = spark.createDataFrame([(1, 0.5, "LOW"), (4, 0.1, "HIGH"), (77, 1.0, "LOW")], "farm_id long, risk_score double, risk_class string")
    store.write_snapshot(store.apply_scores(rows, scores), path, "assessments")
    after = {r["farm_id"]: (r["risk_score"], r["risk_class"]) for r in store.read_table(spark, path, "assessments").collect()}
    assert after[1] == (0.5, "LOW") and after[4] == (0.1, "HIGH") and after[5] == (0.9, "HIGH") and len(after) == 8
    store.reset_store(spark, path)
    assert store.read_table(spark, path, "assessments").count() == 0


def test_a_failed_snapshot_leaves_the_table(spark, tables, tmp_path):
    _, a = tables
    path = str(tmp_path)
    store.reset_store(spark, path)
    store.append_table(a, path, "assessments")
    rows = store.read_table(spark, path, "assessments")
    broken = rows.withColumn("risk_score", F.raise_error(F.lit("no score")).cast("double"))
    with pytest.raises(Exception, match="no score"):
        store.write_snapshot(broken, path, "assessments")
    assert store.read_table(spark, path, "assessments").count() == 8
    store.write_snapshot(rows.filter("farm_id > 2"), path, "assessments")
    assert rows.count() == 8  # the version a reader began with
    assert store.read_table(spark, path, "assessments").count() < 8


def _stored_files(path):
    return {str(f): f.stat().st_mtime_ns for f in Path(path).glob("assessments/part=*/bucket=*/*.parquet")}


def _brute_force(steps):
    """Rows after appends and updates, one by one."""
    rows = []
    for kind, given in steps:
        if kind == "append":
            rows += [dict(r) for r in given]
        else:
            for change in given:
                for row in rows:
                    if row["farm_id"] == change["farm_id"]:
                        row.update(change)
    return sorted((r["farm_id"], r["defo_pct"], r["risk_score"], r["risk_class"]) for r in rows)


def _merged_rows(df):
    return sorted(tuple(r) for r in df.select("farm_id", "defo_pct", "risk_score", "risk_class").collect())


@pytest.mark.parametrize("most", [store.MOST_PATCHES, 0])
def test_updates_merge_on_read(spark, tmp_path, monkeypatch, most):
    """Loads and updates in turn against a plain list; a farm with many rows, repeated changes, NULL as a value."""
    monkeypatch.setattr(store, "MOST_PATCHES", most)
    path, kinds = str(tmp_path), "farm_id long, defo_pct double, risk_score double, risk_class string"
    store.reset_store(spark, path, buckets=8)

    def row(i, n=0):
        return {"farm_id": i, "defo_pct": float(n), "risk_score": 0.1, "risk_class": "LOW"}

    steps = [
        ("append", [row(i) for i in range(200)] + [row(7, n) for n in range(1, 300)]),
        ("update", [{"farm_id": i, "risk_score": 0.5 + i / 1000} for i in (3, 7, 50, 999)]),
        ("append", [row(i, 1) for i in (3, 7, 300)]),
        ("update", [{"farm_id": i, "risk_class": "HIGH", "defo_pct": 42.0} for i in (3, 300, 120)]),
        ("update", [{"farm_id": 50, "risk_score": -1.0}]),
    ]
    for nth, (kind, given) in enumerate(steps):
        schema = ", ".join(f for f in kinds.split(", ") if f.split()[0] in given[0])
        df = spark.createDataFrame(given, schema)
        if kind == "append":
            store.append_table(df, path, "assessments")
        else:
            before = _stored_files(path)
            store.update_table(df.unionByName(df), path, "assessments")
            after = _stored_files(path)
            assert before.items() <= after.items() and len(after) > len(before)
        assert _merged_rows(store.read_table(spark, path, "assessments")) == _brute_force(steps[: nth + 1])
    began = store.read_table(spark, path, "assessments")
    want = _brute_force(steps)
    assert _merged_rows(store.read_table(spark, path, "assessments", [7, 300, 5])) == [r for r in want if r[0] in (5, 7, 300)]
    before = _stored_files(path)
    store.compact_table(spark, path, "assessments")
    entries, _ = store._manifest(spark, path, "assessments")
    assert not any(e.patch for e in entries) and len({e.bucket for e in entries}) == len(entries) == 8
    assert len({e.part for e in entries}) == 2  # buckets without changes keep the files of the first load
    assert before.items() <= _stored_files(path).items()
    assert _merged_rows(store.read_table(spark, path, "assessments")) == want == _merged_rows(began)
    store.update_table(spark.createDataFrame([(3, None)], "farm_id long, risk_score double"), path, "assessments")
    assert [r["risk_score"] for r in store.read_table(spark, path, "assessments", [3]).collect()] == [None, None]


def test_updates_that_change_nothing(spark, tmp_path):
    path = str(tmp_path)
    store.reset_store(spark, path)
    change = spark.createDataFrame([(1, 0.5), (None, 0.7)], "farm_id long, risk_score double")
    store.update_table(change, path, "assessments")
    store.compact_table(spark, path, "assessments")
    assert store.read_table(spark, path, "assessments").count() == 0
    store.append_table(change, path, "assessments")
    store.update_table(change.limit(0).withColumn("risk_class", F.lit("X")), path, "assessments")
    store.update_table(change.withColumn("risk_score", F.col("risk_score") * 2), path, "assessments")
    got = {(r["farm_id"], r["risk_score"]) for r in store.read_table(spark, path, "assessments").collect()}
    assert got == {(1, 1.0), (None, 0.7)}
    for wrong in (change.select("farm_id"), change.withColumn("colour", F.lit(1))):
        with pytest.raises(ValueError):
            store.update_table(wrong, path, "assessments")


def test_a_failed_update_leaves_the_table(spark, tmp_path):
    path = str(tmp_path)
    store.reset_store(spark, path)
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7)], "farm_id long, risk_score double")
    store.append_table(rows, path, "assessments")
    with pytest.raises(Exception, match="no score"):
        store.update_table(rows.withColumn("risk_score", F.raise_error(F.lit("no score")).cast("double")), path, "assessments")
    got = {(r["farm_id"], r["risk_score"]) for r in store.read_table(spark, path, "assessments").collect()}
    assert got == {(1, 0.5), (2, 0.7)}


def test_boundaries_of_any_properties(spark, tmp_path):
    def square(x, y, side):
        return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]

    features = [
        {"type": "Feature", "properties": {"country_na": "Colombia", "n": 1},
         "geometry": {"type": "MultiPolygon", "coordinates": [[square(0, 0, 50), square(10, 10, 20)], [square(70, 70, 20)]]}},
        {"type": "Feature", "properties": {"country_na": "Colombia"}, "geometry": {"type": "Polygon", "coordinates": [square(40, 40, 20)]}},
        {"type": "Feature", "properties": None, "geometry": {"type": "Polygon", "coordinates": [square(0, 0, 100)]}},
    ]
    want = {(r, c) for r in range(5) for c in range(5)} - {(r, c) for r in (1, 2) for c in (1, 2)}
    want |= {(r, c) for r in (7, 8) for c in (7, 8)} | {(r, c) for r in (4, 5) for c in (4, 5)}
    cells = spark.createDataFrame([(r, c) for r in range(10) for c in range(10)], "row long, col long")
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(f) for f in features))
    (tmp_path / "whole.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    for layout, name in (("lines", "lines.json"), ("collection", "whole.json")):
        chosen = files.read_boundary(files.read_boundaries(spark, str(tmp_path / name), layout), "properties.country_na", "Colombia")
        assert {tuple(r) for r in clip_to_boundary(cells, chosen, GridSpec(10.0)).collect()} == want


def test_scores_reach_every_row_of_a_farm(spark):
    rows = spark.createDataFrame([(1, 0.1, "LOW"), (1, 0.2, "LOW"), (2, 0.3, "LOW")], "farm_id long, risk_score double, risk_class string")
    new = spark.createDataFrame([(1, 0.9, "HIGH")], "farm_id long, risk_score double, risk_class string")
    got = sorted(tuple(r) for r in store.apply_scores(rows, new).collect())
    assert got == [(1, 0.9, "HIGH"), (1, 0.9, "HIGH"), (2, 0.3, "LOW")]


def test_key_checks_and_latest(spark):
    farms = spark.createDataFrame([(1,), (2,), (2,)], "farm_id long")
    rows = spark.createDataFrame([(1, "2026-01-01", 0.1), (1, "2026-02-01", 0.2), (9, "2026-01-01", 0.3)], "farm_id long, assessed_at string, risk_score double")
    got = {tuple(r) for r in store.check_keys(farms, rows).collect()}
    assert got == {("farm key", 2, 2), ("no farm", 9, 1), ("many assessments", 1, 2)}
    assert {(r["farm_id"], r["risk_score"]) for r in store.latest_assessments(rows).collect()} == {(1, 0.2), (9, 0.3)}


def test_geojson_files(spark, tables, tmp_path):
    farms, _ = tables
    path = str(tmp_path / "lines")
    files.write_geojson(farms, path)
    want = {tuple(r) for r in farms.collect()}
    back = files.read_geojson(spark, path).select(*farms.columns)
    assert {tuple(r) for r in back.collect()} == want
    # a collection written one feature per line, and the same document in one piece
    lines = [r["feature"] for r in to_feature(farms.withColumnRenamed("n_cells", "count"), ["farm_id", "area_ha", "count", "commodity"]).collect()]
    text = '{\n"type": "FeatureCollection",\n"features": [\n' + ",\n".join(lines) + "\n]\n}\n"
    (tmp_path / "c.geojson").write_text(text)
    for layout in ("lines", "collection"):
        got = files.read_geojson(spark, str(tmp_path / "c.geojson"), layout).select(*farms.columns)
        assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(ValueError):
        files.read_geojson(spark, path, "other")


def test_feature_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 10.0, 0.1, 0.2, None), (2, 5.5, None, 1.0, 2.0, 3.0)], schemas.FEATURES)
    for fmt in ("csv", "parquet"):
        files.write_features(df, str(tmp_path / fmt), fmt)
    back = files.read_features(spark, str(tmp_path / "csv"), schemas.FEATURES)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    cut = files.read_features(spark, str(tmp_path / "csv"), schemas.FEATURES, ["farm_id", "nb_defo_pct_200"])
    assert sorted(map(tuple, cut.collect())) == [(1, 0.1), (2, 1.0)]
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
