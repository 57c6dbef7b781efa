"""Zonal sums, rings and distances against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gladeline.functions.numbers import cap_distance, share_pct
from gladeline.grid import GridSpec
from gladeline.operators.footprints import centroid
from gladeline.operators.proximity import (
    both_distances, distance_feature, erase_own, masked_distance, nearest_loss, sample_at,
)
from gladeline.operators.zonal import loss_shares, loss_words, parcel_context, parcel_loss, zonal_sum
from tests.test_geometry import RUN, as_runs, disc

CELL = "row long, col long, forest2020 int, lossyear int, area_m2 double"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    cells = {}
    for r in range(60):
        for c in range(150):
            if rng.random() < 0.7:
                cells[r, c] = (rng.random() < 0.7, 22 if rng.random() < 0.08 else rng.choice([0, 0, 20]))
    feet = {}
    for f in range(1, 40):
        r0, c0 = rng.randrange(50), rng.randrange(140)
        feet[f] = {(r0 + a, c0 + b) for a in range(rng.randrange(1, 9)) for b in range(rng.randrange(1, 9))}
    feet[40] = {(500, 500)}
    loss = {k for k, (forest, year) in cells.items() if forest and year >= 21}
    frame = spark.createDataFrame([(r, c, int(f), y, 100.0) for (r, c), (f, y) in cells.items()], CELL)
    runs = spark.createDataFrame(as_runs(feet), RUN)
    lost = spark.createDataFrame(sorted(loss), "row long, col long")
    return {"cells": cells, "feet": feet, "loss": loss, "frame": frame, "runs": runs, "lost": lost}


def centre_of(cells):
    n = len(cells)
    return (2 * sum(r for r, _ in cells) + n) // (2 * n), (2 * sum(c for _, c in cells) + n) // (2 * n)


def test_own_and_ring_sums(world):
    words = loss_words(world["frame"])
    got = {r["farm_id"]: r for r in loss_shares(world["runs"], words, GridSpec(10.0), [2, 6]).collect()}
    assert got.keys() == world["feet"].keys()
    for f, foot in world["feet"].items():
        for suffix, zone in (("", foot), ("_2", disc(foot, 2) - foot), ("_6", disc(foot, 6) - foot)):
            valid = zone & world["cells"].keys()
            want = (100.0 * len(zone & world["loss"]), 100.0 * len(valid)) if valid else (None, None)
            assert (got[f][f"defo_m2{suffix}"], got[f][f"total_m2{suffix}"]) == want


def test_zonal_sum_over_word_borders_negative_columns_and_nulls(spark):
    rng = random.Random(9)
    cells = {(r, c): (rng.random(), rng.choice([None, 1.0, 2.5])) for r in range(-2, 4) for c in range(-200, 200) if rng.random() < 0.6}
    cells |= {(r, c): (0.5, None) for r, c in [(9, -64), (9, -1), (9, 0), (9, 63), (9, 64), (9, 127)]}
    frame = spark.createDataFrame([(r, c, *v) for (r, c), v in cells.items()], "row int, col int, a double, b double")
    runs = [(f, rng.randrange(-2, 4), lo, lo + rng.randrange(0, 180)) for f in range(60) for lo in [rng.randrange(-200, 150)]]
    runs += [(100 + i, 9, a, b) for i, (a, b) in enumerate([(-64, -64), (-64, -1), (63, 64), (0, 127), (1, 62), (-64, 127)])]
    table = spark.createDataFrame(runs, "farm_id long, row int, col_lo int, col_hi int")
    for pruned in (True, False):
        got = {r["farm_id"]: (r["a"], r["b"]) for r in zonal_sum(table, frame, ["a", "b"], pruned=pruned).collect()}
        assert len(got) == len(runs)
        for farm, row, lo, hi in runs:
            inside = [cells[row, c] for c in range(lo, hi + 1) if (row, c) in cells]
            for at in (0, 1):
                values = [v[at] for v in inside if v[at] is not None]
                assert got[farm][at] == (pytest.approx(sum(values), abs=1e-9) if values else None)


def test_zonal_sum_takes_no_footprint_apart(spark):
    """A footprint of a million cells joins as its words, and whole numbers add up exactly."""
    runs = spark.range(1000).select(F.lit(1).cast("long").alias("farm_id"), F.col("id").alias("row"), F.lit(0).cast("long").alias("col_lo"), F.lit(999).cast("long").alias("col_hi"))
    frame = spark.range(0, 200_000).select((F.col("id") % 1000).alias("row"), F.floor(F.col("id") / 1000 * 5).alias("col"), F.lit(3.0).alias("a"))
    out = zonal_sum(runs, frame, ["a"], pruned=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(made) == 1 and "[word#" in made[0], made
    assert out.first()["a"] == 600_000.0


def test_zonal_sum_of_any_band_agrees_with_words(world):
    bands = world["frame"].withColumn("defo_m2", F.when((F.col("lossyear") >= 21) & (F.col("forest2020") == 1), 100.0).otherwise(0.0))
    a = {r["farm_id"]: (r["defo_m2"], r["area_m2"]) for r in zonal_sum(world["runs"], bands, ["defo_m2", "area_m2"]).collect()}
    b = {r["farm_id"]: (r["defo_m2"], r["total_m2"]) for r in parcel_loss(world["runs"], loss_words(world["frame"]), GridSpec(10.0)).collect()}
    assert a == b


def test_null_band_does_not_shrink_the_other(spark):
    cells = spark.createDataFrame([(0, 0, None, 100.0), (0, 1, 5.0, 100.0)], "row long, col long, defo_m2 double, total_m2 double")
    runs = spark.createDataFrame([(1, 0, 0, 1)], RUN)
    assert tuple(zonal_sum(runs, cells, ["defo_m2", "total_m2"]).first()) == (1, 5.0, 200.0)


def test_area_follows_latitude(spark):
    grid = GridSpec(10.0, lat0=60.0, cell_deg=1.0)
    area = spark.range(2).select(grid.pixel_area(F.col("id")).alias("a")).collect()
    radius = 6_371_008.8
    want = radius**2 * math.radians(1) * (math.sin(math.radians(60)) - math.sin(math.radians(59)))
    assert area[0]["a"] == pytest.approx(want)
    assert area[1]["a"] > area[0]["a"]


def test_empty_parcel_has_no_share(world):
    row = parcel_context(world["runs"], loss_words(world["frame"]), GridSpec(10.0), [20]).filter("farm_id = 40").first()
    assert (row["defo_pct"], row["nb_defo_pct_20"]) == (None, None)


def brute(point, loss, cap):
    best = min(((point[0] - r) ** 2 + (point[1] - c) ** 2 for r, c in loss), default=None)
    return None if best is None or best > cap * cap else best


@pytest.mark.parametrize("cap", [3, 20, 256])
def test_nearest_equals_brute_force(world, cap):
    points = centroid(world["runs"])
    plain = {r[0]: r[1] for r in nearest_loss(points, world["lost"], cap).collect()}
    masked = {r[0]: r[1] for r in nearest_loss(points, world["lost"], cap, world["runs"]).collect()}
    for f, foot in world["feet"].items():
        for got, loss in ((plain, world["loss"]), (masked, world["loss"] - foot)):
            want = brute(centre_of(foot), loss, cap)
            assert (got[f] is None) == (want is None)
            if want is not None:
                assert round(got[f] ** 2) == want


def test_sparse_loss_far_away(spark):
    """One loss cell, points at and just past the radius, negative coordinates included."""
    lost = spark.createDataFrame([(0, 0)], "row long, col long")
    points = spark.createDataFrame(
        [(1, 0, 256), (2, 0, 257), (3, -256, 0), (4, -181, 181), (5, -182, 182)], "farm_id long, crow long, ccol long")
    got = {r[0]: r[1] for r in nearest_loss(points, lost).collect()}
    assert got[1] == 256 and got[2] is None and got[3] == 256 and got[5] is None
    assert got[4] == pytest.approx(math.sqrt(2) * 181)


def test_no_loss_at_all_means_the_cap(spark, world):
    lost = spark.createDataFrame([], "row long, col long")
    got = distance_feature(centroid(world["runs"]), lost)
    assert {r["dist_to_defo_m"] for r in got.collect()} == {2560.0}


def test_masked_distance_rules(world):
    points, lost, runs = centroid(world["runs"]), world["lost"], world["runs"]
    shares = parcel_loss(runs, loss_words(world["frame"]), GridSpec(10.0))
    plain = distance_feature(points, lost, 10.0, 200.0)
    by_split = {r[0]: r[1] for r in masked_distance(shares, plain, points, lost, runs, 10.0, 200.0).collect()}
    by_all = {r[0]: r[1] for r in distance_feature(points, lost, 10.0, 200.0, runs, "m").collect()}
    both = {r[0]: (r[1], r[2]) for r in both_distances(points, lost, runs, 10.0, 200.0).collect()}
    known = {r["farm_id"]: r["defo_pct"] for r in shares.collect()}
    assert by_split == {f: v for f, v in by_all.items() if known[f] is not None}
    assert {f: v[1] for f, v in both.items()} == by_all
    for f, (a, b) in both.items():
        assert b >= a
        if known[f] == 0:
            assert b == a


def test_only_own_loss(spark):
    """Loss inside the parcel only: 0 m plain, the cap once masked."""
    runs = spark.createDataFrame([(1, 4, 4, 6), (1, 5, 4, 6), (1, 6, 4, 6)], RUN)
    lost = spark.createDataFrame([(5, 5)], "row long, col long")
    assert tuple(both_distances(centroid(runs), lost, runs).first()) == (1, 0.0, 2560.0)
    near = spark.createDataFrame([(5, 5), (5, 7)], "row long, col long")
    assert tuple(both_distances(centroid(runs), near, runs).first()) == (1, 0.0, 20.0)


def test_sample_and_erase(world):
    points = centroid(world["runs"])
    got = {r[0]: r[1] for r in sample_at(points, world["frame"], "lossyear").collect()}
    for f, foot in world["feet"].items():
        cell = world["cells"].get(centre_of(foot))
        assert got[f] == (cell[1] if cell else None)
    left = {tuple(r) for r in erase_own(world["lost"], world["runs"], 7).collect()}
    assert left == world["loss"] - world["feet"][7]


def test_share_and_cap_expressions(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1600.0), (None, 5.0)], "a double, b double")
    got = [r[0] for r in df.select(share_pct(F.col("a"), F.col("b"))).collect()]
    assert got == [None, 0.062, None]  # 0.0625 rounds to the even digit
    px = spark.createDataFrame([(None,), (1.0,), (300.0,)], "p double")
    assert [r[0] for r in px.select(cap_distance(F.col("p"), 10.0, 2560.0)).collect()] == [2560.0, 10.0, 2560.0]


def test_context_of_a_parcel_without_a_cell(spark):
    """It owns no cell centre: NULL shares, and the distance from its polygon's centroid."""
    from gladeline.operators.footprints import polygon_runs
    from gladeline.plans.screening import context_features

    def square(x, y, size):
        return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]]

    cells = spark.createDataFrame(
        [(r, c, 1, 22 if (r, c) == (5, 9) else 0) for r in range(12) for c in range(12)],
        "row long, col long, forest2020 int, lossyear int")
    parcels = spark.createDataFrame(
        [(1, square(10.0, 10.0, 20.0)), (2, square(31.0, 52.0, 2.0))],
        "farm_id long, rings array<array<struct<x:double,y:double>>>")
    grid = GridSpec(10.0)
    got = context_features(polygon_runs(parcels, grid), cells, grid, [20], 500.0, parcels)
    rows = {r["farm_id"]: r.asDict() for r in got.collect()}
    assert set(rows) == {1, 2} and rows[1]["total_m2"] == 400.0
    assert rows[2]["defo_pct"] is None and rows[2]["nb_defo_pct_20"] is None
    assert rows[2]["dist_to_defo_m"] == rows[2]["dist_to_defo_m_masked"] == 60.0


def test_buffers_meet_the_raster_by_tile_as_word_by_word(spark, monkeypatch):
    """Parcels over tile borders, below zero, of several pieces and on one spot; no exchange of the words of a buffer."""
    from gladeline.operators import zonal
    from gladeline.operators.footprints import dilate

    monkeypatch.setattr(zonal, "PART_MARKS", 500)
    rng = random.Random(5)
    cells = [(r, c, 1, 22 if rng.random() < 0.2 else 0) for r in range(-80, 90) for c in range(-90, 300) if rng.random() < 0.6]
    words = loss_words(spark.createDataFrame(cells, "row long, col long, forest2020 int, lossyear int"))
    runs = [(1, r, 250, 262) for r in range(60, 68)] + [(2, -3, -5, 70), (2, -1, -5, -4), (2, -1, 66, 70)] + [(3, 200, 900, 950)]
    runs += [(i, r, 10, 14) for i in range(10, 60) for r in (0, 1)]
    runs = spark.createDataFrame(runs, "farm_id long, row long, col_lo long, col_hi long")
    got = loss_shares(runs, words, GridSpec(10.0), [3, 70])
    met = dilate(runs, [3, 70]).join(words, ["row", "word"])

    def of(zone, bits):
        return F.sum(F.bit_count(F.expr(f"({zone}) & {bits}")) * 100.0)

    zones = {"": "own", "_3": "b_3 & ~own", "_70": "b_70 & ~own"}
    want = met.groupBy("farm_id").agg(*[of(z, bits).alias(f"{n}_m2{x}") for x, z in zones.items() for n, bits in (("defo", "loss"), ("total", "valid"))])
    want = {r["farm_id"]: r.asDict() for r in want.collect()}
    rows = {r["farm_id"]: r.asDict() for r in got.collect()}
    assert set(rows) == {1, 2, 3, *range(10, 60)} and rows[3]["total_m2_70"] is None
    for k, row in want.items():
        assert {c: v or 0.0 for c, v in rows[k].items()} == {c: v or 0.0 for c, v in row.items()}
    text = got._jdf.queryExecution().executedPlan().toString()
    above = text.split("SortMergeJoin [trow")[0]
    assert "pos#" in above and all("pos#" not in line and "word#" not in line for line in above.splitlines() if "Exchange" in line)


def test_a_task_merges_half_a_million_words_at_most(spark):
    """100 cells with buffers of 1,000 cells: 6.4 million words or more, known before anything is widened."""
    runs = spark.createDataFrame([(i, 5000, 3000 + 40 * i, 3000 + 40 * i) for i in range(100)], "farm_id long, row long, col_lo long, col_hi long")
    words = spark.createDataFrame([(5000, 50, -1, 1)], "row long, word long, valid long, loss long")
    plan = loss_shares(runs, words, GridSpec(10.0), [1000])._jdf.queryExecution().optimizedPlan().toString()
    parts = {int(n) for n in re.findall(r"RepartitionByExpression \[trow#.*\], (\d+)", plan)}
    assert len(parts) == 1 and min(parts) >= 2 * 1001 * 32 * 100 // 500_000


def test_a_wide_radius_joins_few_squares_of_a_point(spark, monkeypatch):
    """Loss everywhere: of the seventy sheets around a point only those that can hold the nearest cell are shuffled."""
    from gladeline.operators import proximity

    sizes, join = [], proximity.join_to_unique

    def counted(many, *rest, **more):
        sizes.append(many.count())
        return join(many, *rest, **more)

    monkeypatch.setattr(proximity, "join_to_unique", counted)
    lost = [(r, c) for r in range(-400, 400, 9) for c in range(-400, 400, 7)]
    at = [(i, 13 * i - 130, 97 - 17 * i) for i in range(20)]
    points = spark.createDataFrame(at, "farm_id long, crow long, ccol long")
    got = {r[0]: r[1] for r in nearest_loss(points, spark.createDataFrame(lost, "row long, col long")).collect()}
    assert all(round(got[i] ** 2) == brute((r, c), lost, 256) for i, r, c in at)
    assert len(sizes) == 3 and max(sizes) <= 25 * len(at)


def test_own_loss_that_fills_whole_sheets_is_no_bound(spark):
    """All loss of the own sheets is the parcel's; beyond a wide radius it must not close the squares farther off."""
    runs = spark.createDataFrame([(1, r, 0, 511) for r in range(64)], "farm_id long, row long, col_lo long, col_hi long")
    lost = [(r, c) for r in range(0, 64, 5) for c in range(0, 512, 5)] + [(31, -200), (200, 700)]
    points = spark.createDataFrame([(1, 31, 20)], "farm_id long, crow long, ccol long")
    lost = spark.createDataFrame(lost, "row long, col long")
    assert [r[1] for r in nearest_loss(points, lost, 256, runs).collect()] == [220.0]
