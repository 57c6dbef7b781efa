"""Cluster labels, parcels and ids."""

import random

import pytest
from pyspark.sql import functions as F

from gladeline.grid import GridSpec
from gladeline.operators import components as cc
from gladeline.plans.screening import build_parcels
from tests.test_geometry import cells_of

MASK = "row long, col long"


def brute(cells):
    left, comps = set(cells), {}
    while left:
        start = min(left)
        stack, seen = [start], {start}
        while stack:
            r, c = stack.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    n = (r + a, c + b)
                    if n in left and n not in seen:
                        seen.add(n)
                        stack.append(n)
        left -= seen
        comps[min(seen)[0] * 2**31 + min(seen)[1]] = seen
    return comps


def labels(spark, cells, parts=3):
    rows = list(cells)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, MASK).repartition(parts)
    out = {}
    for r in cc.connected_components(df).collect():
        out.setdefault(r["comp_id"], set()).add((r["row"], r["col"]))
    return out


def test_corner_contact_connects(spark):
    assert labels(spark, {(0, 0), (1, 1), (5, 5)}) == {0: {(0, 0), (1, 1)}, 5 * 2**31 + 5: {(5, 5)}}


@pytest.mark.parametrize("density", [0.15, 0.42, 0.9])
def test_random_masks(spark, density):
    rng = random.Random(int(density * 100))
    cells = {(r, c) for r in range(40) for c in range(200) if rng.random() < density}
    assert labels(spark, cells) == brute(cells)


def test_long_snake_over_word_borders(spark):
    """A cluster of great diameter: alternate full rows joined at alternate ends."""
    cells = set()
    for r in range(0, 60, 2):
        cells |= {(r, c) for c in range(200)}
        cells.add((r + 1, 199 if r % 4 == 0 else 0))
    got = labels(spark, cells)
    assert got == {0: cells}


def test_labels_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    cells = {(r, c) for r in range(25) for c in range(90) if rng.random() < 0.4}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = labels(spark, cells, 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == labels(spark, cells, 7)


def test_empty_mask(spark):
    assert cc.connected_components(spark.createDataFrame([], MASK)).count() == 0


def test_parcels_are_sized_numbered_and_whole(spark):
    rng = random.Random(9)
    cells = {(r, c) for r in range(40) for c in range(120) if rng.random() < 0.3}
    farms, runs = cc.parcels(spark.createDataFrame(sorted(cells), MASK), 3, 8)
    want = [s for _, s in sorted(brute(cells).items()) if 3 <= len(s) <= 8]
    assert [(r["farm_id"], r["n_cells"]) for r in farms.orderBy("farm_id").collect()] == [(i, len(s)) for i, s in enumerate(want)]
    assert cells_of(runs) == dict(enumerate(want))
    assert {round(r["area_ha"] - r["n_cells"] * 0.01, 9) for r in farms.collect()} == {0.0}


def test_largest_and_study_area(spark):
    runs = spark.createDataFrame(
        [(1, 0, 0, 4), (1, 1, 0, 4), (9, 20, 10, 14), (9, 21, 10, 14)], "comp_id long, row long, col_lo long, col_hi long")
    areas = cc.component_area_km2(runs, GridSpec(1000.0).pixel_area(F.col("row")))
    assert tuple(cc.largest_component(areas).first()) == (1, 10.0)  # equal areas: the smaller id
    mask = spark.createDataFrame([(r, c) for r in range(10, 13) for c in range(20, 25)], MASK)
    assert cc.study_area(mask, F.lit(1.0), 5) == (6, 15, 17, 26)  # two radii wide
    assert cc.study_area(mask, F.lit(1.0), 40, 4) == (6, 85, 50, 129)  # fine cells around 45.5, 89.5
    assert cc.study_area(spark.createDataFrame([], MASK), F.lit(1.0), 5) is None


def test_build_parcels_end_to_end(spark):
    cells = [(r, c, 0.9 if (r // 10 + c // 10) % 3 == 0 else 0.0) for r in range(60) for c in range(60)]
    df = spark.createDataFrame(cells, "row long, col long, crop_prob double")
    farms, runs = build_parcels(df, GridSpec(10.0), coarse=5, radius_m=200.0, lo=10, hi=1000)
    rows = farms.collect()
    assert rows and {r["farm_id"] for r in rows} == set(range(len(rows)))
    assert sum(r["n_cells"] for r in rows) == sum(r["col_hi"] - r["col_lo"] + 1 for r in runs.collect())
    assert all(r["geometry"].startswith('{"type":') for r in rows)
