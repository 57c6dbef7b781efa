"""The distance band against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gladeline.operators.distance import distance_band, distance_metres, squared_distances
from gladeline.operators.words import cells_to_words

CELL = "row int, col int, loss boolean"


def band_of(spark, cells, reach, **more):
    frame = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], CELL).repartition(3)
    words = cells_to_words(frame, valid=F.lit(True), loss=F.col("loss"))
    return distance_band(words, reach, **more)


@pytest.mark.parametrize("seed,reach,tile_shift", [(1, 3, 6), (2, 17, 6), (3, 70, 6), (4, 150, 7), (5, 40, 9)])
def test_band_equals_brute_force_over_tiles(spark, seed, reach, tile_shift):
    rng = random.Random(seed)
    cells = {(r, c): rng.random() < 0.002 for r in range(-70, 90) for c in range(-150, 150) if rng.random() < 0.6}
    got = {(r["row"], r["col"]): r["d2"] for r in band_of(spark, cells, reach, tile_shift=tile_shift).collect()}
    lost = np.array([k for k, v in cells.items() if v])
    assert got.keys() == cells.keys()
    for at, d2 in got.items():
        nearest = int(((lost - at) ** 2).sum(axis=1).min())
        assert d2 == (nearest if nearest <= reach * reach else None)


def test_dense_loss_no_loss_and_no_cells(spark):
    cells = {(r, c): True for r in range(10) for c in range(100)}
    assert {r["d2"] for r in band_of(spark, cells, 5).collect()} == {0}
    none = band_of(spark, {k: False for k in cells}, 5)
    assert {r["d2"] for r in none.collect()} == {None} and none.count() == 1000
    assert [r[2] for r in distance_metres(none, 10.0, 50.0).limit(2).collect()] == [50.0, 50.0]
    assert band_of(spark, cells, 5).limit(0).count() == 0


def test_metres_are_capped_and_rounded(spark):
    band = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 25), (0, 3, 26), (0, 4, None)], "row long, col long, d2 long")
    assert [r[2] for r in distance_metres(band, 10.0, 50.0).orderBy("col").collect()] == [0.0, 14.1, 50.0, 50.0, 50.0]


def test_one_shuffle_and_bounded_work(spark):
    cells = {(0, c): c == 0 for c in range(200)}
    plan = band_of(spark, cells, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    far = np.zeros((40, 40), bool)
    far[20, 20] = True
    assert squared_distances(far, 10)[10, 10] == 0 and squared_distances(far, 10)[10, 13] == 9


def test_wrong_parameters_are_refused(spark):
    words = spark.createDataFrame([(0, 0, 1, 1)], "row long, word long, valid long, loss long")
    for bad in ({"reach": 0}, {"reach": 5, "tile_shift": 4}):
        with pytest.raises(ValueError):
            distance_band(words, **bad)
