"""Pages of a stored view against plain Python."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gladeline.plans import serving as sv


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    made = [(rng.randrange(700), float(i), None if rng.random() < 0.1 else rng.random(), rng.choice(["LOW", "MEDIUM", "HIGH", None])) for i in range(900)]
    return made + [made[0]] * 3


@pytest.fixture(scope="module")
def view(spark, rows):
    return spark.createDataFrame(rows, "farm_id long, area_ha double, risk_score double, risk_class string").repartition(7)


@pytest.fixture(scope="module")
def pages(view, tmp_path_factory):
    return sv.store_pages(view, str(tmp_path_factory.mktemp("pages") / "stored"), rows_per_range=100)


REQUESTS = [
    (10, 0, None, None), (250, 95, None, None), (5, 900, None, None), (5, 903, None, None), (7, 10**6, None, None), (1000, 0, None, None),
    (20, 30, ["LOW"], None), (20, 30, ["LOW", "HIGH"], 0.5), (300, 100, None, 0.2), (5, 0, ["never"], None), (5, 0, None, 1.1),
]


@pytest.mark.parametrize("limit,offset,classes,least", REQUESTS)
def test_pages_hold_the_rows_of_their_places(pages, view, rows, limit, offset, classes, least):
    kept = [r for r in rows if (classes is None or r[3] in classes) and (least is None or (r[2] is not None and r[2] >= least))]
    got = sv.read_page(pages, limit, offset, classes, least)
    assert got.columns == view.columns
    found = [tuple(r) for r in got.collect()]
    assert [r[0] for r in found] == sorted(r[0] for r in kept)[offset : offset + limit]
    wanted = F.lit(True) if classes is None else F.col("risk_class").isin(*classes)
    filtered = view.filter(wanted if least is None else wanted & (F.col("risk_score") >= least))
    for most_top in (0, 10**6):
        assert [tuple(r) for r in sv.page(filtered, limit, offset, most_top).collect()] == found


def test_all_pages_together_are_the_view(pages, rows):
    found = [tuple(r) for k in range(10) for r in sv.read_page(pages, 100, 100 * k).collect()]
    assert sorted(found, key=str) == sorted(rows, key=str)


def test_a_page_reads_its_ranges_alone_and_writes_nothing(spark, pages):
    from gladeline.session import ensure_checkpoint_dir

    before = set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))
    deep = sv.read_page(pages, 10, 455)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*range_no", plan) and "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert len(set(re.findall(r"range_no#\d+ = (\d+)", plan))) == 1 < len(pages.rows.inputFiles())
    assert deep.count() == 10
    assert set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:"))) == before


def test_a_first_page_of_a_view_writes_nothing(spark, view):
    from gladeline.session import ensure_checkpoint_dir

    before = set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:")))
    assert sv.page(view, 10).count() == 10
    assert set(os.listdir(ensure_checkpoint_dir(spark).removeprefix("file:"))) == before


def test_pages_are_opened_again_and_may_be_empty(spark, view, tmp_path):
    sv.store_pages(view.filter("farm_id < 50"), str(tmp_path / "some"))
    again = sv.open_pages(spark, str(tmp_path / "some"))
    assert sv.read_page(again, 10).count() == 10
    none = sv.store_pages(view.limit(0), str(tmp_path / "none"))
    assert sv.read_page(none, 10).collect() == []
