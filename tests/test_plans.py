"""What the physical plans must and must not hold, and skewed inputs."""

import random

import pytest
from pyspark.sql import functions as F

from gladeline import standin as s
from gladeline.catalog.queries import QUERIES
from gladeline.operators.joins import join_to_unique
from gladeline.operators.raster import clip_box, mosaic, scenes_between, threshold
from gladeline.sources.files import read_boundary

SF = "/root/testdata/sf0.001"

SPATIAL = (
    "clip", "zonal_sum", "defo_pct", "buffer_runs", "ring_runs", "ring_features", "parcel_context", "nearest_loss",
    "nearest_loss_excluding_own", "both_distances", "sample_at", "polygon_runs", "parcels_view", "stats_document",
    "polygonize_parcels", "polygonize_area", "outline_parts", "outline_perimeter",
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPATIAL)
def test_no_nested_loop_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "Pandas"):
        assert word not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.range(100).select(
        F.col("id").alias("row"), F.col("id").alias("col"), (F.col("id") / 100).alias("crop_prob"), F.lit(1).alias("other"),
        F.lit("2020-01-01").cast("timestamp_ntz").alias("acquired_at"),
    ).write.parquet(path)
    cells = spark.read.parquet(path)
    text = plan(threshold(cells, "crop_prob", 0.3).select("row", "col"))
    assert "GreaterThan(crop_prob,0.3)" in text.split("PushedFilters")[1]
    assert "other" not in text.split("ReadSchema")[1]
    assert "GreaterThanOrEqual(row,1)" in plan(clip_box(cells, 1, 50, 2, 60)).split("PushedFilters")[1]
    assert "GreaterThanOrEqual(acquired_at" in plan(scenes_between(cells, "2020-01-01", "2021-01-01"))
    assert "EqualTo(n_name,NATION_3)" in plan(read_boundary(s.table(spark, SF, "nation"), "n_name", "NATION_3"))


def test_listing_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["early_warning"](spark, SF))


def test_hot_key_join_is_split(spark):
    """A key with most rows joins a freshly aggregated side: the hot partition is cut into several tasks."""
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        many = spark.range(0, 60_000, 1, 8).select(
            F.col("id").alias("farm_id"), F.when(F.col("id") % 3 == 0, F.col("id") % 500).otherwise(7).alias("k"))
        unique = spark.range(500).groupBy(F.col("id").alias("k")).agg(F.max("id").alias("v"))
        joined = join_to_unique(many, unique, ["k"]).groupBy("farm_id").agg(F.max("v").alias("v"))
        rows = joined.collect()
        text = plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 60_000 and all(r["v"] == (r["farm_id"] % 500 if r["farm_id"] % 3 == 0 else 7) for r in rows)
    assert "skew=true" in text.split("== Initial Plan ==")[0]


def test_mosaic_combines_a_hot_cell_before_the_shuffle(spark):
    scenes = spark.range(0, 30_000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 100).otherwise(5).alias("row"), F.lit(1).cast("long").alias("col"),
        F.col("id").alias("seq"), (F.col("id") * 2.0).alias("p"))
    df = mosaic(scenes, ["seq"], ["p"])
    text = plan(df)
    assert text.index("partial_max_by") > text.index("Exchange")
    assert "HashAggregate" in text and "SortAggregate" not in text
    got = {r["row"]: r["p"] for r in df.collect()}
    want = {}
    for i in range(30_000):
        want[i % 100 if i % 3 == 0 else 5] = i * 2.0
    assert got == want


def test_hot_place_many_parcels_on_one_word(spark):
    """A third of all parcels on one spot: same results as apart."""
    from gladeline.grid import GridSpec
    from gladeline.operators.zonal import loss_words, parcel_context

    rng = random.Random(1)
    cells = [(r, c, 1, 22 if rng.random() < 0.1 else 0) for r in range(30) for c in range(100)]
    raster = loss_words(spark.createDataFrame(cells, "row long, col long, forest2020 int, lossyear int"))
    spots = [(i, 10, 10) if i % 3 == 0 else (i, rng.randrange(25), rng.randrange(90)) for i in range(300)]
    rows = [(f, r + k, c, c + 4) for f, r, c in spots for k in range(3)]
    runs = spark.createDataFrame(rows, "farm_id long, row long, col_lo long, col_hi long")
    got = {r["farm_id"]: tuple(r)[1:] for r in parcel_context(runs, raster, GridSpec(10.0), [20, 50]).collect()}
    assert len(got) == 300 and len({got[i] for i in range(0, 300, 3)}) == 1


def test_checkpoints_go_to_the_named_folder(spark):
    from gladeline.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark)
    assert folder and ensure_checkpoint_dir(spark) == folder == spark.sparkContext.getCheckpointDir()


def test_cells_are_pruned_before_they_are_shuffled(spark, tmp_path):
    """One small region of a wide raster: the box is pushed to the scan, tiles are kept by a broadcast, no cell is lost."""
    from gladeline.operators.raster import clip, prune

    path = str(tmp_path / "cells")
    spark.range(0, 400_000).select(
        (F.col("id") % 4000).alias("row"), (F.floor(F.col("id") / 4000) * 41).alias("col"), F.col("id").alias("v")).write.parquet(path)
    cells = spark.read.parquet(path)
    region = spark.createDataFrame([(5, 0, 90), (6, 40, 90), (3000, 3900, 4100)], "row long, col_lo long, col_hi long")
    want = {(r, c) for r, lo, hi in ((5, 0, 90), (6, 40, 90), (3000, 3900, 4100)) for c in range(0, 4100, 41) if lo <= c <= hi}
    clipped = clip(cells, region)
    assert {(r["row"], r["col"]) for r in clipped.collect()} == want
    text = plan(clipped)
    assert "GreaterThanOrEqual(row,5)" in text and "LeftSemi, BuildRight" in text
    few, box = prune(cells, region), prune(cells, region, most_tiles=1)
    assert few.columns == cells.columns and few.count() < box.count() < 400_000
    assert {(r["row"], r["col"]) for r in clip(box, region).collect()} == want
    assert prune(cells, region.limit(0)).count() == 0
