"""The raster stored by tile."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from gladeline.operators.raster import clip
from gladeline.sources import tiles

REGION = [(5, 0, 90), (6, 40, 90), (300, 390, 410), (-3, -70, -60)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tiles"))
    cells = spark.range(0, 60_000).select(
        (F.col("id") % 400 - 20).alias("row"), (F.floor(F.col("id") / 400) * 3 - 90).alias("col"), F.col("id").alias("v"))
    tiles.create_tiles(spark, path, cells.schema, shift=5)
    tiles.add_cells(cells.filter("v % 3 > 0"), path)
    tiles.add_cells(cells.filter("v % 3 = 0"), path)
    return path, cells


def region(spark, rows=REGION):
    return spark.createDataFrame(rows, "row long, col_lo long, col_hi long")


def inside(cells):
    hit = [F.col("row").eqNullSafe(r) & F.col("col").between(lo, hi) for r, lo, hi in REGION]
    return sorted(tuple(r) for r in cells.filter(hit[0] | hit[1] | hit[2] | hit[3]).collect())


def files_read(df) -> int:
    """Files that the scan of the cells opened, by its own metric."""
    df.collect()
    scans, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet") and "cells/batch" in node.toString() + node.relation().location().toString():
            scans.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(scans)


def test_all_cells_come_back(spark, stored):
    path, cells = stored
    back = tiles.read_tiles(spark, path)
    assert back.columns == cells.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    held = tiles.read_directory(spark, path)
    assert held.agg(F.sum("n_cells")).first()[0] == 60_000 and held.select("batch").distinct().count() == 2
    one = held.filter("tile = '-1_-3'").agg(F.min("row_lo"), F.max("row_hi"), F.min("col_lo"), F.max("col_hi")).first()
    assert tuple(one) == (-20, -1, -90, -66)


def test_only_touched_tiles_are_opened(spark, stored):
    path, cells = stored
    near = tiles.read_touching(spark, path, region(spark))
    touched = {r["tile"] for r in tiles.tiles_of_runs(region(spark), 5).collect()}
    assert touched == {"0_0", "0_1", "0_2", "9_12", "-1_-3", "-1_-2"}
    folders = {t: len(glob.glob(f"{path}/cells/batch=*/tile_row=*/tile={t}/*.parquet")) for t in touched}
    total = len(glob.glob(f"{path}/cells/batch=*/tile_row=*/tile=*/*.parquet"))
    assert "dynamicpruning" in re.sub(r"\s", "", near._jdf.queryExecution().executedPlan().toString()).lower()
    assert files_read(near) == sum(folders.values()) < total / 5
    assert sorted(map(tuple, clip(near, region(spark), pruned=False).collect())) == inside(cells)


def test_more_tiles_than_are_broadcast(spark, stored):
    path, cells = stored
    near = tiles.read_touching(spark, path, region(spark), most_tiles=3)
    assert "Broadcast" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, clip(near, region(spark), pruned=False).collect())) == inside(cells)
    assert tiles.read_touching(spark, path, region(spark, []), most_tiles=3).count() == 0


def test_runs_that_touch_nothing(spark, stored):
    path, _ = stored
    for runs in ([], [(100_000, 0, 5)]):
        assert tiles.read_touching(spark, path, region(spark, runs)).count() == 0


def test_a_failed_load_is_never_read(spark, stored, tmp_path):
    path = str(tmp_path)
    schema = "row long, col long, v long"
    good = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 2, None)], schema)
    tiles.create_tiles(spark, path, good.schema, shift=3)
    assert tiles.read_tiles(spark, path).count() == 0 and tiles.read_touching(spark, path, region(spark)).count() == 0
    tiles.add_cells(good, path)
    began = tiles.read_tiles(spark, path)
    with pytest.raises(Exception, match="cell without col"):
        tiles.add_cells(spark.createDataFrame([(1, None, 1), (70, 1, 1)], schema), path)
    tiles.add_cells(good.limit(0), path)
    assert sorted(map(str, tiles.read_tiles(spark, path).collect())) == sorted(map(str, good.collect()))
    tiles.add_cells(good.withColumn("other", F.lit(1)), path)
    assert began.count() == 3 and tiles.read_tiles(spark, path).count() == 6
    with pytest.raises(ValueError):
        tiles.create_tiles(spark, str(tmp_path / "x"), good.drop("row").schema)


def test_a_hot_tile_is_written_by_several_tasks(spark, tmp_path):
    path, size = str(tmp_path), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    cells = spark.range(0, 200_000, 1, 4).select((F.col("id") % 1000).alias("row"), F.floor(F.col("id") / 1000).alias("col"), F.rand(1).alias("v"))
    before = spark.conf.get(size)
    spark.conf.set(size, "256k")
    try:
        tiles.create_tiles(spark, path, cells.schema)
        tiles.add_cells(cells, path)
    finally:
        spark.conf.set(size, before)
    assert len(glob.glob(f"{path}/cells/*/tile_row=0/tile=0_0/*.parquet")) > 3
    assert tiles.read_tiles(spark, path).count() == 200_000


@pytest.mark.parametrize("most_tiles", [100_000, 3])
def test_many_tiles_share_a_bounded_number_of_folders(spark, stored, tmp_path, monkeypatch, most_tiles):
    """Files follow the bound, whatever the number of tiles; a region still gets its tiles and no other cells."""
    path, cells = str(tmp_path), stored[1]
    monkeypatch.setattr(tiles, "MOST_FOLDERS", 20)
    tiles.create_tiles(spark, path, cells.schema, shift=5)
    tiles.add_cells(cells.filter("v % 3 > 0"), path)
    monkeypatch.setattr(tiles, "MOST_FOLDERS", 256)
    tiles.add_cells(cells.filter("v % 3 = 0"), path)
    first, second = sorted(glob.glob(f"{path}/cells/batch=*"))
    assert 4 < len(glob.glob(f"{first}/*/*")) <= 20 and len(glob.glob(f"{second}/*/*")) > 150
    mine, plain = (sorted(map(tuple, tiles.read_directory(spark, p).select("tile_row", "tile", "n_cells", "row_lo", "row_hi", "col_lo", "col_hi").collect()))
                   for p in (path, stored[0]))
    assert mine == plain
    near = tiles.read_touching(spark, path, region(spark), most_tiles)
    assert near.columns == cells.columns
    if most_tiles > 3:
        total = len(glob.glob(f"{path}/cells/batch=*/tile_row=*/tile=*/*.parquet"))
        assert 0 < files_read(near) < total / 2
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, tiles.read_touching(spark, stored[0], region(spark)).collect()))
    assert sorted(map(tuple, tiles.read_tiles(spark, path).collect())) == sorted(map(tuple, cells.collect()))
