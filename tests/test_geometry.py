"""Runs, words, buffers, outlines and polygons against brute force on small random grids."""

import json
import time
import random

import pytest
from pyspark.sql import functions as F

from gladeline.functions.geojson import geometry_texts, parse_rings
from gladeline.grid import GridSpec
from gladeline.operators.footprints import buffer_runs, centroid, dilate, parcel_points, polygon_runs, ring_runs
from gladeline.operators import outlines
from gladeline.operators.outlines import outline_edges, polygonize
from gladeline.operators.raster import clip
from gladeline.operators.words import cells_to_words, merge_pieces, runs_to_words, words_to_cells, words_to_runs

RUN = "farm_id long, row long, col_lo long, col_hi long"


def blob(seed, n=40, span=90, low=-20):
    rng = random.Random(seed)
    return {(rng.randrange(12), rng.randrange(low, low + span)) for _ in range(n)}


def as_runs(footprints):
    rows = []
    for fid, cells in footprints.items():
        for r, c in sorted(cells):
            if (r, c - 1) in cells:
                continue
            end = c
            while (r, end + 1) in cells:
                end += 1
            rows.append((fid, r, c, end))
    return rows


def cells_of(df, key="farm_id"):
    out = {}
    for r in df.collect():
        for c in range(r["col_lo"], r["col_hi"] + 1):
            cell = (r["row"], c)
            assert cell not in out.setdefault(r[key], set()), "runs overlap"
            out[r[key]].add(cell)
    return out


def disc(cells, radius):
    reach = range(-radius, radius + 1)
    steps = [(a, b) for a in reach for b in reach if a * a + b * b <= radius * radius]
    return {(r + a, c + b) for r, c in cells for a, b in steps}


@pytest.fixture(scope="module")
def footprints():
    return {i: blob(i, n=5 + 12 * i) for i in range(1, 6)}


@pytest.fixture(scope="module")
def runs(spark, footprints):
    return spark.createDataFrame(as_runs(footprints), RUN)


def test_words_round_trip(runs, footprints):
    words = runs_to_words(runs, ["farm_id"])
    assert cells_of(words_to_runs(words, ["farm_id"])) == footprints
    back = {}
    for r in words_to_cells(words, ["farm_id"]).collect():
        back.setdefault(r["farm_id"], set()).add((r["row"], r["col"]))
    assert back == footprints


def test_merged_runs_are_maximal(spark):
    wide = spark.createDataFrame([(1, 0, -70, 200), (1, 1, 63, 64)], RUN)
    got = {tuple(r) for r in words_to_runs(runs_to_words(wide, ["farm_id"]), ["farm_id"]).collect()}
    assert got == {(1, 0, -70, 200), (1, 1, 63, 64)}
    pieces = spark.createDataFrame([(1, 0, 0, 3), (1, 0, 4, 6), (1, 0, 8, 9)], RUN)
    assert {tuple(r) for r in merge_pieces(pieces, ["farm_id"]).collect()} == {(1, 0, 0, 6), (1, 0, 8, 9)}


@pytest.mark.parametrize("radius", [1, 5])
def test_buffer_and_ring_equal_the_disc(runs, footprints, radius):
    want = {f: disc(cells, radius) for f, cells in footprints.items()}
    assert cells_of(buffer_runs(runs, radius)) == want
    assert cells_of(ring_runs(runs, radius)) == {f: want[f] - footprints[f] for f in want}


def test_several_radii_in_one_pass(runs, footprints):
    words = dilate(runs, [2, 7])
    for radius in (2, 7):
        one = words.select("farm_id", "row", "word", F.col(f"b_{radius}").alias("bits"))
        assert cells_of(words_to_runs(one, ["farm_id"])) == {f: disc(c, radius) for f, c in footprints.items()}


def test_centroid_of_a_footprint(runs, footprints):
    for r in centroid(runs).collect():
        cells = footprints[r["farm_id"]]
        n = len(cells)
        rows, cols = sum(c[0] for c in cells), sum(c[1] for c in cells)
        assert r["n_cells"] == n
        assert r["row_mean"] == pytest.approx(rows / n)
        assert r["col_mean"] == pytest.approx(cols / n)
        assert (r["crow"], r["ccol"]) == ((2 * rows + n) // (2 * n), (2 * cols + n) // (2 * n))


def test_parcel_without_a_cell_has_its_polygons_centroid(spark):
    """Too small, turned the other way, without area, without rings: every parcel keeps a row."""
    def square(x, y, size):
        return [[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]]

    shapes = [
        (1, square(0.0, 0.0, 40.0)), (2, square(31.0, 52.0, 2.0)), (3, [square(-29.0, 11.0, 2.0)[0][::-1]]),
        (4, [[(10.0, 10.0), (30.0, 10.0), (10.0, 10.0)]]), (5, []), (6, None),
    ]
    farms = spark.createDataFrame(shapes, "farm_id long, rings array<array<struct<x:double,y:double>>>")
    grid = GridSpec(10.0)
    owned = polygon_runs(farms, grid)
    got = {r["farm_id"]: r for r in parcel_points(farms.unionByName(farms), owned, grid).collect()}
    assert len(got) == 6 and got[1]["n_cells"] == 16 and (got[1]["row_mean"], got[1]["col_mean"]) == (1.5, 1.5)
    assert [got[i]["n_cells"] for i in (2, 3, 4, 5, 6)] == [0] * 5
    assert (got[2]["crow"], got[2]["ccol"]) == (5, 3) and (got[3]["crow"], got[3]["ccol"]) == (1, -3)
    assert got[2]["row_mean"] == pytest.approx(4.8) and got[2]["col_mean"] == pytest.approx(2.7)
    assert (got[4]["crow"], got[4]["ccol"]) == (1, 2)
    assert got[5]["crow"] is None and got[6]["row_mean"] is None


def test_long_ring_keeps_its_order(spark):
    """A comb with 400 teeth: one ring of 1,600 corners in the order of the outline, turning at each."""
    cells = {(r, 2 * c) for r in (1, 2, 3) for c in range(400)} | {(4, c) for c in range(799)}
    rings = polygonize(spark.createDataFrame(as_runs({1: cells}), RUN)).first()["rings"]
    assert len(rings) == 1 and len(rings[0]) == 1601
    ring = [(p["x"], p["y"]) for p in rings[0]]
    assert ring[0] == ring[-1] == (0.0, 1.0) and len(set(ring)) == 1600
    sides = list(zip(ring, ring[1:]))
    assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in sides)
    assert sum(a[0] * b[1] - b[0] * a[1] for a, b in sides) == 2 * len(cells)


def test_clip_keeps_cells_inside_overlapping_runs(spark):
    cells = spark.createDataFrame([(r, c, 0.5) for r in range(3) for c in range(130)], "row long, col long, p double")
    region = spark.createDataFrame([(1, 60, 70), (1, 65, 129), (2, 0, 0)], "row long, col_lo long, col_hi long")
    got = {(r["row"], r["col"]) for r in clip(cells, region).collect()}
    assert got == {(1, c) for c in range(60, 130)} | {(2, 0)}


def test_outline_length_counts_bare_sides(runs, footprints):
    length = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    got = {r[0]: r[1] for r in outline_edges(runs).groupBy("farm_id").agg(F.sum(length)).collect()}
    want = {
        f: sum((r + a, c + b) not in cells for r, c in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        for f, cells in footprints.items()
    }
    assert got == want


def test_polygons_turn_back_into_the_same_cells(runs, footprints):
    """Outline, text, parse, scanline: holes and corner contacts included."""
    text = geometry_texts(polygonize(runs), scale=10.0)
    rings = text.select("farm_id", parse_rings(F.col("geometry")).alias("rings"))
    assert cells_of(polygon_runs(rings, GridSpec(10.0))) == footprints


def test_annulus_has_one_hole(spark):
    ring = {(r, c) for r in range(7) for c in range(7)} - {(r, c) for r in range(2, 5) for c in range(2, 5)}
    runs = spark.createDataFrame(as_runs({1: ring}), RUN)
    shapes = polygonize(runs)
    assert [len(r) for r in shapes.first()["rings"]] == [5, 5]
    assert geometry_texts(shapes).first()["geometry"].startswith('{"type":"Polygon"')
    assert cells_of(polygon_runs(polygonize(runs), GridSpec(1.0))) == {1: ring}


def test_nested_parts_keep_their_holes(spark):
    """An island inside the hole of an annulus: two outer rings, the hole belongs to the big one."""
    ring = {(r, c) for r in range(9) for c in range(9)} - {(r, c) for r in range(1, 8) for c in range(1, 8)}
    shape = ring | {(4, 4)}
    text = geometry_texts(polygonize(spark.createDataFrame(as_runs({1: shape}), RUN)))
    import json

    doc = json.loads(text.first()["geometry"])
    assert doc["type"] == "MultiPolygon"
    assert sorted(len(part) for part in doc["coordinates"]) == [1, 2]


def test_corner_contact_gives_two_parts(spark):
    import json

    runs = spark.createDataFrame(as_runs({1: {(0, 0), (1, 1)}}), RUN)
    doc = json.loads(geometry_texts(polygonize(runs)).first()["geometry"])
    assert doc["type"] == "MultiPolygon"
    assert len(doc["coordinates"]) == 2


def test_four_hundred_rings_find_their_parts(spark):
    """Frames of 3 x 3 cells that touch at corners only: 400 outer rings with a hole each."""
    import json

    frame = {(r, c) for r in range(3) for c in range(3)} - {(1, 1)}
    shape = {(r + 3 * a, c + 3 * b) for a in range(28) for b in range(28) if (a + b) % 2 == 0 for r, c in frame}
    text = geometry_texts(polygonize(spark.createDataFrame(as_runs({1: shape}), RUN)))
    doc = json.loads(text.first()["geometry"])
    assert [len(part) for part in doc["coordinates"]] == [2] * (28 * 14)
    for outer, hole in doc["coordinates"]:
        assert min(outer)[0] < min(hole)[0] < max(hole)[0] < max(outer)[0]
    rings = text.select("farm_id", parse_rings(F.col("geometry")).alias("rings"))
    assert cells_of(polygon_runs(rings, GridSpec(1.0))) == {1: shape}


def test_shapes_without_rings_have_no_text(spark):
    shapes = spark.createDataFrame([(1, None), (2, [])], "farm_id long, rings array<array<struct<x:double,y:double>>>")
    assert {tuple(r) for r in geometry_texts(shapes).collect()} == {(1, None), (2, None)}


def test_slanted_polygon_takes_cells_by_centre(spark):
    ring = [(0.0, 0.0), (100.0, 0.0), (0.0, 100.0), (0.0, 0.0)]
    rows = [(1, [[{"x": x, "y": y} for x, y in ring]])]
    df = spark.createDataFrame(rows, "farm_id long, rings array<array<struct<x:double,y:double>>>")
    got = cells_of(polygon_runs(df, GridSpec(10.0)))[1]
    inside = {(r, c) for r in range(10) for c in range(10) if (r + 0.5) + (c + 0.5) < 10}
    border = {(r, c) for r in range(10) for c in range(10) if (r + 0.5) + (c + 0.5) == 10}
    assert inside <= got <= inside | border


def test_cells_to_words_marks_each_mask(spark):
    cells = spark.createDataFrame([(0, 0, True), (0, 63, False), (0, 64, True)], "row long, col long, loss boolean")
    got = {(r["word"]): (r["valid"], r["lost"]) for r in cells_to_words(cells, valid=F.lit(True), lost=F.col("loss")).collect()}
    assert got == {0: (1 - 2**63, 1), 1: (1, 1)}


@pytest.mark.parametrize("tile_shift", [0, 1, 3])
def test_rings_across_tiles_are_the_same(runs, spark, monkeypatch, tile_shift):
    whole = {r["farm_id"]: r["rings"] for r in polygonize(runs).collect()}
    monkeypatch.setattr(outlines, "TILE_SHIFT", tile_shift)
    monkeypatch.setattr(outlines, "BATCH_ROWS", 5)
    assert {r["farm_id"]: r["rings"] for r in polygonize(runs).collect()} == whole
    comb = [(1, r, 0, 399 if r % 2 == 0 else 0) for r in range(60)]
    shape = polygonize(spark.createDataFrame(comb, RUN)).first()["rings"]
    assert len(shape) == 1 and len(shape[0]) == len(set(map(tuple, shape[0]))) + 1 == 2 * 60 + 3
    turns = [(a["x"] == b["x"]) != (b["x"] == c["x"]) for a, b, c in zip(shape[0], shape[0][1:], shape[0][2:])]
    assert all(turns)


def test_ranking_writes_less_than_three_times_the_sides(spark, monkeypatch):
    """A comb of 1,024 teeth, 700 cells wide: one ring of 4,098 sides over 24 tiles."""
    written = []
    store = outlines.cut_lineage
    monkeypatch.setattr(outlines, "cut_lineage", lambda df: written.append((kept := store(df)).count()) or kept)
    teeth = spark.range(2048).select(
        F.lit(1).cast("long").alias("farm_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col_lo"),
        F.when(F.col("id") % 2 == 0, 700).otherwise(0).cast("int").alias("col_hi"),
    )
    corners = outlines.outline_corners(teeth)
    sides = corners.count()
    assert sides == outline_edges(teeth).count() >= 4096 and sum(written) < 3 * sides
    assert corners.filter("place = 0").count() == 1 and corners.agg(F.max("place")).first()[0] == sides - 1


def test_ten_thousand_holes_on_one_row(spark):
    """Two frames side by side, 5,000 holes each in the same row, swept once."""
    rows = []
    for first in (0, 15_010):
        rows += [(1, r, first, first + 15_001) for r in (0, 2)]
        rows += [(1, 1, first + 3 * k, first + 3 * k + 1) for k in range(5000)] + [(1, 1, first + 15_001, first + 15_001)]
    shapes = polygonize(spark.createDataFrame(rows, RUN))
    plan = outlines_plan = geometry_texts(shapes)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in outlines_plan and "Cartesian" not in plan
    start = time.perf_counter()
    parts = json.loads(geometry_texts(shapes).first()["geometry"])["coordinates"]
    assert [len(p) for p in parts] == [5001, 5001] and time.perf_counter() - start < 60
    for part in parts:
        left, right = part[0][0][0], max(x for x, _ in part[0])
        assert all(left < ring[0][0] < right for ring in part[1:])


def test_texts_are_parsed_once_on_the_way_to_runs(spark):
    texts = spark.createDataFrame([(1, '{"type":"Polygon","coordinates":[[[0,0],[30,0],[30,20],[0,20],[0,0]]]}'), (2, None)], "farm_id long, geometry string")
    got = polygon_runs(texts.repartition(1).select("farm_id", parse_rings(F.col("geometry")).alias("rings")), GridSpec(10.0))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 2), (1, 1, 0, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(") <= 2
