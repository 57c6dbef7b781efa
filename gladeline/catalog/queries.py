"""One query per operator, over the stand-in raster and parcels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gladeline import standin as s
from gladeline.functions.geojson import geometry_texts, parse_rings, to_feature, to_feature_collection
from gladeline.functions.labels import MEDIAN_AFFECTED_PCT, compliance_label, risk_binary, risk_class
from gladeline.functions.numbers import cap_distance, share_pct
from gladeline.grid import GridSpec
from gladeline.operators import components as cc
from gladeline.operators import distance as ds
from gladeline.operators import footprints as fp
from gladeline.operators import proximity as px
from gladeline.operators import raster as ra
from gladeline.operators import zonal as zo
from gladeline.operators.outlines import outline_edges, polygonize
from gladeline.plans import metrics as me
from gladeline.plans import modelling as mo
from gladeline.plans import reports as rp
from gladeline.plans import screening as sc
from gladeline.plans import serving as sv
from gladeline.plans.scoring import scoring_run as run_scoring
from gladeline.plans.scoring import watch_list as run_watch_list
from gladeline.session import cut_lineage, scratch_folder
from gladeline.sources import schemas
from gladeline.sources.files import (
    read_boundaries, read_boundary, read_features, read_geojson, write_features, write_geojson,
)
from gladeline.sources.tiles import add_cells, create_tiles, read_directory, read_touching
from gladeline.sources.store import (
    append_table, apply_scores, check_keys, compact_table, latest_assessments, read_table, register_views, reset_store,
    update_table, with_defaults, write_snapshot,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DEGREE_GRID = GridSpec(cell_m=10.0, lat0=9.0, cell_deg=0.0001)
CLASSES = ("LOW", "MEDIUM", "HIGH")
RINGS = ["nb_defo_pct_20", "nb_defo_pct_50", "nb_defo_pct_100"]
# the library's own settings: 300 trees, depth 30, 1000 iterations, five folds
SETTINGS = mo.Settings()


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _view(spark, d) -> DataFrame:
    return sv.parcels_view(s.farms(spark, d), s.assessments(spark, d))


def _distance(spark, d) -> DataFrame:
    return px.distance_feature(s.points(spark, d), s.loss(spark, d), 10.0, s.CAP_M)


def _frame(spark, d, masked: bool = False) -> DataFrame:
    """The model frame of the small rings. The raster is read several times, so the mosaic is written once."""
    return _any_frame(spark, d, masked, s.RADII_M, s.CAP_M)


def _real_frame(spark, d, masked: bool = False, raster: DataFrame | None = None) -> DataFrame:
    """The model frame with the library's own radii and cap."""
    return _any_frame(spark, d, masked, sc.RADII_M, sc.DISTANCE_CAP_M, raster)


def _any_frame(spark, d, masked, radii_m, cap_m, raster: DataFrame | None = None) -> DataFrame:
    raster = cut_lineage(s.cells(spark, d)) if raster is None else raster
    shares = cut_lineage(s.shares(spark, d, raster, radii_m))
    points, loss = s.points(spark, d), s.loss(spark, d, raster)
    if masked:
        distances = px.both_distances(points, loss, s.farm_runs(spark, d), 10.0, cap_m)
    else:
        distances = px.distance_feature(points, loss, 10.0, cap_m)
    rings = [f"nb_defo_pct_{m}" for m in radii_m]
    return sc.model_frame(
        s.farms(spark, d), s.assessments(spark, d, shares, rings[-1]), shares.select("farm_id", *rings), distances
    )


def _in_range(score: str):
    return F.coalesce(F.col(score).between(0.0, 1.0), F.lit(True)).alias("in_range")


def _sizes(spark, d) -> DataFrame:
    return cc.component_size(cc.component_runs(s.crop_mask(spark, d)))


def _ranked(spark, d) -> DataFrame:
    """Stand-in score, label, and predicted class from the score."""
    return s.assessments(spark, d).filter(F.col("risk_class").isNotNull() & F.col("risk_score").isNotNull()).select(
        "farm_id", "risk_score", "risk_class",
        (F.col("defo_pct") > 0).cast("long").alias("hit"),
        risk_class(F.col("risk_score") * 100.0, 0.5).alias("predicted"),
    )


# ---- sources -------------------------------------------------------------------------------------------

@query
def read_boundary_by_name(spark, d):
    return read_boundary(s.table(spark, d, "nation"), "n_name", "NATION_3").select("n_nationkey", "n_name", "n_regionkey")


@query
def scenes_between(spark, d):
    rows = ra.scenes_between(s.scenes(spark, d), "1997-01-01", "1998-01-01")
    return rows.groupBy("row").agg(F.count(F.lit(1)).alias("n_scenes"), F.max("col").alias("max_col"))


@query
def band(spark, d):
    return ra.band(s.cells(spark, d), "lossyear").select("row", "col", F.col("lossyear").cast("long").alias("lossyear"))


@query
def table_query(spark, d):
    register_views(s.farms(spark, d), s.assessments(spark, d))
    return spark.sql("""
        SELECT commodity, count(*) AS n_farms, sum(area_ha) AS area_ha, count_if(defo_pct > 0) AS n_affected
        FROM farms INNER JOIN assessments USING (farm_id) GROUP BY commodity""")


@query
def column_defaults(spark, d):
    bare = s.farms(spark, d).select("farm_id", "area_ha")
    return with_defaults(bare, s.AS_OF).select("farm_id", "commodity", F.date_format("assessed_at", "yyyy-MM-dd").alias("assessed_on"))


@query
def key_violations(spark, d):
    """Farms are customers, assessments are orders: many orders of one customer, some customers without orders."""
    farms = s.table(spark, d, "customer").select(F.col("c_custkey").alias("farm_id"))
    orders = s.table(spark, d, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 2).alias("farm_id"))
    return check_keys(farms, orders)


@query
def latest_assessment(spark, d):
    """Orders as repeated assessments of a customer; the newest one stays."""
    orders = s.table(spark, d, "orders").select(
        F.col("o_custkey").alias("farm_id"), F.col("o_orderdate").alias("assessed_at"),
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"),
    )
    return latest_assessments(orders).select("farm_id", "id", "value")


@query
def apply_new_scores(spark, d):
    rows = s.assessments(spark, d)
    affected = rows.filter(F.col("defo_pct") > 0)
    scores = affected.select("farm_id", F.lit(0.9).alias("risk_score"), F.lit("HIGH").alias("risk_class"))
    return apply_scores(rows, scores).select("farm_id", "risk_score", "risk_class")


@query
def union_parts(spark, d):
    rows = s.assessments(spark, d).select("farm_id", "defo_pct")
    clean, affected = rows.filter(F.col("defo_pct") == 0), rows.filter(F.col("defo_pct") > 0)
    return clean.unionByName(affected)


@query
def geojson_files(spark, d):
    """Parcels written as GeoJSON and read back."""
    path = scratch_folder(spark)
    write_geojson(s.farms(spark, d), path)
    return read_geojson(spark, path)


@query
def feature_files(spark, d):
    """A per-parcel table written as CSV and read back with a column subset."""
    path = scratch_folder(spark)
    wide = s.assessments(spark, d).select(*[F.col(f.name).cast(f.dataType) for f in schemas.ASSESSMENTS])
    write_features(wide, path, "csv")
    return read_features(spark, path, schemas.ASSESSMENTS, ["farm_id", "defo_m2", "total_m2", "defo_pct"])


@query
def stored_tables(spark, d):
    """Tables made anew, loaded, and scored by a snapshot."""
    path = scratch_folder(spark)
    reset_store(spark, path)
    rows = s.assessments(spark, d)
    append_table(rows.withColumn("risk_score", F.lit(None)).withColumn("risk_class", F.lit(None)), path, "assessments")
    stored = read_table(spark, path, "assessments")
    write_snapshot(apply_scores(stored, rows.select("farm_id", "risk_score", "risk_class")), path, "assessments")
    return read_table(spark, path, "assessments").select("farm_id", "defo_pct", "risk_score", "risk_class")


def _updated(spark, d) -> str:
    """Clean parcels loaded and marked, affected ones loaded after the mark, and the worse of them raised."""
    path = scratch_folder(spark)
    reset_store(spark, path)
    rows = cut_lineage(s.assessments(spark, d))
    hit = F.coalesce(F.col("defo_pct") > 0, F.lit(False))
    append_table(rows.filter(~hit), path, "assessments")
    update_table(rows.select("farm_id", F.lit("SEEN").alias("risk_class")), path, "assessments")
    append_table(rows.filter(hit), path, "assessments")
    worse = rows.filter(hit & (F.col("risk_score") > 0.01))
    update_table(worse.select("farm_id", F.lit(0.95).alias("risk_score")), path, "assessments")
    return path


@query
def updated_tables(spark, d):
    """A stored table of two loads and two updates, merged by the reader."""
    return read_table(spark, _updated(spark, d), "assessments").select("farm_id", "defo_pct", "risk_score", "risk_class")


@query
def compacted_tables(spark, d):
    """The same after its patches were folded into its rows."""
    path = _updated(spark, d)
    compact_table(spark, path, "assessments")
    return read_table(spark, path, "assessments").select("farm_id", "defo_pct", "risk_score", "risk_class")


# ---- raster --------------------------------------------------------------------------------------------

@query
def threshold(spark, d):
    return ra.threshold(s.cells(spark, d), "crop_prob", s.CROP_T).select("row", "col", "crop_prob")


@query
def mosaic_masked(spark, d):
    """Scenes that are masked in one band: the last valid value counts, per band."""
    seen = F.when(F.col("l_linenumber") % 3 != 0, F.col("crop_prob"))
    masked = s.scenes(spark, d).withColumn("crop_prob", seen)
    return ra.mosaic(masked, s.ORDER, ["crop_prob", "lossyear"]).select("row", "col", "crop_prob", F.col("lossyear").cast("long").alias("lossyear"))


@query
def mosaic(spark, d):
    return s.cells(spark, d).select(
        "row", "col", "crop_prob", F.col("forest2020").cast("long").alias("forest2020"),
        F.col("lossyear").cast("long").alias("lossyear"),
    )


@query
def clip(spark, d):
    region = s.farm_runs(spark, d).select("row", "col_lo", "col_hi")
    return ra.clip(s.cells(spark, d), region).select("row", "col", "crop_prob")


@query
def clip_boundary(spark, d):
    """A boundary file, one of its features by name, and the raster clipped to it."""
    path = scratch_folder(spark)
    write_geojson(s.boundaries(spark, d), path)
    boundary = read_boundary(read_boundaries(spark, path), "properties.name", "ASIA")
    return sc.clip_to_boundary(s.cells(spark, d), boundary, s.GRID).select("row", "col", "crop_prob")


@query
def loss_mask(spark, d):
    return ra.loss_mask(s.cells(spark, d)).select("row", "col", "loss")


@query
def pixel_area(spark, d):
    return s.cells(spark, d).select("row").distinct().select(
        "row", F.round(DEGREE_GRID.pixel_area(F.col("row")), 6).alias("area_m2")
    )


@query
def with_bands(spark, d):
    return ra.loss_area_bands(s.cells(spark, d)).select("row", "col", "defo_m2", "total_m2")


def _tiled(spark, *batches) -> str:
    """A new tiled raster that holds the batches. The stand-in grid is small, and so are its tiles: 32 x 32 cells."""
    path = scratch_folder(spark)
    create_tiles(spark, path, batches[0].schema, shift=5)
    for batch in batches:
        add_cells(batch, path)
    return path


@query
def tile_directory(spark, d):
    """Cells stored by tile, and what the directory says about each."""
    rows = read_directory(spark, _tiled(spark, s.cells(spark, d)))
    return rows.select("tile", "n_cells", "row_lo", "row_hi", "col_lo", "col_hi")


@query
def clip_tiles(spark, d):
    """Two loads of scenes stored by tile; a boundary opens its tiles, and the mosaic is made of what it holds."""
    scenes, cut = s.scenes(spark, d), F.lit("1995-01-01").cast("date")
    late = F.coalesce(F.col("l_shipdate") >= cut, F.lit(False))
    path = _tiled(spark, scenes.filter(~late), scenes.filter(late))
    boundary = read_boundary(s.boundaries(spark, d), "name", "ASIA")
    return ra.mosaic(sc.clip_stored(spark, path, boundary, s.GRID), s.ORDER, s.BANDS).select("row", "col", "crop_prob")


@query
def zonal_sum_tiles(spark, d):
    """Band sums per parcel out of the tiles that parcels touch."""
    path = _tiled(spark, ra.loss_area_bands(s.cells(spark, d)))
    runs = s.farm_runs(spark, d)
    return zo.zonal_sum(runs, read_touching(spark, path, runs), ["defo_m2", "total_m2", "lossyear"], pruned=False)


@query
def sample_at_tiles(spark, d):
    """A band at points out of the tiles that hold a point."""
    path, points = _tiled(spark, s.cells(spark, d)), s.points(spark, d)
    return px.sample_at(points, read_touching(spark, path, px.point_runs(points)), "crop_prob", pruned=False)


@query
def resample(spark, d):
    coarse = ra.resample(s.cells(spark, d), 10, {"crop_prob": "avg", "area_m2": "sum"})
    return coarse.select("row", "col", F.round("crop_prob", 6).alias("crop_prob"), "area_m2")


@query
def erase_own(spark, d):
    """Erases the smallest affected parcel's cells from the mask."""
    affected = s.shares(spark, d).filter(F.col("defo_pct") > 0).agg(F.min("farm_id").alias("id")).first()["id"]
    return px.erase_own(s.loss(spark, d), s.farm_runs(spark, d), affected)


# ---- clusters and parcels ------------------------------------------------------------------------------

@query
def connected_components(spark, d):
    return cc.connected_components(s.crop_mask(spark, d))


@query
def component_size(spark, d):
    return _sizes(spark, d)


@query
def component_area_km2(spark, d):
    areas = cc.component_area_km2(cc.component_runs(s.crop_mask(spark, d)), s.GRID.pixel_area(F.col("row")))
    return areas.select("comp_id", F.round("area_km2", 6).alias("area_km2"))


@query
def largest_component(spark, d):
    areas = cc.component_area_km2(cc.component_runs(s.crop_mask(spark, d)), s.GRID.pixel_area(F.col("row")))
    return cc.largest_component(areas).select("comp_id", F.round("area_km2", 6).alias("area_km2"))


@query
def filter_size(spark, d):
    return cc.filter_size(_sizes(spark, d), *s.SIZE)


@query
def centroid(spark, d):
    return s.points(spark, d)


@query
def aoi_box(spark, d):
    return fp.aoi_box(s.points(spark, d), 20).withColumn(
        "n_rows", F.col("row_hi") - F.col("row_lo") + 1
    ).groupBy("row_lo", "row_hi", "col_lo", "col_hi", "n_rows").agg(F.count(F.lit(1)).alias("n"))


@query
def study_area_cells(spark, d):
    """Coarse clusters, the largest one's centroid, its box, and the cells inside."""
    rough = ra.threshold(ra.resample(s.cells(spark, d), 4, {"crop_prob": "avg"}), "crop_prob", 0.15)
    box = cc.study_area(rough, F.lit(1600.0), 40, 4)
    return ra.clip_box(s.cells(spark, d), *box).select("row", "col", "crop_prob")


@query
def assign_farm_id(spark, d):
    return cc.assign_farm_id(cc.filter_size(_sizes(spark, d), *s.SIZE))


@query
def area_ha(spark, d):
    return _sizes(spark, d).select("comp_id", F.round(cc.area_ha(F.col("n_cells")), 2).alias("area_ha"))


@query
def build_parcels(spark, d):
    """The whole first phase: study area, clusters, size filter, ids, areas, outline text."""
    farms, _ = sc.build_parcels(s.cells(spark, d), s.GRID, coarse=4, radius_m=400.0, lo=3, hi=8, t=0.15)
    return farms.select("farm_id", "n_cells", F.round("area_ha", 2).alias("area_ha"))


@query
def outline_perimeter(spark, d):
    runs = cc.component_runs(s.crop_mask(spark, d))
    edges = outline_edges(runs, "comp_id")
    length = F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))
    return edges.groupBy("comp_id").agg(F.sum(length).alias("perimeter"))


@query
def polygonize_parcels(spark, d):
    return geometry_texts(polygonize(s.farm_runs(spark, d)), scale=10.0)


@query
def outline_parts(spark, d):
    """Clusters as text and back: cells of a cluster, rings and parts of its outline."""
    text = geometry_texts(polygonize(cc.component_runs(s.crop_mask(spark, d)), "comp_id"), "comp_id", 10.0)
    back = text.select("comp_id", parse_rings(F.col("geometry")).alias("rings"))
    return cc.component_size(fp.polygon_runs(back, s.GRID, "comp_id"))


@query
def polygonize_area(spark, d):
    """Signed ring areas of cluster outlines add up to the cell counts."""
    shapes = polygonize(cc.component_runs(s.crop_mask(spark, d)), "comp_id").select("comp_id", F.explode("rings").alias("r"))
    sides = shapes.select(
        "comp_id", F.explode(F.arrays_zip(
            F.slice("r", F.lit(1), F.size("r") - 1).alias("a"), F.slice("r", F.lit(2), F.size("r") - 1).alias("b"))).alias("e"),
    )
    twice = F.col("e.a.x") * F.col("e.b.y") - F.col("e.b.x") * F.col("e.a.y")
    return sides.groupBy("comp_id").agg((F.sum(twice) / 2).cast("long").alias("n_cells"))


# ---- zonal and proximity -------------------------------------------------------------------------------

@query
def polygon_runs(spark, d):
    return fp.polygon_runs(s.rings(spark, d), s.GRID)


@query
def zonal_sum(spark, d):
    bands = ra.loss_area_bands(s.cells(spark, d))
    # the parcels cover the whole raster: nothing to prune
    return zo.zonal_sum(s.farm_runs(spark, d), bands, ["defo_m2", "total_m2", "lossyear"], pruned=False)


@query
def defo_pct(spark, d):
    return zo.parcel_loss(s.farm_runs(spark, d), zo.loss_words(s.cells(spark, d)), s.GRID)


@query
def buffer_runs(spark, d):
    return fp.buffer_runs(s.farm_runs(spark, d), 5)


@query
def ring_runs(spark, d):
    return fp.ring_runs(s.farm_runs(spark, d), 5)


@query
def assessed_parcels(spark, d):
    """Every parcel assessed, not yet scored."""
    rows = sc.assess(s.farm_runs(spark, d), s.cells(spark, d), s.GRID, s.AS_OF, s.farms(spark, d))
    return rows.select("farm_id", "defo_pct", "risk_score", "risk_class", F.date_format("assessed_at", "yyyy-MM-dd").alias("assessed_on"))


@query
def ring_features(spark, d):
    return zo.ring_features(s.farm_runs(spark, d), zo.loss_words(s.cells(spark, d)), s.GRID, s.RADII_M)


@query
def parcel_context(spark, d):
    return s.shares(spark, d)


@query
def nearest_loss(spark, d):
    found = px.nearest_loss(s.points(spark, d), s.loss(spark, d), 15)
    return found.select("farm_id", F.round(F.col("dist_px") * F.col("dist_px")).cast("long").alias("dist_px2"))


@query
def nearest_loss_excluding_own(spark, d):
    found = px.nearest_loss(s.points(spark, d), s.loss(spark, d), 15, s.farm_runs(spark, d))
    return found.select("farm_id", F.round(F.col("dist_px") * F.col("dist_px")).cast("long").alias("dist_px2"))


@query
def cap_distance_m(spark, d):
    found = px.nearest_loss(s.points(spark, d), s.loss(spark, d), 15)
    return found.select("farm_id", cap_distance(F.col("dist_px"), 10.0, 120.0).alias("dist_to_defo_m"))


@query
def distance_feature(spark, d):
    return _distance(spark, d)


@query
def sample_at(spark, d):
    return px.sample_at(s.points(spark, d), s.cells(spark, d), "crop_prob")


@query
def distance_band(spark, d):
    """The distance raster up to the library's own cap, for every valid cell."""
    words = zo.loss_words(s.cells(spark, d))
    band = ds.distance_band(words, int(s.GRID.cells(sc.DISTANCE_CAP_M)))
    return ds.distance_metres(band, s.GRID.cell_m, sc.DISTANCE_CAP_M)


@query
def masked_distance(spark, d):
    raster = cut_lineage(s.cells(spark, d))
    points, loss = s.points(spark, d), s.loss(spark, d, raster)
    original = px.distance_feature(points, loss, 10.0, s.CAP_M)
    return px.masked_distance(s.shares(spark, d, raster), original, points, loss, s.farm_runs(spark, d), 10.0, s.CAP_M)


@query
def both_distances(spark, d):
    return px.both_distances(s.points(spark, d), s.loss(spark, d), s.farm_runs(spark, d), 10.0, s.CAP_M)


@query
def context_features(spark, d):
    return sc.context_features(s.farm_runs(spark, d), cut_lineage(s.cells(spark, d)), s.GRID, s.RADII_M, s.CAP_M)


@query
def parcel_context_real(spark, d):
    """Own loss and rings of 200, 500 and 1000 m."""
    return s.shares(spark, d, radii_m=sc.RADII_M)


@query
def both_distances_real(spark, d):
    """Both distances up to 2560 m."""
    loss = s.loss(spark, d, cut_lineage(s.cells(spark, d)))
    return px.both_distances(s.points(spark, d), loss, s.farm_runs(spark, d), 10.0, sc.DISTANCE_CAP_M)


@query
def masking_report(spark, d):
    raster = cut_lineage(s.cells(spark, d))
    pairs = cut_lineage(px.both_distances(s.points(spark, d), s.loss(spark, d, raster), s.farm_runs(spark, d), 10.0, s.CAP_M))
    return rp.masking_report(
        s.shares(spark, d, raster), pairs.drop("dist_to_defo_m_masked"), pairs.drop("dist_to_defo_m")
    )


# ---- relational and serving ----------------------------------------------------------------------------

@query
def parcels_view(spark, d):
    return _view(spark, d)


@query
def model_frame(spark, d):
    return _frame(spark, d, masked=True)


@query
def semi_filter(spark, d):
    affected = s.shares(spark, d).filter(F.col("defo_pct") > 0)
    return sv.semi_filter(s.farms(spark, d), affected).select("farm_id", "area_ha")


@query
def list_farms(spark, d):
    return sv.list_farms(_view(spark, d), "LOW", 0.001, limit=100, offset=50).select(
        "farm_id", "area_ha", "defo_pct", "risk_score", "risk_class"
    )


@query
def list_farms_first_page(spark, d):
    return sv.list_farms(_view(spark, d)).select("farm_id", "area_ha", "defo_pct", "risk_score", "risk_class")


@query
def get_farm(spark, d):
    dated = sv.parcels_view(s.farms(spark, d), s.assessments(spark, d), dated=True)
    return sv.get_farm(dated, 42).drop("assessed_at")


@query
def projection(spark, d):
    return s.farms(spark, d).select(F.col("farm_id").cast("int").cast("long").alias("parcel"), F.col("geometry").alias("geom"))


@query
def page(spark, d):
    return sv.page(s.farms(spark, d), 25, 100).select("farm_id", "area_ha")


@query
def page_directory(spark, d):
    """A stored view and its directory: a first page, one across ranges, one of a class, one by score, and the last rows."""
    view = _view(spark, d)
    pages = sv.store_pages(view, scratch_folder(spark), rows_per_range=500)
    n = view.count()
    asked = {
        "first": (40, 0, None, None), "across": (600, 100, None, None), "class": (30, 60, ["HIGH", "MEDIUM", "LOW"], None),
        "score": (25, 10, ["LOW"], 0.001), "last": (20, n - 7, None, None),
    }
    out = None
    for name, request in asked.items():
        part = sv.read_page(pages, *request).select(F.lit(name).alias("request"), "farm_id", "area_ha", "risk_score", "risk_class")
        out = part if out is None else out.unionByName(part)
    return out


@query
def page_after(spark, d):
    return sv.page_after(s.farms(spark, d), 25, 100).select("farm_id", "area_ha")


@query
def early_warning(spark, d):
    return sv.early_warning(_view(spark, d), 10).select("farm_id", "area_ha", "defo_pct", "risk_score")


@query
def top_loss(spark, d):
    return sv.top_loss(_view(spark, d), 10).select("farm_id", "area_ha", "defo_pct")


@query
def sort_by_score(spark, d):
    return sv.sort_by_score(s.assessments(spark, d)).select("farm_id", "risk_score")


@query
def class_stats(spark, d):
    return sv.class_stats(s.assessments(spark, d)).withColumn("avg_risk_score", F.round("avg_risk_score", 6))


@query
def score_summary(spark, d):
    return rp.score_summary(s.assessments(spark, d))


@query
def totals(spark, d):
    return sv.totals(s.farms(spark, d))


@query
def count_where(spark, d):
    pct = F.col("defo_pct")
    return rp.count_where(s.assessments(spark, d), n_affected=pct > 0, n_clean=pct == 0, n_half=pct > 50, n_unknown=pct.isNull())


@query
def column_delta(spark, d):
    pairs = px.both_distances(s.points(spark, d), s.loss(spark, d), s.farm_runs(spark, d), 10.0, s.CAP_M)
    return rp.column_delta(pairs, "dist_to_defo_m", "dist_to_defo_m_masked").withColumn(
        "max_abs_delta", F.round("max_abs_delta", 1)
    )


@query
def value_counts(spark, d):
    return rp.value_counts(s.assessments(spark, d), "risk_class")


@query
def describe(spark, d):
    out = rp.describe(s.shares(spark, d), RINGS)
    return out.select("column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query
def affected_quantiles(spark, d):
    return rp.affected_quantiles(s.assessments(spark, d)).select(
        *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75", "q90")]
    )


@query
def median_threshold(spark, d):
    return rp.median_threshold(s.assessments(spark, d)).select(F.round("threshold", 4).alias("threshold"))


@query
def classes_by_learnt_median(spark, d):
    """The median of affected parcels as the class border."""
    rows = s.shares(spark, d).select("farm_id", "defo_pct")
    t = rp.median_threshold(rows).first()["threshold"]
    return rows.select("farm_id", risk_class(F.col("defo_pct"), t).alias("risk_class"))


@query
def verify_scores(spark, d):
    return rp.verify_scores(s.assessments(spark, d), s.table(spark, d, "customer").count())


@query
def head(spark, d):
    return rp.head(s.farms(spark, d), 5).select("farm_id", "n_cells", "area_ha")


# ---- labels and documents ------------------------------------------------------------------------------

@query
def risk_class_label(spark, d):
    return s.shares(spark, d).select("farm_id", risk_class(F.col("defo_pct"), MEDIAN_AFFECTED_PCT).alias("risk_class"))


@query
def risk_binary_label(spark, d):
    return s.shares(spark, d).select("farm_id", risk_binary(F.col("defo_pct")).alias("risk_binary"))


@query
def compliance_wording(spark, d):
    return s.assessments(spark, d).select("farm_id", compliance_label(F.col("risk_class")).alias("label"))


@query
def to_feature_text(spark, d):
    """Feature texts, taken apart again so that number formatting does not matter."""
    text = to_feature(_view(spark, d)).select("feature")
    prop = "$.properties."
    return text.select(
        F.get_json_object("feature", "$.type").alias("type"),
        F.get_json_object("feature", "$.geometry.type").alias("geometry_type"),
        *[F.get_json_object("feature", prop + c).cast(t).alias(c) for c, t in
          (("farm_id", "long"), ("area_ha", "double"), ("defo_pct", "double"), ("risk_score", "double"), ("risk_class", "string"))],
    )


@query
def feature_collection_size(spark, d):
    """A page of 100 parcels as one collection."""
    page_rows = sv.list_farms(_view(spark, d), limit=100)
    text = to_feature_collection(page_rows, F.col("farm_id"))
    kinds = "struct<type:string,features:array<struct<properties:struct<farm_id:bigint>>>>"
    doc = text.select(F.from_json("collection", kinds).alias("c"))
    return doc.select("c.type", F.posexplode("c.features").alias("place", "f")).select(
        "type", F.col("place").cast("long").alias("place"), F.col("f.properties.farm_id").alias("farm_id")
    )


@query
def geometry_round_trip(spark, d):
    rings = s.farms(spark, d).select("farm_id", F.explode(parse_rings(F.col("geometry"))).alias("ring"))
    return rings.select("farm_id", F.posexplode("ring").alias("place", "p")).select(
        "farm_id", F.col("place").cast("long").alias("place"), "p.x", "p.y"
    )


@query
def stats_document(spark, d):
    """The nested document, opened into rows."""
    doc = sv.stats_document(s.farms(spark, d), s.assessments(spark, d))
    return doc.select("total_parcels", "total_area_ha", "unclassified", F.posexplode("by_risk_class").alias("place", "e")).select(
        "total_parcels", "total_area_ha", "unclassified", F.col("place").cast("long").alias("place"), "e.*"
    )


@query
def browse(spark, d):
    return sv.browse(_view(spark, d), ["LOW", "HIGH"], 2).select("farm_id", "area_ha", "risk_class")


@query
def class_tiles(spark, d):
    return sv.class_tiles(s.assessments(spark, d)).select(F.col("place").cast("long").alias("place"), "risk_class", "label", "count")


@query
def rounding(spark, d):
    share = F.col("l_quantity") / 16.0 + F.col("l_linenumber")
    return s.table(spark, d, "lineitem").select(share.alias("v")).groupBy(
        F.bround("v", 3).alias("even3"), F.round("v", 1).alias("up1"), F.round("v", 2).alias("up2"), F.round("v", 4).alias("up4")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def scalar_functions(spark, d):
    x = F.col("l_quantity")
    return s.table(spark, d, "lineitem").select(x).distinct().select(
        x.alias("q"), F.round(F.sqrt(x), 6).alias("root"), F.abs(x - 25).alias("gap"),
        F.least(x, F.lit(30.0)).alias("clipped"), share_pct(x, F.lit(48.0)).alias("pct"),
    )


# ---- models --------------------------------------------------------------------------------------------

@query
def balanced_weight(spark, d):
    rows = s.assessments(spark, d).select("farm_id", "risk_class")
    return mo.balanced_weight(rows, "risk_class").select("farm_id", F.round("weight", 6).alias("weight"))


@query
def stratified_folds(spark, d):
    rows = s.assessments(spark, d).select("farm_id", "risk_class")
    return mo.stratified_folds(rows, "risk_class").select("farm_id", "risk_class", F.col("fold").cast("long").alias("fold"))


@query
def stratified_split(spark, d):
    rows = s.assessments(spark, d).select("farm_id", "risk_class")
    return mo.stratified_split(rows, "risk_class").select("farm_id", "is_test")


@query
def roc_auc(spark, d):
    return me.roc_auc(_ranked(spark, d), "risk_score", "hit").select(F.round("roc_auc", 6).alias("roc_auc"))


@query
def average_precision(spark, d):
    return me.average_precision(_ranked(spark, d), "risk_score", "hit").select(F.round("pr_auc", 6).alias("pr_auc"))


@query
def macro_f1(spark, d):
    return me.macro_f1(_ranked(spark, d), "risk_class", "predicted", CLASSES).select(F.round("macro_f1", 6).alias("macro_f1"))


@query
def classification_report(spark, d):
    out = me.classification_report(_ranked(spark, d), "risk_class", "predicted", CLASSES)
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def report_averages(spark, d):
    out = me.report_averages(_ranked(spark, d), "risk_class", "predicted", CLASSES)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c != "support"], "support")


@query
def confusion_matrix(spark, d):
    return me.confusion_matrix(_ranked(spark, d), "risk_class", "predicted", CLASSES)


@query
def select_best(spark, d):
    """Picks among the ring features by how well each ranks affected parcels."""
    frame = _frame(spark, d).filter(F.col("risk_binary").isNotNull())
    pairs = F.array(*[F.struct(F.lit(n).alias("features"), F.col(c).alias("value")) for n, c in
                      (("B: nb200 only", "nb_defo_pct_20"), ("D: nb 200+500+1000", "nb_defo_pct_50"),
                       ("A: area+nb200 (baseline)", "nb_defo_pct_100"))])
    rows = frame.select((F.col("defo_pct") > 0).cast("long").alias("hit"), F.explode(pairs).alias("p")).select("hit", "p.*")
    table = me.ranking_metrics(rows, "value", "hit", ["features"]).select(
        F.lit("RF").alias("model"), F.lit("binary").alias("framing"), "features",
        F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"),
    )
    return mo.select_best(table).select("features", "roc_auc", "pr_auc", F.col("n_feats").cast("long").alias("n_feats"))


@query
def leakage_audit(spark, d):
    out = mo.leakage_audit(_frame(spark, d).filter(F.col("risk_binary").isNotNull()), [*RINGS, "defo_pct", "area_ha"])
    return out.withColumn("roc_auc", F.round("roc_auc", 6)).drop("derived_from")


@query
def leakage_by_derivation(spark, d):
    """A feature that holds a little of the parcel's own share under a harmless name, beside honest ones."""
    frame = _frame(spark, d).filter(F.col("risk_binary").isNotNull())
    scaled = frame.withColumn("pressure", F.col("defo_pct") * 0.001).withColumn("pressure", F.col("pressure") + F.col("nb_defo_pct_20"))
    out = mo.leakage_audit(scaled, [*RINGS, "pressure", "area_ha"])
    return out.withColumn("roc_auc", F.round("roc_auc", 6))


@query
def forest_scores(spark, d):
    """A forest on every feature, scoring every parcel."""
    return mo.score_all(_real_frame(spark, d), "RF", mo.FEATURE_SETS["F: E + area"], mo.BINARY, SETTINGS).select("farm_id", "risk_score")


@query
def regression_scores(spark, d):
    return mo.score_all(_real_frame(spark, d), "LR", mo.FEATURE_SETS["F: E + area"], mo.BINARY, SETTINGS).select("farm_id", "risk_score")


@query
def cross_val_predict(spark, d):
    folded = cut_lineage(mo.stratified_folds(_real_frame(spark, d), "risk_binary", SETTINGS.folds))
    return mo.cross_val_predict(folded, "RF", mo.FEATURE_SETS["E: dist + nb multi"], mo.BINARY, SETTINGS)


@query
def out_of_fold_scores(spark, d):
    return mo.out_of_fold_scores(_real_frame(spark, d), "LR", mo.FEATURE_SETS["F: E + area"], SETTINGS)


@query
def importance_table(spark, d):
    return mo.importance_table(_real_frame(spark, d), mo.FEATURE_SETS, SETTINGS)


@query
def compare_models(spark, d):
    return mo.compare_models(_real_frame(spark, d), SETTINGS, mo.FEATURE_SETS)


@query
def variant_counts(spark, d):
    """What must hold for any comparison: each variant predicts every row with all features once, in [0, 1]."""
    rows = mo.variant_predictions(_real_frame(spark, d), mo.FEATURE_SETS, (mo.BINARY, mo.THREE_CLASS), SETTINGS)
    return rows.groupBy("model", "framing", "features", "label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("farm_id").alias("n_farms"), F.bool_and(F.col("score").between(0.0, 1.0)).alias("in_range")
    )


@query
def watch_list(spark, d):
    """Clean parcels by the stand-in score, with the features that explain it. Both read one stored mosaic."""
    raster = cut_lineage(s.cells(spark, d))
    assessed = s.assessments(spark, d, s.shares(spark, d, raster))
    scored = _real_frame(spark, d, raster=raster).join(assessed.select("farm_id", "risk_score"), "farm_id")
    return run_watch_list(scored, ["dist_to_defo_m", "nb_defo_pct_200", "nb_defo_pct_500", "nb_defo_pct_1000"], 25)


@query
def sensitivity(spark, d):
    return mo.sensitivity(_real_frame(spark, d, masked=True), SETTINGS, mo.MASKING_SETS)


@query
def usable_rows(spark, d):
    return mo.usable_rows(_real_frame(spark, d))


@query
def regression_score_ranges(spark, d):
    """What must hold for any fit: a row per parcel, a score where no feature is missing, all in [0, 1]."""
    scored = mo.score_all(_real_frame(spark, d), "LR", mo.FEATURE_SETS["F: E + area"], mo.BINARY, SETTINGS)
    return scored.select("farm_id", F.col("risk_score").isNotNull().alias("scored"), _in_range("risk_score"))


@query
def out_of_fold_ranges(spark, d):
    """One held-out score in [0, 1] per labelled parcel with every feature."""
    scores = mo.out_of_fold_scores(_real_frame(spark, d), "LR", mo.FEATURE_SETS["F: E + area"], SETTINGS)
    return scores.select("farm_id", _in_range("oof_score"))


@query
def scoring_run(spark, d):
    """Compare, select, refit, score and store; the rows are those of the stored snapshot."""
    path = scratch_folder(spark)
    reset_store(spark, path)
    frame = cut_lineage(_real_frame(spark, d))
    append_table(frame.withColumn("assessed_at", F.lit(s.AS_OF)).drop("risk_class"), path, "assessments")
    run_scoring(frame, path, SETTINGS)
    rows = read_table(spark, path, "assessments")
    return rows.select("farm_id", "defo_pct", "risk_class", _in_range("risk_score"))


@query
def score_v2(spark, d):
    _, scores = mo.score_v2(_real_frame(spark, d), ["area_ha", "nb_defo_pct_200"], SETTINGS)
    return scores


@query
def score_v2_report(spark, d):
    report, _ = mo.score_v2(_real_frame(spark, d), ["area_ha", "nb_defo_pct_200"], SETTINGS)
    return report
