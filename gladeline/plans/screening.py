"""From raster cells to assessed parcels with context features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gladeline.functions.geojson import geometry_texts, parse_rings
from gladeline.functions.labels import MEDIAN_AFFECTED_PCT, risk_binary, risk_class
from gladeline.grid import GridSpec
from gladeline.operators.components import MAX_PIXELS, MIN_PIXELS, parcels, study_area
from gladeline.operators.footprints import centroid, parcel_points, polygon_runs
from gladeline.operators.outlines import polygonize
from gladeline.operators.proximity import both_distances
from gladeline.operators.raster import clip, clip_box, is_loss, resample, threshold
from gladeline.operators.zonal import loss_words, parcel_context, parcel_loss
from gladeline.session import cut_lineage
from gladeline.sources.store import with_defaults
from gladeline.sources.tiles import read_touching

CROP_THRESHOLD = 0.3
RADII_M = (200, 500, 1000)
DISTANCE_CAP_M = 2560.0
STUDY_RADIUS_M = 20_000


def build_parcels(
    cells: DataFrame, grid: GridSpec, coarse: int = 100, radius_m: float = STUDY_RADIUS_M,
    lo: int = MIN_PIXELS, hi: int = MAX_PIXELS, t: float = CROP_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """Study area from the largest coarse cluster, then parcels from the fine clusters inside it.

    Returns ``farms(farm_id, n_cells, area_ha, geometry)`` and ``farm_runs``.
    """
    rough = threshold(resample(cells, coarse, {"crop_prob": "avg"}), "crop_prob", t)
    coarse_grid = GridSpec(grid.cell_m * coarse, grid.lat0, grid.cell_deg and grid.cell_deg * coarse)
    box = study_area(rough, coarse_grid.pixel_area(F.col("row")), grid.cells(radius_m), coarse)
    if box is None:
        raise ValueError("no cell passes the threshold")
    mask = threshold(clip_box(cells, *box), "crop_prob", t).select("row", "col")
    farms, runs = parcels(mask, lo, hi)
    shapes = geometry_texts(polygonize(runs), scale=grid.cell_m)
    return farms.drop("comp_id").join(shapes, "farm_id"), runs


def boundary_runs(boundaries: DataFrame, grid: GridSpec) -> DataFrame:
    """The boundaries ``(geometry)`` as runs ``(row, col_lo, col_hi)``; those of different ones may overlap."""
    shapes = boundaries.select("geometry").distinct().select(
        F.sha2("geometry", 256).alias("shape"), parse_rings(F.col("geometry")).alias("rings")
    )
    return polygon_runs(shapes, grid, "shape").select("row", "col_lo", "col_hi")


def clip_to_boundary(cells: DataFrame, boundaries: DataFrame, grid: GridSpec) -> DataFrame:
    """Cells whose centre lies in any of the boundaries ``(geometry)``: holes and several parts count, overlaps once."""
    return clip(cells, boundary_runs(boundaries, grid))


def clip_stored(spark: SparkSession, path: str, boundaries: DataFrame, grid: GridSpec) -> DataFrame:
    """As :func:`clip_to_boundary` over a tiled raster, of which only the tiles that a boundary touches are opened."""
    runs = cut_lineage(boundary_runs(boundaries, grid))
    return clip(read_touching(spark, path, runs), runs, pruned=False)


def assess(farm_runs: DataFrame, cells: DataFrame, grid: GridSpec, as_of: str, parcels: DataFrame | None = None) -> DataFrame:
    """Unscored assessments: own loss of every parcel, of all in ``parcels`` if given."""
    loss = with_defaults(parcel_loss(farm_runs, loss_words(cells), grid, parcels), as_of)
    return loss.select(
        "farm_id", "defo_m2", "total_m2", "defo_pct", F.lit(None).cast("double").alias("risk_score"),
        F.lit(None).cast("string").alias("risk_class"), "assessed_at",
    )


def context_features(
    farm_runs: DataFrame, cells: DataFrame, grid: GridSpec,
    radii_m: Sequence[int] = RADII_M, cap_m: float = DISTANCE_CAP_M, parcels: DataFrame | None = None,
) -> DataFrame:
    """Own loss, ring shares and both distances per parcel.

    With ``parcels(farm_id, rings)`` those that own no cell have a row too: NULL shares, and distances from the
    centroid of their polygon.
    """
    points = centroid(farm_runs) if parcels is None else parcel_points(parcels, farm_runs, grid)
    loss = cells.filter(is_loss()).select("row", "col")
    distances = both_distances(points, loss, farm_runs, grid.cell_m, cap_m)
    return parcel_context(farm_runs, loss_words(cells), grid, radii_m, parcels).join(distances, "farm_id")


def model_frame(
    farms: DataFrame, assessments: DataFrame, *features: DataFrame, t: float = MEDIAN_AFFECTED_PCT
) -> DataFrame:
    """Parcels with own share, features and both labels; a parcel must be in every table."""
    frame = farms.select("farm_id", "area_ha").join(assessments.select("farm_id", "defo_pct"), "farm_id")
    for table in features:
        frame = frame.join(table, "farm_id")
    share = F.col("defo_pct")
    return frame.withColumn("risk_class", risk_class(share, t)).withColumn("risk_binary", risk_binary(share))
