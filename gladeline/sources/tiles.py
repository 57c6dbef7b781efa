"""A raster stored by tile, with a directory of what every tile holds.

``<path>/cells/batch=/tile_row=/tile=`` are the cells, ``<path>/directory`` one row per batch and tile, ``<path>/layout``
the side of a tile and the schema. A batch of more than ``MOST_FOLDERS`` tiles is stored in folders of 2 x 2, 4 x 4, ...
tiles, so that the number of files follows the cells and not the tiles; ``tile_row`` and ``tile`` are then those of the
first tile, followed by ``+`` and the side. A batch counts from the moment its directory rows are written, so a load that
fails is never read, and a reader keeps the batches it began with.

Defined cases: a cell without a row or column is refused; repeated cells are kept, also across batches; an empty
batch is no batch; negative rows and columns have tiles of their own.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gladeline.operators.raster import MOST_TILES
from gladeline.session import cut_lineage

SHIFT = 12  # 4096 x 4096 cells per tile
MOST_FOLDERS = 256  # of a batch
MOST_STEPS = 20  # a folder is 2^20 tiles wide at most
DIRECTORY = T.StructType([
    T.StructField("batch", T.StringType()),
    T.StructField("tile_row", T.LongType()),
    T.StructField("tile", T.StringType()),
    T.StructField("n_cells", T.LongType()),
    T.StructField("row_lo", T.LongType()),
    T.StructField("row_hi", T.LongType()),
    T.StructField("col_lo", T.LongType()),
    T.StructField("col_hi", T.LongType()),
    T.StructField("folder", T.StringType()),
])
_LAYOUT = "shift int, fields string"


def _tile_row(row: Column, shift: int) -> Column:
    return F.shiftright(row.cast("long"), shift)


def _tile(tile_row: Column, tile_col: Column) -> Column:
    return F.concat_ws("_", tile_row.cast("string"), tile_col.cast("string"))


def _folder_row(row: Column, shift: int, step: int) -> Column:
    """The tile row that names a folder of ``2^step`` tiles a side."""
    return F.shiftleft(_tile_row(row, shift + step), step)


def _folder(row: Column, col: Column, shift: int, step: int) -> Column:
    name = _tile(_folder_row(row, shift, step), _folder_row(col, shift, step))
    return F.concat(name, F.lit(f"+{1 << step}")) if step else name


def _step(cells: DataFrame, shift: int) -> int:
    """How often folders double their side until ``MOST_FOLDERS`` hold the cells, counted over the tiles alone."""
    tiles = cut_lineage(cells.select(_tile_row(F.col("row"), shift).alias("row"), _tile_row(F.col("col"), shift).alias("col")).distinct())
    wide = [F.countDistinct(_folder_row(F.col("row"), 0, k), _folder_row(F.col("col"), 0, k)).alias(str(k)) for k in range(MOST_STEPS + 1)]
    if tiles.count() <= MOST_FOLDERS:
        return 0
    held = tiles.agg(*wide[1:]).first()
    return next((int(k) for k in held.asDict() if held[k] <= MOST_FOLDERS), MOST_STEPS)


def create_tiles(spark: SparkSession, path: str, schema: T.StructType, shift: int = SHIFT) -> None:
    """An empty tiled raster for cells of ``schema``, which holds ``row`` and ``col``; a path is used once."""
    missing = {"row", "col"} - set(schema.names)
    if missing:
        raise ValueError(f"cells without {sorted(missing)}")
    spark.createDataFrame([(shift, schema.json())], _LAYOUT).coalesce(1).write.parquet(f"{path}/layout")
    spark.createDataFrame([], DIRECTORY).write.parquet(f"{path}/directory")


def _layout(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    shift, fields = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
    return shift, T.StructType.fromJson(json.loads(fields))


def add_cells(cells: DataFrame, path: str) -> None:
    """Store ``cells`` as one more batch; columns are matched by name and cast to the stored types.

    Cells are shuffled by folder and rebalanced, so that one with very many cells is written by several tasks and
    small ones share a task. Files are sorted by row and column, whose statistics then prune inside a tile.
    """
    spark = cells.sparkSession
    shift, schema = _layout(spark, path)
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    typed = cells.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    for place in ("row", "col"):
        known = F.coalesce(F.col(place), F.raise_error(F.lit(f"cell without {place}")).cast(schema[place].dataType))
        typed = typed.withColumn(place, known)
    step, row, col = _step(typed, shift), F.col("row").cast("long"), F.col("col").cast("long")
    placed = typed.withColumn("tile_row", _folder_row(row, shift, step)).withColumn("tile", _folder(row, col, shift, step))
    sorted_cells = placed.hint("rebalance", "tile").sortWithinPartitions("tile_row", "tile", "row", "col")
    folder = f"{path}/cells/batch={batch}"
    sorted_cells.write.partitionBy("tile_row", "tile").parquet(folder)
    tile_row = _tile_row(row, shift).alias("tile_row")
    tile = _tile(_tile_row(row, shift), _tile_row(col, shift)).alias("tile")
    held = spark.read.schema(_stored(schema)).parquet(folder).groupBy(tile_row, tile, F.col("tile").alias("folder")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.min(row).alias("row_lo"), F.max(row).alias("row_hi"),
        F.min(col).alias("col_lo"), F.max(col).alias("col_hi"),
    )
    entries = held.withColumn("batch", F.lit(batch)).select(*DIRECTORY.names)
    # one file per batch: its rows are tiles, not cells, and they appear all at once
    entries.coalesce(1).write.mode("append").parquet(f"{path}/directory")


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema, T.StructField("tile_row", T.LongType()), T.StructField("tile", T.StringType())])


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch and tile: number of cells and the box around them."""
    return spark.read.schema(DIRECTORY).parquet(f"{path}/directory")


def _all_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the published batches, with their partition columns. Batches are loads: one row each comes here."""
    _, schema = _layout(spark, path)
    batches = sorted(r[0] for r in read_directory(spark, path).select("batch").distinct().collect())
    if not batches:
        return spark.createDataFrame([], _stored(schema))
    folders = [f"{path}/cells/batch={b}" for b in batches]
    parts = spark.read.schema(_stored(schema)).option("basePath", f"{path}/cells").parquet(*folders)
    return parts.select(*_stored(schema).names)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """All cells."""
    return _all_cells(spark, path).drop("tile_row", "tile")


def tiles_of_runs(runs: DataFrame, shift: int) -> DataFrame:
    """The tiles that the runs ``(row, col_lo, col_hi)`` touch: ``tile_row, tile``, each once."""
    lo, hi = _tile_row(F.col("col_lo"), shift), _tile_row(F.col("col_hi"), shift)
    spans = runs.select(_tile_row(F.col("row"), shift).alias("tile_row"), lo.alias("lo"), hi.alias("hi")).distinct()
    each = spans.select("tile_row", F.explode(F.sequence("lo", "hi")).alias("tile_col"))
    return each.select("tile_row", _tile(F.col("tile_row"), F.col("tile_col")).alias("tile")).distinct()


def read_touching(spark: SparkSession, path: str, runs: DataFrame, most_tiles: int = MOST_TILES) -> DataFrame:
    """Cells of the tiles that the runs touch; those of other tiles are not opened.

    The tiles touched are matched with the directory and written, a row each, then broadcast: at run time Spark prunes
    the folders of the scan by them, and cells of other tiles in the same folder are dropped by their own tile. (Over an unwritten plan the adaptive planner may change the plan of the
    broadcast, then finds nothing to reuse for the pruning, and scans every folder.) With more than ``most_tiles`` of
    them nothing is broadcast: the tile rows between the first and the last prune the folders, a shuffled join the rest.
    """
    shift, _ = _layout(spark, path)
    # directories written before folders held several tiles name none
    folder = F.coalesce("folder", "tile").alias("folder")
    held = read_directory(spark, path).groupBy("tile_row", "tile", folder).agg(F.sum("n_cells").alias("n_cells"))
    touched = cut_lineage(held.join(tiles_of_runs(runs, shift), ["tile_row", "tile"], "left_semi"))
    folder_row = F.split("folder", "_")[0].cast("long")
    n, first, last, several = touched.agg(
        F.count(F.lit(1)), F.min(folder_row), F.max(folder_row), F.bool_or(F.col("folder") != F.col("tile"))
    ).first()
    cells = _all_cells(spark, path)
    names = cells.columns
    wanted = touched.filter(F.col("n_cells") > 0)  # dynamic pruning asks for a filter on this side
    if several:
        cells = cells.withColumn("__tile", _tile(_tile_row(F.col("row"), shift), _tile_row(F.col("col"), shift)))
        wanted, by = wanted.select(F.col("folder").alias("tile"), F.col("tile").alias("__tile")), ["tile", "__tile"]
    else:
        wanted, by = wanted.select("tile"), ["tile"]
    if n == 0:
        near = cells.filter(F.lit(False))
    elif n <= most_tiles:
        near = cells.join(F.broadcast(wanted), by, "left_semi")
    else:
        near = cells.filter(F.col("tile_row").between(first, last)).hint("merge").join(wanted, by, "left_semi")
    return near.select(*names).drop("tile_row", "tile")
