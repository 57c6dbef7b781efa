"""Session settings and the shared folder for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    cores = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gladeline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names, else a local one in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="gladeline-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, for files that are read back at once."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints once and go on from the files.

    The files survive the loss of an executor, so what follows never reruns the plan before it. Unlike a
    checkpoint, a file scan brings no constraints of the old plan along; in a loop those would pile up and slow
    the planner more with every round.
    """
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
