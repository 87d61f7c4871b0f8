"""Session-level helpers: checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only if it is known to have at most this many rows.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the shared folder of spark.checkpoint.dir; a temporary one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="corpusmill-")
    sc.setCheckpointDir(where)


def checkpoint_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder; later plans read them from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if a (checkpointed) side has at most so many rows, else leaves a shuffle join."""
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df


def spread(df: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than there are cores, dealt out over all cores.

    Only a small input (at most one scan partition per core) is ever shuffled by
    this; work per row that takes long would else leave cores idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df._jdf.queryExecution().toRdd().getNumPartitions() < cores
    return df.repartition(cores) if few else df


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, for clusters where it is not installed."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusmill_shipped", None):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(SparkFiles.getRootDirectory(), "corpusmill-package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    sc._corpusmill_shipped = True
