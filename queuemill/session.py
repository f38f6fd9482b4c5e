"""Session set-up and the shared folder for checkpoints and scratch tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.checkpoint.compress": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def get_session(app_name: str = "queuemill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to every Python worker, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_queuemill_shipped", False):
        return
    package = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="queuemill-"), "queuemill")
    context.addPyFile(shutil.make_archive(archive, "zip", package.parent, package.name))
    context._queuemill_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests) gets a folder of its own; on a cluster a missing setting is an
    error, since executors could not read each other's machine-local files.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = context.getCheckpointDir() or tempfile.mkdtemp(prefix="queuemill-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared checkpoint folder; :func:`clear_scratch` deletes it."""
    path = os.path.join(checkpoint_root(spark), "queuemill", f"{label}-{uuid.uuid4().hex}")
    context = spark.sparkContext
    context._queuemill_scratch = [*getattr(context, "_queuemill_scratch", []), path]
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders that this session has made so far; returns how many there were.

    Call it when the results that read them have been written: plans read scratch tables when they run.
    """
    context = spark.sparkContext
    made = getattr(context, "_queuemill_scratch", [])
    context._queuemill_scratch = []
    settings = context._jsc.hadoopConfiguration()
    for path in made:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(settings).delete(folder, True)
    return len(made)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, column by column."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The configured number of shuffle partitions, for exchanges that must not be coalesced."""
    value = spark.conf.get("spark.sql.shuffle.partitions")
    return int(value) if value.isdigit() else spark.sparkContext.defaultParallelism


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder with its partitions as they are.

    Later steps reread it, also after executor loss.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
