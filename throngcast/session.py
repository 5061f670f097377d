"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **settings: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, RocksDB state)."""
    builder = (
        SparkSession.builder.appName("throngcast")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application; their Python workers import the state machines."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    # only the driver reads this file, Spark distributes it
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='throngcast-package-')}/throngcast", "zip", package.parent, package.name)
    context.addPyFile(archive)
    # the worker that starts a stream's processor runs next to the driver and does not see added files
    known = context.environment.get("PYTHONPATH", "")
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, str(package.parent)]))
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> None:
    """Package and runtime settings the operators rely on, for sessions built elsewhere."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="throngcast-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for one run's tables or stream checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts lineage like a checkpoint, but is read by columns and has a known size."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
