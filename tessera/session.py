"""Sessions: what every query needs of the one it runs in."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_LOCAL: list[str] = []
#: Bytes of a batch that a Python worker gets.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it runs from a source folder (clusters ship it with --py-files), and bounds
    the bytes of what they get at once, where the session does not say it: rows alone do not, as texts may be long."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    return spark


def local(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true"}
    return prepare(SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate())


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process, so any folder is shared; a local-cluster is not."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of spark.checkpoint.dir; else a temporary one in a local session, and one below the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not is_local(spark):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera_shared"
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written to the shared folder and read back, so that plans do not grow with rounds and lost executors cost no more than a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task of dealt() gets at most, about, and those worth a task of their own.
TASK_ROWS, LEAST_ROWS = 500_000, 50_000


def dealt(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """df dealt by keys into as many tasks as so many rows need, so that what a task holds does not grow with the table."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(min(wanted, 1 + rows // LEAST_ROWS), -(-rows // TASK_ROWS)), *keys)
