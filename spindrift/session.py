"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "spindrift", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume; on a cluster, pass your own session instead."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    Workers get PYTHONPATH from the context's environment, so a cluster whose nodes have the package elsewhere keeps its own path: the entry is appended.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def shared_uri(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a temporary one. A cluster without it raises an error."""
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if uri:
        return uri.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not os.path.isdir(getattr(shared_uri, "own", "")):
        shared_uri.own = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, shared_uri.own, True)
    return f"file://{shared_uri.own}"


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder, where they outlive any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_uri(spark))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str):
    """A driver table, read from any path that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
