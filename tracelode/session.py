"""Spark session settings and lineage cuts shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped_to: list[SparkContext] = []


def build_session(app: str = "tracelode", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on; the cluster's own values win where set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once a context, for Python code that calls it in tasks."""
    context = spark.sparkContext
    if context in _shipped_to:
        return
    source = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{source.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(source.rglob("*.py")):
            archive.write(path, path.relative_to(source.parent))
    context.addPyFile(str(target))
    _shipped_to[:] = [context]


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or a scratch folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh sub-folder of the shared folder, for tables a job writes and reads back."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: a lost executor costs no recomputation.

    A written table rather than `checkpoint()`: a checkpointed plan keeps the filter constraints of
    its source, and in a loop of joins those pile up until the generated code no longer compiles.
    The table also has a known size, so joins with it are planned on facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "round")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
