"""Session set-up and the one place that knows where intermediate tables go."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants. All of them can be overridden by the cluster or by `extra`.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
    "spark.sql.parquet.int96RebaseModeInWrite": "CORRECTED",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app_name: str, master: str | None = None, extra: dict | None = None) -> SparkSession:
    """Session builder. `master` is left to spark-submit unless given (local runs, tests)."""
    # Driver and workers must run one interpreter, or the first Python task fails on a version check.
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    os.environ.setdefault("PYSPARK_DRIVER_PYTHON", sys.executable)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by `spark.checkpoint.dir`.

    A local session without the setting gets a temporary folder. On a cluster a missing setting is an
    error: a machine-local folder would be lost together with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    context = spark.sparkContext
    if not getattr(context, "_crowdlens_folder", None):  # the setting itself can't be changed in a running session
        context._crowdlens_folder = tempfile.mkdtemp(prefix="crowdlens-")
    return context._crowdlens_folder


def stage_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark)}/crowdlens/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the checkpoint folder and read it back.

    Cuts the lineage, so a result that several later steps need is computed once, and it survives the
    loss of executors. Being columnar, each reader still scans only the columns it uses.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Spark send the package to all workers, once per context: they may have no other way to import it."""
    context = spark.sparkContext
    if getattr(context, "_crowdlens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="crowdlens-code-")  # the driver's; addPyFile copies the file to every executor
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{root.name}.zip", "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(f"{folder}/{root.name}.zip")
    context._crowdlens_shipped = True
