"""One small entry for each micro-batch that is on disk: readers see those batches only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_manifest"
ENTRY = "batch_id bigint, rows bigint, files array<struct<path:string,bytes:bigint>>"


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def commit(spark: SparkSession, out: str, batch_id: int) -> dict:
    """Enter what lies in the folder of a batch: its files, and its rows by the files' footers. An empty batch has an entry, too.

    The entry is written aside and renamed, so it is there whole or not at all; a repeated batch replaces its own.
    """
    folder = f"{out}/batch_id={batch_id}"
    store, place = _store(spark, folder)
    found, rows = [], 0
    if store.exists(place):
        found = sorted((f.getPath().getName(), f.getLen()) for f in store.listStatus(place) if f.getPath().getName().endswith(".parquet"))
        rows = spark.read.parquet(folder).count() if found else 0
    entry = {"batch_id": batch_id, "rows": rows, "files": [{"path": name, "bytes": size} for name, size in found]}
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    aside, final = path(f"{out}/{FOLDER}/.{batch_id}.new"), path(f"{out}/{FOLDER}/{batch_id}.json")
    sink = store.create(aside, True)
    try:
        sink.write(bytearray((json.dumps(entry) + "\n").encode()))
    finally:
        sink.close()
    if store.exists(final):
        store.delete(final, False)
    if not store.rename(aside, final):
        raise OSError(f"batch {batch_id} can't be entered in {out}/{FOLDER}")
    return entry


def entries(spark: SparkSession, out: str) -> DataFrame:
    """Committed batches: id, rows, files."""
    if not exists(spark, f"{out}/{FOLDER}"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(f"{out}/{FOLDER}")


def committed(rows: DataFrame, out: str) -> DataFrame:
    """`rows` (with batch_id) of committed batches; all of a folder without a manifest."""
    spark = rows.sparkSession
    if not exists(spark, f"{out}/{FOLDER}"):
        return rows
    known = entries(spark, out).select("batch_id").distinct()
    return rows.join(known.withColumn("batch_id", F.col("batch_id").cast(rows.schema["batch_id"].dataType)), "batch_id", "left_semi")
