"""Results per model arm, kept as versions: a new run replaces its own arms and leaves the others."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.operators.upsert import metrics_upsert


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, or None before the first run."""
    stored = _versions(spark, path)
    if stored is None:
        return None
    newest = stored.agg(F.max("version")).head()[0]
    return stored.where(F.col("version") == newest).drop("version")


def record(new: DataFrame, path: str, key: str = "arm") -> DataFrame:
    """Merge `new` into the latest version and write the result as the next one. Earlier versions stay."""
    spark = new.sparkSession
    stored = _versions(spark, path)
    number, merged = 0, new
    if stored is not None:
        number = stored.agg(F.max("version")).head()[0] + 1
        merged = metrics_upsert(latest(spark, path), new, [key])
    merged.withColumn("version", F.lit(number)).coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return latest(spark, path)
