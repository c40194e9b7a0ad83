"""Raw JSON lines to typed, partitioned Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from crowdlens.functions.lists import clean_list, counted_list
from crowdlens.functions.text import text_fingerprint, word_count
from crowdlens.sources.schemas import PRIMARY_ID, SCHEMAS

# Fixed value: timestamp format of the raw records.
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
CORRUPT = "_corrupt"
PARTITION_BY = {"review": ("year",)}


class MissingInput(FileNotFoundError):
    """A raw file is not where it was expected."""


def read_raw(spark: SparkSession, entity: str, path: str) -> DataFrame:
    """Records of one entity under its declared schema, plus `_corrupt` with the text of a broken line."""
    declared = SCHEMAS[entity]
    schema = StructType([*declared.fields]).add(CORRUPT, StringType())
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", CORRUPT).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingInput(f"no {entity} records at {path}: put the raw JSON lines there first") from error
        raise


def _usable(entity: str) -> Column:
    usable = F.col(CORRUPT).isNull()
    return usable & F.col(PRIMARY_ID[entity]).isNotNull() if PRIMARY_ID[entity] else usable


def set_aside_broken(raw: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(usable records, quarantined records): broken lines and records without their primary id go aside."""
    return raw.where(_usable(entity)).drop(CORRUPT), raw.where(~_usable(entity))


def moment(column: str) -> Column:
    """Time of a raw record; a bad one becomes null."""
    return F.try_to_timestamp(column, F.lit(TIMESTAMP_FORMAT))


def transform_business(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("category_list", clean_list(F.col("categories")))
        .withColumn("n_categories", F.size("category_list"))
        .withColumn("is_open", F.col("is_open").cast("boolean"))
        .drop("categories")
    )


def transform_review(df: DataFrame, order: str = "reference", min_fingerprint_chars: int = 0) -> DataFrame:
    """Parsed time with its date and year, text length, words and fingerprint. A bad time becomes null."""
    return (
        df.withColumn("ts", moment("date"))
        .withColumns({"review_date": F.to_date("ts"), "year": F.year("ts")})
        .withColumns({
            "text_len": F.length("text"),
            "word_count": word_count(F.col("text")),
            "text_hash": text_fingerprint(F.col("text"), order, min_fingerprint_chars),
        })
        .drop("date")
    )


def transform_user(df: DataFrame) -> DataFrame:
    """Join time, number of friends and of elite years. The lists themselves are dropped."""
    return df.withColumns({
        "yelping_since_ts": moment("yelping_since"),
        "friend_count": counted_list(F.col("friends"), ("None",)),
        "elite_years": counted_list(F.col("elite"), ("",)),
    }).drop("friends", "elite", "yelping_since")


def transform_checkin(df: DataFrame) -> DataFrame:
    return df.withColumn("checkin_count", counted_list(F.col("date"), ("",))).drop("date")


def transform_tip(df: DataFrame) -> DataFrame:
    return df.withColumns({"ts": moment("date"), "tip_date": F.to_date(moment("date"))}).drop("date")


TRANSFORMS = {
    "business": transform_business,
    "review": transform_review,
    "user": transform_user,
    "checkin": transform_checkin,
    "tip": transform_tip,
}


@dataclass(frozen=True)
class IngestResult:
    entity: str
    rows_in: int
    rows_written: int
    rows_quarantined: int


class RowsLost(RuntimeError):
    """Fewer or more rows landed than were read."""


def ingest_entity(spark: SparkSession, entity: str, raw_path: str, out_root: str) -> IngestResult:
    """Read, transform and write one entity, then check that every record landed or was quarantined.

    Clean input is parsed once; the check counts lines without parsing them (observed metrics would save that pass, but a
    session that has used them can no longer run the ML models of this Spark version). Only if some did not land does a
    second pass write the broken ones aside; a quarantine of an earlier run goes away. Reviews are partitioned by year.
    Rebalancing gives each year files of even size: without it every input task would leave a small file in every year,
    and a plain repartition one huge file per year.
    """
    usable, broken = set_aside_broken(read_raw(spark, entity, raw_path), entity)
    target, aside = f"{out_root}/{entity}", f"{out_root}/_quarantine/{entity}"
    rows = TRANSFORMS[entity](usable)
    if entity in PARTITION_BY:
        rows = rows.hint("rebalance", *PARTITION_BY[entity])
    rows.write.mode("overwrite").partitionBy(*PARTITION_BY.get(entity, ())).parquet(target)
    # A line of blanks and tabs is no record; the JSON reader skips it.
    rows_in = spark.read.text(raw_path).where(F.col("value").rlike(r"[^ \t\r]")).count()
    written, quarantined = spark.read.parquet(target).count(), 0
    if written != rows_in or _exists(spark, aside):
        broken.write.mode("overwrite").parquet(aside)
        quarantined = spark.read.parquet(aside).count()
    result = IngestResult(entity, rows_in, written, quarantined)
    if written + quarantined != rows_in:
        raise RowsLost(str(result))
    return result


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ingest(
    spark: SparkSession, raw_paths: dict, out_root: str, only: Sequence[str] | None = None
) -> list[IngestResult]:
    """Ingest all entities of `raw_paths`, or those in `only`."""
    chosen = list(only or raw_paths)
    unknown = [name for name in chosen if name not in SCHEMAS or name not in raw_paths]
    if unknown:
        raise ValueError(f"unknown entities: {unknown}")
    return [ingest_entity(spark, entity, raw_paths[entity], out_root) for entity in chosen]
