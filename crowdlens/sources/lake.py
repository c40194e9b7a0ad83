"""Landing Parquet in a lake and querying it as external tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), only_these_partitions: bool = False) -> None:
    """Overwrite a table, or with `only_these_partitions` just the partitions present in `df`."""
    writer = df.write.mode("overwrite")
    if only_these_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def land(spark: SparkSession, source: str, target: str, partition_by: Sequence[str] = ("year",)) -> None:
    """Copy a Parquet table to another store, keeping those of `partition_by` that it has. `target` may be any Hadoop path.

    Rebalancing gives each partition folder files of even size.
    """
    table = spark.read.parquet(source)
    kept = [name for name in partition_by if name in table.columns]
    write_parquet(table.hint("rebalance", *kept) if kept else table, target, kept)


def landing_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What a landing would copy, without reading file contents: files and bytes per partition folder."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        .load(path).select("path", "length")
    )
    folder = F.regexp_extract("path", r"/([^/=]+=[^/]*)/[^/]+$", 1)
    return files.groupBy(folder.alias("partition")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )


def external_table_ddl(table: str, df: DataFrame, location: str, partition_by: Sequence[str] = ()) -> str:
    """CREATE TABLE text for Parquet files at `location` with the schema of `df`."""
    columns = ",\n  ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in df.schema.fields)
    partitions = f"\nPARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    return f"CREATE TABLE IF NOT EXISTS {table} (\n  {columns}\n)\nUSING parquet{partitions}\nLOCATION '{location}'"


def register_table(spark: SparkSession, table: str, location: str, partition_by: Sequence[str] = ()) -> None:
    """Create the external table and make its partition folders known; without that it looks empty."""
    spark.sql(external_table_ddl(table, spark.read.parquet(location), location, partition_by))
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {table}")


def reviews_of_year(reviews: DataFrame, year: int) -> DataFrame:
    """Review count and mean rating of a year. Filters the partition column, so other years are not read."""
    return reviews.where(F.col("year") == year).agg(
        F.count("*").alias("reviews"), F.round(F.avg("stars"), 3).alias("avg_stars")
    )


def stars_by_region(
    reviews: DataFrame, businesses: DataFrame, first_year: int, last_year: int, region: str = "state",
    business: str = "business_id", n: int = 20,
) -> DataFrame:
    """Reviews and mean rating per region, the largest `n`.

    Ratings are summed per business before the join: the join then meets one row per business, however
    many reviews a single one holds.
    """
    per_business = (
        reviews.where(F.col("year").between(first_year, last_year))
        .groupBy(business).agg(F.count("*").alias("_n"), F.sum("stars").alias("_sum"), F.count("stars").alias("_rated"))
    )
    return (
        per_business.join(businesses.select(business, region), business)
        .groupBy(region)
        .agg(F.sum("_n").alias("n"), F.round(F.try_divide(F.sum("_sum"), F.sum("_rated")), 3).alias("avg_stars"))
        .orderBy(F.desc("n"), F.asc(region))
        .limit(n)
    )


def same_day_bursts(df: DataFrame, author: str, day: str, more_than: int = 10, n: int = 100) -> DataFrame:
    """Authors with more than `more_than` rows on one day, the largest `n` bursts."""
    return (
        df.groupBy(author, day).agg(F.count("*").alias("same_day_reviews"))
        .where(F.col("same_day_reviews") > more_than)
        .orderBy(F.desc("same_day_reviews"), F.asc(author), F.asc(day))
        .limit(n)
    )
