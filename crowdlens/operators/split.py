"""Grouped train/test split that does not move when data is appended, and its audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.operators.joins import null_safe_join
from crowdlens.operators.ordering import running_totals

#: Rows of a sample that one task may sort.
SMALL_SAMPLE = 10_000

# Salt, hash and number of buckets decide the side of every group and must not change.
def _bucket(key: Column, salt: str, method: str, buckets: int) -> Column:
    salted = F.concat_ws("|", F.lit(salt), key)
    if method == "xxhash64":
        number = F.xxhash64(salted)
    elif method == "md5":
        number = F.conv(F.substring(F.md5(salted), 1, 8), 16, 10).cast("long")
    else:
        raise ValueError(f"unknown hash: {method!r}")
    return F.pmod(number, F.lit(buckets))


def grouped_split(
    df: DataFrame, group: str, fraction: float = 0.2, salt: str = "cci-v1", method: str = "xxhash64",
    out: str = "split",
) -> DataFrame:
    """Add `split`: whole groups land in 'test' or 'train' by a salted hash. No shuffle."""
    held_out = _bucket(F.col(group), salt, method, 1000) < int(round(fraction * 1000))
    return df.withColumn(out, F.when(held_out, F.lit("test")).otherwise(F.lit("train")))


def split_slice(df: DataFrame, split: str, column: str = "split") -> DataFrame:
    """One side of the split; prunes partitions where the table is partitioned by it."""
    return df.where(F.col(column) == split)


def split_summary(
    df: DataFrame, group: str = "business_id", author: str = "user_id", labels: str = "n_labels",
    split: str = "split", approximate: bool = False,
) -> DataFrame:
    """Rows, distinct groups and authors, and mean labels per side.

    The exact counts come from sums per (side, group) and per (side, author), which combine before their shuffles;
    counting both in one aggregation would triple the rows.
    """
    totals = [F.count("*").alias("rows"), F.sum(labels).alias("_sum"), F.count(labels).alias("_n")]
    if approximate:
        found = df.groupBy(split).agg(
            *totals, F.approx_count_distinct(group).alias("businesses"), F.approx_count_distinct(author).alias("users"))
    else:
        groups = df.groupBy(split, group).agg(*totals).groupBy(split).agg(
            *[F.sum(name).alias(name) for name in ("rows", "_sum", "_n")], F.count(group).alias("businesses"))
        authors = df.groupBy(split, author).agg(F.lit(1)).groupBy(split).agg(F.count(author).alias("users"))
        found = null_safe_join(groups, authors, [split])
    mean = F.round(F.try_divide(F.col("_sum"), F.col("_n")), 3)
    return found.select(split, "rows", "businesses", "users", mean.alias("avg_labels"))


def split_leakage(df: DataFrame, group: str = "business_id", split: str = "split") -> DataFrame:
    """One row: groups, groups on both sides (must be 0) and the share of groups held out."""
    sides = df.groupBy(group).agg(F.min(split).alias("_low"), F.max(split).alias("_high"))
    return sides.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("_low") != F.col("_high")).alias("leaking_groups"),
        F.avg(F.when(F.col("_low") == "test", 1.0).otherwise(0.0)).alias("test_share"),
    )


def md5_threshold(fraction: float) -> str:
    """The 32 hexadecimal digits below which `fraction` of all md5 sums lie."""
    return f"{min(int(fraction * 2**64), 2**64 - 1):016x}" + "0" * 16


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 17, method: str = "xxhash64") -> DataFrame:
    """Uniform sample by a seeded hash of the key, compared in full length, so that no fraction is too small.

    Unlike `sample`, the choice does not depend on partitioning, and a retried task repeats it. `md5` is slower and
    can be repeated in any engine.
    """
    if fraction >= 1:
        return df
    if method == "md5":
        return df.where(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))) < md5_threshold(fraction))
    if method != "xxhash64":
        raise ValueError(f"unknown hash: {method!r}")
    return df.where(F.xxhash64(F.lit(seed), F.col(key)) < F.lit(int(fraction * 2**64) - 2**63))


def bounded_sample(df: DataFrame, key: str, limit: int | None, seed: int = 17, method: str = "xxhash64") -> DataFrame:
    """Exactly `limit` rows spread over the whole table, those of the smallest hashes of the key; all rows where there are no more.

    Equal hashes are ordered by key. Each task keeps its smallest, so the table is read once and never counted, and only
    `limit` rows of each task are moved. As a sort of more than `SMALL_SAMPLE` rows in one task would be long, a larger sample
    first looks for the hash of its last row among hashes alone; of equal keys it has as many as there is room for.
    """
    if limit is None:
        return df
    if method == "md5":
        mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    elif method == "xxhash64":
        mark = F.xxhash64(F.lit(seed), F.col(key))
    else:
        raise ValueError(f"unknown hash: {method!r}")
    marked = df.withColumn("_mark", mark)
    if limit <= SMALL_SAMPLE:
        return marked.orderBy("_mark", key).limit(limit).drop("_mark")
    counts = marked.groupBy("_mark").agg(F.count("*").alias("_n"))
    curve = running_totals(counts, [], [F.col("_mark")], ["_n"])
    last = curve.where(F.col("cum__n") >= limit).orderBy("_mark").select("_mark", F.col("cum__n") - F.col("_n")).head()
    if last is None:
        return df
    before = marked.where(F.col("_mark") < F.lit(last[0]))
    edge = marked.where(F.col("_mark") == F.lit(last[0])).orderBy(key).limit(limit - last[1])
    return before.unionByName(edge).drop("_mark")
