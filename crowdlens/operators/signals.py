"""Behavioural signals per author over a review history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.operators.joins import hot_split_join
from crowdlens.params import QueueParams
from crowdlens.session import stage


def reviews_in_window(
    reviews: DataFrame, start: str, end: str, date: str = "review_date", author: str = "user_id",
    year: str | None = "year",
) -> DataFrame:
    """Reviews with an author in the half-open range [start, end).

    Where the table is partitioned by year, the implied year range is added so that whole partitions
    are skipped; a filter on the date alone reads every file.
    """
    kept = reviews.where(
        (F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date"))
        & F.col(author).isNotNull()
    )
    if year and year in reviews.columns:
        kept = kept.where(F.col(year).between(int(start[:4]), int(end[:4])))
    return kept


def business_consensus(
    reviews: DataFrame, business: str = "business_id", stars: str = "stars", min_reviews: int = 10
) -> DataFrame:
    """Mean rating of every business that has enough reviews for one."""
    rated = reviews.groupBy(business).agg(
        F.sum(stars).alias("_sum"), F.count(stars).alias("_rated"), F.count("*").alias("business_n_reviews"))
    mean = F.try_divide(F.col("_sum"), F.col("_rated"))
    return rated.where(F.col("business_n_reviews") >= min_reviews).select(
        business, mean.alias("business_mean_stars"), "business_n_reviews")


def burstiness(reviews: DataFrame, author: str = "user_id", date: str = "review_date") -> DataFrame:
    """Peak reviews on one day, days with a review, and their ratio.

    Two aggregations: the first leaves one row per author and day, so its row count already is the
    number of days, and even an author with a third of all reviews shrinks to a few rows per task.
    """
    per_day = reviews.groupBy(author, date).agg(F.count("*").alias("day_reviews"))
    return (
        per_day.groupBy(author)
        .agg(F.max("day_reviews").alias("max_reviews_per_day"), F.count(date).alias("active_days"))
        .withColumn(
            "burstiness",
            F.col("max_reviews_per_day").cast("double") / F.greatest(F.col("active_days"), F.lit(1)).cast("double"),
        )
    )


def duplication(
    reviews: DataFrame, author: str = "user_id", text_hash: str = "text_hash", null_is_unique: bool = False
) -> DataFrame:
    """Reviews whose fingerprint the same author used more than once, and their share.

    With `null_is_unique`, reviews without a fingerprint never count as copies.
    """
    per_text = reviews.groupBy(author, text_hash).agg(F.count("*").alias("copies"))
    repeated = F.col("copies") > 1
    if null_is_unique:
        repeated = repeated & F.col(text_hash).isNotNull()
    return (
        per_text.groupBy(author)
        .agg(
            F.sum(F.when(repeated, F.col("copies")).otherwise(F.lit(0).cast("long"))).alias("duplicate_reviews"),
            F.sum("copies").alias("_reviews"),
        )
        .withColumn("duplication", F.col("duplicate_reviews") / F.col("_reviews"))
        .drop("_reviews")
    )


def hash_repeats(
    reviews: DataFrame, keys: Sequence[str] = ("user_id", "text_hash"), hot_rows: int = 5_000_000, salts: int = 256
) -> DataFrame:
    """Each review with the number of reviews that share its keys, by default author and fingerprint.

    Says what `count(*) OVER (PARTITION BY author, text_hash)` says, without sorting a whole group
    into one task: the counts are aggregated first and those above 1 are looked up. A review with a null
    key has nothing to share and counts 1.
    """
    keys = list(keys)
    counts = reviews.groupBy(*keys).agg(F.count("*").alias("hash_repeats")).where(F.col("hash_repeats") > 1)
    spread = [name for name in reviews.columns if name not in keys]
    found = hot_split_join(
        reviews, counts, counts.where(F.col("hash_repeats") >= hot_rows), keys, spread or keys, "left", salts
    )
    return found.withColumn("hash_repeats", F.coalesce("hash_repeats", F.lit(1).cast("long")))


def rating_deviation(
    reviews: DataFrame, consensus: DataFrame, params: QueueParams, business: str = "business_id",
    author: str = "user_id", stars: str = "stars",
) -> DataFrame:
    """Each review with the mean rating it is measured against (null without a consensus) and the gap.

    By default the consensus includes the review itself; `leave_one_out` takes it out.
    """
    joined = hot_split_join(
        reviews, consensus, consensus.where(F.col("business_n_reviews") >= params.hot_rows), [business],
        [author], "left", params.salts,
    )
    reference = F.col("business_mean_stars")
    if params.leave_one_out:
        total = reference * F.col("business_n_reviews") - F.col(stars)
        reference = F.when(F.col("business_n_reviews") > 1, total / (F.col("business_n_reviews") - 1))
    return joined.withColumn("star_gap", F.abs(F.col(stars) - reference))


def reviewer_profile(
    reviews: DataFrame, consensus: DataFrame, params: QueueParams, business: str = "business_id",
    author: str = "user_id", stars: str = "stars", date: str = "review_date", text_len: str = "text_len",
) -> DataFrame:
    """Review count, share of 1- and 5-star ratings, mean gap, first and last date, mean text length."""
    extreme = F.when(F.col(stars).isin(1.0, 5.0), F.lit(1.0)).otherwise(F.lit(0.0))
    narrow = reviews.select(author, business, stars, date, text_len)
    return (
        rating_deviation(narrow, consensus, params, business, author, stars)
        .groupBy(author)
        .agg(
            F.count("*").alias("n_reviews"),
            F.avg(extreme).alias("rating_extremity"),
            F.avg("star_gap").alias("deviation"),
            F.min(date).alias("first_review_date"),
            F.max(date).alias("last_review_date"),
            F.avg(text_len).alias("avg_text_len"),
        )
        .where(F.col("n_reviews") >= params.min_reviews_per_author)
    )


def precocity(days: Column) -> Column:
    """1 / ln(days + 2): 1.4427 on day 0 and for missing or negative gaps, near 0 after years."""
    waited = F.greatest(F.coalesce(days, F.lit(0)), F.lit(0)).cast("double")
    return F.lit(1.0) / F.log1p(waited + F.lit(1.0))


def reviewer_signals(
    reviews: DataFrame, users: DataFrame, params: QueueParams = QueueParams(), author: str = "user_id",
    joined_at: str = "yelping_since_ts",
) -> DataFrame:
    """One row per author with enough reviews: the five signals and what they were computed from.

    `reviews` needs user_id, business_id, stars, review_date, text_len and text_hash. These six narrow columns and the
    consensus (one row per business) are written once: five aggregations then read a small table instead of repeating
    whatever `reviews` is made of, and each reads only its own columns. All four sides are partitioned by author when
    they meet.
    """
    needed = [author, "business_id", "stars", "review_date", "text_len", "text_hash"]
    history = stage(reviews_in_window(reviews, params.start_date, params.end_date, author=author).select(*needed), "history")
    consensus = stage(business_consensus(history, min_reviews=params.min_reviews_per_business), "consensus")
    user_columns = [name for name in users.columns if name != author]
    signals = (
        reviewer_profile(history, consensus, params, author=author)
        .join(burstiness(history, author), author, "left")
        .join(duplication(history, author), author, "left")
        .join(users.select(author, *user_columns), author, "left")
    )
    gap = F.datediff(F.col("first_review_date"), F.to_date(joined_at))
    derived = {name: F.coalesce(name, F.lit(0.0)) for name in ("duplication", "deviation")}
    derived |= {"days_to_first_review": gap, "precocity": precocity(gap), "precocity_imputed": ~F.coalesce(gap >= 0, F.lit(False))}
    return signals.withColumns(derived)
