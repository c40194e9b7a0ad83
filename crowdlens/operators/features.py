"""The labelled review table: one row per eligible review, inputs from the review and its author only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.operators.joins import lookup_join
from crowdlens.operators.labels import attach_labels
from crowdlens.operators.split import grouped_split
from crowdlens.params import LabelParams

# Author columns of the labelled table (output name, input name).
AUTHOR_COLUMNS = (
    ("user_review_count", "review_count"),
    ("user_average_stars", "average_stars"),
    ("user_fans", "fans"),
    ("user_useful_votes", "useful"),
    ("friend_count", "friend_count"),
    ("elite_years", "elite_years"),
    ("yelping_since_ts", "yelping_since_ts"),
)

# Business facts encode the label; none may be an input of the labelled table.
BUSINESS_INPUTS = frozenset({
    "name", "address", "city", "state", "postal_code", "latitude", "longitude", "business_stars",
    "business_mean_stars", "review_count", "is_open", "attributes", "categories", "category_list",
    "n_categories", "hours",
})


def reviewer_features(users: DataFrame, columns: Sequence[tuple] = AUTHOR_COLUMNS, key: str = "user_id") -> DataFrame:
    return users.select(key, *[F.col(source).alias(name) for name, source in columns])


def eligible_reviews(
    reviews: DataFrame, min_chars: int = 40, text_len: str = "text_len",
    required: Sequence[str] = ("business_id", "user_id"),
) -> DataFrame:
    """Reviews with a text of at least `min_chars` characters and all required ids.

    The length is null where the text is, so a missing text fails the filter without its column being read.
    """
    keep = F.col(text_len) >= min_chars
    for name in required:
        keep = keep & F.col(name).isNotNull()
    return reviews.where(keep)


def assert_no_business_inputs(df: DataFrame) -> DataFrame:
    leaked = BUSINESS_INPUTS.intersection(df.columns)
    if leaked:
        raise ValueError(f"business facts among the inputs: {sorted(leaked)}")
    return df


def review_labeled(
    reviews: DataFrame, businesses: DataFrame, users: DataFrame, categories: Sequence[str],
    params: LabelParams = LabelParams(),
) -> DataFrame:
    """Eligible reviews with the label vector of their business, author features and the split.

    Both lookups are protected against a business or author that holds a large share of the reviews. No
    broadcast is forced: the author side may have billions of rows.
    """
    columns = [
        name for name in ("review_id", "business_id", "user_id", "text", "text_len", "word_count", "review_date",
                          "text_hash", "stars") if name in reviews.columns
    ]
    facts = eligible_reviews(reviews, params.min_chars).select(*columns).withColumnRenamed("stars", "review_stars")
    labels = attach_labels(businesses, categories)
    authors = reviewer_features(users)
    joined = lookup_join(facts, labels, "business_id", ["user_id"], "inner")
    joined = lookup_join(joined, authors, "user_id", ["business_id"], "left", keys_from=facts)
    mean = F.coalesce(F.col("user_average_stars"), F.col("review_stars"))
    table = (
        joined.withColumn("account_age_days_at_review", F.datediff("review_date", F.to_date("yelping_since_ts")))
        .withColumn("star_deviation_from_user_mean", F.col("review_stars") - mean)
        .drop("yelping_since_ts")
    )
    split = grouped_split(table, "business_id", params.test_fraction, params.split_salt, params.split_hash)
    return assert_no_business_inputs(split)
