"""Knobs of the jobs as immutable values; nothing reads module globals at run time."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

# The five behavioural signals, and the four that are averages over an author's reviews.
SIGNALS = ("burstiness", "duplication", "rating_extremity", "deviation", "precocity")
SHRUNK_SIGNALS = ("burstiness", "duplication", "rating_extremity", "deviation")

# Categories too generic to be useful as labels.
CATEGORY_STOPLIST = ("Restaurants", "Food", "Shopping", "Nightlife", "Event Planning & Services")

# Numeric columns that join the text projection in the dense model arms.
NUMERIC_FEATURES = (
    "review_stars",
    "text_len",
    "word_count",
    "user_review_count",
    "user_average_stars",
    "user_fans",
    "friend_count",
    "elite_years",
    "account_age_days_at_review",
    "star_deviation_from_user_mean",
)


# The defaults below that decide results (dates, minima, pseudo count, breakpoints, clips, split, text and
# sample sizes) are those a user expects; `hot_rows` and `salts` only change plans.
@dataclass(frozen=True)
class QueueParams:
    """Review-queue settings."""

    start_date: str = "2005-01-01"
    end_date: str = "2100-01-01"
    min_reviews_per_author: int = 3
    min_reviews_per_business: int = 10
    pseudo_count: float = 10.0
    cdf_points: int = 1001
    quantile_accuracy: int = 10_000
    exact_quantiles: bool = False
    clip_low: float = -5.0
    clip_high: float = 8.0
    leave_one_out: bool = False
    # A business with at least this many reviews is joined by broadcast and its reviews are spread by salt.
    # rows / hot_rows bounds how many such businesses can exist.
    hot_rows: int = 5_000_000
    salts: int = 256


@dataclass(frozen=True)
class LabelParams:
    """Labelled-table settings."""

    top_k: int = 50
    stoplist: tuple = CATEGORY_STOPLIST
    min_chars: int = 40
    test_fraction: float = 0.20
    split_salt: str = "cci-v1"
    split_hash: str = "xxhash64"


@dataclass(frozen=True)
class TextParams:
    """Text-model settings."""

    ngrams: tuple = (1, 2)
    min_df: int = 3
    max_features: int = 200_000
    select_k: int = 20_000
    svd_dims: int = 256
    train_rows: int | None = None  # fit on all training rows; a number draws so many of them
    seed: int = 17


def from_conf(spark: SparkSession, params):
    """Override fields of `params` with `spark.crowdlens.<field>` session settings where present."""
    changes = {}
    for field in fields(params):
        raw = spark.conf.get(f"spark.crowdlens.{field.name}", None)
        if raw is None:
            continue
        current = getattr(params, field.name)
        if isinstance(current, bool):
            changes[field.name] = raw.strip().lower() == "true"
        elif isinstance(current, tuple):
            kind = type(current[0]) if current else str
            changes[field.name] = tuple(kind(part.strip()) for part in raw.split(",") if part.strip())
        else:
            # A setting without a value is a number that is not limited.
            changes[field.name] = int(raw) if current is None else type(current)(raw)
    return replace(params, **changes)
