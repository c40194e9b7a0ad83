"""Score every account and write the review queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.operators.scaler import Scaler, fit_scaler
from crowdlens.operators.scoring import review_queue_top, score_signals
from crowdlens.operators.signals import reviewer_signals
from crowdlens.params import QueueParams
from crowdlens.session import stage
from crowdlens.sources.lake import write_parquet


@dataclass(frozen=True)
class ScoredAccounts:
    accounts: DataFrame
    scaler: Scaler


def score_all_accounts(reviews: DataFrame, users: DataFrame, params: QueueParams = QueueParams()) -> ScoredAccounts:
    """Signals, scaler and scores. The review history is read once: the signals are staged in between."""
    signals = stage(reviewer_signals(reviews, users, params), "signals")
    scaler = fit_scaler(signals, params)
    return ScoredAccounts(score_signals(signals, scaler), scaler)


def run(
    spark: SparkSession, reviews_path: str, users_path: str, out: str, params: QueueParams = QueueParams(),
    top: int = 200, rank_by: str = "queue_score",
) -> DataFrame:
    """Write accounts, scaler and the top of the queue (CSV with a header) below `out`; return the top."""
    users = spark.read.parquet(users_path).select(
        "user_id", "yelping_since_ts", F.col("fans").alias("user_fans"), F.col("useful").alias("user_useful_votes"),
        "friend_count", "elite_years",
    )
    scored = score_all_accounts(spark.read.parquet(reviews_path), users, params)
    write_parquet(scored.accounts, f"{out}/reviewer_anomaly")
    scored.scaler.save(spark, f"{out}/anomaly_scaler")
    best = review_queue_top(spark.read.parquet(f"{out}/reviewer_anomaly"), top, rank_by)
    best.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/review_queue_top")
    return best
