"""Score stored accounts again with the stored scaler and compare with the stored scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.functions.numeric import clip
from crowdlens.operators.parity import compare_scores, parity_summary
from crowdlens.operators.scaler import Scaler
from crowdlens.operators.scoring import score_accounts
from crowdlens.session import stage


class ScoresDiverge(RuntimeError):
    """Batch and repeated scores differ for some accounts."""


def run(spark: SparkSession, out: str, tol: float = 1e-6) -> DataFrame:
    """Compare all accounts below `out` (see `plans.review_queue`); raise if any differs."""
    accounts = spark.read.parquet(f"{out}/reviewer_anomaly")
    scaler = Scaler.load(spark, f"{out}/anomaly_scaler")
    # Stored components are not clipped, repeated ones are: compare what enters the score on both sides.
    batch = accounts.withColumns({
        f"component_{name}": clip(F.col(f"z_{name}"), scaler.clip_low, scaler.clip_high) for name in scaler.signals})
    components = [f"component_{name}" for name in scaler.signals]
    compared = stage(compare_scores(batch, score_accounts(accounts, scaler), "user_id", components, tol=tol), "parity")
    summary = parity_summary(compared)
    worst = compared.where(~compared.status.isin("ok", "skipped")).orderBy(compared.delta.desc_nulls_last()).limit(5)
    found = worst.collect()
    if found:
        raise ScoresDiverge("\n".join(str(row) for row in found))
    return summary
