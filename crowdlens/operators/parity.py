"""Do two scoring runs agree, and if not, which component differs?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_scores(
    batch: DataFrame, served: DataFrame, key: str = "user_id", components: Sequence[str] = (), dp: int = 4,
    tol: float = 1e-6, total: str = "anomaly_score",
) -> DataFrame:
    """All accounts of either side with a status: ok, mismatch, skipped (null input) or missing on one side.

    Totals are compared at `dp` decimals. For a mismatch, `suspect` is the component with the largest gap
    (the first one on a tie).
    """
    left = batch.select(key, F.col(total).alias("_b"), *[F.col(c).alias(f"_b_{c}") for c in components],
                        F.lit(True).alias("_in_batch"))
    right = served.select(key, F.col(total).alias("_s"), *[F.col(c).alias(f"_s_{c}") for c in components],
                          F.lit(True).alias("_in_served"))
    both = left.join(right, key, "full_outer").select(
        key,
        F.round("_b", dp).alias("batch"),
        F.round("_s", dp).alias("served"),
        F.array(*[
            F.struct(
                F.coalesce(F.round(F.abs(F.round(f"_s_{c}", dp) - F.round(f"_b_{c}", dp)), dp), F.lit(0.0)).alias("gap"),
                F.lit(-i).alias("order"),
                F.lit(c).alias("component"),
            )
            for i, c in enumerate(components)
        ]).alias("_gaps"),
        "_in_batch", "_in_served",
    ).withColumn("delta", F.round(F.abs(F.col("served") - F.col("batch")), dp + 2))
    status = (
        F.when(F.col("_in_batch").isNull(), F.lit("missing_in_batch"))
        .when(F.col("_in_served").isNull(), F.lit("missing_in_served"))
        .when(F.col("delta").isNull(), F.lit("skipped"))
        .when(F.col("delta") > tol, F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    suspect = F.array_max("_gaps")["component"] if components else F.lit(None).cast("string")
    return both.withColumn("status", status).select(
        key, "batch", "served", "delta", "status",
        F.when(F.col("status") == "mismatch", suspect).alias("suspect"),
    )


def scoring_parity(batch: DataFrame, served: DataFrame, key: str = "user_id", components: Sequence[str] = (),
                   dp: int = 4, tol: float = 1e-6) -> DataFrame:
    """Only the accounts that do not agree; empty when the two runs match."""
    return compare_scores(batch, served, key, components, dp, tol).where(~F.col("status").isin("ok", "skipped"))


def parity_summary(compared: DataFrame) -> DataFrame:
    """Accounts per status."""
    return compared.groupBy("status").agg(F.count("*").alias("accounts"))
