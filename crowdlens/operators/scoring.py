"""Rank-normal components, account scores and the review queue. One code path for batch and stream."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.functions.numeric import clip
from crowdlens.operators.scaler import Scaler, shrink_signals


def _steps(breakpoints: list) -> tuple[list, list]:
    """Distinct breakpoints as bucket edges, and the normal quantile of each bucket's share."""
    size = len(breakpoints)
    margin = 0.5 / size
    edges: list = []
    at_or_below: list = []
    for position, value in enumerate(sorted(breakpoints), start=1):
        if edges and edges[-1] == value:
            at_or_below[-1] = position
        else:
            edges.append(value)
            at_or_below.append(position)
    normal = NormalDist()
    shares = [0.0, *[count / size for count in at_or_below]]
    quantiles = [normal.inv_cdf(min(max(share, margin), 1.0 - margin)) for share in shares]
    return [float("-inf"), *edges, float("inf")], quantiles


def rank_normalise(df: DataFrame, columns: dict, breakpoints: dict, prefix: str = "z_") -> DataFrame:
    """Add `z_<signal>`: the normal quantile of the share of breakpoints at or below the value.

    `columns` maps signal -> column. The share only takes as many values as there are breakpoints, so the
    result is a bucket number and a table lookup. NaN ranks highest, null stays null.
    """
    edges, quantiles = zip(*[_steps(breakpoints[name]) for name in columns])
    buckets = [f"_bucket_{name}" for name in columns]
    ranked = Bucketizer(
        splitsArray=list(edges), inputCols=list(columns.values()), outputCols=buckets, handleInvalid="keep"
    )
    added = {}
    for name, column, bucket, table in zip(columns, columns.values(), buckets, quantiles):
        lookup = F.split(F.lit(",".join(repr(value) for value in table)), ",").cast("array<double>")
        # The bucket of NaN lies one past the last one.
        place = F.least(F.col(bucket).cast("int") + 1, F.lit(len(table)))
        added[f"{prefix}{name}"] = F.when(F.col(column).isNotNull(), F.element_at(lookup, place))
    return ranked.transform(df).withColumns(added).drop(*buckets)


def robust_z(df: DataFrame, columns: dict, scaler: Scaler, prefix: str = "z_") -> DataFrame:
    """Add `z_<signal>` = (value - median) / scale, the older method."""
    return df.withColumns({
        f"{prefix}{name}": (F.col(column) - F.lit(float(scaler.median[name]))) / F.lit(float(scaler.scale[name]))
        for name, column in columns.items()
    })


def anomaly_score(df: DataFrame, scaler: Scaler, n: str = "n_reviews", prefix: str = "z_") -> DataFrame:
    """Add the sum of the clipped components, and that sum times ln(1 + n) as the queue order."""
    total = None
    for name in scaler.signals:
        part = clip(F.col(f"{prefix}{name}"), scaler.clip_low, scaler.clip_high)
        total = part if total is None else total + part
    return df.withColumn("anomaly_score", total).withColumn(
        "queue_score", F.col("anomaly_score") * F.log1p(F.col(n).cast("double"))
    )


def score_signals(signals: DataFrame, scaler: Scaler, n: str = "n_reviews") -> DataFrame:
    """Shrink, normalise and score: adds s_*, z_*, anomaly_score, queue_score and model_version."""
    scaler.validate()
    prior = {name: scaler.prior_mean[name] for name in scaler.shrunk_signals}
    shrunk = shrink_signals(signals, prior, scaler.pseudo_count, scaler.signals, n)
    columns = {name: f"s_{name}" for name in scaler.signals}
    if scaler.method == "rank_normal":
        ranked = rank_normalise(shrunk, columns, scaler.cdf_breakpoints)
    else:
        ranked = robust_z(shrunk, columns, scaler)
    return anomaly_score(ranked, scaler, n).withColumn("model_version", F.lit(scaler.model_version))


def score_accounts(accounts: DataFrame, scaler: Scaler, keys: tuple = ("user_id",), n: str = "n_reviews") -> DataFrame:
    """Score aggregates computed elsewhere; scores and components to 4 decimals.

    Rows must hold all signals and n (see `validate_signals`); a null input gives a null score, never a
    default. Works on streaming DataFrames as well.
    """
    scored = score_signals(accounts, scaler, n)
    components = [
        F.round(clip(F.col(f"z_{name}"), scaler.clip_low, scaler.clip_high), 4).alias(f"component_{name}")
        for name in scaler.signals
    ]
    return scored.select(
        *keys,
        n,
        F.round("anomaly_score", 4).alias("anomaly_score"),
        F.round("queue_score", 4).alias("queue_score"),
        *components,
        "model_version",
    )


def review_queue_top(
    scored: DataFrame, n: int = 200, rank_by: str = "queue_score", author: str = "user_id", signals: tuple = ()
) -> DataFrame:
    """The first `n` accounts, ties broken by author; signals to 4 decimals."""
    if rank_by not in ("queue_score", "anomaly_score"):
        raise ValueError(f"cannot rank by {rank_by!r}")
    names = signals or ("burstiness", "duplication", "rating_extremity", "deviation", "precocity")
    context = [c for c in ("max_reviews_per_day", "duplicate_reviews", "avg_text_len") if c in scored.columns]
    return (
        scored.orderBy(F.desc(rank_by), F.asc(author))
        .limit(n)
        .select(author, "n_reviews", "queue_score", "anomaly_score",
                *[F.round(name, 4).alias(name) for name in names], *context)
    )
