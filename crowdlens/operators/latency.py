"""Latency summaries, rolling percentiles and choices on throughput curves."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.operators.joins import null_safe_join
from crowdlens.operators.ordering import row_numbers, running_totals

# The percentiles of every latency report.
PERCENTILES = (("p50", 0.50), ("p95", 0.95), ("p99", 0.99))


def latency_summary(
    df: DataFrame, value: str, keys: Sequence[str] = (), exact: bool = True, dp: int = 2, accuracy: int = 10_000
) -> DataFrame:
    """n, mean, p50, p95, p99 and max per key.

    Exact percentiles interpolate between the two neighbouring values, found on distributed running
    counts; otherwise a mergeable sketch is used. A key without values has n = 0 and nulls.
    """
    keys = list(keys)
    basics = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")]
    if not exact:
        sketched = F.percentile_approx(value, F.array(*[F.lit(p) for _, p in PERCENTILES]), accuracy)
        summary = df.groupBy(*keys).agg(*basics, sketched.alias("_p")).select(
            *keys, "n", "mean", "max", *[F.col("_p")[i].alias(name) for i, (name, _) in enumerate(PERCENTILES)]
        )
    else:
        counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
        curve = running_totals(counts, keys, [F.col(value)], ["_c"])
        sizes = df.groupBy(*keys).agg(*basics)
        if keys:
            placed = null_safe_join(curve, sizes.select(*keys, "n"), keys)
        else:
            sizes = sizes.withColumn("_all", F.lit(0))
            placed = curve.withColumn("_all", F.lit(0)).join(F.broadcast(sizes.select("_all", "n")), "_all")
        below = F.col("cum__c") - F.col("_c")
        picks = []
        for name, p in PERCENTILES:
            place = (F.col("n") - 1) * F.lit(p)
            for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
                hit = (below <= rank) & (rank < F.col("cum__c"))
                picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        names = keys or ["_all"]
        found = placed.groupBy(*names).agg(*picks)
        summary = null_safe_join(sizes, found, names, "left").select(
            *keys, "n", "mean", "max",
            *[
                (F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))
                 * ((F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p)))).alias(name)
                for name, p in PERCENTILES
            ],
        )
    return summary.select(
        *keys, "n", *[F.round(name, dp).alias(f"{name}_ms") for name in ("mean", "p50", "p95", "p99", "max")]
    )


def rolling_latency(
    df: DataFrame, key: str, order: Sequence[str], value: str, n: int = 2000, dp: int = 3, block: int | None = None
) -> DataFrame:
    """For each row with a value, n, mean, p50, p95, p99 and max of the last `n` values of its key in `order`.

    Rows without a value are no part of any window and get no row; null keys form one key. Rows are numbered within their key and cut into blocks; the last n-1 rows of a block are also sent to
    the next one, so a key of any size is spread over many tasks and no window crosses a block. Inside a
    block a compiled rolling window slides along: Spark's own framed percentile rebuilds every window from scratch.
    """
    size = max(block or 16 * n, n)
    numbered = row_numbers(df.where(F.col(value).isNotNull()), [key], [F.col(name) for name in order])
    own = ((F.col("rn") - 1) / size).cast("long")
    carried = F.when(F.col("rn") > (own + 1) * size - (n - 1), F.array(own, own + 1)).otherwise(F.array(own))
    blocks = numbered.select(
        key, *order, F.col(value).cast("double").alias("_value"), "rn", own.alias("_own"), F.explode(carried).alias("_block")
    )
    kinds = {field.name: field.dataType.simpleString() for field in df.schema.fields}
    stats = ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")
    schema = ", ".join(
        [f"{key} {kinds[key]}", *[f"{name} {kinds[name]}" for name in order], "n bigint", *[f"{s} double" for s in stats]]
    )

    def slide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rn", ignore_index=True)
        window = rows["_value"].rolling(n, min_periods=1)
        found = pd.DataFrame({
            "n": window.count().astype("int64"), "mean_ms": window.mean(),
            **{f"{name}_ms": window.quantile(p) for name, p in PERCENTILES}, "max_ms": window.max()})
        reported = rows["_own"] == rows["_block"]
        return pd.concat([rows.loc[reported, [key, *order]], found[reported]], axis=1)

    rolled = blocks.groupBy(key, "_block").applyInPandas(slide, schema)
    return rolled.withColumns({name: F.round(name, dp) for name in stats})


def throughput_knee(
    curve: DataFrame, size: str = "batch_size", rate: str = "throughput_per_sec", gain: float = 1.10,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Last batch size that still raises throughput by `gain` over the one before; stops at the first miss.

    `curve` has one row per batch size: the size axis of a benchmark, not data.
    """
    groups = list(keys) or [F.lit(0)]
    by_size = Window.partitionBy(*groups).orderBy(size)
    previous = F.lag(rate).over(by_size)
    step = curve.withColumn(
        "_ok", F.when(previous.isNull() | (F.col(rate) >= previous * gain), F.lit(1)).otherwise(F.lit(0))
    )
    so_far = by_size.rowsBetween(Window.unboundedPreceding, 0)
    return (
        step.withColumn("_reached", F.min("_ok").over(so_far))
        .where(F.col("_reached") == 1)
        .groupBy(*keys)
        .agg(F.max(size).alias("knee"))
    )


def sweep_pct_of_best(points: DataFrame, value: str = "macro_average_precision", keys: Sequence[str] = ()) -> DataFrame:
    """Each point of a sweep as a percentage of the best one. One row per sweep point, not data."""
    groups = list(keys) or [F.lit(0)]
    best = F.max(value).over(Window.partitionBy(*groups))
    return points.withColumn("pct_of_best", F.try_divide(F.col(value), best) * 100.0)
