"""Latency of the last N values of each key on a stream, in state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crowdlens.operators.latency import PERCENTILES
from crowdlens.session import ship_package

STATS = ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")


def last_n_latency(stream: DataFrame, key: str, order: Sequence[str], value: str, n: int = 2000, dp: int = 3) -> DataFrame:
    """For each row with a value, n, mean, p50, p95, p99 and max of its key's last `n` values, in the order of their arrival.

    A key's state is a ring of its last n - 1 values. Rows of one micro-batch arrive in `order`; a row that comes in a later
    micro-batch than another came after it, as for any window of observations. So a stream that arrives in order gives what
    `rolling_latency` gives on the whole table. Memory per key: n values and the key's rows of one micro-batch. Rows
    without a value are no part of any window and get no row; null keys form one key.
    """
    ship_package(stream.sparkSession)
    order = list(order)
    kinds = {field.name: field.dataType.simpleString() for field in stream.schema.fields}
    columns = [f"{key} {kinds[key]}", *[f"{name} {kinds[name]}" for name in order]]
    names = [key, *order, "n", *STATS]

    def advance(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts), ignore_index=True).sort_values(order, ignore_index=True, kind="stable")
        values = pd.concat([pd.Series(ring, dtype="float64"), rows["_value"].astype("float64")], ignore_index=True)
        window = values.rolling(n, min_periods=1)
        found = pd.DataFrame({
            "n": window.count().astype("int64"), "mean_ms": window.mean(),
            **{f"{name}_ms": window.quantile(p) for name, p in PERCENTILES}, "max_ms": window.max()})
        kept = max(n - 1, 0)
        state.update((values.iloc[len(values) - kept:].tolist() if kept < len(values) else values.tolist(),))
        yield pd.concat([rows[[key, *order]], found.iloc[len(ring):].reset_index(drop=True)], axis=1)[names]

    chosen = stream.where(F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias("_value"))
    rolled = chosen.groupBy(key).applyInPandasWithState(
        advance, ", ".join([*columns, "n bigint", *[f"{name} double" for name in STATS]]), "ring array<double>", "append",
        GroupStateTimeout.NoTimeout)
    return rolled.withColumns({name: F.round(name, dp) for name in STATS})
