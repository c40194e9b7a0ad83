"""Lookup joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` in which null equals null, so that the rows of a null group stay. Keys are kept once."""
    names = {key: f"_right_{number}" for number, key in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [left[key].eqNullSafe(renamed[name]) for key, name in names.items()])
    return left.join(renamed, same, how).drop(*names.values())


def frequent_keys(fact: DataFrame, key: str, support: float = 0.001) -> DataFrame:
    """Keys that may hold more than `support` of the rows (all that do, perhaps a few more).

    The frequent-items aggregate keeps at most 1/support counters, whatever the size of `fact`, so the
    result has a proven bound and may be broadcast.
    """
    items = fact.select(key).stat.freqItems([key], support)
    return items.select(F.explode(f"{key}_freqItems").alias(key)).where(F.col(key).isNotNull())


def hot_split_join(
    fact: DataFrame,
    dim: DataFrame,
    hot_dim: DataFrame,
    key: Sequence[str],
    salt_by: Sequence[str],
    how: str = "left",
    salts: int = 256,
) -> DataFrame:
    """Join `fact` with `dim` (one row per key) without piling a hot key onto one task.

    `hot_dim` holds the rows of `dim` whose keys are frequent in `fact`; the caller guarantees a bound on
    their number, so they are broadcast. Rows of `fact` that hit one of them, or have a null key, are
    spread over `salts` partitions by a hash of `salt_by` (a retried task repeats it, unlike `rand`);
    only the remaining keys meet `dim` in a shuffle, and there Spark still chooses the physical join by size.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type: {how!r}")
    key = list(key)
    values = [name for name in dim.columns if name not in key]

    hot = hot_dim.select(
        *key, *[F.col(name).alias(f"_hot_{name}") for name in values], F.lit(True).alias("_is_hot")
    )
    cold = dim.select(
        *key, *[F.col(name).alias(f"_cold_{name}") for name in values], F.lit(True).alias("_is_cold"),
        # -1 for every row, but not as a constant: the optimiser would replace a constant in the join condition, the
        # route would no longer be a join key, and all rows of a hot key would meet in one task.
        (F.pmod(F.xxhash64(*key), F.lit(1)).cast("int") - 1).alias("_route"),
    )
    no_match = F.lit(False)
    for name in key:
        no_match = no_match | F.col(name).isNull()
    routed = fact.join(F.broadcast(hot), key, "left").withColumn(
        "_route",
        F.when(
            F.col("_is_hot").isNotNull() | no_match,
            F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"),
        ).otherwise(F.lit(-1)),
    )
    joined = routed.join(cold, [*key, "_route"], "left")
    if how == "inner":
        joined = joined.where(F.col("_is_hot").isNotNull() | F.col("_is_cold").isNotNull())
    kept = [F.col(name) for name in fact.columns]
    found = [
        F.when(F.col("_is_hot").isNotNull(), F.col(f"_hot_{name}")).otherwise(F.col(f"_cold_{name}")).alias(name)
        for name in values
    ]
    return joined.select(*kept, *found)


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    salt_by: Sequence[str],
    how: str = "left",
    support: float = 0.001,
    salts: int = 256,
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """`hot_split_join` with the frequent keys found in the data.

    They are looked for in `keys_from` where given: the source of `fact` does as well and is cheaper than
    a `fact` that is itself the result of a join. Which keys are found affects the speed, not the result.
    """
    hot_keys = frequent_keys(fact if keys_from is None else keys_from, key, support)
    hot_dim = dim.join(F.broadcast(hot_keys), key, "left_semi")
    return hot_split_join(fact, dim, hot_dim, [key], salt_by, how, salts)
