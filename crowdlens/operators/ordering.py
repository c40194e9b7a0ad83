"""Global order without a single-task sort: running totals, row numbers and exact quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.operators.joins import null_safe_join
from crowdlens.session import stage


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column], sums: Sequence[str]) -> DataFrame:
    """Add `cum_<c>` (inclusive, in `order` within `group`) for each column of `sums`.

    The rows are range-partitioned by group and order into slices and written once, which pins the slices.
    Slice totals (one row per group and slice) give each slice its starting value; the rest is a window
    inside one slice. No task ever holds a whole group. (group, order) should be unique. Nulls form a group.
    """
    group, order = list(group), list(order)
    ranged = df.repartitionByRange(*[F.col(name) for name in group], *order)
    ranged = stage(ranged.withColumn("_slice", F.spark_partition_id()), "running-totals")

    totals = ranged.groupBy(*group, "_slice").agg(*[F.sum(name).alias(f"_total_{name}") for name in sums])
    whole = group or [F.lit(0)]
    before = Window.partitionBy(*whole).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *group,
        "_slice",
        *[F.coalesce(F.sum(f"_total_{name}").over(before), F.lit(0)).alias(f"_start_{name}") for name in sums],
    )
    inside = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return null_safe_join(ranged, starts, [*group, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_start_{name}") + F.sum(name).over(inside)).alias(f"cum_{name}") for name in sums],
    )


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    """Exact `row_number` within `group`, for groups of any size."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), group, order, ["_one"])
    return counted.withColumn(out, F.col("cum__one")).drop("_one", "cum__one")


def exact_quantiles(values: DataFrame, group: str, value: str, points: int) -> DataFrame:
    """`points` evenly spaced quantiles per group as (group, idx, value); nulls are ignored.

    Quantile i is the smallest value with at least i/(points-1) of the rows at or below it. Equal values
    are counted together first, and the selection is integer arithmetic on running counts.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    curve = running_totals(counts, [group], [F.col(value)], ["n"])
    sizes = curve.groupBy(group).agg(F.max("cum_n").alias("_rows"))
    steps = points - 1
    below = F.col("cum_n") - F.col("n")
    first = F.when(below == 0, F.lit(0)).otherwise(F.expr(f"((cum_n - n) * {steps}) div _rows") + 1)
    last = F.expr(f"(cum_n * {steps}) div _rows")
    return (
        null_safe_join(curve, sizes, [group])
        .withColumn("_first", first.cast("int"))
        .withColumn("_last", last.cast("int"))
        .where(F.col("_first") <= F.col("_last"))
        .select(group, F.explode(F.sequence("_first", "_last")).alias("idx"), value)
    )


def largest(df: DataFrame, by: str, ties: str, k: int, small: int = 10_000) -> DataFrame:
    """The `k` rows with the largest `by`, ties by the smaller `ties`. Rows without a `by` have no rank and are left out.

    Sort-and-limit keeps k rows of every partition and merges them in one task, which is fine for a small
    k. For a larger one the value of the k-th row is found first, on distributed running counts, so that
    only about k rows are left to merge.
    """
    df = df.where(F.col(by).isNotNull())
    if k > small:
        df = stage(df, "largest")
        values = df.groupBy(by).agg(F.count("*").alias("_n"))
        curve = running_totals(values, [], [F.col(by).desc()], ["_n"])
        bound = curve.where(F.col("cum__n") - F.col("_n") < k).agg(F.min(by)).head()[0]
        if bound is not None:  # else there are no rows
            df = df.where(F.col(by) >= F.lit(bound))
    return df.orderBy(F.desc(by), F.asc(ties)).limit(k)
