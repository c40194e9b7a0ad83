import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from crowdlens.operators.joins import frequent_keys, hot_split_join, lookup_join
from crowdlens.operators.latency import latency_summary, rolling_latency
from crowdlens.operators.ordering import exact_quantiles, largest, row_numbers, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on key 0, some null keys, and keys the lookup does not know."""
    rng = random.Random(1)
    keys = [0] * 400 + [None] * 50 + [rng.randrange(1, 120) for _ in range(750)]
    fact = spark.createDataFrame([(key, i) for i, key in enumerate(keys)], "k long, v long")
    dim = spark.createDataFrame([(key, f"name{key}", key * 1.5) for key in range(100)], "k long, name string, x double")
    return fact, dim


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_split_join_equals_a_plain_join(skewed, how):
    fact, dim = skewed
    plain = {tuple(r) for r in fact.join(dim, "k", how).select("k", "v", "name", "x").collect()}
    hot = hot_split_join(fact, dim, dim.where("k < 3"), ["k"], ["v"], how, salts=7)
    assert hot.count() == len(plain)
    assert {tuple(r) for r in hot.select("k", "v", "name", "x").collect()} == plain
    found = lookup_join(fact, dim, "k", ["v"], how)
    assert {tuple(r) for r in found.select("k", "v", "name", "x").collect()} == plain


def test_hot_rows_are_spread_over_many_routes(skewed):
    fact, dim = skewed
    with pytest.raises(ValueError):
        hot_split_join(fact, dim, dim, ["k"], ["v"], "full")
    assert 0 in {row.k for row in frequent_keys(fact, "k", 0.2).collect()}
    assert frequent_keys(fact, "k", 0.2).count() <= 5


def test_running_totals_match_a_single_order(spark):
    rng = random.Random(2)
    rows = [(("big" if i % 3 else "small"), i, rng.randrange(10)) for i in rng.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "g string, o long, n long").repartition(8)
    got = running_totals(df, ["g"], [F.col("o").desc()], ["n"]).collect()
    expected = {}
    for group in ("big", "small"):
        total = 0
        for g, o, n in sorted((r for r in rows if r[0] == group), key=lambda r: -r[1]):
            total += n
            expected[g, o] = total
    assert {(r.g, r.o): r.cum_n for r in got} == expected


def test_running_totals_without_groups_and_row_numbers(spark):
    df = spark.range(500).select(F.col("id").alias("o"), F.lit(2).alias("n"))
    got = {r.o: r.cum_n for r in running_totals(df, [], [F.col("o")], ["n"]).collect()}
    assert got == {i: 2 * (i + 1) for i in range(500)}
    numbered = row_numbers(spark.range(300).select((F.col("id") % 2).alias("g"), "id"), ["g"], [F.col("id").desc()])
    assert {(r.g, r.id): r.rn for r in numbered.collect()} == {(i % 2, i): (299 - i) // 2 + 1 for i in range(300)}


def test_exact_quantiles(spark):
    rng = random.Random(3)
    values = {"zeros": [0.0] * 700 + [rng.random() for _ in range(300)], "plain": [rng.random() for _ in range(57)]}
    rows = [(name, v) for name, vs in values.items() for v in vs] + [("plain", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "signal string, value double"), "signal", "value", 101).collect()
    for name, vs in values.items():
        found = [r.value for r in sorted((r for r in got if r.signal == name), key=lambda r: r.idx)]
        assert found == list(np.quantile(vs, [i / 100 for i in range(101)], method="inverted_cdf"))


@pytest.mark.parametrize("k", [1, 40, 333, 5000])
def test_largest_with_and_without_a_bound(spark, k):
    rng = random.Random(9)
    rows = [(f"t{i}", rng.randrange(30)) for i in range(900)] + [("none", None)]
    df = spark.createDataFrame(rows, "name string, n int").repartition(7)
    expected = [r[0] for r in sorted(rows[:900], key=lambda r: (-r[1], r[0]))][:k]
    for small in (0, 10_000):
        assert [r.name for r in largest(df, "n", "name", k, small).collect()] == expected  # a null has no rank
        assert largest(df.where("n IS NULL"), "n", "name", k, small).count() == 0


def test_a_hot_key_reaches_all_partitions(spark):
    """Half of the rows share one key, others have none; without broadcast and re-planning the salt must spread them."""
    fact = spark.range(40_000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 4 == 1, F.concat(F.lit("k"), F.col("id")))
        .alias("key"))
    dim = fact.where("key IS NOT NULL").select("key").distinct().withColumn("value", F.length("key"))
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], "false")
        spark.conf.set(names[1], "-1")
        joined = hot_split_join(fact, dim, dim.where("key = 'hot'"), ["key"], ["row"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert any("SortMergeJoin" in line and line.count("_route") >= 2 for line in plan.splitlines())
        for chosen in ("key = 'hot'", "key IS NULL"):
            sizes = [r["count"] for r in joined.where(chosen).groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * min(sizes)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert {r.value for r in joined.where("key = 'hot'").select("value").distinct().collect()} == {3}


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), (None, 3)], "g string, o long")
    assert sorted((r.g or "", r.o, r.rn) for r in row_numbers(df, ["g"], [F.col("o")]).collect()) == [
        ("", 1, 1), ("", 2, 2), ("", 3, 3), ("a", 1, 1)]
    assert exact_quantiles(df.select("g", F.col("o").cast("double").alias("v")), "g", "v", 3).count() == 6


def test_summaries_of_null_keys_and_values(spark):
    rows = [(None, i, float(i)) for i in range(50)] + [("a", i, None if i % 2 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, o long, v double")
    found = {r.k: r for r in latency_summary(df, "v", ["k"]).collect()}
    assert (found[None].n, found[None].p50_ms) == (50, 24.5) and (found["a"].n, found["a"].p50_ms) == (20, 19.0)
    for block in (3, 6, 100):
        got = {(r.k, r.o): (r.n, r.max_ms) for r in rolling_latency(df, "k", ["o"], "v", 3, block=block).collect()}
        assert len(got) == 70 and got[None, 49] == (3, 49.0) and got["a", 2] == (2, 2.0) and got["a", 38] == (3, 38.0)


def test_cume_dist_agrees_with_breakpoints(spark):
    """The share of rows at or below a value, by a window, against its place among exact quantiles."""
    rng = random.Random(12)
    df = spark.createDataFrame([("s", float(rng.randrange(40))) for _ in range(400)], "signal string, value double")
    points = exact_quantiles(df, "signal", "value", 201)
    places = points.groupBy("value").agg(F.max("idx").alias("idx")).where("idx < 200")
    shares = df.withColumn("share", F.cume_dist().over(Window.partitionBy("signal").orderBy("value"))).distinct()
    gaps = places.join(shares, "value").select((F.col("share") - F.col("idx") / 200).alias("gap")).collect()
    assert gaps and all(0 <= r.gap + 1e-9 and r.gap < 1 / 200 for r in gaps)
