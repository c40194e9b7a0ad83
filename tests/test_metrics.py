import random

import math

import pytest
from pyspark.sql import functions as F

from crowdlens.functions.numeric import correlation_p
from crowdlens.operators import latency, metrics, predictions, upsert


def long(spark, pairs, label=0):
    return spark.createDataFrame([(label, y, s) for y, s in pairs], "label int, y int, score double")


def brute(pairs):
    """Average precision and AUC by definition, tied scores together."""
    positives = sum(y for y, _ in pairs)
    ap, seen_tp, seen = 0.0, 0, 0
    for score in sorted({s for _, s in pairs}, reverse=True):
        tied = [y for y, s in pairs if s == score]
        seen_tp, seen = seen_tp + sum(tied), seen + len(tied)
        ap += sum(tied) / positives * seen_tp / seen
    wins = sum((a > b) + 0.5 * (a == b) for y, a in pairs if y for z, b in pairs if not z)
    return ap, wins / (positives * (len(pairs) - positives))


def test_average_precision_with_ties(spark):
    got = metrics.label_metrics(long(spark, [(1, .9), (0, .9), (1, .5), (0, .4), (1, .4), (0, .1)])).head()
    assert got.average_precision == pytest.approx(0.588889, abs=1e-6)


def test_metrics_equal_their_definition_over_many_partitions(spark):
    rng = random.Random(4)
    data = {label: [(int(rng.random() < 0.2), round(rng.random(), 2)) for _ in range(400)] for label in (0, 1)}
    scores = long(spark, data[0], 0).union(long(spark, data[1], 1)).repartition(6)
    got = {r.label: r for r in metrics.label_metrics(scores).collect()}
    for label, pairs in data.items():
        ap, auc = brute(pairs)
        assert got[label].average_precision == pytest.approx(ap) and got[label].roc_auc == pytest.approx(auc)
        assert got[label].lift == pytest.approx(ap / got[label].prevalence)
        assert abs(got[label].average_precision - got[label].prevalence) < 0.1  # random scores: about the base rate
    report = metrics.multilabel_report(scores).head()
    assert report.micro_average_precision == pytest.approx(brute(data[0] + data[1])[0])
    assert report.macro_average_precision == pytest.approx((brute(data[0])[0] + brute(data[1])[0]) / 2)
    assert report.n_labels_scored == 2 and report.test_rows == 400


def test_constant_labels_are_left_out(spark):
    scores = long(spark, [(0, .1), (0, .2)], 0).union(long(spark, [(1, .1), (1, .2)], 1)).union(long(spark, [(1, .9), (0, .2)], 2))
    got = {r.label: (r.average_precision, r.roc_auc, r.lift) for r in metrics.label_metrics(scores).collect()}
    assert got == {0: (None, None, None), 1: (None, None, None), 2: (1.0, 1.0, 2.0)}
    report = metrics.multilabel_report(scores).head()
    assert report.n_labels_scored == 1 and report.macro_prevalence_floor == 0.5 and report.macro_lift == 2.0
    assert [r.label for r in metrics.per_label_report(metrics.label_metrics(scores)).collect()] == [2, 0, 1]


def test_delta_regression_and_buckets(spark):
    before = spark.createDataFrame([(0, .001, .1), (1, .01, .2), (2, .1, .3), (3, .2, None)], "label int, prevalence double, average_precision double")
    after = spark.createDataFrame([(0, .4), (1, .4), (2, .4), (3, .9)], "label int, average_precision double")
    got = metrics.label_delta_regression(before, after).head()
    assert got.n_labels == 3 and got.slope == pytest.approx(-0.1) and got.r == pytest.approx(-1.0)
    assert got.p_value == pytest.approx(0.0, abs=1e-7)
    assert got.mean_delta_rare == pytest.approx(0.3) and got.mean_delta_common == pytest.approx(0.1)


def test_gap_decomposition_refuses_mixed_test_sets(spark):
    rows = [("s", .57, 10), ("d", .43, 10), ("t", .42, 10)]
    schema = "arm string, macro_average_precision double, test_rows long"
    got = metrics.gap_decomposition(spark.createDataFrame(rows, schema), "s", "d", "t").head()
    assert got.representation_gap == pytest.approx(0.14) and got.representation_share == pytest.approx(0.14 / 0.15)
    mixed = spark.createDataFrame(rows[:2] + [("t", .42, 11)], schema)
    with pytest.raises(Exception, match="different test sets"):
        metrics.gap_decomposition(mixed, "s", "d", "t").collect()


def test_upsert_keeps_other_arms(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "arm string, v double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "arm string, v double")
    assert {tuple(r) for r in upsert.metrics_upsert(old, new).collect()} == {("a", 1.0), ("b", 3.0), ("c", 4.0)}


def test_top_k_then_floor(one):
    p = F.array(F.lit(.2), F.lit(.9), F.lit(.5))
    assert [(r.category, r.probability) for r in one(predictions.topk_categories(p, "xyz", 2, 0.6))] == [("y", 0.9)]
    tied = F.array(F.lit(.5), F.lit(.9), F.lit(.5))
    assert [r.category for r in one(predictions.topk_categories(tied, "xyz", 3))] == ["y", "x", "z"]
    for bad in ({"k": 0}, {"k": 51}, {"floor": 1.5}):
        with pytest.raises(ValueError):
            predictions.topk_categories(p, "xyz", **bad)


def test_latency_summary_exact_sketch_and_empty(spark):
    import numpy as np

    values = [random.Random(6).gauss(50, 20) for _ in range(501)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v double")
    got = {r.k: r for r in latency.latency_summary(df, "v", ["k"], dp=6).collect()}
    assert got["a"].p95_ms == pytest.approx(np.percentile(values, 95), abs=1e-6)
    assert got["a"].p50_ms == pytest.approx(np.percentile(values, 50), abs=1e-6)
    assert got["b"].n == 0 and got["b"].p50_ms is None
    overall = latency.latency_summary(df, "v", dp=6).head()
    assert overall.n == 501 and overall.p99_ms == pytest.approx(np.percentile(values, 99), abs=1e-6)
    sketch = latency.latency_summary(df.where("k = 'a'"), "v", exact=False).head()
    assert sketch.p50_ms == pytest.approx(np.percentile(values, 50), abs=1.0)
    assert latency.latency_summary(df.where("k = 'z'"), "v").head().n == 0


@pytest.mark.parametrize("n, block", [(1, 5), (7, 20), (50, 50), (2000, None)])
def test_rolling_latency_across_blocks(spark, n, block):
    import numpy as np

    rng = random.Random(8)
    values = [(("x" if i % 4 else "y"), i, rng.random() * 100) for i in range(240)]
    df = spark.createDataFrame(values, "k string, t long, v double").repartition(5)
    got = {(r.k, r.t): r for r in latency.rolling_latency(df, "k", ["t"], "v", n, dp=9, block=block).collect()}
    assert len(got) == 240
    for key in "xy":
        own = [(t, v) for k, t, v in values if k == key]
        for i, (t, _) in enumerate(own):
            window = [v for _, v in own[max(0, i - n + 1):i + 1]]
            r = got[key, t]
            assert r.n == len(window) and r.max_ms == pytest.approx(max(window))
            assert r.p95_ms == pytest.approx(np.percentile(window, 95)) and r.mean_ms == pytest.approx(np.mean(window))


def test_knee_stops_at_the_first_miss(spark):
    curve = spark.createDataFrame([(1, 100.0), (2, 120.0), (4, 125.0), (8, 200.0)], "batch_size int, throughput_per_sec double")
    assert latency.throughput_knee(curve).head().knee == 2
    best = {r.batch_size: r.pct_of_best for r in latency.sweep_pct_of_best(curve, "throughput_per_sec").collect()}
    assert best[8] == 100.0 and best[1] == 50.0


def exact_p(r, n):
    """Student's t with n - 2 degrees of freedom by numerical integration of its density."""
    v = n - 2
    t = abs(r) * math.sqrt(v / (1 - r * r))
    scale = math.gamma((v + 1) / 2) / math.gamma(v / 2) / math.sqrt(v * math.pi)
    # Substituting u = 1 / x makes the tail finite: the integral over 0 < x < 1 / t.
    steps, total = 20_000, 0.0
    for i in range(steps):
        x = (i + 0.5) / steps / t
        total += scale * (1 + 1 / (v * x * x)) ** (-(v + 1) / 2) / (x * x) / steps / t
    return 2 * total


@pytest.mark.parametrize("r, n", [(-0.405, 50), (-0.0253, 50), (0.5, 3), (0.9, 4), (0.3, 5), (0.99, 12), (0.05, 300), (-0.6, 41)])
def test_p_value_of_a_correlation(one, r, n):
    assert one(correlation_p(F.lit(r), F.lit(n))) == pytest.approx(exact_p(r, n), rel=2e-4, abs=1e-9)


def test_published_and_extreme_p_values(one):
    got = one(correlation_p(F.lit(-0.405), F.lit(50)), correlation_p(F.lit(-0.0253), F.lit(50)), correlation_p(F.lit(0.0), F.lit(9)),
              correlation_p(F.lit(1.0), F.lit(9)), correlation_p(F.lit(0.5), F.lit(2)), correlation_p(F.lit(None).cast("double"), F.lit(9)))
    assert round(got[0], 4) == 0.0035 and got[1] == pytest.approx(0.8616, abs=2e-4)
    assert got[2:] == (1.0, 0.0, None, None)
