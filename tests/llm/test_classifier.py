import zlib

import numpy as np
import pyarrow as pa
import pytest

from crowdlens.llm import classifier, words
from crowdlens.llm.queries import LEARN
from tests.llm.conftest import prose

SMALL = classifier.Settings(buckets=1 << 14, train_rows=150)


def corpus(n):
    good = [(i, prose(i, 60)) for i in range(n)]
    bad = [(n + i, " ".join(w.upper() + "!!" if j % 3 else w for j, w in enumerate(prose(9000 + i, 60).split()))) for i in range(n)]
    return good + bad


def test_held_out_rows_are_told_apart(documents, spark):
    texts = corpus(120)
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    judged = classifier.judge(documents(texts), labels, LEARN, settings=SMALL)
    unseen = {r.doc_id for r in documents(texts).where(f"NOT ({LEARN})").select("doc_id").collect()}
    rows = [r for r in judged.select("row.doc_id", "score", "predicted").collect() if r.doc_id in unseen]
    assert len(rows) > 30 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == (r.doc_id < 120) for r in rows) >= 0.95 * len(rows)


def test_ratios_count_all_rows(spark):
    learn = spark.createDataFrame([("alpha beta", 1)] * 3 + [("gamma", 0), ("", 0), (None, 0)], "text string, label int")
    ratios, bad, good = classifier.log_ratios(learn, SMALL)
    assert (bad, good) == (3, 3)
    assert ratios.max() > 0 > ratios.min()


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    cost = np.full(80, 0.5)
    sparse = classifier.Sparse(np.arange(81) * 5, np.tile(np.arange(5), 80), x.ravel())
    w = classifier.dual_coordinate_descent(sparse, y, cost, 5, 400)
    x = np.column_stack((x, np.ones(80)))  # the constant feature

    def primal(v):
        return 0.5 * v @ v + cost @ np.maximum(0, 1 - y * (x @ v))
    best = np.zeros(6)
    for step in range(1, 20_000):  # plain subgradient descent
        wrong = y * (x @ best) < 1
        best -= 0.5 / step * (best - (cost[wrong] * y[wrong]) @ x[wrong])
    assert primal(w) <= primal(best) + 1e-3


def test_curve_follows_frequencies():
    margin = np.repeat([-1.0, 1.0], 1000)
    label = np.concatenate((np.arange(1000) < 200, np.arange(1000) < 900)).astype(int)
    slope, offset = classifier.logistic_curve(margin, label)
    assert 1 / (1 + np.exp(slope - offset)) == pytest.approx(0.2, abs=0.01)
    assert 1 / (1 + np.exp(-slope - offset)) == pytest.approx(0.9, abs=0.01)


@pytest.mark.parametrize("marks, share", [([], 0.5), ([(4, 1), (6, 1)], 1.0), ([(4, 0), (None, 1), (6, None), (99, 1)], 0.0)])
def test_odd_rows_and_labels(documents, odd_texts, spark, marks, share):
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    rows = classifier.judge(documents(odd_texts), labels, settings=SMALL).select("row.*", "predicted").collect()
    assert len(rows) == len(odd_texts) and {r.predicted for r in rows} == {int(share >= 0.3)}
    assert classifier.judge(documents([]), labels, settings=SMALL).count() == 0


def plain_features(text):
    """Indicators of one text, word by word: the buckets that `features` finds when texts stand alone."""
    return np.unique(classifier.features(next(words.slices(pa.array([text or ""]), words.SPACED)), SMALL.buckets)[1])


def test_scores_equal_a_plain_version(documents, spark):
    """Ratios, dual coordinate descent, curve and probability by plain loops over all learning rows."""
    texts = corpus(60)
    marks = {i: int(i < 60) for i, _ in texts}
    labels = spark.createDataFrame([(i, y, 0) for i, y in marks.items()], "doc_id long, quality int, toxic int")
    judged = classifier.judge(documents(texts), labels, LEARN, settings=SMALL)
    got = {r.doc_id: r.score for r in judged.select("row.doc_id", "score").collect()}
    learn = [(i, t, marks[i]) for i, t in texts if zlib.crc32(str(i).encode()) % 5]
    count = np.ones((2, SMALL.buckets))
    for _, text, y in learn:
        count[y][plain_features(text)] += 1
    ratio = (np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())).astype(np.float32)
    # The rows of the fit, in the order in which Spark hands them over.
    ordered = classifier._sample(classifier.learning_rows(documents(texts), labels, LEARN), sum(y == 0 for *_, y in learn),
                                 sum(y for *_, y in learn), SMALL).repartition(1).collect()
    assert sorted((r.text, r.label) for r in ordered) == sorted((t, y) for _, t, y in learn)
    rows = []
    for r in ordered:
        x = np.zeros(SMALL.buckets + 1)
        found = plain_features(r.text)
        x[found] = ratio[found]
        x /= max(np.linalg.norm(x), 1e-30)
        x[-1] = 1
        rows.append(x)
    x, label = np.array(rows), np.array([r.label for r in ordered])
    y = np.where(label == 1, 1.0, -1.0)
    cost = SMALL.cost * 0.5 / np.array([(label == c).mean() for c in (0, 1)])[label]

    def descent(chosen):
        w, alpha, rng = np.zeros(x.shape[1]), np.zeros(len(y)), np.random.default_rng(7)
        for _ in range(SMALL.epochs):
            most = 0.0
            for i in rng.permutation(chosen):
                new = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / (x[i] @ x[i]), 0, cost[i])
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]) * (x[i] @ x[i]))
                alpha[i] = new
            if most < 1e-3:
                break
        return w
    unseen = np.arange(len(y)) % 4 == 0
    slope, offset = classifier.logistic_curve(x[unseen] @ descent(np.flatnonzero(~unseen)), label[unseen])
    w = descent(np.arange(len(y)))
    for i, text in texts:
        v = np.zeros(SMALL.buckets)
        found = plain_features(text)
        v[found] = ratio[found]
        margin = v @ w[:-1] / max(np.linalg.norm(v), 1e-30) + w[-1]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(slope * margin + offset))), abs=1e-3)


def test_the_bounds_hold_for_repeated_rows_and_long_texts(spark):
    rows = spark.createDataFrame([("copy", 1)] * 5000 + [(f"text {i}", i % 2) for i in range(100)], "text string, label int")
    sample = classifier._sample(rows, 50, 5050, classifier.Settings(train_rows=60)).collect()
    assert len(sample) == len(set(sample)) and 3 <= sum(r.label == 0 for r in sample) <= 4 and len(sample) <= 64
    long = spark.createDataFrame([("x" * 1000 + str(i), i % 2) for i in range(100)], "text string, label int")
    sample = classifier._sample(long, 50, 50, classifier.Settings(train_bytes=20_000)).collect()
    assert 10 <= len(sample) <= 20
    sample = classifier._sample(long, 50, 50, classifier.Settings(train_bytes=10)).collect()
    assert sorted(r.label for r in sample) == [0, 1]


def test_a_model_is_learned_from_many_copies(documents, spark):
    texts = [(i, "good plain words here") for i in range(300)] + [(300 + i, "BAD!! $$ CLICK %%") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    judged = classifier.judge(documents(texts), labels, LEARN, settings=classifier.Settings(buckets=1 << 12, train_rows=4))
    assert {(r.doc_id < 300, r.predicted) for r in judged.select("row.doc_id", "predicted").collect()} == {(True, 1), (False, 0)}
