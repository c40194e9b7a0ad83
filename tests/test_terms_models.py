import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdlens.operators import blocks, boosting, linear, metrics, models, svd, terms, text_model
from crowdlens.operators.text_model import TextModel, fit_text_model
from crowdlens.params import TextParams
from crowdlens.plans.baselines import ARMS, Baselines

TOPICS = {0: "coffee espresso barista latte", 1: "massage towel relax spa", 2: "tyre engine brake oil"}
NOISE = "the good place very nice people came went again with friend"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        labels = [int(rng.random() < 0.4) for _ in range(3)] + [0]
        if not any(labels):
            labels[i % 3] = 1
        picked = [w for j in range(3) if labels[j] for w in rng.choices(TOPICS[j].split(), k=4)]
        text = picked + rng.choices(NOISE.split(), k=8)
        rng.shuffle(text)
        rows.append((i, " ".join(text), labels, float(len(text))))
    rows.append((120, None, [1, 0, 0, 0], 0.0))
    return spark.createDataFrame(rows, "doc_id long, text string, labels array<int>, size double"), rows


def python_tfidf(rows, min_df):
    counts = {}
    for doc, text, *_ in rows:
        w = re.findall(r"\w\w+", (text or "").lower())
        counts[doc] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for doc, c in counts.items():
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= min_df}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out.update({(doc, t): v / norm for t, v in raw.items()})
    return out


def test_tfidf_equals_the_formula(corpus):
    docs, rows = corpus
    tokens = terms.tokenise(docs)
    expected = python_tfidf(rows, 3)
    for limit, hot in ((None, 20), (None, 10**9), (100_000, 1)):
        vocabulary = terms.term_stats(tokens, 3, limit)
        got = {(r.doc_id, r.term): r.w for r in terms.tfidf(tokens, vocabulary, len(rows), vocabulary_rows=limit, hot_rows=hot).collect()}
        assert got.keys() == expected.keys()
        assert all(got[key] == pytest.approx(value) for key, value in expected.items())


def test_vocabulary_limit_keeps_the_most_frequent(corpus):
    tokens = terms.tokenise(corpus[0], ngrams=(1,))
    best = terms.term_stats(tokens, 1, 5).collect()
    everything = sorted(terms.term_stats(tokens, 1, None).collect(), key=lambda r: (-r.term_count, r.term))
    assert [r.term for r in best] == [r.term for r in everything[:5]]


def test_chi2_equals_the_matrix_definition(corpus):
    docs, rows = corpus
    weights = python_tfidf(rows, 3)
    tokens = terms.tokenise(docs)
    long = terms.tfidf(tokens, terms.term_stats(tokens, 3, None), len(rows))
    got = {r.term: r.chi2 for r in terms.chi2_scores(long, docs).collect()}
    labels = {doc: vector for doc, _, vector, _ in rows}
    for term in {t for _, t in weights}:
        column = {doc: w for (doc, t), w in weights.items() if t == term}
        best, total = 0.0, sum(column.values())
        for j in range(3):
            p = sum(v[j] for v in labels.values()) / len(labels)
            o = sum(w for doc, w in column.items() if labels[doc][j])
            best = max(best, (o - p * total) ** 2 / (p * total) + (total - o - (1 - p) * total) ** 2 / ((1 - p) * total))
        assert got[term] == pytest.approx(best)
    top = [r.term for r in terms.chi2_select(terms.chi2_scores(long, docs), 3).orderBy("rank").collect()]
    assert all(set(t.split()) & set(" ".join(TOPICS.values()).split()) for t in top)


def test_chi2_refuses_a_constant_target(spark):
    weights = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0)], "doc_id long, term string, w double")
    labels = spark.createDataFrame([(1, [1, 0]), (2, [1, 0])], "doc_id long, labels array<int>")
    with pytest.raises(terms.DegenerateTarget):
        terms.chi2_scores(weights, labels)


def test_tokenise_shuffles_only_the_texts(corpus):
    docs, _ = corpus
    tokens = terms.tokenise(docs)
    plan = terms.tfidf(tokens, terms.term_stats(tokens, 3, 1000), 121, vocabulary_rows=1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2          # the texts, once for the vocabulary and once for the weights
    assert "hashpartitioning(doc_id#" in plan and "Python" not in plan


@pytest.fixture(scope="module")
def baselines(corpus):
    docs, _ = corpus
    params = TextParams(max_features=500, select_k=60, svd_dims=5, train_rows=10_000)
    return Baselines(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), params, numeric=["size"], max_iter=25,
                     boost=boosting.BoostParams(rounds=3, depth=2))


def test_arms_beat_the_floor_on_one_test_set(baselines):
    rows = {r.arm: r for r in baselines.report(["linear_tfidf", "linear_svd_meta", "xgb_svd_meta"]).collect()}
    assert rows["linear_tfidf"].macro_average_precision > 0.95
    assert all(r.macro_average_precision > r.macro_prevalence_floor for r in rows.values())
    assert all(r.n_labels_scored == 3 for r in rows.values())      # the fourth label never occurs


def test_svd_projects_both_sides(baselines):
    left, right, explained = baselines.projected()
    assert len(left.head().svd) == 5 and len(right.head().svd) == 5 and 0.0 < explained < 1.0
    with pytest.raises(ValueError):
        baselines.scores("other")


def test_sweep_uses_all_terms_beyond_their_number(baselines):
    points = [r.k for r in baselines.sweep([10, 10**5, 10**6]).collect()]
    assert sorted(points) == [10] + [baselines.terms.vocabulary.count()] * 2


def test_saved_model_scores_like_the_fitted_one(spark, corpus, tmp_path):
    docs, _ = corpus
    params = TextParams(max_features=500, select_k=60)
    names = ["coffee", "spa", "car", "never"]
    model = fit_text_model(docs, names, params, max_iter=25)
    model.save(str(tmp_path / "model"))
    loaded = TextModel.load(spark, str(tmp_path / "model"))
    fresh = spark.createDataFrame([(1, "espresso and latte by the barista"), (2, None), (3, "brake oil")], "doc_id long, text string")
    got = {r.doc_id: [p.category for p in r.predictions] for r in loaded.predict(fresh, 1, 0.5).collect()}
    assert got[1] == ["coffee"] and got[3] == ["car"] and set(got) == {1, 2, 3}
    first = {r.doc_id: r.probabilities for r in model.probabilities(docs).collect()}
    again = {r.doc_id: r.probabilities for r in loaded.probabilities(docs).collect()}
    assert all(first[doc] == pytest.approx(again[doc]) for doc in first)
    assert max(p[3] for p in first.values()) < 1e-6


def test_table_scoring_equals_the_fitted_estimators(corpus):
    """Probabilities of the term-table model equal Spark ML's on the same features."""
    docs, _ = corpus
    params = TextParams(max_features=500, select_k=60)
    model = fit_text_model(docs, list("abcd"), params, max_iter=25)
    table = {r.doc_id: r.probabilities for r in model.probabilities(docs).collect()}
    shared = Baselines(docs, docs, params, max_iter=25)
    fitted = {}
    for r in shared.linear().collect():
        fitted.setdefault(r.doc_id, {})[r.label] = r.score
    for doc, probabilities in table.items():
        for j in range(3):
            assert probabilities[j] == pytest.approx(fitted[doc][j], abs=1e-4)


def test_partitions_of_tokens_follow_the_characters(spark, monkeypatch):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("some words " * 10).alias("text"))
    monkeypatch.setattr(terms, "TASK_CHARS", 110)
    tokens = terms.tokenise(docs)
    assert tokens.rdd.getNumPartitions() == 64  # merged by the bytes of the texts it was one
    assert {(r.term, r.tf) for r in tokens.collect()} == {("some", 10), ("words", 10), ("some words", 10), ("words some", 9)}


def test_the_vocabulary_is_counted_in_larger_tasks_than_the_weights(spark, monkeypatch):
    """each task shuffles a row for each of its terms; so small a task as the weights need shuffles most of them again and again."""
    rows = [(i, f"common words {i % 4}x only{i}") for i in range(64)] + [(3, "common more"), (64, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n_docs, chars = terms.text_size(docs)
    assert (n_docs, chars) == (66, sum(len(t or "") for _, t in rows))
    whole = {tuple(r) for r in terms.term_stats(terms.tokenise(docs), 3, None).collect()}
    monkeypatch.setattr(terms, "TASK_CHARS", 32)
    monkeypatch.setattr(terms, "COUNT_CHARS", 320)
    vocabulary = terms.vocabulary_of(docs, 3, None, chars=chars)
    plan = terms.tfidf(terms.tokenise(docs, chars=chars), vocabulary, n_docs, vocabulary_rows=1000)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(doc_id#\d+L, (\d+)\), REPARTITION", plan)]
    assert sorted(dealt) == [-(-chars // 320), -(-chars // 32)]
    assert {tuple(r) for r in vocabulary.collect()} == whole and ("common", 65, 64) in whole


def test_terms_are_counted_in_the_row_of_their_document(spark):
    rows = [(1, "b a b a b"), (1, "b a"), (None, "xx yy"), (None, "xx"), (2, None), (3, "aa aab aa aab"), (4, "zz " * 100_000)]
    docs = spark.createDataFrame([(i, t and t.replace("b a", "bb aa").replace("a b", "aa bb")) for i, t in rows], "doc_id long, text string")
    want = {}
    for i, t in docs.collect():
        own = [w for w in (t or "").split() if len(w) > 1]
        for term in own + [f"{a} {b}" for a, b in zip(own, own[1:])]:
            want[i, term] = want.get((i, term), 0) + 1
    found = terms.tokenise(docs)
    got = found.collect()
    assert {(r.doc_id, r.term): r.tf for r in got} == want and len(got) == len(want)
    assert dict(found.dtypes)["tf"] == "bigint"
    # No hash table of (id, term): it would hold all n-grams of a task.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[doc_id" not in plan.replace("ObjectHashAggregate", "") and "Python" not in plan


def test_dense_features_clean_numbers(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, Vectors.dense([1.0]), float("nan"))], ["id", "svd", "a"])
    got = models.dense_features(df.withColumn("b", F.lit(None).cast("double")), ["a", "b"]).head().features
    assert list(got) == [1.0, 0.0, 0.0]
    assert list(models.dense_features(df, ["a"], drop_metadata=True).head().features) == [1.0]


def test_documents_without_known_terms_stay_in_every_arm(spark, corpus):
    docs, _ = corpus
    unknown = spark.createDataFrame([(1000, "zzzz yyyy", [1, 0, 0, 0], 2.0), (1004, None, [0, 1, 0, 0], 0.0)], docs.schema)
    params = TextParams(max_features=500, select_k=60, svd_dims=5, train_rows=10_000)
    arms = ["linear_tfidf", "linear_svd_meta", "linear_svd_only"]
    fitted = Baselines(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0").union(unknown), params, numeric=["size"],
                       max_iter=10)
    found = fitted.report(arms)
    assert {r.test_rows for r in found.collect()} == {docs.where("doc_id % 4 = 0").count() + 2}
    assert metrics.gap_decomposition(found, *arms).head().test_rows == docs.where("doc_id % 4 = 0").count() + 2
    assert {r.arm for r in fitted.per_label.select("arm").distinct().collect()} == set(arms)
    zero = fitted.projected()[1].where("doc_id = 1000").head().svd
    assert not any(zero)


def test_no_python_on_the_test_side(baselines):
    index = text_model.term_index(baselines.terms.vocabulary)
    cells = models.indexed_terms(baselines.test_weights, index)
    basis = cells.sparkSession.createDataFrame([(0, [1.0, 0.0])], "idx int, v array<double>")
    fitted = models.fit_sparse(
        baselines.train.select("doc_id", "labels"), baselines.terms.weights, index, index.count(), max_iter=2)
    scored = models.linear_scores(baselines.test, baselines.test_weights, index, fitted)
    for frame in (models.project(cells, basis, 2), scored):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(node in plan for node in ("Python", "Pandas", "Arrow"))


def test_a_ranking_without_positive_scores_is_refused(spark):
    with pytest.raises(terms.DegenerateTarget):
        terms.assert_some_term_scores(spark.createDataFrame([("a", 0.0)], "term string, chi2 double"))


# ---------------------------------------------------------------- fits against plain solvers

def sparse_problem(n=400, width=30, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, width)) * (rng.random((n, width)) < 0.25)
    x[5] = 0
    y = (x @ rng.normal(size=(width, labels)) * 2 + rng.normal(size=(n, labels)) > 0.2).astype(int)
    y[:, labels - 1] = 0
    return x, y


def packed(spark, x, y, sparse):
    if sparse:
        rows = [(y[i].tolist(), np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist()) for i in range(len(x))]
        return blocks.pack(spark.createDataFrame(rows, "labels array<int>, index array<int>, value array<double>"))
    return blocks.pack(spark.createDataFrame([(y[i].tolist(), x[i].tolist()) for i in range(len(x))], "labels array<int>, value array<double>"))


@pytest.mark.parametrize("sparse", [True, False])
def test_joint_fit_equals_one_fit_for_each_label(spark, sparse):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    x, y = sparse_problem()
    fitted = linear.fit(packed(spark, x, y, sparse), x.shape[1], y.shape[1], c=4.0, tolerance=1e-8)
    for j in range(3):
        rows = spark.createDataFrame([(Vectors.dense(x[i].tolist()), float(y[i, j])) for i in range(len(x))], ["features", "label"])
        plain = LogisticRegression(regParam=1 / (4.0 * len(x)), standardization=False, maxIter=2000, tol=1e-12).fit(rows)
        assert fitted.coefficients[:, j] == pytest.approx(plain.coefficients.toArray(), abs=1e-4)
        assert fitted.intercepts[j] == pytest.approx(plain.intercept, abs=1e-4)
    assert not fitted.coefficients[:, 3].any() and fitted.intercepts[3] == -linear.CERTAIN
    assert fitted.passes < 80  # for all labels together


def test_joint_fit_is_stationary_and_groups_of_labels_change_nothing(spark, monkeypatch):
    x, y = sparse_problem(seed=2)
    data = packed(spark, x, y, True)
    fitted = linear.fit(data, x.shape[1], y.shape[1], tolerance=1e-8)
    p = 1 / (1 + np.exp(-(x @ fitted.coefficients + fitted.intercepts)))
    gradient = x.T @ (p - y) / len(x) + fitted.coefficients / (4.0 * len(x))
    assert np.abs(gradient[:, :3]).max() < 1e-6 and np.abs((p - y).mean(axis=0)[:3]).max() < 1e-6
    monkeypatch.setattr(linear, "NUMBERS", 1)
    assert linear.fit(data, x.shape[1], y.shape[1], tolerance=1e-8).coefficients == pytest.approx(fitted.coefficients, abs=1e-6)


def test_sums_over_many_tasks_go_through_parts(spark, monkeypatch):
    x, y = sparse_problem(seed=3)
    data = packed(spark, x, y, True).repartition(6)
    monkeypatch.setattr(blocks, "PART", 7)
    direct = blocks.total(data, linear._moments(30, 4), 35)
    assert blocks.total(data, linear._moments(30, 4), 35, direct=1) == pytest.approx(direct)
    assert direct == pytest.approx(np.concatenate(((x ** 2).sum(axis=0), y.sum(axis=0), [len(x)])))


def plain_booster(x, y, p):
    """Every cut of every feature tried on every node, row by row, without histograms."""
    weight = np.where(y == 1, max((len(y) - y.sum()) / y.sum(), 1.0), 1.0)
    margin = np.zeros(len(y))

    def worth(g, h):
        return g.sum() ** 2 / (h.sum() + p.penalty)

    def tree(rows, depth, g, h):
        best = (1e-12, None, None)
        for f in range(x.shape[1]) if depth else ():
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left, right = rows[x[rows, f] < cut], rows[x[rows, f] >= cut]
                if min(h[left].sum(), h[right].sum()) < p.min_weight:
                    continue
                gain = worth(g[left], h[left]) + worth(g[right], h[right]) - worth(g[rows], h[rows])
                if gain > best[0] + 1e-9:
                    best = (gain, left, right)
        if best[1] is None:
            margin[rows] += -p.step * g[rows].sum() / (h[rows].sum() + p.penalty)
        else:
            for part in best[1:]:
                tree(part, depth - 1, g, h)
    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-margin))
        tree(np.arange(len(y)), p.depth, weight * (q - y), weight * q * (1 - q))
    return 1 / (1 + np.exp(-margin))


def test_boosting_equals_a_plain_booster(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(150, 4)), 1)
    y = np.column_stack(((x[:, 0] * x[:, 1] > 0), (x[:, 2] > 0.4), np.zeros(150), np.ones(150))).astype(int)
    p = boosting.BoostParams(rounds=12, depth=3, step=0.3, row_share=1.0, column_share=1.0, min_weight=1.0)
    frame = spark.createDataFrame([(i, y[i].tolist(), x[i].tolist()) for i in range(150)], "doc_id long, labels array<int>, value array<double>")
    trees = boosting.fit(frame.repartition(3), 4, "value", p)
    got = {r.doc_id: r.scores for r in boosting.scores(frame, trees, "value", ["doc_id"]).collect()}
    for j in range(2):
        assert [got[i][j] for i in range(150)] == pytest.approx(plain_booster(x, y[:, j], p).tolist(), abs=1e-9)
    assert all(got[i][2] == 0.0 and got[i][3] == 1.0 for i in range(150))


def test_boosting_of_full_size_learns_what_a_line_cannot():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1200, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    p = boosting.BoostParams()
    assert (p.rounds, p.depth, p.step, p.row_share, p.column_share, p.min_weight, p.penalty) == (300, 6, 0.08, 0.85, 0.7, 4.0, 1.5)
    cuts = boosting.cut_points(x[:800], p.bins)
    trees = boosting.Trees(cuts, {0: boosting.grow(boosting.binned(x[:800], cuts), y[:800], p)}, p.depth)
    assert ((trees.probabilities(x[800:])[:, 0] > 0.5) == y[800:]).mean() > 0.9


@pytest.mark.parametrize("n, width, rank", [(60, 40, 5), (30, 50, 29), (50, 12, 11)])
def test_svd_finds_the_subspace_of_a_dense_one(spark, n, width, rank):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, 12)) * 0.6 ** np.arange(12)) @ rng.normal(size=(12, width)) + 0.001 * rng.normal(size=(n, width))
    x[np.abs(x) < 0.05] = 0
    cells = [(i, int(j), float(x[i, j])) for i in range(n) for j in np.flatnonzero(x[i])]
    basis, found = svd.right_vectors(spark.createDataFrame(cells, "doc_id long, idx int, w double"), rank)
    _, values, right = np.linalg.svd(x)
    assert found == min(rank, (values > 1e-10 * values[0]).sum())
    got = np.zeros((width, found))
    for row in basis.collect():
        got[row.idx] = row.v
    assert got.T @ got == pytest.approx(np.eye(found), abs=1e-9)
    same = np.linalg.svd(got[:, :5].T @ right[:5].T)[1]
    assert same == pytest.approx(np.ones(5), abs=1e-3)
    assert np.linalg.norm(x @ got, axis=0) == pytest.approx(values[:found], rel=1e-2, abs=1e-3 * values[0])


def test_svd_of_a_table_of_small_rank_drops_the_rest(spark):
    cells = [(i, j, float((i + 1) * (j + 1))) for i in range(9) for j in range(7)]
    basis, found = svd.right_vectors(spark.createDataFrame(cells, "doc_id long, idx int, w double"), 4)
    assert found == 1 and all(len(r.v) == 1 for r in basis.collect())


def test_no_cell_is_sorted_with_a_vector(spark):
    cells = spark.createDataFrame([(1, 0, 0.5), (1, 1, -2.0), (2, 1, 1.0)], "doc_id long, idx int, w double")
    basis = spark.createDataFrame([(0, [1.0, 0.0, 3.0]), (1, [0.5, 1.0, 0.0])], "idx int, v array<double>")
    found = models.project(cells, basis, 10**9)
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()  # which sorts its rows beyond 128 keys
    assert {r.doc_id: r.svd.toArray().tolist() for r in found.collect()} == {1: [-0.5, -2.0, 1.5], 2: [0.5, 1.0, 0.0]}


def test_svd_product_over_many_chunks_is_the_dense_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 40)) * (rng.random((90, 40)) < 0.3)
    column = [j * 1_500 for j in range(40)]  # fifteen chunks of columns
    cells = spark.createDataFrame(
        [(i * 7, column[j], float(x[i, j])) for i in range(90) for j in np.flatnonzero(x[i])], "doc_id long, idx int, w double")
    blocks_, ids = svd.packed(cells, "doc_id")
    assert ids.count() == 90 and ids.select("slab").distinct().count() == svd.SLABS
    v = rng.normal(size=(40, 3))
    rows = {}
    for j in range(40):
        rows.setdefault(column[j] // svd.CHUNK, []).append(j)
    table = spark.createDataFrame(
        [(c, np.array([column[j] % svd.CHUNK for j in own], np.int16).tobytes(), v[own].tobytes()) for c, own in rows.items()], svd.VECTORS)
    got = np.zeros((40, 3))
    for r in svd.product(blocks_, table, 3).collect():
        for idx, value in zip(*svd._numbers(r.asDict(), 3)):
            got[column.index(int(idx) + r.chunk * svd.CHUNK)] = value
    assert got == pytest.approx(x.T @ (x @ v))


@pytest.mark.parametrize("n, width", [(20, 300), (300, 20)])
def test_svd_moves_the_shorter_side_and_projects_the_rows(spark, monkeypatch, n, width):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.3)
    cells = [(i * 3, int(j), float(x[i, j])) for i in range(n) for j in np.flatnonzero(x[i])]
    moved = []
    plain = svd.product

    def watched(blocks_, vectors, size, *rest, **named):
        if named.get("left", True):
            moved.append(sum(len(r.v) for r in vectors.collect()) / 8 / size)
        return plain(blocks_, vectors, size, *rest, **named)
    monkeypatch.setattr(svd, "product", watched)
    basis, rows, found = svd.decomposed(spark.createDataFrame(cells, "doc_id long, idx int, w double"), 6)
    assert found == 6 and moved and set(moved) == {20}  # rows of the tables that every slab meets
    v = np.zeros((width, found))
    for row in basis.collect():
        v[row.idx] = row.v
    assert {r.doc_id for r in rows.collect()} == {3 * i for i in range(n)}
    assert all(r.v == pytest.approx((x @ v)[r.doc_id // 3].tolist(), abs=1e-9) for r in rows.collect())


def test_projection_in_blocks_is_the_plain_sum(spark):
    rng = np.random.default_rng(9)
    cells = spark.createDataFrame([(i, int(j) * 900, float(rng.normal())) for i in range(30) for j in rng.choice(20, 6, False)],
                                  "doc_id long, idx int, w double")
    basis = spark.createDataFrame([(j * 900, rng.normal(size=4).tolist()) for j in range(15)], "idx int, v array<double>")
    plain = {r.doc_id: r.svd.toArray().tolist() for r in models.project(cells, basis, 2).collect()}
    found = models.project(cells, basis, 10**9)
    assert "SortMergeJoin [idx" not in found._jdf.queryExecution().executedPlan().toString()  # no cell carries a vector
    got = {r.doc_id: r.svd.toArray().tolist() for r in found.collect()}
    assert got.keys() == plain.keys() and all(got[i] == pytest.approx(plain[i]) for i in plain)


def test_slabs_grow_with_the_rows(monkeypatch):
    assert [svd.slabs_for(n) for n in (0, 1, 2_001, 10**5, 400_000, 10**6)] == [1, 1, 2, 8, 8, 20]


def test_small_sums_of_many_tasks_come_directly(spark, monkeypatch):
    x, y = sparse_problem(seed=3)
    data = packed(spark, x, y, True).repartition(12)
    monkeypatch.setattr(blocks, "_add", None)  # adding up in parts would fail
    assert blocks.total(data, linear._moments(30, 4), 35) == pytest.approx(
        np.concatenate(((x ** 2).sum(axis=0), y.sum(axis=0), [len(x)])))


def test_block_products_equal_the_dense_ones():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(7, 9)) * (rng.random((7, 9)) < 0.4)
    x[2] = x[6] = 0
    bounds = np.concatenate(([0], np.cumsum((x != 0).sum(axis=1))))
    columns, place = np.unique(np.nonzero(x)[1], return_inverse=True)
    block = blocks.Block(np.zeros((7, 1)), bounds, columns.astype(np.int32), place.astype(np.int32), x[x != 0])
    right, rest, out = rng.normal(size=(9, 3)), rng.normal(size=(7, 3)), np.zeros((9, 3))
    assert block.times(right) == pytest.approx(x @ right)
    block.transposed_times(rest, out)
    assert out == pytest.approx(x.T @ rest)


def test_widths_fitted_together_equal_single_fits_in_shared_passes(spark, monkeypatch):
    x, y = sparse_problem(seed=4)
    data = packed(spark, x, y, True)
    passes, losses = [], linear._losses
    monkeypatch.setattr(linear, "_losses", lambda points: passes.append(list(points)) or losses(points))
    found = linear.fit_widths(data, [30, 3, 11, 30], y.shape[1], tolerance=1e-8)
    assert list(found) == [30, 11, 3] and passes[0] == [30, 11, 3] and len(passes) == found[30].passes + 1 < 80
    for width in found:
        alone = linear.fit(packed(spark, x[:, :width], y, True), width, y.shape[1], tolerance=1e-8)
        assert found[width].coefficients == pytest.approx(alone.coefficients, abs=1e-5)
        assert found[width].intercepts == pytest.approx(alone.intercepts, abs=1e-5)
    monkeypatch.setattr(linear, "NUMBERS", 20)  # groups of one or two problems
    assert linear.fit_widths(data, [30, 11], y.shape[1], tolerance=1e-8)[11].coefficients == pytest.approx(
        found[11].coefficients, abs=1e-5)


def test_the_sweep_fits_all_widths_at_once(baselines, monkeypatch):
    calls, fit = [], linear.fit_widths
    monkeypatch.setattr(linear, "fit_widths", lambda blocks, widths, *a: calls.append(list(widths)) or fit(blocks, widths, *a))
    rows = {r.k: r for r in baselines.sweep([60, 10, 20]).collect()}
    assert calls == [[60, 10, 20]]
    plain = metrics.multilabel_report(baselines.linear(20)).head()
    assert rows[20].macro_average_precision == pytest.approx(plain.macro_average_precision, abs=1e-6)


def test_first_columns_of_a_block():
    x = np.array([[0.0, 1, 0, 2], [0, 0, 0, 0], [0, 0, 3, 4], [5, 0, 0, 6]])
    bounds = np.concatenate(([0], np.cumsum((x != 0).sum(axis=1))))
    columns, place = np.unique(np.nonzero(x)[1], return_inverse=True)
    block = blocks.Block(np.zeros((4, 1)), bounds, columns.astype(np.int32), place.astype(np.int32), x[x != 0])
    full = blocks.Block(np.zeros((4, 1)), *[np.zeros(0, int)] * 3, x.ravel())
    for width in range(5):
        for kind in (block, full):
            assert kind.first_columns(width).times(np.eye(width)) == pytest.approx(x[:, :width])


def test_arms_are_fitted_on_all_training_rows(spark, monkeypatch):
    """above 400,000 rows, vocabulary, projection and fits came from a sample."""
    from crowdlens.catalog import model_queries
    from crowdlens.params import from_conf
    from crowdlens.plans import baselines as plan

    class Seen(Exception):
        pass

    def seen(train, *_):
        raise Seen(train.count())
    monkeypatch.setattr(plan, "training_terms", seen)
    docs = spark.range(400_001).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.array(F.lit(1)).alias("labels"))
    for params, rows in ((TextParams(), 400_001), (model_queries.PARAMS, 400_001), (TextParams(train_rows=20_000), 20_000)):
        with pytest.raises(Seen) as found:
            Baselines(docs, docs.limit(1), params)
        assert found.value.args == (rows,)
    spark.conf.set("spark.crowdlens.train_rows", "7")
    try:
        assert from_conf(spark, TextParams()).train_rows == 7
    finally:
        spark.conf.unset("spark.crowdlens.train_rows")
    assert from_conf(spark, TextParams()).train_rows is None


def test_the_report_takes_the_gap_to_the_trees_apart(spark, monkeypatch):
    """the third arm of the decomposition was a linear one, and the trees weren't fitted at all."""
    from crowdlens.catalog import model_queries

    value = {"linear_tfidf": .57, "linear_svd_meta": .43, "linear_svd_only": .40, "xgb_svd_meta": .42}
    asked = []

    class Fitted:
        def report(self, arms=ARMS):
            return spark.createDataFrame([(arm, value[arm], .1, 10) for arm in arms],
                                         "arm string, macro_average_precision double, macro_prevalence_floor double, test_rows long")

    def taken_apart(found, *arms):
        asked.append(arms)
        return metrics.gap_decomposition(found, *arms)
    monkeypatch.setattr(model_queries, "baselines", lambda *_: Fitted())
    monkeypatch.setattr(model_queries, "gap_decomposition", taken_apart)
    rows = model_queries.baseline_report(spark, "").collect()
    assert {r.arm for r in rows} == set(ARMS) and all(r.above_floor and r.gap_adds_up and r.test_rows == 10 for r in rows)
    assert asked == [("linear_tfidf", "linear_svd_meta", "xgb_svd_meta")]


def test_linear_dense_arms_share_their_passes(spark, corpus, monkeypatch):
    """each arm took passes of its own, and the features of one are the first of the other's."""
    docs, _ = corpus
    params = TextParams(max_features=500, select_k=60, svd_dims=5)
    sides = docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0")
    calls = []
    whole = linear.fit_widths
    monkeypatch.setattr(linear, "fit_widths", lambda *a: calls.append(a[1]) or whole(*a))
    shared = Baselines(*sides, params, numeric=["size"], max_iter=60)
    shared.report(["linear_svd_meta", "linear_svd_only"])
    assert calls == [[6, 5]]
    for arm in ("linear_svd_meta", "linear_svd_only"):
        alone = Baselines(*sides, params, numeric=["size"], max_iter=60)
        want = {(r.doc_id, r.label): r.score for r in alone.scores(arm).collect()}
        got = {(r.doc_id, r.label): r.score for r in shared.scores(arm).collect()}
        assert got == pytest.approx(want, abs=1e-6) and len(got) == len(want) > 0
    assert calls[1:] == [[6], [5]]


def test_leaves_of_the_last_level_have_no_histogram(monkeypatch):
    """half of a tree's nodes are on its last level, whose histograms cost as much as those of any other level."""
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 200, (6, 3_000), dtype=np.uint8)
    y = ((bins[1] > 90) ^ (bins[4] < 60)).astype(float)
    nodes = []
    whole = boosting._histogram
    monkeypatch.setattr(boosting, "_histogram", lambda *a: nodes.append(a[4]) or whole(*a))
    params = boosting.BoostParams(rounds=2, depth=3, row_share=1.0, column_share=1.0)
    feature, cut, value = boosting.grow(bins, y, params)
    assert nodes == [1, 1, 2] * 2
    p = 0.5  # of every row before the first tree
    weight = np.where(y == 1, max((1 - y.mean()) / y.mean(), 1.0), 1.0)
    at = boosting.leaves(bins, feature[0], cut[0], params.depth)
    for leaf in np.unique(at):
        own = at == leaf
        want = -(weight * (p - y))[own].sum() / ((weight * p * (1 - p))[own].sum() + params.penalty)
        assert value[0, leaf] == pytest.approx(params.step * want)


def test_products_add_up_runs_of_any_length(monkeypatch):
    rng = np.random.default_rng(6)
    lengths = np.concatenate((rng.integers(1, 5, 200), [300, 40, 1]))
    into = np.repeat(np.sort(rng.choice(400, len(lengths), replace=False)), lengths).astype(np.int32)
    take, w, matrix = rng.integers(0, 50, len(into)), rng.normal(size=len(into)), rng.normal(size=(50, 7))
    want = np.ones((400, 7))
    np.add.at(want, into, w[:, None] * matrix[take])
    for at_once in (1, 100, svd.AT_ONCE):
        monkeypatch.setattr(svd, "AT_ONCE", at_once)
        out = np.ones((400, 7))
        svd._sums(matrix, take, w, into, out)
        assert out == pytest.approx(want)
    none = np.zeros(0, np.int32)
    svd._sums(matrix, none, np.zeros(0), none, out)
    assert out == pytest.approx(want)


def test_frequent_terms_are_not_shuffled_by_term(spark, monkeypatch):
    """all terms of all documents were, and the vocabulary was counted once for either kind."""
    rows = [(i, f"common words {i % 4}x only{i}") for i in range(64)] + [(None, "common words"), (64, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = terms.tokenise(docs)
    vocabulary = terms.term_stats(tokens, 3, None)
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 5)
    weights = terms.tfidf(tokens, vocabulary, len(rows), hot_rows=1_000)
    monkeypatch.undo()
    whole = terms.tfidf(tokens, vocabulary, len(rows), vocabulary_rows=1000)
    got, want = ({(r.doc_id, r.term): r.w for r in df.collect()} for df in (weights, whole))
    assert got == pytest.approx(want) and len(want) > 200
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [term" not in plan                    # counted and written before
    assert "LeftAnti" in plan and "_route" not in plan      # frequent terms leave before the shuffle
    assert ">= 65" in plan                                  # of the vocabulary's terms, the three that may be broadcast
    # The others come back to their documents; neither is shuffled again.
    monkeypatch.setattr(terms, "BROADCAST_TERMS", 5)
    monkeypatch.setattr(terms, "TASK_CHARS", 110)
    chars = terms.text_size(docs)[1]
    parts = terms.text_parts(docs, chars)
    assert parts == -(-chars // 110) > 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = terms.tfidf(terms.tokenise(docs, chars=chars), vocabulary, len(rows), hot_rows=1_000, parts=parts)
        assert {(r.doc_id, r.term): r.w for r in dealt.collect()} == pytest.approx(want)
        shuffles = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, \d+\), (\w+)", dealt._jdf.queryExecution().executedPlan().toString().split("== Initial")[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert set(shuffles) == {("doc_id", "REPARTITION_BY_NUM"), ("term", "ENSURE_REQUIREMENTS")}
    monkeypatch.undo()
    alone = terms.tfidf(tokens, vocabulary, len(rows), hot_rows=65)
    assert {(r.doc_id, r.term): r.w for r in alone.collect()} == pytest.approx(want)
