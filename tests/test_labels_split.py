import pytest
from pyspark.sql import functions as F

from crowdlens.operators import features, labels, split
from crowdlens.params import LabelParams, QueueParams, from_conf


@pytest.fixture(scope="module")
def businesses(spark):
    rows = [("a", ["Bars", "Food", "Cafes"]), ("b", ["Bars", "Spas"]), ("c", ["Spas", "Spas"]), ("d", ["Zoo"]), ("e", [])]
    return spark.createDataFrame(rows, "business_id string, category_list array<string>")


def test_vocabulary_order_stop_list_and_repeats(businesses):
    got = [tuple(r) for r in labels.label_vocabulary(businesses, k=3, stoplist=["Food"]).orderBy("idx").collect()]
    assert got == [(0, "Spas", 3), (1, "Bars", 2), (2, "Cafes", 1)]
    distinct = labels.label_vocabulary(businesses, k=2, distinct=True).orderBy("idx").collect()
    assert [(r.category, r.n) for r in distinct] == [("Bars", 2), ("Spas", 2)]


def test_vectors_keep_order_and_drop_unlabelled(businesses):
    got = {r.business_id: (r.labels, r.n_labels) for r in labels.attach_labels(businesses, ["Spas", "Bars", "Cafes"]).collect()}
    assert got == {"a": ([0, 1, 1], 2), "b": ([1, 1, 0], 2), "c": ([1, 0, 0], 1)}


def test_prevalence_weights_and_identical_labels(spark):
    rows = spark.createDataFrame([([1, 1, 0, 1],), ([1, 1, 0, 0],), ([1, 0, 0, 0],), ([1, 0, 0, 0],)], "labels array<int>")
    prevalence = labels.label_prevalence(rows)
    got = {r.idx: (r.positives, r.prevalence, r.is_constant) for r in prevalence.collect()}
    assert got == {0: (4, 1.0, True), 1: (2, 0.5, False), 2: (0, 0.0, True), 3: (1, 0.25, False)}
    weights = {r.idx: (r.pos_weight, r.scale_pos_weight) for r in labels.label_class_weights(prevalence).collect()}
    assert weights == {0: (1.0, 1.0), 1: (1.0, 1.0), 2: (4.0, None), 3: (3.0, 3.0)}
    twins = spark.createDataFrame([([1, 1, 0],), ([1, 1, 1],), ([0, 0, 1],)], "labels array<int>")
    pairs = {(r.idx_a, r.idx_b): r.jaccard for r in labels.label_cooccurrence(twins).collect()}
    assert pairs[0, 1] == 1.0 and pairs[0, 2] == pytest.approx(1 / 3)


@pytest.mark.parametrize("method", ["xxhash64", "md5"])
def test_split_is_disjoint_stable_and_near_its_target(spark, method):
    small = spark.range(4000).select((F.col("id") % 1000).cast("string").alias("g"))
    large = spark.range(9000).select((F.col("id") % 3000).cast("string").alias("g"))
    before = {r.g: r.split for r in split.grouped_split(small, "g", method=method).distinct().collect()}
    after = {r.g: r.split for r in split.grouped_split(large, "g", method=method).distinct().collect()}
    assert len(before) == 1000 and all(after[g] == side for g, side in before.items())
    audit = split.split_leakage(split.grouped_split(large, "g", method=method), "g").head()
    assert audit.groups == 3000 and audit.leaking_groups == 0 and abs(audit.test_share - 0.2) < 0.03
    with pytest.raises(ValueError):
        split.grouped_split(small, "g", method="sha")


def test_leakage_is_seen(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "business_id string, split string")
    assert split.split_leakage(rows).head().leaking_groups == 1


def test_hash_sample_does_not_depend_on_partitions(spark):
    df = spark.range(20_000)
    first = {r.id for r in split.hash_sample(df.repartition(3), "id", 0.1).collect()}
    second = {r.id for r in split.hash_sample(df.repartition(11), "id", 0.1).collect()}
    assert first == second and abs(len(first) - 2000) < 200
    assert split.bounded_sample(df, "id", 50_000).count() == 20_000
    for method in ("xxhash64", "md5"):
        found = sorted(r.id for r in split.bounded_sample(df, "id", 5_000, method=method).collect())
        assert len(set(found)) == 5_000 and found == sorted(r.id for r in split.bounded_sample(df.repartition(7), "id", 5_000, method=method).collect())
    assert split.bounded_sample(df, "id", None) is df


def test_labelled_table(spark, businesses):
    reviews = spark.createDataFrame(
        [("r1", "a", "u1", "x" * 50, 50, 1, "2020-03-01", 1, 4.0), ("r2", "a", "u2", "x" * 50, 50, 1, "2020-03-01", 2, 2.0),
         ("r3", "a", "u1", "short", 5, 1, "2020-03-01", 3, 1.0), ("r4", "d", "u1", "x" * 50, 50, 1, "2020-03-01", 4, 1.0),
         ("r5", "b", None, "x" * 50, 50, 1, "2020-03-01", 5, 1.0), ("r6", "b", "u1", None, None, None, "2020-03-01", 6, 1.0)],
        "review_id string, business_id string, user_id string, text string, text_len int, word_count int, review_date string, "
        "text_hash long, stars double").withColumn("review_date", F.to_date("review_date"))
    users = spark.createDataFrame([("u1", 9, 3.5, 1, 2, 3, 4, "2021-03-01 00:00:00")],
                                  "user_id string, review_count long, average_stars double, fans long, useful long, "
                                  "friend_count int, elite_years int, since string").select(
        "*", F.to_timestamp("since").alias("yelping_since_ts")).drop("since")
    table = features.review_labeled(reviews, businesses, users, ["Spas", "Bars"], LabelParams())
    got = {r.review_id: r for r in table.collect()}
    assert set(got) == {"r1", "r2"}
    assert got["r1"].labels == [0, 1] and got["r1"].account_age_days_at_review == -365
    assert got["r1"].star_deviation_from_user_mean == 0.5
    assert got["r2"].user_average_stars is None and got["r2"].star_deviation_from_user_mean == 0.0
    assert "yelping_since_ts" not in table.columns
    with pytest.raises(ValueError):
        features.assert_no_business_inputs(businesses)


def test_params_from_session_settings(spark):
    spark.conf.set("spark.crowdlens.pseudo_count", "20")
    spark.conf.set("spark.crowdlens.exact_quantiles", "true")
    spark.conf.set("spark.crowdlens.stoplist", "A, B")
    try:
        got = from_conf(spark, QueueParams())
        assert got.pseudo_count == 20.0 and got.exact_quantiles is True and got.cdf_points == 1001
        assert from_conf(spark, LabelParams()).stoplist == ("A", "B")
    finally:
        for name in ("pseudo_count", "exact_quantiles", "stoplist"):
            spark.conf.unset(f"spark.crowdlens.{name}")


def test_no_fraction_is_too_small_to_sample(spark):
    rows = spark.range(3_000_000)
    for method in ("xxhash64", "md5"):
        assert 0 < split.hash_sample(rows, "id", 4 / 2**20, method=method).count() < 40
        assert split.hash_sample(rows.limit(50), "id", 1.0, method=method).count() == 50


def test_bounded_sample_is_exact_when_it_is_large_and_keys_repeat(spark, monkeypatch):
    df = spark.range(100).selectExpr("id % 40 AS id", "id AS n").repartition(5)
    for limit in (0, 1, 33, 99, 100, 101):
        small = split.bounded_sample(df, "id", limit).select("id").collect()
        monkeypatch.setattr(split, "SMALL_SAMPLE", -1)
        large = split.bounded_sample(df, "id", limit).select("id").collect()
        monkeypatch.undo()
        assert len(small) == len(large) == min(limit, 100) and sorted(small) == sorted(large)
