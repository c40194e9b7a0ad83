import unicodedata
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from crowdlens.functions.lists import clean_list, counted_list
from crowdlens.functions.numeric import clip, finite_or_zero, logistic, norm_ppf
from crowdlens.functions.text import fingerprint_text, runs_of_equals, strip_accents, text_fingerprint, word_count, word_ngrams, words


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("value, expected", [
    (None, []), ("", []), (" A , ,B", ["A", "B"]), ("A", ["A"]), ("A,A", ["A", "A"]),
])
def test_clean_list(one, value, expected):
    assert one(clean_list(text(value))) == expected


@pytest.mark.parametrize("value, friends, elite", [
    (None, 0, 0), ("None", 0, 1), ("", 1, 0), ("a", 1, 1), ("a,b", 2, 2),
])
def test_counted_list(one, value, friends, elite):
    assert one(counted_list(text(value), ("None",)), counted_list(text(value), ("",))) == (friends, elite)


@pytest.mark.parametrize("value, expected", [("", 1), ("\n hi there", 3), (None, None), ("  a b  ", 2)])
def test_word_count(one, value, expected):
    assert one(word_count(text(value))) == expected


def test_fingerprint_orders(one):
    assert one(fingerprint_text(text("Great FOOD 5"))) == "reat5"
    assert one(fingerprint_text(text("Great FOOD 5"), "lower_first")) == "greatfood5"
    with pytest.raises(ValueError):
        fingerprint_text(text("x"), "other")


def test_fingerprint_of_null_emoji_and_short_texts(one):
    assert one(text_fingerprint(text(None))) == 42
    assert one(text_fingerprint(text("👍"))) == one(F.xxhash64(F.lit("")))
    assert one(text_fingerprint(text("👍"), min_chars=3)) is None
    assert one(text_fingerprint(text(None), min_chars=3)) is None
    assert one(text_fingerprint(text("abc"), min_chars=3)) == one(F.xxhash64(F.lit("abc")))


@pytest.mark.parametrize("value", [
    "plain text", "Éleçùñö straße", "ﬁne ½ cup № 5", "ǅ Ǣ ệ ṩ", "日本語 テスト", "éclair", "Ελλάδα й", "–“x”…",
])
def test_strip_accents_matches_decomposition(one, value):
    expected = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    assert one(strip_accents(text(value))) == expected


def test_words_and_ngrams(one):
    assert one(words(text("Crème, brûlée a x_1 42!"))) == ["creme", "brulee", "x_1", "42"]
    assert one(words(text(None))) == []
    tokens = F.array(*[F.lit(w) for w in "a b c".split()])
    assert one(word_ngrams(tokens)) == ["a", "b", "c", "a b", "b c"]
    assert one(word_ngrams(tokens, (1, 2, 3))) == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(word_ngrams(tokens, (2,))) == ["a b", "b c"]
    assert one(word_ngrams(F.array().cast("array<string>"))) == []
    assert one(word_ngrams(F.array(F.lit("solo")))) == ["solo"]


def test_numeric_helpers(one):
    null = F.lit(None).cast("double")
    assert one(clip(null, -5, 8)) is None
    assert one(clip(F.lit(9.0), -5, 8), clip(F.lit(-9.0), -5, 8), clip(F.lit(1.5), -5, 8)) == (8.0, -5.0, 1.5)
    for value in (float("nan"), float("inf"), float("-inf")):
        assert one(finite_or_zero(F.lit(value))) == 0.0
    assert one(finite_or_zero(null)) == 0.0
    assert one(finite_or_zero(F.lit(2.5))) == 2.5
    assert one(logistic(F.lit(0.0))) == 0.5


def test_norm_ppf_matches_the_normal_distribution(spark):
    shares = [i / 1001 for i in range(1, 1001)] + [1e-12, 1 - 1e-9, 0.5 / 1001]
    rows = spark.createDataFrame([(p,) for p in shares], "p double").select("p", norm_ppf(F.col("p")).alias("z")).collect()
    for row in rows:
        assert row.z == pytest.approx(NormalDist().inv_cdf(row.p), abs=1e-9)
    ends = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(norm_ppf(F.col("p")).alias("z")).collect()
    assert [row.z for row in ends] == [None, None, None]


def test_runs_of_equals_count_each_string(one):
    values = ["b", "a", "b", "ab", "a b", "a", "b", "é"]
    runs = one(runs_of_equals(F.array(*[F.lit(x) for x in values])))
    assert sorted(run.split("\n") for run in runs) == sorted([x] * values.count(x) for x in set(values))
    assert one(runs_of_equals(F.array().cast("array<string>"))) == []
