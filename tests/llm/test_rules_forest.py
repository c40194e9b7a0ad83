import collections
import re

import numpy as np
import pytest

from crowdlens.llm import rules_forest
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if runs[tuple(w[i: i + 3])] >= 2 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def test_statistics_equal_a_plain_count(documents, odd_texts, spark):
    texts = odd_texts + [(20, "a b c a b c a"), (21, "l 1\nl 1\n\n\nl 1 \nl 1"), (22, "x x x x"), (23, "#*$ %&|<>"),
                         (24, "\r\n".join(["same"] * 3)), (25, prose(3, 60) + "\n" + prose(3, 60))]
    docs = documents(texts)
    got = rules_forest.measured(docs).collect()
    want = collections.Counter((i, *brute(t), len(WORD.findall(t or "")) < 50 or 100 * brute(t)[4] > 50 * brute(t)[0])
                               for i, t in texts)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                               for r in got) == want


def test_forest_isolates_outliers_and_keeps_good_rows(documents, spark):
    good = [(i, prose(i, 120)) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "###" for w in prose(i + 5000, 120).split())) for i in range(6)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:200]] + [(1000, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules_forest.judge(documents(good + bad), labels, rules_forest.Settings(good_loss=0.02)).collect()}
    assert all(not got[i].kept and not got[i].base_failed for i, _ in bad)
    assert sum(not got[i].kept for i, _ in good) <= 9
    assert min(got[i].anomaly for i, _ in bad) > np.median([got[i].anomaly for i, _ in good])


def test_threshold_covers_all_labelled_rows(spark):
    scored = spark.createDataFrame([(i, False, i / 100) for i in range(100)], "doc_id long, base_failed boolean, anomaly double")
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    assert rules_forest.threshold(scored, labels, rules_forest.Settings(good_loss=0.05)) == pytest.approx(0.94)


def test_odd_and_empty_tables(documents, odd_texts, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules_forest.judge(documents([]), none).count() == 0
    got = rules_forest.judge(documents(odd_texts), none).collect()
    assert len(got) == len(odd_texts)
    assert {r.doc_id for r in got if r.kept} == {6}  # no labels: the fixed rules decide alone
    marks = spark.createDataFrame([(None, 1, 0), (6, None, 0), (6, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in rules_forest.judge(documents(odd_texts), marks).collect() if r.kept} == {6}
