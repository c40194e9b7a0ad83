import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crowdlens.llm import decontaminate, words
from tests.llm.conftest import prose

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return PLAIN.findall((text or "").translate(LOWER))


def brute(doc, items):
    w, hit, found = split(doc), set(), set()
    for item, text in items:
        v = split(text)
        n = min(13, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for s in range(len(w) - n + 1):
                if w[s: s + n] == v[i: i + n]:
                    hit |= set(range(s, s + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    items = [(i, prose(100 + i, rng.choice([1, 3, 5, 12, 13, 14, 40]))) for i in range(25)]
    items += [(3, items[3][1]), (None, prose(777, 20)), (30, None), (31, ""), (32, "the"), (33, items[0][1] + " " + items[1][1])]
    docs = []
    for i in range(60):
        text = prose(i, rng.randrange(0, 200)).split()
        for _ in range(rng.randrange(3)):
            passage = (rng.choice(items)[1] or "").upper().split()
            cut = rng.randrange(0, max(1, len(passage) - 12))
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[cut:]
        docs.append((i, rng.choice([" ", "\n", " - "]).join(text)))
    return docs + [(70, prose(777, 20)), (70, prose(777, 20)), (71, "the"), (None, items[5][1])], items


@pytest.mark.parametrize("block", [300_000, 40])
def test_hits_equal_brute_force(documents, odd_texts, spark, case, block):
    docs, items = case
    docs = docs + odd_texts
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    judged = decontaminate.judge(documents(docs), benchmark, decontaminate.Settings(block=block))
    got = judged.select("row.doc_id", "row.text", "n_words", "n_hit", F.array_join("items", ",").alias("i"), "contaminated").collect()
    want = collections.Counter((i, hashlib.md5((t or "-").encode()).hexdigest(), *brute(t[:3000] if t and len(t) > 90_000 else t, items))
                               for i, t in docs if t is None or len(t) < 90_000)
    assert collections.Counter((r.doc_id, hashlib.md5((r.text or "-").encode()).hexdigest(), r.n_words, r.n_hit, r.i, r.contaminated)
                               for r in got if r.text is None or len(r.text) < 90_000) == want
    assert len(got) == len(docs)


def test_empty_tables(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontaminate.judge(documents([]), some).count() == 0
    rows = decontaminate.judge(documents(["one two", None]), none).select("n_hit", "contaminated").collect()
    assert {tuple(r) for r in rows} == {(0, False)}


def test_windows_whose_words_hash_alike_are_compared_by_bytes(documents, spark):
    from tests.llm.test_words import thue_morse
    a = thue_morse(10)
    items = spark.createDataFrame([(1, a), (2, "red big fox")], "item_id long, text string")
    docs = documents([a, thue_morse(10, "b", "a"), "RED-big fox", "fox red big", "red big fo x"])

    def hits():
        return [r.n_hit for r in decontaminate.judge(docs, items).orderBy("row.doc_id").select("n_hit").collect()]
    assert hits() == [1, 0, 3, 0, 0]
    block = decontaminate.Block.of([None, None], pa.array(["red big fox", "a b"]), decontaminate.Settings())
    texts = next(words.slices(pa.array(["x RED big fox bed big fox", "a c a b"]), words.PLAIN))
    same = block.equal(texts, np.array([1, 4, 3, 0]), np.zeros(4, int), 3)
    assert same.tolist() == [True, False, False, False]
    assert block.equal(texts, np.array([7, 9]), np.ones(2, int), 2).tolist() == [False, True]
