import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crowdlens.llm import jaccard_join as jj
from crowdlens.llm.components import stars
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)} - {()})


def brute(docs, k, percent):
    """(doc_id, size, component) of every row, by comparing all pairs."""
    sets = [shingles(t, k) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    group[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            ids[root(i)].append(doc)
    return collections.Counter((d, len(s), min(ids[root(i)], default=None) if s else d)
                               for i, ((d, _), s) in enumerate(zip(docs, sets)))


def edited(text, edits, rng):
    w = text.split()
    for _ in range(edits):
        at = rng.randrange(len(w))
        rng.choice([lambda: w.__setitem__(at, "new" + str(rng.randrange(10**6))), lambda: w.insert(at, "more"), lambda: w.pop(at)])()
    return " ".join(w)


@pytest.fixture(scope="module")
def family():
    """Copies, chains of edits across the threshold, sizes from few to many words, shared passages."""
    rng, docs = random.Random(8), []
    for f, n in enumerate([4, 6, 10, 12, 20, 35, 60, 61, 120, 300]):
        text = prose(f, n)
        docs.append(text)
        for step in range(7):
            text = edited(text, rng.randrange(0, max(2, n // 12)), rng)
            docs.append(text)
        docs += [docs[-1].upper(), docs[-1]]
    passage = prose(99, 50)
    docs += [prose(200 + i, 40 + 3 * i) + " " + passage for i in range(15)]
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs))


@pytest.mark.parametrize("k, percent, block", [(3, 90, 512), (5, 80, 2), (2, 50, 3)])
def test_components_equal_all_pairs(documents, family, odd_texts, k, percent, block):
    docs = family + [(i + 5000 if i else i, t) for i, t in odd_texts] + [(9000, family[0][1]), (9000, prose(1234, 9))]
    joined = jj.join(documents(docs), jj.Settings(k=k, percent=percent, block=block))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jj.components(joined).collect())
    assert got == brute(docs, k, percent)


def test_second_round_finds_links_beside_the_hub(documents):
    """A star around a text that is not the smallest node, with rays that are not similar to each other."""
    centre = [f"w{i}" for i in range(200)]
    docs = [(0, " ".join(centre))]
    for ray in range(12):
        w = list(centre)
        w[ray * 14: ray * 14 + 6] = [f"r{ray}x{j}" for j in range(6)]
        docs.append((ray + 1, " ".join(w)))
    for percent in (90, 94):
        joined = jj.join(documents(docs), jj.Settings(k=1, percent=percent, block=4))
        got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jj.components(joined).collect())
        assert got == brute(docs, 1, percent)


def test_one_of_each_group_stays(documents, family, odd_texts):
    docs = [(i + 100, t) for i, t in family] + odd_texts + [(5, "a\x00b \x0b c")]
    kept = jj.one_of_each(documents(docs))
    assert kept.columns == documents(docs).columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    blank = [(i, t) for i, t in docs if not shingles(t, 5)]
    assert all(got[x] == n for x, n in collections.Counter(blank).items())
    filled = [(i, t) for i, t in docs if shingles(t, 5)]
    roots = {c for _, _, c in brute(filled, 5, 80)}
    assert sum(got.values()) - len(blank) == len(roots)
    assert {i for i, t in got if shingles(t, 5)} == roots


def test_no_rows(documents):
    assert jj.components(jj.join(documents([]))).count() == 0
    assert jj.one_of_each(documents([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 60), st.integers(0, 60), st.sampled_from([50, 80, 90, 95]), st.integers(0, 5))
def test_similar_sets_share_a_part_and_pass_the_sketch(common, left, right, percent, seed):
    rng = np.random.default_rng(seed * 7919 + common * 61 + left * 7 + right)
    pool = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    rng.shuffle(pool)
    a, b = np.sort(pool[: common + left]), np.sort(np.concatenate((pool[:common], pool[200: 200 + right])))
    if 100 * common < percent * (common + left + right):
        return
    doc = np.repeat([0, 1], [len(a), len(b)])
    keys = [set(), set()]
    for owner, key in jj.part_keys(doc, np.concatenate((a, b)), np.array([len(a), len(b)]), jj.Settings(percent=percent)):
        for o, x in zip(owner.tolist(), key.tolist()):
            keys[o].add(x)
    assert left + right == 0 or keys[0] & keys[1]
    x, y = jj.bit_sketch(a), jj.bit_sketch(b)
    n = min(len(x), len(y))
    assert jj.allowed(jj.hamming(jj.folded(x, n), jj.folded(y, n)), len(a), len(b), percent)


def test_parts_of_hot_passages_make_few_rows(documents, spark):
    """Exact copies leave a task once; a key's rows stay linear in its nodes."""
    docs = documents([(i, prose(1, 80)) for i in range(200)])
    assert jj.shared_parts(docs, jj.Settings()).count() == 0


def test_stars_are_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    group = {x: x for e in edges for x in e}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x
    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        group[high] = low
    want = {(x, root(x)) for e in edges if e[0] != e[1] for x in e}
    got = stars(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_forest_is_minimal_and_connects():
    rng = np.random.default_rng(5)
    for _ in range(60):
        group = rng.integers(0, 8, 20)
        group = np.unique(group, return_inverse=True)[1]
        i, j = rng.integers(0, 20, (2, 30))
        keep = group[i] != group[j]
        i, j = i[keep], j[keep]
        far = rng.integers(1, 50, len(i))
        root = list(range(20))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        cost = 0
        for e in np.argsort(far, kind="stable"):  # Kruskal
            a, b = find(group[i[e]]), find(group[j[e]])
            if a != b:
                root[a] = b
                cost += far[e]
        chosen = jj.spanning_forest(group, i, j, far) if len(i) else []
        assert sum(far[e] for e in chosen) == cost


def test_words_built_alike_are_not_linked(documents):
    from tests.llm.test_words import thue_morse
    texts = [thue_morse(10), thue_morse(10, "b", "a"), thue_morse(10).upper(), f"x {thue_morse(11)} y", f"x {thue_morse(11, 'b', 'a')} y"]
    found = jj.components(jj.join(documents(texts), jj.Settings(k=3, percent=90))).collect()
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}


def test_equal_hashes_of_one_kind_make_no_links(documents, monkeypatch):
    """First hashes that agree for all words of one length: their clash with the second ones is noticed, another seed is taken."""
    original = jj.set_elements

    def weak(texts, s, second=False):
        if second or s.seed:
            return original(texts, s, second)
        lengths = (texts.ends - texts.starts).astype(np.uint64)
        return jj.words.shingles(texts, jj.words.mix(lengths), s.k)
    monkeypatch.setattr(jj, "set_elements", weak)
    texts = ["one two six", "ten one big", "one two six", "one two six ten"]
    found = jj.components(jj.join(documents(texts), jj.Settings(k=3, percent=90))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {0: (1, 0), 1: (1, 1), 2: (1, 0), 3: (2, 3)}
