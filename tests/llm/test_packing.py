import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crowdlens.llm import packing
from tests.llm.conftest import prose


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths])

    def padding(cuts):
        tops = [lengths[c] for c in cuts]
        return sum(n * (min(t for t in tops if t >= x) - x) for x, n in zip(lengths, counts))
    got = packing.boundaries(lengths, counts, buckets)
    assert got[-1] == len(lengths) - 1 and len(got) <= buckets
    options = [(*c, len(lengths) - 1) for k in range(buckets) for c in itertools.combinations(range(len(lengths) - 1), k)]
    assert padding(got) == min(map(padding, options))


@pytest.mark.parametrize("settings_", [packing.Settings(buckets=3, token_budget=200, part_rows=7),
                                       packing.Settings(buckets=5, token_budget=64, exact=8, part_rows=3)])
def test_every_row_has_one_place(documents, odd_texts, settings_):
    docs = odd_texts + [(50 + i, prose(i, i * 3 % 101)) for i in range(80)] + [(50, prose(0, 0))]
    rows = packing.pack(documents(docs), settings_).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted(
        (str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in docs)
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    for bucket in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == bucket]
        top = max(r.n_tokens for r in own)
        assert {r.bucket_length for r in own} == {top} and all(r.padding == top - r.n_tokens for r in own)
        sizes = [sum(r.batch == b for r in own) for b in range(max(r.batch for r in own) + 1)]
        room = max(1, settings_.token_budget // max(top, 1))
        assert all(n == room for n in sizes[:-1]) and 0 < sizes[-1] <= room  # all but the last batch are full
    assert all(r.over_budget == (r.n_tokens > settings_.token_budget) for r in rows)


def test_batches_gather_the_places(documents):
    packed = packing.pack(documents([prose(i, i) for i in range(40)]), packing.Settings(buckets=4, token_budget=100))
    rows = packing.batches(packed).collect()
    assert sorted(i for r in rows for i in r.doc_ids) == list(range(40))
    assert all(r.n_tokens <= r.padded_tokens <= max(100, r.bucket_length) for r in rows)


def test_no_rows(documents):
    assert packing.pack(documents([])).count() == 0


def test_bins_grow_with_lengths_and_stay_few(spark):
    from pyspark.sql import functions as F
    rows = spark.range(0, 200_000, 7).select("id", packing.bin_of(F.col("id"), 256).alias("bin")).orderBy("id").collect()
    bins = [r.bin for r in rows]
    assert bins == sorted(bins) and all(r.bin >= r.id and r.bin - r.id <= r.id / 32 for r in rows)
    assert len(set(bins)) < 256 + 64 * 12


def _padding(edges, lengths, counts):
    return int((counts * (np.array(edges)[np.searchsorted(edges, lengths)] - lengths)).sum())


@pytest.mark.parametrize("seed", range(4))
def test_boundaries_of_many_lengths_cost_as_little_as_trying_every_cut(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(20_000, 400, replace=False))
    counts = rng.integers(1, 50, 400)
    before = np.concatenate(([0], np.cumsum(counts)))
    cost = np.concatenate(([0.0], np.full(400, np.inf)))
    for buckets in range(1, 7):
        cost = np.array([np.inf] + [(cost[:i] + lengths[i - 1] * (before[i] - before[:i])).min() for i in range(1, 401)])
        edges = lengths[packing.boundaries(lengths, counts, buckets)]
        assert _padding(edges, lengths, counts) == cost[-1] - (counts * lengths).sum()


def test_lengths_beyond_exact_are_planned_one_by_one(spark):
    lengths = np.array([3000, 3005, 3060, 3062, 19_000])
    counts = np.array([200, 100, 1, 1, 1])
    rows = spark.createDataFrame([(int(x),) for x, n in zip(lengths, counts) for _ in range(n)], "n_tokens long")
    got = packing.plan(rows, packing.Settings(buckets=4))
    options = [[*c, 19_000] for c in itertools.combinations(map(int, lengths[:-1]), 3)]
    assert _padding(got, lengths, counts) == min(_padding(o, lengths, counts) for o in options) == 2
    few = packing.plan(rows, packing.Settings(buckets=4, distinct=3))  # with shared bins, as before
    assert few == [3005, 3062, 19_000] and _padding(few, lengths, counts) == 1002


def test_the_number_of_lengths_switches_nothing(spark):
    lengths = spark.range(1, 200_003).withColumnRenamed("id", "n_tokens")  # more than the 200,000 that once were the end
    edges = packing.plan(lengths, packing.Settings(buckets=2))
    best = min(range(1, 200_003), key=lambda cut: cut * cut + (200_002 - cut) * 200_002)
    assert edges == [best, 200_002]
