import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crowdlens.llm import near_vectors, queries

FOLDER = "/root/testdata/sf0.001"
EVERY = near_vectors.Settings(k=3, bits=32, covered=1.0, chunk_rows=16, block_rows=4, slots=3)


def frame_of(spark, rows, kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return frame.withColumns({name: F.lit("x") for name in ("vector", "part", "slot", "ids", "codes", "rank", "score", "label")})


def plain(rows, k, is_query):
    kept = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    lengths = [len(v) for _, v in kept]
    length = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    kept = [(i, v) for i, v in kept if len(v) == length]
    found = []
    for i, v in kept:
        if i is not None and is_query(i):
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j is None, j or 0) for j, w in kept if j != i)
            found += [(i, rank, None if none else j, round(score, 9)) for rank, (score, none, j) in enumerate(near[:k], 1)]
    return sorted(found, key=str)


def got(frame):
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in frame.collect()), key=str)


def test_with_all_bits_the_search_is_exact(spark):
    """Repeated rows, a common vector, rows without an id, ties; the radius covers all, or queries widen until it does."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += rows[:9] + [(500 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)] + [(None, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0])] * 2
    rows += [(900, [-50.0] * 6)]  # far from all others
    s = near_vectors.Settings(**{**EVERY.__dict__, "bits": 6})
    exact = near_vectors.Settings(**{**s.__dict__, "calibration": 10_000})
    frame = frame_of(spark, rows)
    original = near_vectors.radius
    near_vectors.radius = lambda *_: 6
    try:
        assert got(near_vectors.search(frame, F.col("vec_id") % 5 == 0, exact)) == plain(rows, 3, lambda i: i % 5 == 0)
    finally:
        near_vectors.radius = original


def test_queries_widen_until_they_have_enough(spark):
    rows = [(i, [float(i % 7) - 3, float(i % 11) - 5, 1.0 + i]) for i in range(40)] + [(100, [-1000.0, 3000.0, -2000.0])]
    original = near_vectors.radius
    near_vectors.radius = lambda *_: 0
    try:
        found = near_vectors.search(frame_of(spark, rows), F.col("vec_id") % 10 == 0, EVERY).collect()
    finally:
        near_vectors.radius = original
    for i in (0, 10, 20, 30, 100):
        own = sorted((r["rank"], r.score) for r in found if r.query_id == i)
        assert [rank for rank, _ in own] == [1, 2, 3] and [s for _, s in own] == sorted(s for _, s in own)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None), (5, []), (10, [0.0, 0.0]), (15, [nan, 1.0]), (20, [inf, 1.0]), (25, [1.0, None]), (30, [1.0, 2.0, 3.0])]
    few = [(35, [1.0, 1.0]), (36, [1.0, 1.0]), (40, [-0.0, 2.0]), (None, [1.0, 1.5])]
    for rows in (odd + few, odd[:6], few[:1], few[1:3], []):
        assert got(near_vectors.search(frame_of(spark, rows), F.col("vec_id") % 5 == 0, EVERY)) == plain(rows, 3, lambda i: i % 5 == 0)
    assert got(near_vectors.search(frame_of(spark, odd + few, "float"), F.col("vec_id") < 0, EVERY)) == []


@pytest.mark.parametrize("radius", [0, 1, 5, 17, 30, 63, 64])
def test_every_code_within_the_radius_is_found(radius):
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    codes[1000:2000] = codes[0] ^ (1 << rng.integers(0, 16, (1000, 4)) * (rng.random((1000, 4)) < 0.4)).astype(np.uint16)
    chunk = near_vectors.Chunk(pa.array(range(3000)), codes, np.zeros((3000, 1)))
    for code in codes[[0, 1, 1500, 2999]]:
        assert chunk.within(code, radius).tolist() == np.flatnonzero(near_vectors.differing(codes, code) <= radius).tolist()
    assert sum(t + 1 for t in near_vectors.thresholds(radius, 4)) == radius + 1


def test_learned_rotations_are_orthogonal_and_better_than_chance():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 24))
    x = centres[rng.integers(0, 16, 2000)] + 0.1 * rng.normal(size=(2000, 24))
    codes = near_vectors.learn(x, near_vectors.Settings(bits=48))
    for part in (codes.directions[:, :24], codes.directions[:, 24:]):
        assert np.allclose(part.T @ part, np.eye(24), atol=1e-9)
    bits = codes.of(x)
    same = near_vectors.differing(bits[1:], bits[0])
    near = ((x[1:] - x[0]) ** 2).sum(axis=1) < 1
    assert same[near].max() < np.median(same[~near])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_recall_and_distances_on_the_table(spark):
    rows = queries.QUERIES["op13_multi_index_search"](spark, FOLDER).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = plain(table, 10, lambda i: i % 100 == 0)
    scores = {(q, v): s for q, _, v, s in plain(table, len(table), lambda i: i % 100 == 0)}
    found = {(r.query_id, r.vec_id) for r in rows}
    assert len(rows) == len(want) == len(found)
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-8 for r in rows)
    assert len(found & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
