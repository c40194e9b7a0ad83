import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crowdlens.llm import centroids

SMALL = centroids.Settings(clusters=4, dimensions=3, scale=16, rounds=5, seed=3)


def plain(rows, s):
    """All distances, in Python integers."""
    kept = [(i, [int(np.floor(s.scale * np.float64(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == s.dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{s.seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[: s.clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]
    for _ in range(s.rounds):
        found = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    sums = [sum(d for d, m in found if m == n) for n in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((str(i), n, d, sums[n], sum(sums), digest[n]) for (i, _), (d, n) in zip(kept, found))


def got(frame):
    return sorted((str(r[0]), *r[1:]) for r in frame.collect())


def frame_of(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return frame.withColumns({name: F.lit("x") for name in ("vector", "cluster", "distance", "n", "inertia", "label")})


def test_equals_plain_rounds(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(3)]) for i in range(400)]
    rows += rows[:30] + [(1000 + i, [0.5, -0.25, 2.0]) for i in range(200)]  # repeated rows, one common vector
    assert got(centroids.cluster(frame_of(spark, rows), SMALL)) == plain(rows, SMALL)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]),
            (7, [-inf, 1.0, 1.0]), (8, [0.0, 0.0, 0.0]), (9, [-0.0, -1e-9, 1e-9]), (None, [3.0, 3.0, 3.0]), (10, [3.0, 3.0, 3.0]),
            (10, [3.0, 3.0, 3.0]), (11, [-100.0, 100.0, 0.01])]
    assert got(centroids.cluster(frame_of(spark, rows), SMALL)) == plain(rows, SMALL)
    for few in (rows[:7], [], rows[7:8]):
        assert got(centroids.cluster(frame_of(spark, few), SMALL)) == plain(few, SMALL)


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="would not be exact"):
        centroids.cluster(frame_of(spark, [(1, [1e9, 0.0, 0.0])]), SMALL).collect()


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 12), st.integers(0, 2**31), st.sampled_from([2, 40, 1 << 20]))
def test_the_scan_finds_the_nearest(d, k, seed, size):
    rng = np.random.default_rng(seed)
    vectors, centres = rng.integers(-size, size, (60, d)), rng.integers(-size, size, (k, d))
    centres[-1] = centres[0]
    vectors[:k] = centres
    number, distance = centroids.nearest(vectors, centres)
    every = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


def test_the_scan_leaves_centroids_out():
    rng = np.random.default_rng(2)
    centres = rng.integers(-30, 30, (200, 16)) + rng.integers(-900, 900, (200, 1))
    vectors = centres[rng.integers(0, 200, 1000)] + rng.integers(-9, 9, (1000, 16))
    done = []
    centroids.nearest(vectors, centres, done.append)
    assert sum(done) < 0.05 * 1000 * 200
