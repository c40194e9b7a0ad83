"""Centroid clustering by equal-average equal-variance search, on whole numbers throughout.

A vector's components become integers floor(scale * x). Rounds of assignment and averaging follow; both are exact: squared
distances are integers, a new centroid is the floor of a sum divided by a count. To find the nearest centroid, the centroids
are sorted by the mean of their components and scanned outward from the vector's own mean. For d components

    distance >= d * (mean - mean')**2 + (deviation - deviation')**2,    deviation = length of the vector minus its mean.

The first term alone grows along each side, so the scan of a side ends when it passes the best distance; the second one skips
single centroids. Both are compared with room for rounding, and what is left is decided by the integer distance, ties by the
smaller number, so the result is that of a full search.

* Vectors are turned into integers once, as a staged table. A round is one pass over it: each task adds up its vectors for
  each centroid, at most `clusters` rows, which Spark sums. The driver gets clusters x (components + 1) sums.
* Nothing is grouped by cluster but those sums, so a cluster with a third of all vectors is no hot key.

Odd cases: vectors that are null, have another number of components, or hold null, NaN or infinite ones have no row in the
result. Repeated rows all count and all return. The first centroids are the vectors whose hash of seed and id is smallest; ids
that are null come last, equal hashes are ordered by the vector. With fewer vectors than `clusters` there are fewer centroids;
equal first centroids leave the later ones empty, where they stay. An empty table gives no rows. A component whose integer is
2**27 or more in size is an error, as distances would no longer be exact. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.llm import frames
from crowdlens.session import stage

LARGEST = 1 << 27
RESULT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


@dataclass(frozen=True)
class Settings:
    clusters: int = 8
    dimensions: int = 64
    scale: int = 1024
    rounds: int = 10
    seed: int = 3


# ---------------------------------------------------------------- nearest centroid

def _moments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the components and length of what is left without it."""
    mean = vectors.sum(axis=1) / vectors.shape[1]
    return mean, np.sqrt(((vectors - mean[:, None]) ** 2).sum(axis=1))


def nearest(vectors: np.ndarray, centroids: np.ndarray, exact_done: Callable[[int], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest row of `centroids` for each row of `vectors`, both int64; `exact_done` is told
    how many distances were computed."""
    d = vectors.shape[1]
    mean, deviation = _moments(vectors)
    means, deviations = _moments(centroids)
    order = np.argsort(means, kind="stable")
    means, deviations = means[order], deviations[order]
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    chosen = np.full(len(vectors), len(centroids))
    right = np.searchsorted(means, mean)
    sides = [[right - 1, -1, np.arange(len(vectors))], [right, 1, np.arange(len(vectors))]]
    while any(len(rows) for _, _, rows in sides):
        for side in sides:
            at, step, rows = side
            rows = rows[(at[rows] >= 0) & (at[rows] < len(means))]
            place = at[rows]
            bound = d * (mean[rows] - means[place]) ** 2
            near = bound * (1 - 1e-9) <= best[rows]  # else all further ones on this side are too far as well
            rows, place, bound = rows[near], place[near], bound[near]
            gap = np.abs(deviation[rows] - deviations[place])
            gap = np.maximum(gap - 1e-9 * (deviation[rows] + deviations[place]), 0)
            left = (bound + gap * gap) * (1 - 1e-9) <= best[rows]
            some, number = rows[left], order[place[left]]
            distance = ((vectors[some] - centroids[number]) ** 2).sum(axis=1)
            if exact_done:
                exact_done(len(some))
            better = (distance < best[some]) | ((distance == best[some]) & (number < chosen[some]))
            best[some[better]], chosen[some[better]] = distance[better], number[better]
            at[rows] += step
            side[2] = rows
    return chosen, best


# ---------------------------------------------------------------- passes over all vectors

def _matrix(batch: pa.RecordBatch, settings: Settings) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    if len(flat) and max(-int(flat.min()), int(flat.max())) >= LARGEST:
        raise ValueError(f"a component of {settings.scale} times a vector is {LARGEST} or more: distances would not be exact")
    return flat.reshape(-1, settings.dimensions)


def _sum_task(centroids: np.ndarray, settings: Settings):
    """Sum of the vectors of each centroid, with their number."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centroids.shape, np.int64)
        counts = np.zeros(len(centroids), np.int64)
        for batch in batches:
            vectors = _matrix(batch, settings)
            if not len(vectors):
                continue
            chosen, _ = nearest(vectors, centroids)
            order = np.argsort(chosen, kind="stable")
            some, first = np.unique(chosen[order], return_index=True)
            sums[some] += np.add.reduceat(vectors[order], first)
            counts += np.bincount(chosen, minlength=len(centroids))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])
    return task


def _averaged(vectors: DataFrame, centroids: np.ndarray, settings: Settings) -> np.ndarray:
    """The next centroids: clusters x dimensions sums reach the driver."""
    parts = frames.map_rows(vectors.select("vector"), _sum_task(centroids, settings), "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).collect()
    moved = centroids.copy()
    for row in sums:
        moved[row["cluster"], row["at"]] = int(row["total"]) // row["n"]
    return moved


def _assign_task(centroids: np.ndarray, settings: Settings):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, distance = nearest(_matrix(batch, settings), centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(chosen.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"])
    return task


def whole(rows: DataFrame, settings: Settings, vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    value = F.col(vector)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(value.isNotNull() & (F.size(value) == settings.dimensions) & finite).select(
        F.col(id_).cast("long").alias("vec_id"),
        F.transform(value, lambda x: F.floor(x.cast("double") * settings.scale)).alias("vector"))


def first_centroids(vectors: DataFrame, settings: Settings) -> np.ndarray:
    rank = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(rank.asc_nulls_last(), "vector").limit(settings.clusters).select("vector").collect()
    return np.array([row["vector"] for row in rows], np.int64).reshape(-1, settings.dimensions)


def cluster(rows: DataFrame, settings: Settings = Settings(), vector: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """For each vector its cluster, squared distance, the sums of distances over the cluster and over all, and the digest of
    the cluster's centroid (RESULT)."""
    spark = rows.sparkSession
    vectors = stage(whole(rows, settings, vector, id_), "cluster-vectors")
    centroids = first_centroids(vectors, settings)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(settings.rounds):
        moved = _averaged(vectors, centroids, settings)
        if np.array_equal(moved, centroids):
            break  # nothing changes any more
        centroids = moved
    assigned = stage(frames.map_rows(vectors, _assign_task(centroids, settings), "vec_id long, cluster int, distance long"),
                     "cluster-assigned")
    sums = {row["cluster"]: int(row["total"]) for row in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row for each centroid: at most `clusters`.
    facts = spark.createDataFrame(
        [(number, total, sum(sums.values()), digests[number]) for number, total in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(*[field.split()[0] for field in RESULT.split(", ")])
