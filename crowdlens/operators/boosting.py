"""Boosted trees for many labels over one binned matrix.

Features are cut into at most 256 bins once, on a bounded sample of rows, and the training rows are packed as bytes. Each label is
then boosted in a task of its own on the packed rows: second-order gradients of the logistic loss, histograms per level, the
smaller child counted and the larger one derived, splits by gain with an L2 penalty on the leaves. So a label costs one job instead of
one job for each level of each tree, and labels run side by side.

A task holds all training rows as one byte per row and feature (rows x features, 106 MB for 400,000 x 266), and three times that while it
puts their blocks together. Test rows are never gathered: trees travel to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from crowdlens.session import ship_package, stage

PACK_ROWS = 4_096
#: Rows that are counted at once, so that their keys and gradients stay in a core's cache.
COUNT_ROWS = 16_384


@dataclass(frozen=True)
class BoostParams:
    """The sizes, rates and penalties a user of the baselines expects."""

    rounds: int = 300
    depth: int = 6
    step: float = 0.08
    row_share: float = 0.85
    column_share: float = 0.7
    min_weight: float = 4.0
    penalty: float = 1.5
    bins: int = 256
    sample_rows: int = 10_000
    seed: int = 17


def cut_points(sample: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each column the ascending upper bounds of all its bins but the last: between all values if they are few, else quantiles."""
    cuts = []
    for column in sample.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
        cuts.append((values[1:] + values[:-1]) / 2 if len(values) > 1 else np.zeros(0))
    return cuts


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, features x rows; a value equal to a bound lies above it."""
    return np.array([np.searchsorted(cut, column, "right") for cut, column in zip(cuts, values.T)], np.uint8).reshape(
        len(cuts), len(values))


# ---------------------------------------------------------------- one label

def _histogram(
    bins: np.ndarray, columns: np.ndarray, rows: np.ndarray, node: np.ndarray, n_nodes: int, g: np.ndarray, h: np.ndarray, width: int,
) -> np.ndarray:
    """Sums of g and h per node, column and bin: 2 x n_nodes x columns x width.

    One column after another: the sums of all nodes then stay in a core's cache, and no key or weight is written once for each column.
    """
    out = np.zeros((2, n_nodes, len(columns), width))
    for low in range(0, len(rows), COUNT_ROWS):
        some = rows[low: low + COUNT_ROWS]
        base, weights = node[low: low + COUNT_ROWS] * width, (g[some], h[some])
        for i, column in enumerate(columns):
            key = base + bins[column].take(some)
            for sums, weight in zip(out, weights):
                sums[:, i] += np.bincount(key, weight, n_nodes * width).reshape(n_nodes, width)
    return out


def _split(histogram: np.ndarray, params: BoostParams, scratch: np.ndarray) -> tuple[int, int, float]:
    """(column, last bin on the left, gain) of the best split of one node; the first of equals. `scratch`: two arrays like the histogram."""
    left, right = scratch
    whole = histogram.sum(axis=2)[..., None]
    np.cumsum(histogram, axis=2, out=left)
    np.subtract(whole, left, out=right)
    light = (left[1] < params.min_weight) | (right[1] < params.min_weight)
    light[:, -1] = True  # all bins on the left are no split
    for g, h in (left, right):
        h += params.penalty
        np.square(g, out=g)
        g /= h
    gain = left[0]
    gain += right[0]
    gain -= whole[0] ** 2 / (whole[1] + params.penalty)
    gain[light] = -np.inf
    best = int(gain.argmax())
    return *divmod(best, gain.shape[1]), float(gain.ravel()[best])


def grow(bins: np.ndarray, y: np.ndarray, params: BoostParams, label: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, last bin on the left, value) of every node of every tree: rounds x (2 ** (depth + 1) - 1).

    Node i has the children 2 i + 1 and 2 i + 2; a leaf has the feature -1. Positives weigh as much as all negatives together.
    """
    n_nodes = 2 ** (params.depth + 1) - 1
    shape = (params.rounds, n_nodes)
    feature, cut, value = np.full(shape, -1, np.int16), np.zeros(shape, np.uint8), np.zeros(shape)
    positives = int(y.sum())
    weight = np.where(y == 1, max((len(y) - positives) / max(positives, 1), 1.0), 1.0)
    rng = np.random.default_rng([params.seed, label])
    margin, width = np.zeros(len(y)), int(bins.max(initial=0)) + 1
    for tree in range(params.rounds):
        p = 0.5 * (1 + np.tanh(0.5 * margin))
        g, h = weight * (p - y), np.maximum(weight * p * (1 - p), 1e-16)
        rows = np.flatnonzero(rng.random(len(y)) < params.row_share) if params.row_share < 1 else np.arange(len(y))
        columns = np.arange(len(bins))
        if params.column_share < 1:
            columns = np.sort(rng.choice(len(bins), max(1, int(params.column_share * len(bins))), replace=False))
        at = np.zeros(len(rows), np.int64)  # node of each drawn row
        level = np.array([0])  # nodes that may still be split, with their histograms
        sums = _histogram(bins, columns, rows, at, 1, g, h, width)
        scratch = np.empty((2, 2, len(columns), width))
        for depth in range(1, params.depth + 1):
            best = [_split(sums[:, k], params, scratch) for k in range(len(level))] if width > 1 else []
            split = np.array([k for k, (_, _, gain) in enumerate(best) if gain > 1e-12], np.int64)
            if not len(split):
                break
            parents = level[split]
            feature[tree, parents], cut[tree, parents] = columns[[best[k][0] for k in split]], [best[k][1] for k in split]
            is_parent = np.zeros(n_nodes, bool)
            is_parent[parents] = True
            inner = np.flatnonzero(is_parent[at])
            parent = at[inner]
            goes_right = bins[feature[tree, parent], rows[inner]] > cut[tree, parent]
            at[inner] = 2 * parent + 1 + goes_right
            if depth == params.depth:
                break  # these children are leaves, which need no histogram
            # The child with fewer rows is counted, its sibling is the rest of the parent.
            count = np.bincount(at[inner], minlength=n_nodes)
            small = np.where(count[2 * parents + 1] <= count[2 * parents + 2], 2 * parents + 1, 2 * parents + 2)
            number = np.full(n_nodes, -1)
            number[small] = np.arange(len(small))
            counted = inner[number[at[inner]] >= 0]
            less = _histogram(bins, columns, rows[counted], number[at[counted]], len(small), g, h, width)
            level = np.concatenate((small, np.where(small % 2 == 1, small + 1, small - 1)))
            sums = np.concatenate((less, sums[:, split] - less), axis=1)
        # Rows are in leaves only, and only these are looked up.
        value[tree] = -np.bincount(at, g[rows], n_nodes) / (np.bincount(at, h[rows], n_nodes) + params.penalty)
        margin += params.step * value[tree, leaves(bins, feature[tree], cut[tree], params.depth)]
    return feature, cut, params.step * value


def leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """Leaf of one tree for every row."""
    at, row = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(depth):
        own = feature[at]
        at = np.where(own < 0, at, 2 * at + 1 + (bins[own, row] > cut[at]))
    return at


# ---------------------------------------------------------------- all labels

@dataclass(frozen=True)
class Trees:
    """Cut points of the features, and for each label its trees, or one probability if it never or always occurs."""

    cuts: list
    labels: dict
    depth: int

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.cuts)
        out = np.empty((len(values), len(self.labels)))
        for j in range(len(self.labels)):
            if isinstance(self.labels[j], float):
                out[:, j] = self.labels[j]
                continue
            margin = np.zeros(len(values))
            for feature, cut, value in zip(*self.labels[j]):
                margin += value[leaves(bins, feature, cut, self.depth)]
            out[:, j] = 0.5 * (1 + np.tanh(0.5 * margin))
        return out


def _values(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _pack_task(cuts: list):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, PACK_ROWS):
                own = batch.slice(low, PACK_ROWS)
                labels = _values(own.column("labels"), own.num_rows)
                bins = binned(_values(own.column("value"), own.num_rows), cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.num_rows], pa.int32()), pa.array([(labels.T != 0).astype(np.uint8).tobytes()]), pa.array([bins.tobytes()])],
                    names=["n_rows", "labels", "bins"])
    return task


def _grow_task(n_features: int, params: BoostParams):
    def task(key: tuple, table: pa.Table) -> pa.Table:
        label = key[0].as_py()
        parts = sorted(zip(table["bins"].to_pylist(), table["y"].to_pylist()))  # trees don't depend on the order of arrival
        bins = np.concatenate([np.frombuffer(b, np.uint8).reshape(n_features, -1) for b, _ in parts], axis=1)
        y = np.concatenate([np.frombuffer(p, np.uint8) for _, p in parts]).astype(float)
        del parts
        share = float(y.mean())
        grown = [b"", b"", b""] if share in (0.0, 1.0) else [x.tobytes() for x in grow(bins, y, params, label)]
        return pa.table({"label": pa.array([label], pa.int32()), "share": [share], **dict(zip(("feature", "cut", "value"), ([x] for x in grown)))})
    return task


def fit(train: DataFrame, n_labels: int, features_col: str = "features", params: BoostParams = BoostParams()) -> Trees:
    """Trees of each label on rows with `labels` and an array of numbers `features_col`."""
    ship_package(train.sparkSession)
    rows = stage(train.select(F.col("labels").cast("array<int>").alias("labels"), F.col(features_col).cast("array<double>").alias("value")), "boost-rows")
    mark = F.xxhash64("value", "labels")
    marks = rows.select(mark.alias("mark")).distinct().orderBy("mark").limit(params.sample_rows)
    last = marks.agg(F.max("mark")).head()[0]
    if last is None:
        raise ValueError("no training rows")
    sample = rows.withColumn("mark", mark).where(F.col("mark") <= last).dropDuplicates(["mark"]).orderBy("mark").select("value").toArrow()
    cuts = cut_points(_values(sample["value"].combine_chunks(), sample.num_rows), params.bins)
    packed = stage(rows.mapInArrow(_pack_task(cuts), "n_rows int, labels binary, bins binary"), "boost-bins")
    of_label = packed.select(F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1))).alias("label"), "n_rows", "labels", "bins").select(
        "label", "bins", F.substring("labels", F.col("label") * F.col("n_rows") + 1, F.col("n_rows")).alias("y"))
    # One range a label: by a hash, several labels would share a task.
    grown = of_label.repartitionByRange(n_labels, "label").groupBy("label").applyInArrow(
        _grow_task(len(cuts), params), "label int, share double, feature binary, cut binary, value binary").collect()
    found = {}
    for row in grown:
        shape = (params.rounds, -1)
        found[row["label"]] = row["share"] if not row["feature"] else (
            np.frombuffer(row["feature"], np.int16).reshape(shape), np.frombuffer(row["cut"], np.uint8).reshape(shape),
            np.frombuffer(row["value"], np.float64).reshape(shape))
    return Trees(cuts, found, params.depth)


def scores(test: DataFrame, trees: Trees, features_col: str, keep: list[str]) -> DataFrame:
    """`keep` and `scores`: the probability of each label."""
    ship_package(test.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = trees.probabilities(_values(batch.column("_values"), batch.num_rows)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in keep], pa.array(list(found), pa.list_(pa.float64()))], names=[*keep, "scores"])
    chosen = test.select(*keep, test[features_col].cast("array<double>").alias("_values"))
    schema = StructType([*[chosen.schema[name] for name in keep], StructField("scores", ArrayType(DoubleType()))])
    return chosen.mapInArrow(task, schema)
