"""Logistic regression of all labels at once: one pass over the training rows gives every label's loss and gradient.

The labels are separate convex problems, so each has its own limited-memory quasi-Newton steps and its own step length; they only
share the passes. A label that has converged takes no further part. Features are scaled by their curvature at zero, which
a first pass finds, so that frequent and rare terms need equally long steps. Fits on the first k features, for several k, are
further such problems and share the passes as well.

The driver holds the coefficients with `MEMORY` pairs of earlier steps: wide problems are fitted in groups of at
most `NUMBERS` coefficients together. Training rows never come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from crowdlens.operators.blocks import Block, total
from crowdlens.session import ship_package

MEMORY = 8
NUMBERS = 4_000_000
#: Intercept of a label that every training row has, or (negative) none.
CERTAIN = 1e3


@dataclass(frozen=True)
class LinearFit:
    """coefficients: features x labels."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    passes: int = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _moments(width: int, size: int):
    """Sums of squares per feature, positives per label, rows."""
    def sums(blocks: Iterator[Block]) -> np.ndarray:
        squares, positives, rows = np.zeros(width), np.zeros(size), 0
        for block in blocks:
            block.squares(squares)
            positives += (block.labels != 0).sum(axis=0)
            rows += len(block.labels)
        return np.concatenate((squares, positives, [rows]))
    return sums


def _losses(points: dict[int, tuple[list[int], np.ndarray]]):
    """By width, widest first: labels and their weights (the last row: intercepts). Sums the losses, then the gradients, of each width."""
    def sums(blocks: Iterator[Block]) -> np.ndarray:
        # A label's numbers lie side by side: blocks gather and scatter them one label after another.
        found = {width: (np.zeros(len(labels)), np.zeros(weights.shape, order="F")) for width, (labels, weights) in points.items()}
        for block in blocks:
            for width, (labels, weights) in points.items():
                block = block.first_columns(width)
                loss, gradient = found[width]
                y = (block.labels[:, labels] != 0).astype(float)
                margin = block.times(weights[:-1]) + weights[-1]
                loss += (np.logaddexp(0.0, margin) - y * margin).sum(axis=0)
                rest = _sigmoid(margin) - y
                block.transposed_times(rest, gradient[:-1])
                gradient[-1] += rest.sum(axis=0)
        return np.concatenate([part.ravel("F") for pair in found.values() for part in pair])
    return sums


@dataclass
class _Search:
    """Quasi-Newton steps of one label, told loss and gradient of one trial point after another."""

    at: np.ndarray
    loss: float
    gradient: np.ndarray
    tolerance: float
    pairs: list = field(default_factory=list)
    small: int = 0
    done: bool = False

    def __post_init__(self):
        self.first = float(np.abs(self.gradient).max())
        self._aim()

    def _aim(self) -> None:
        direction = -self.gradient
        undo = []
        for s, y, rho in reversed(self.pairs):
            a = rho * float(s @ direction)
            direction = direction - a * y
            undo.append(a)
        if self.pairs:
            s, y, rho = self.pairs[-1]
            direction = direction / (rho * float(y @ y))
        for (s, y, rho), a in zip(self.pairs, reversed(undo)):
            direction = direction + (a - rho * float(y @ direction)) * s
        self.direction, self.slope = direction, float(self.gradient @ direction)
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(float(np.abs(self.gradient).sum()), 1e-12))
        self.done = self.done or self.slope >= 0 or np.abs(self.gradient).max() <= self.tolerance * max(self.first, 1e-12)

    def trial(self) -> np.ndarray:
        return self.at + self.step * self.direction

    def told(self, loss: float, gradient: np.ndarray) -> None:
        if not loss <= self.loss + 1e-4 * self.step * self.slope:
            # Shorten to where a parabola through both losses is lowest.
            bend = 2 * (loss - self.loss - self.step * self.slope)
            self.step *= min(max(-self.step * self.slope / bend, 0.1), 0.5) if np.isfinite(bend) and bend > 0 else 0.1
            self.done = self.step < 1e-10
            return
        s, y = self.step * self.direction, gradient - self.gradient
        if float(s @ y) > 1e-300:
            self.pairs = [*self.pairs, (s, y, 1.0 / float(s @ y))][-MEMORY:]
        gained = (self.loss - loss) / max(abs(loss), 1e-12)
        self.small = self.small + 1 if gained < self.tolerance * 1e-3 else 0
        self.at, self.loss, self.gradient = self.trial(), loss, gradient
        self.done = self.small >= 3
        self._aim()


def fit(blocks: DataFrame, width: int, size: int, c: float = 4.0, max_iter: int = 400, tolerance: float = 1e-5) -> LinearFit:
    """Coefficients of `size` labels on packed rows of `width` features.

    The penalty on the coefficients, not the intercept, is 1 / (2 c) of their squares beside the summed loss. A label that never
    or always occurs has no coefficients and a certain intercept. At most `max_iter` passes for a group of labels.
    """
    return fit_widths(blocks, [width], size, c, max_iter, tolerance)[width]


def _groups(problems: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Problems (width, label) in their order, as many together as have NUMBERS coefficients, at least one."""
    group, numbers = [], 0
    for problem in problems:
        if group and numbers + problem[0] + 1 > NUMBERS:
            yield group
            group, numbers = [], 0
        group.append(problem)
        numbers += problem[0] + 1
    if group:
        yield group


def fit_widths(
    blocks: DataFrame, widths: Sequence[int], size: int, c: float = 4.0, max_iter: int = 400, tolerance: float = 1e-5,
) -> dict[int, LinearFit]:
    """`fit` on the first k of the packed features for each k of `widths`, in passes that all widths and labels share."""
    ship_package(blocks.sparkSession)
    widths = sorted(set(widths), reverse=True)
    widest = widths[0]
    tasks = blocks.rdd.getNumPartitions()
    moments = total(blocks, _moments(widest, size), widest + size + 1, tasks=tasks)
    squares, positives, rows = moments[:widest], moments[widest:-1], moments[-1]
    found = {width: LinearFit(np.zeros((width, size)), np.where(positives > 0, CERTAIN, -CERTAIN)) for width in widths}
    usable = [j for j in range(size) if 0 < positives[j] < rows]
    penalty = 1.0 / (c * max(rows, 1.0))
    scale = 1.0 / np.sqrt(np.append(0.25 * squares / max(rows, 1.0) + penalty, 0.25))
    scales = {width: np.append(scale[:width], scale[-1]) for width in widths}
    passes = 0
    for group in _groups([(width, j) for width in widths for j in usable]):
        def evaluated(trials: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
            points = {}
            for width in dict.fromkeys(width for width, _ in trials):
                labels = [j for k, j in trials if k == width]
                points[width] = labels, np.array([scales[width] * trials[width, j] for j in labels]).T
            sums = total(blocks, _losses(points), sum(len(trial) + 1 for trial in trials.values()), tasks=tasks) / rows
            out, low = {}, 0
            for width, (labels, weights) in points.items():
                middle, high = low + len(labels), low + len(labels) + weights.size
                gradient = sums[middle:high].reshape(weights.shape, order="F")
                gradient[:-1] += penalty * weights[:-1]
                loss = sums[low:middle] + 0.5 * penalty * (weights[:-1] ** 2).sum(axis=0)
                out |= {(width, j): (float(loss[i]), scales[width] * gradient[:, i]) for i, j in enumerate(labels)}
                low = high
            return out

        start = {}
        for width, j in group:
            share = positives[j] / rows
            start[width, j] = np.zeros(width + 1)
            start[width, j][-1] = np.log(share / (1 - share)) / scale[-1]
        searches = {problem: _Search(start[problem], *told, tolerance) for problem, told in evaluated(start).items()}
        for _ in range(max_iter):
            active = {problem: search for problem, search in searches.items() if not search.done}
            if not active:
                break
            passes += 1
            for problem, told in evaluated({problem: search.trial() for problem, search in active.items()}).items():
                active[problem].told(*told)
        for (width, j), search in searches.items():
            weights = scales[width] * search.at
            found[width].coefficients[:, j], found[width].intercepts[j] = weights[:-1], weights[-1]
    return {width: replace(fitted, passes=passes) for width, fitted in found.items()}


def dense_scores(test: DataFrame, features_col: str, fitted: LinearFit, keep: list[str]) -> DataFrame:
    """`keep` and `scores` of rows whose features are arrays as long as the coefficients."""
    ship_package(test.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("_values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scores = _sigmoid(values @ fitted.coefficients + fitted.intercepts) if batch.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in keep], pa.array(list(scores), pa.list_(pa.float64()))], names=[*keep, "scores"])
    chosen = test.select(*keep, test[features_col].cast("array<double>").alias("_values"))
    schema = StructType([*[chosen.schema[name] for name in keep], StructField("scores", ArrayType(DoubleType()))])
    return chosen.mapInArrow(task, schema)
