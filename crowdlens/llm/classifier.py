"""Quality classifier: naive Bayes log-count ratios as feature scales, a linear hinge-loss model on top.

Features are indicators of hashed n-grams: single words, pairs of words, and runs of three word shapes (which
kinds of characters a word has, its length class, whether it repeats the word before it). Each indicator is
multiplied by the log ratio of its counts in good and bad documents; the scaled vector has length 1. The linear
model is fitted by dual coordinate descent, its margins become probabilities by a logistic curve fitted on
documents that the model has not seen.

* Counts cover ALL labelled learning rows (`counts`): each task adds up dense vectors of `buckets` numbers, so that
  what is shuffled has a bound per task, and what reaches the driver has a bound altogether (2 x `buckets`).
* The linear model is fitted in one task on at most `train_rows` different learning rows of at most `train_bytes` together (the
  documented bounds), those of the smallest hashes of text and label in each class. A row that is repeated counts in the ratios
  as often as it occurs, but once in this fit. Each class has its share of the rows, and a twentieth at least.
* Every whole text is scored; the weights (`buckets` floats) travel with the task.

Odd cases: null and empty texts have no features and get the probability of margin 0 plus the intercept. Null labels
and labels of unknown documents teach nothing. Several labels of one document all count. With no learning row of one
class the score is the share of good rows for every document (0.5 without any row). Extra columns are passed through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from crowdlens.llm import frames, words
from crowdlens.session import stage


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    train_rows: int = 16_000
    train_bytes: int = 128 << 20
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 12


@dataclass(frozen=True)
class Model:
    """weights[bucket] already holds scale x coefficient; probability = 1 / (1 + exp(-(slope * margin + offset)))."""

    scales: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


# ---------------------------------------------------------------- features

def _classes() -> np.ndarray:
    """For each byte a bit: lower-case or any non-ASCII letter, upper case, digit, sentence mark, other symbol."""
    out = np.full(256, 16, np.uint8)
    out[0x61:0x7B], out[0x80:], out[0x41:0x5B], out[0x30:0x3A] = 1, 1, 2, 4
    out[[ord(c) for c in ".,;:'\"-"]] = 8
    return out


_CLASSES = _classes()


def _shapes(texts: words.Texts, hashed: np.ndarray) -> np.ndarray:
    if not len(hashed):
        return hashed
    edges = np.column_stack((texts.starts, texts.ends)).ravel()
    kinds = np.bitwise_or.reduceat(np.append(_CLASSES[texts.data], np.uint8(0)), edges)[::2]
    last = _CLASSES[texts.data[texts.ends - 1]]
    length = np.minimum(np.log2(texts.ends - texts.starts).astype(np.uint64), 6)
    same = np.zeros(len(hashed), np.uint64)
    same[1:] = (hashed[1:] == hashed[:-1]) & (texts.doc[1:] == texts.doc[:-1])
    return words.mix(kinds.astype(np.uint64) << np.uint64(16) | last.astype(np.uint64) << np.uint64(8)
                     | length << np.uint64(1) | same)


def features(texts: words.Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every distinct indicator, sorted."""
    hashed = texts.hashes(words.CASED)
    shaped = _shapes(texts, hashed)
    docs, found = [texts.doc], [hashed]
    for base, k, seed in ((hashed, 2, 1), (shaped, 1, 2), (shaped, 2, 3), (shaped, 3, 4)):
        at, value = words.windows(base, texts.doc, k)
        docs.append(texts.doc[at])
        found.append(words.mix(value + np.uint64(seed)))
    key = np.concatenate(docs).astype(np.int64) * buckets + (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)
    key = np.unique(key)
    return key // buckets, key % buckets


# ---------------------------------------------------------------- counts over all learning rows

def _count_task(buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, rows = np.zeros((2, buckets), np.int64), [0, 0]
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for texts in words.slices(batch.column("text"), words.SPACED):
                doc, bucket = features(texts, buckets)
                y = label[texts.first: texts.first + len(texts)]
                for c in (0, 1):
                    totals[c] += np.bincount(bucket[y[doc] == c], minlength=buckets)
                    rows[c] += int((y == c).sum())
        some = np.flatnonzero(totals.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(totals[0][some], rows[0])),
             pa.array(np.append(totals[1][some], rows[1]))], names=["bucket", "bad", "good"])
    return task


def log_ratios(learn: DataFrame, settings: Settings) -> tuple[np.ndarray, int, int]:
    """Log-count ratio of each bucket over all rows (text, label), and how many rows each class has."""
    parts = frames.map_rows(learn.select("text", "label"), _count_task(settings.buckets), "bucket long, bad long, good long")
    sums = parts.groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    bucket = sums["bucket"].to_numpy()
    counts = np.zeros((2, settings.buckets + 1))
    counts[0][bucket], counts[1][bucket] = sums["bad"].to_numpy(), sums["good"].to_numpy()  # -1: the number of rows
    bad, good = counts[0][:-1] + settings.smoothing, counts[1][:-1] + settings.smoothing
    ratios = np.log(good / good.sum()) - np.log(bad / bad.sum())
    return ratios.astype(np.float32), int(counts[0][-1]), int(counts[1][-1])


# ---------------------------------------------------------------- the linear model

@dataclass
class Sparse:
    """Rows of a sparse matrix in three arrays: row i has `value` at `column` in bounds[i]:bounds[i + 1]."""

    bounds: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.bounds[i], self.bounds[i + 1])
        return self.column[own], self.value[own]


def dual_coordinate_descent(x: Sparse, y: np.ndarray, cost: np.ndarray, width: int, epochs: int,
                            chosen: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
    """Weights of a hinge-loss model, the last one for a constant feature of 1; one dual variable for each chosen row (all
    by default) in the box [0, cost of the row]."""
    chosen = np.arange(len(y)) if chosen is None else chosen
    weights, alpha = np.zeros(width + 1), np.zeros(len(y))
    norms = {i: float(np.dot(x.row(i)[1], x.row(i)[1])) + 1.0 for i in chosen.tolist()}
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(chosen).tolist():
            column, value = x.row(i)
            gradient = y[i] * (float(weights[column] @ value) + weights[-1]) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[column] += step * value
                weights[-1] += step
                most = max(most, abs(step) * norms[i])
                alpha[i] = new
        if most < 1e-3:
            break
    return weights


def logistic_curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Newton steps on the smoothed targets)."""
    good, bad = int(label.sum()), int((1 - label).sum())
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack((margin, np.ones(len(margin))))
    beta = np.array([0.0, math.log((good + 1) / (bad + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _fit_task(scales: np.ndarray, settings: Settings):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, sizes, labels = [], [], []
        for batch in batches:
            labels.append(np.asarray(batch.column("label")))
            for texts in words.slices(batch.column("text"), words.SPACED):
                doc, bucket = features(texts, settings.buckets)
                columns.append(bucket.astype(np.int32))
                sizes.append(np.bincount(doc, minlength=len(texts)))
        if not labels:
            return
        label, size = np.concatenate(labels), np.concatenate(sizes)
        x = Sparse(np.concatenate(([0], np.cumsum(size))), np.concatenate(columns), np.zeros(0, np.float32))
        columns.clear()
        x.value = scales[x.column]
        lengths = np.sqrt(np.add.reduceat(np.append(x.value, np.float32(0)) ** 2, x.bounds[:-1]) * (size > 0))
        x.value /= np.repeat(np.where(lengths > 0, lengths, 1), size).astype(np.float32)
        y = np.where(label == 1, 1.0, -1.0)
        share = np.array([(label == c).mean() for c in (0, 1)])
        cost = settings.cost * 0.5 / np.maximum(share[label.astype(int)], 1e-9)  # both classes weigh the same
        order = np.arange(len(y))
        unseen = order % 4 == 0
        slope, offset = 4.0, 0.0
        if unseen.sum() >= 8 and len(set(label[~unseen])) == 2:
            part = dual_coordinate_descent(x, y, cost, settings.buckets, settings.epochs, order[~unseen])
            margins = [float(part[c] @ v) + part[-1] for c, v in map(x.row, order[unseen].tolist())]
            slope, offset = logistic_curve(np.array(margins), label[unseen])
        weights = dual_coordinate_descent(x, y, cost, settings.buckets, settings.epochs)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((used, [-1, -2]))), pa.array(np.concatenate((weights[used], [slope, offset])))],
            names=["at", "value"])
    return task


def learning_rows(docs: DataFrame, labels: DataFrame, learn: str = "true") -> DataFrame:
    """(id, text, label) of labelled documents that satisfy the SQL condition `learn` on `doc_id`."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label")).where(
        "label IN (0, 1)").withColumnRenamed("_id", "doc_id")
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(learn)
    return chosen.join(frames.small_side(marks.where(learn)), "doc_id")


def _sample(rows: DataFrame, bad: int, good: int, settings: Settings) -> DataFrame:
    """Two passes: hashes and sizes of the different rows, of which each class has its smallest; then the chosen rows."""
    marked = rows.select("text", "label", F.xxhash64("text", "label").alias("_mark"))
    sizes = stage(marked.groupBy("label", "_mark").agg(F.max(F.octet_length("text")).cast("long").alias("_size")), "learning-rows")
    chosen = F.lit(False)
    for label, n in ((0, bad), (1, good)):
        share = max(n / (bad + good), 0.05)
        last = frames.last_mark(sizes.where(F.col("label") == label), math.ceil(share * settings.train_rows), int(share * settings.train_bytes))
        if last is not None:
            chosen = chosen | ((F.col("label") == label) & (F.col("_mark") <= F.lit(last)))
    return marked.where(chosen).dropDuplicates(["label", "_mark"]).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, learn: str = "true", settings: Settings = Settings()) -> Model:
    learn_rows = learning_rows(docs, labels, learn)
    scales, bad, good = log_ratios(learn_rows, settings)
    blank = np.zeros(settings.buckets, np.float32)
    if not bad or not good:
        share = good / (good + bad) if good + bad else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(scales, blank, 0.0, 0.0, math.log(share / (1 - share)))
    sample = _sample(learn_rows, bad, good, settings)
    found = frames.map_rows(sample.repartition(1), _fit_task(scales, settings), "at long, value double").toArrow()
    at, value = found["at"].to_numpy(), found["value"].to_numpy()
    weights = np.zeros(settings.buckets + 1)
    weights[at[at >= 0]] = value[at >= 0]
    return Model(scales, weights[:-1].astype(np.float32), float(weights[-1]),
                 float(value[at == -1][0]), float(value[at == -2][0]))


# ---------------------------------------------------------------- scores

def probabilities(texts: words.Texts, model: Model) -> np.ndarray:
    doc, bucket = features(texts, len(model.scales))
    scale = model.scales[bucket].astype(np.float64)
    dot = np.bincount(doc, scale * model.weights[bucket], len(texts))
    norm = np.sqrt(np.bincount(doc, scale * scale, len(texts)))
    margin = dot / np.where(norm > 0, norm, 1.0) + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -30, 30)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of every document as a struct `row`, and its probability of good quality."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [probabilities(texts, model) for texts in words.slices(frames.text_of(batch), words.SPACED)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.concatenate(got) if got else np.zeros(0))], names=["row", "score"])
    rows = frames.packed(docs, keep)
    return frames.map_rows(rows, task, StructType([frames.row_field(rows), StructField("score", DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, learn: str = "true", threshold: float = 0.3,
          settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """`score` by a model learned from the labels, and `predicted` (1 if score >= threshold, else 0)."""
    scored = score(docs, fit(docs, labels, learn, settings), keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
