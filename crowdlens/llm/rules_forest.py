"""Quality rules: statistics of each text, two fixed rules, and an isolation forest over the statistics.

An isolation forest cuts small samples of rows at random values until every row is alone; rows that are unlike the
others are alone after few cuts. The score of a row is 2 ** (-mean path length / path length expected by chance).
The forest is fitted on `trees` samples of `sample` rows (that is the method: it isolates within small samples), taken
by hash from all documents that pass the fixed rules. The threshold comes from ALL labelled rows: a histogram of
scores by label, and the lowest threshold that rejects at most `good_loss` of the good rows.

Odd cases: null and empty texts have only zeros, so the word minimum rejects them. Rows are judged one by one, repeated
rows alike. Without labelled good rows nothing is rejected by the forest. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.llm import frames, words
from crowdlens.session import stage

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: What the forest sees, all shares or logs, so that short and long texts can be compared. Of repeated lines, repeated
#: words and digits, which good texts have as well (a heading given twice, a number), only what exceeds a tolerance counts.
MEASURES = ("log_words", "word_length", "symbol_share", "dup_lines_share", "repeat_share", "distinct_share", "upper_share",
            "digit_share", "bar_share", "line_length")
SCHEMA = f"doc_id long, {STATISTICS}, base_failed boolean, measures array<float>"

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_LINES = np.ones(256, bool)
_LINES[0x0A] = False


@dataclass(frozen=True)
class Settings:
    min_words: int = 50
    max_repeat_share: float = 0.5
    trees: int = 100
    sample: int = 256
    good_loss: float = 0.002
    seed: int = 11


# ---------------------------------------------------------------- statistics

def statistics(texts: words.Texts) -> dict[str, np.ndarray]:
    """Exact counts for each text."""
    n, hashed, data = len(texts), texts.hashes(words.CASED), texts.data
    owner = np.repeat(np.arange(n), np.diff(texts.bounds))
    at, found = words.windows(hashed, texts.doc, 3)
    repeated = np.zeros(len(hashed), bool)
    if len(at):
        _, inverse, count = np.unique(words.owned(texts.doc[at], found), return_inverse=True, return_counts=True)
        hit = at[count[inverse] >= 2]
        for j in range(3):
            repeated[hit + j] = True
    lines = words.split(data, texts.bounds, _LINES)
    with_word = np.zeros(len(lines.starts), bool)
    if len(texts.starts):
        with_word[np.searchsorted(lines.starts, texts.starts, "right") - 1] = True
    line_hash = words.span_hashes(data, lines.starts, lines.ends, words.CASED)[with_word]
    line_doc = lines.doc[with_word]
    # A first line of its kind in its text is kept once by `unique`; all others equal an earlier one.
    kinds = line_doc[np.unique(words.owned(line_doc, line_hash), return_index=True)[1]]
    n_lines = np.bincount(line_doc, minlength=n)
    distinct = texts.doc[np.unique(words.owned(texts.doc, hashed), return_index=True)[1]]

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n)
    return {
        "n_words": texts.counts, "word_chars": texts.characters(), "n_symbols": per_text(_SYMBOLS[data]),
        "n_dup_lines": n_lines - np.bincount(kinds, minlength=n),
        "n_repeat_words": np.bincount(texts.doc[repeated], minlength=n),
        "_distinct": np.bincount(distinct, minlength=n), "_lines": n_lines,
        "_upper": per_text((data >= 0x41) & (data <= 0x5A)), "_digits": per_text((data >= 0x30) & (data <= 0x39)),
        "_bars": per_text(data == 0x7C),
    }


def measures(s: dict[str, np.ndarray]) -> np.ndarray:
    """One row of MEASURES for each text."""
    n, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["_lines"], 1)
    # Few different words are normal in long texts: compare with the square root law of vocabularies.
    distinct = s["_distinct"] / np.minimum(n, 12 * np.sqrt(n))

    def beyond(count: str, of: np.ndarray, tolerated: float) -> np.ndarray:
        return np.maximum(s[count] / of - tolerated, 0)
    return np.column_stack((
        np.log1p(s["n_words"]), chars / n, s["n_symbols"] / chars, beyond("n_dup_lines", lines, 0.3),
        beyond("n_repeat_words", n, 0.2), distinct, s["_upper"] / chars, beyond("_digits", chars, 0.15), s["_bars"] / n,
        np.log1p(n / lines))).astype(np.float32)


def measured(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, the statistics, `base_failed` and `measures` of every document."""
    names = [part.split()[0] for part in STATISTICS.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for texts in words.slices(batch.column("text"), words.SPACED):
                s = statistics(texts)
                failed = (s["n_words"] < settings.min_words) | (
                    s["n_repeat_words"] > settings.max_repeat_share * s["n_words"])
                m = measures(s)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(texts.first, len(texts)), *[pa.array(s[name], pa.int64()) for name in names], pa.array(failed),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())),
                ], names=["doc_id", *names, "base_failed", "measures"])
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return frames.map_rows(chosen, task, SCHEMA)


# ---------------------------------------------------------------- the forest

def chance_path(n: float) -> float:
    """Expected cuts until a row of n is found by chance (mean depth of a random search tree)."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in arrays, [tree, node]: node i has the children 2i + 1 and 2i + 2; measure -1 is a leaf."""

    measure: np.ndarray
    cut: np.ndarray
    length: np.ndarray  # path length at a leaf
    expected: float


def grow(rows: np.ndarray, settings: Settings) -> Forest:
    """A forest over `rows` in the order given: tree t gets the t-th run of `sample` rows, starting again at the end."""
    size = min(settings.sample, len(rows))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    nodes = 2 ** (depth + 1) - 1
    measure = np.full((settings.trees, nodes), -1, np.int8)
    cut, length = np.zeros((settings.trees, nodes), np.float32), np.zeros((settings.trees, nodes), np.float32)
    rng = np.random.default_rng(settings.seed)
    for tree in range(settings.trees):
        todo = [(0, 0, rows[(np.arange(size) + tree * size) % len(rows)])]
        while todo:
            node, level, part = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level == depth or len(part) <= 1 or not len(usable):
                length[tree, node] = level + chance_path(len(part))
                continue
            m = int(rng.choice(usable))
            value = np.float32(rng.uniform(low[m], high[m]))
            left = part[:, m] <= value
            if left.all() or not left.any():  # the cut fell on the end of the range
                value = low[m]
                left = part[:, m] <= value
            measure[tree, node], cut[tree, node] = m, value
            todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
    return Forest(measure, cut, length, chance_path(size) or 1.0)


def anomaly(rows: np.ndarray, forest: Forest) -> np.ndarray:
    """Score of each row, near 1 for rows isolated at once."""
    total, each = np.zeros(len(rows)), np.arange(len(rows))
    for measure, cut, length in zip(forest.measure, forest.cut, forest.length):
        node = np.zeros(len(rows), np.int64)
        while (inner := measure[node] >= 0).any():
            at = node[inner]
            right = rows[each[inner], measure[at]] > cut[at]
            node[inner] = 2 * at + 1 + right
        total += length[node]
    return 2 ** (-total / len(forest.measure) / forest.expected)


def fit(stats: DataFrame, settings: Settings = Settings()) -> Forest | None:
    """A forest over at most `trees` x `sample` different measures of documents that pass the fixed rules, those of the smallest
    hashes; None without any. Repeated documents count once, so that copies can't fill the sample."""
    passed = stats.where("NOT base_failed").select("measures")
    chosen = frames.bottom_rows(passed, ["measures"], settings.trees * settings.sample).orderBy(F.xxhash64("measures"), "measures")
    rows = chosen.toArrow()["measures"].combine_chunks()
    if not len(rows):
        return None
    return grow(rows.flatten().to_numpy().reshape(len(rows), -1), settings)


def with_scores(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """`stats` without the measures but with `anomaly` (0 for all if there is no forest)."""
    kept = [name for name in stats.columns if name != "measures"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("measures").flatten().to_numpy().reshape(batch.num_rows, -1)
            score = anomaly(rows, forest) if forest is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in kept], pa.array(score)],
                                             names=[*kept, "anomaly"])
    return frames.map_rows(stats, task, SCHEMA.replace("measures array<float>", "anomaly double"))


def threshold(scored: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> float:
    """Lowest threshold above which at most `good_loss` of the good labelled rows lie; infinity without good rows.

    Scores are counted in 10,000 bins, so that all labelled rows fit into a bounded histogram.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), "quality").where("quality = 1")
    bins = scored.where("NOT base_failed").join(frames.small_side(marks), F.col("doc_id") == F.col("_id")).groupBy(
        F.ceil(F.col("anomaly") * 10_000).alias("bin")).count().toArrow().sort_by("bin")
    if not bins.num_rows:
        return math.inf
    bin_, count = bins["bin"].to_numpy(), bins["count"].to_numpy()
    above = count[::-1].cumsum()[::-1] - count  # good rows in higher bins
    return float(bin_[np.flatnonzero(above <= settings.good_loss * count.sum())[0]]) / 10_000


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, statistics, base_failed, anomaly, kept: whether a document passes the fixed rules and the forest."""
    stats = stage(measured(docs, settings), "rule-statistics")
    scored = with_scores(stats, fit(stats, settings))
    limit = threshold(scored, labels, settings)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.lit(limit)))
