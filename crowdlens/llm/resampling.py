"""Importance resampling towards a target corpus, with hashed word runs as features.

Runs of 1 to `longest_run` words (joined by one space) are features; a feature's bucket is the CRC-32 of its bytes modulo
`buckets`. A bucket's gain is the floored log ratio of its share in the target and in the documents, a document's weight the
floored mean of its features' gains. Weight plus Gumbel noise, derived from seed and id, is the score, and the highest scores
are drawn: a sample without replacement in proportion to exp(weight / 1000).

**Position-table CRC.** Without its initial value and final complement the CRC is linear: that of a span is the XOR of one
contribution per byte, which depends on the byte and its distance from the end. `_TABLE[distance][byte]` holds them for
distances below `REACH`; one `bitwise_xor.reduceat` over all bytes gives every span at once. Initial value and complement
become a constant for each length. A longer span is cut from its end into blocks of `REACH` bytes; each block's value is moved
past the bytes behind it (`advance`: 32 x 32 bit matrices for powers of two) and the blocks are combined by XOR as well.

* Two passes over the texts: counts (each task adds up one dense vector, at most `buckets` rows leave it), then weights. The
  driver gets `buckets` sums. Memory is bounded by `words.SLICE` bytes of text or by the longest text.
* The number drawn needs the score of the last one drawn. Scores are whole numbers within +-120,000 (logarithms of
  64-bit counts, and noise between -3,200 and 23,000), so their histogram has a bound. Only the rows from that score on are
  sorted, range-partitioned, and numbered by slice.

Odd cases: null and empty texts have no features, weight 0 and are never drawn (fewer than `least_words`), but return.
Documents without an id have the noise of an empty id and come last among equals; repeated rows all count and each may be drawn.
With an empty target or no documents every formula still holds, as all counts are smoothed by one. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.llm import frames, words
from crowdlens.operators.ordering import row_numbers
from crowdlens.session import stage

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Distances from the end that the table covers.
REACH = 64


@dataclass(frozen=True)
class Settings:
    longest_run: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10


# ---------------------------------------------------------------- CRC-32 of many spans

def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Contribution of every byte at every distance; images of the 32 bits under 1, 2, 4, ... zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), step >> np.uint32(1))
    table = np.empty((REACH, 256), np.uint32)
    table[0] = step
    for distance in range(1, REACH):
        last = table[distance - 1]
        table[distance] = (last >> np.uint32(8)) ^ step[last & np.uint32(255)]
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    moves = [(bits >> np.uint32(8)) ^ step[bits & np.uint32(255)]]
    while len(moves) < 48:
        moves.append(_moved(moves[-1], moves[-1]))
    return table, moves


def _moved(move: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), move[bit], np.uint32(0))
    return out


_TABLE, _MOVES = _tables()


def advance(values: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each value after so many zero bytes."""
    values = values.copy()
    for power in range(int(zeros.max(initial=0)).bit_length()):
        some = np.flatnonzero((zeros >> power) & 1)
        values[some] = _moved(_MOVES[power], values[some])
    return values


def _constants(lengths: np.ndarray) -> np.ndarray:
    """What initial value and complement add to a span of each length."""
    ones = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    return advance(ones, lengths) ^ ones


_CONSTANTS = _constants(np.arange(REACH + 1))


def _linear(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the contributions in spans of 1 to REACH bytes, `words.SLICE` bytes at a time."""
    out = np.empty(len(starts), np.uint32)
    total = np.concatenate(([0], np.cumsum(ends - starts)))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + words.SLICE, "right")) - 1)
        first = total[i:j] - total[i]
        count = int(total[j] - total[i])
        behind = np.repeat(first + (ends - starts)[i:j], np.diff(np.append(first, count))) - 1 - np.arange(count)
        at = np.repeat(ends[i:j], np.diff(np.append(first, count))) - 1 - behind
        out[i:j] = np.bitwise_xor.reduceat(_TABLE[behind, data[at]], first)
        i = j
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of data[start:end] for all spans, which may overlap but not be empty."""
    lengths = ends - starts
    out = np.empty(len(starts), np.uint32)
    short = np.flatnonzero(lengths <= REACH)
    out[short] = _linear(data, starts[short], ends[short]) ^ _CONSTANTS[lengths[short]]
    long = np.flatnonzero(lengths > REACH)
    if len(long):
        blocks = -(-lengths[long] // REACH)
        first = np.cumsum(blocks) - blocks
        behind = (np.arange(int(blocks.sum())) - np.repeat(first, blocks)) * REACH  # bytes between the block and the span's end
        to = np.repeat(ends[long], blocks) - behind
        parts = _linear(data, np.maximum(to - REACH, np.repeat(starts[long], blocks)), to)
        out[long] = np.bitwise_xor.reduceat(advance(parts, behind), first) ^ _constants(lengths[long])
    return out


# ---------------------------------------------------------------- features

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def features(texts: words.Texts, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run, repeats included."""
    data = _LOWER[texts.data]
    docs, found = [texts.doc], [crc32(data, texts.starts, texts.ends)]
    if settings.longest_run > 1 and len(texts.starts):
        # All words with one space between: a run is one span of it.
        lengths = texts.ends - texts.starts
        starts = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[np.repeat(starts, lengths) + within] = data[np.repeat(texts.starts, lengths) + within]
        for k in range(2, settings.longest_run + 1):
            at = np.flatnonzero(texts.doc[: -(k - 1)] == texts.doc[k - 1:])
            docs.append(texts.doc[at])
            found.append(crc32(joined, starts[at], starts[at + k - 1] + lengths[at + k - 1]))
    return np.concatenate(docs), (np.concatenate(found) % np.uint32(settings.buckets)).astype(np.int64)


def _count_task(settings: Settings):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(settings.buckets, np.int64)
        for batch in batches:
            for texts in words.slices(batch.column("text"), words.PLAIN):
                totals += np.bincount(features(texts, settings)[1], minlength=settings.buckets)
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], names=["bucket", "n"])
    return task


def counts(rows: DataFrame, settings: Settings) -> np.ndarray:
    """Features in each bucket over all texts."""
    parts = frames.map_rows(rows.select(F.col("text").cast("string").alias("text")), _count_task(settings), "bucket long, n long")
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(settings.buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the source)) of each bucket, in doubles."""
    of_source, of_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


# ---------------------------------------------------------------- weights, scores and the draw

def _weigh_task(gain: np.ndarray, settings: Settings):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sizes, n_words = [], [], []
            for texts in words.slices(batch.column("text"), words.PLAIN):
                doc, bucket = features(texts, settings)
                size = np.bincount(doc, minlength=len(texts))
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, doc, gain[bucket])
                sums.append(total // np.maximum(size, 1))
                sizes.append(size)
                n_words.append(texts.counts)
            parts = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (n_words, sizes, sums)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, parts)],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return task


def noise(id_: Column, settings: Settings) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document, and its rank in the draw (null if not drawn)."""
    gain = gains(counts(docs, settings), counts(target, settings))
    weighed = frames.map_rows(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        _weigh_task(gain, settings), "doc_id long, n_words long, n_features long, weight long")
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), settings)), "resampling-scores")
    long_enough = F.col("n_words") >= settings.least_words
    # As many rows as there are scores: see above for their bound.
    histogram = scored.where(long_enough).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    running = np.cumsum(histogram["n"].to_numpy())
    wanted = settings.percent * int(running[-1]) // 100 if len(running) else 0
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last = int(histogram["score"][int(np.searchsorted(running, wanted))].as_py())
    near = long_enough & (F.col("score") >= last)
    # The row's own number parts rows that are equal in all else, so that no slice has to hold all of them.
    top = scored.where(near).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("_row")]
    ranked = row_numbers(top, [], order, "rank").withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).drop("_row")
    return ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))
