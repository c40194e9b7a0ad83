"""Packing by optimal length buckets.

The histogram of lengths covers all texts; dynamic programming over it chooses the bucket boundaries that minimise padding.
Inside a bucket texts form batches of at most `token_budget` tokens, every text padded to the bucket's boundary.

Every length has a bin of its own, whatever the table's size, and the histogram is the only thing that reaches the driver. k
different lengths take at least k (k - 1) / 2 tokens, so a table of 10^12 tokens has at most 1.5 million of them. Who sets `distinct`
bounds the histogram: beyond so many different lengths only those up to `exact` have a bin of their own; longer ones share bins whose
width is 1/64 of their size or less. A bin's boundary is its longest text, so every text fits its bucket whole and padding is exact;
with shared bins, texts and padding together are at most 1/64 more than the least possible.

Texts are numbered inside a bucket without gathering it: they are dealt over `parts` by a hash, numbered inside each
(bucket, part), and the sizes of the parts before add up. Parts grow with the number of texts, so none holds much more than
`part_rows`, also where one bucket has all rows.

Odd cases: null and empty texts have length 0 and cost nothing; a text longer than the budget forms a batch of its own
(`over_budget`). Repeated rows and ids are packed as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crowdlens.llm import frames
from crowdlens.session import stage


@dataclass(frozen=True)
class Settings:
    buckets: int = 16
    token_budget: int = 16_384
    exact: int = 2_048
    distinct: int | None = None  # None: boundaries are optimal for all lengths, else up to so many different ones
    part_rows: int = 50_000


def token_count(text: Column) -> Column:
    """Words of a text, the unit of length here."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def bin_of(length: Column, exact: int) -> Column:
    """Number of a length's bin, growing with the length."""
    # Above `exact` the width is a power of two: 1/64 to 1/32 of the length.
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)))) - 6).cast("long")
    return F.when(length <= exact, length).otherwise(F.ceil(length / F.greatest(width, F.lit(1))) * F.greatest(width, F.lit(1)))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Positions (in ascending `lengths`) of the last bin of each bucket, with the least padding at most `buckets` give.

    Costs count padding to a bucket's longest length: sum of count x boundary, as the texts' own tokens are the same for
    every choice. Of equally good choices the one with fewer buckets, then with earlier boundaries.
    """
    n = len(lengths)
    before = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    cost = np.full(n + 1, np.inf)  # least cost of the first i bins with the buckets so far
    cost[0] = 0.0
    cuts, results = [], []
    for _ in range(min(buckets, n)):
        cost, cut = _one_more(cost, before, lengths)
        cuts.append(cut)
        results.append(cost[n])
    chosen, i = [], n
    for cut in reversed(cuts[: int(np.argmin(results)) + 1]):
        chosen.append(i - 1)
        i = int(cut[i])
    return sorted(chosen)


def _one_more(cost: np.ndarray, before: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of the first i bins with one more bucket, and where it begins.

    The best beginning never falls as i grows, so the middle of a stretch halves the choices of both sides: n log n in all.
    All stretches of one depth are done at once, in pieces of bounded memory.
    """
    n = len(lengths)
    new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    left, right, low, high = (np.array([x]) for x in (1, n, 0, n - 1))
    while len(left):
        middle = (left + right) // 2
        top = np.minimum(high, middle - 1)
        sizes = top - low + 1
        ends = np.cumsum(sizes)
        at = 0
        while at < len(middle):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + (1 << 20), "right")))
            width, first = sizes[at:to], ends[at:to] - sizes[at:to]
            first = first - first[0]
            j = np.arange(int(width.sum())) - np.repeat(first, width) + np.repeat(low[at:to], width)
            i = np.repeat(middle[at:to], width)
            options = cost[j] + lengths[i - 1] * (before[i] - before[j])
            least = np.minimum.reduceat(options, first)
            hits = np.flatnonzero(options == np.repeat(least, width))
            chosen = j[hits[np.searchsorted(hits, first)]]  # the first of equals
            new[middle[at:to]], cut[middle[at:to]] = least, chosen
            at = to
        best = cut[middle]
        left, right = np.concatenate((left, middle + 1)), np.concatenate((middle - 1, right))
        low, high = np.concatenate((low, best)), np.concatenate((best, high))
        keep = left <= right
        left, right, low, high = left[keep], right[keep], low[keep], high[keep]
    return new, cut


def plan(lengths: DataFrame, settings: Settings = Settings()) -> list[int]:
    """Ascending bucket boundaries for a table with a column `n_tokens`; empty for an empty table."""
    exact = lengths.groupBy("n_tokens").agg(F.count("*").alias("n"))
    bins = exact.select(F.col("n_tokens").alias("top"), "n")
    bins = (bins if settings.distinct is None else bins.limit(settings.distinct + 1)).toArrow()
    if settings.distinct is not None and bins.num_rows > settings.distinct:
        bins = exact.groupBy(bin_of(F.col("n_tokens"), settings.exact).alias("bin")).agg(
            F.max("n_tokens").alias("top"), F.sum("n").alias("n")).toArrow()
    bins = bins.sort_by("top")
    if not bins.num_rows:
        return []
    top, n = bins["top"].to_numpy(), bins["n"].to_numpy()
    return [int(top[i]) for i in boundaries(top, n, settings.buckets)]


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch (number in the bucket), slot (place in the batch), padding and
    over_budget of every text."""
    measured = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text")).alias("n_tokens"),
                                 F.xxhash64(F.col("text").cast("string")).alias("mark")), "packing-lengths")
    edges = plan(measured, settings)
    if not edges:
        edges = [0]
    parts = max(1, -(-measured.count() // settings.part_rows))
    bounds = F.array(*[F.lit(edge).cast("long") for edge in edges])
    bucket = F.size(F.filter(bounds, lambda edge: edge < F.col("n_tokens")))
    dealt = measured.withColumn("bucket", bucket).withColumn("part", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(parts)))
    order = W.partitionBy("bucket", "part").orderBy(F.col("doc_id").asc_nulls_first(), "mark")
    numbered = stage(dealt.withColumn("number", F.row_number().over(order) - 1), "packing-numbers")
    # One row for each bucket and part: `buckets` windows of at most `parts` rows.
    earlier = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = numbered.groupBy("bucket", "part").agg(F.count("*").alias("n")).select(
        "bucket", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    length = F.get(bounds, F.col("bucket"))
    capacity = F.greatest(F.floor(F.lit(settings.token_budget) / F.greatest(length, F.lit(1))), F.lit(1))
    place = F.col("offset") + F.col("number")
    return numbered.join(frames.small_side(offsets, 200_000), ["bucket", "part"]).select(
        "doc_id", "n_tokens", "bucket", length.alias("bucket_length"), F.floor(place / capacity).alias("batch"),
        (place % capacity).alias("slot"), (length - F.col("n_tokens")).alias("padding"),
        (F.col("n_tokens") > settings.token_budget).alias("over_budget"))


def batches(packed: DataFrame) -> DataFrame:
    """bucket, batch, bucket_length, doc_ids in order of their slots, and tokens with and without padding."""
    rows = packed.groupBy("bucket", "batch", "bucket_length").agg(
        F.array_sort(F.collect_list(F.struct("slot", "doc_id"))).alias("rows"), F.sum("n_tokens").alias("n_tokens"))
    return rows.select("bucket", "batch", "bucket_length", F.transform("rows", lambda r: r["doc_id"]).alias("doc_ids"),
                       "n_tokens", (F.size("rows") * F.col("bucket_length")).alias("padded_tokens"))
