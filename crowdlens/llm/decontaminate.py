"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with document words.

An item's windows are its runs of `width` words (or all its words, if fewer). A window is the set of its `shingle`-word
shingles with their offsets; a document that contains the window contains all of them, so any single one is a
necessary prefix, and the rarest is the best: shingles are ordered by the number of documents that have them, counted
over the whole corpus. Document shingles meet the prefixes; a match fixes where the window would start, which must lie
inside the document with room for the whole window (positional and length bound); then all its words are compared.

The windows of a benchmark are kept in blocks of at most `block` rows, each small enough to travel with a task. One
block is one pass over the documents, without any shuffle of texts; further blocks are further passes that add to what
was found. No key gathers rows, so frequent passages cost only their own comparisons.

Odd cases: null and empty documents and items have no words and no hits. An item without an id hits words, but isn't
counted or listed. Items repeated under one id count once. Repeated documents are judged alike. Words meet by 64-bit hashes,
and what meets is compared byte by byte. An empty benchmark hits nothing. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from crowdlens.llm import frames, words
from crowdlens.session import stage


@dataclass(frozen=True)
class Settings:
    width: int = 13
    shingle: int = 5
    block: int = 300_000
    one_in: int = 20  # contaminated if at least one word in so many is hit


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def window_rows(benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(item, window): the item id as text and each distinct window of each item, its words in lower case with one space between."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item")
            for texts in words.slices(batch.column("text"), words.PLAIN):
                data = _LOWER[texts.data]
                owner, found = [], []
                for d, (first, n) in enumerate(zip(texts.first_word, texts.counts)):
                    own = [data[a:b].tobytes() for a, b in zip(texts.starts[first: first + n], texts.ends[first: first + n])]
                    size = min(n, settings.width)
                    runs = {b" ".join(own[i: i + size]) for i in range(n - size + 1)} if size else ()
                    owner += [texts.first + d] * len(runs)
                    found += sorted(runs)
                yield pa.RecordBatch.from_arrays(
                    [items.take(pa.array(owner, pa.int64())), pa.array(found, pa.binary()).cast(pa.string())], names=["item", "window"])
    chosen = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return frames.map_rows(chosen, task, "item string, window string").distinct()


@dataclass
class Block:
    """Some windows with the bytes and hashes of their words, and their shingles."""

    items: list[str | None]
    size: np.ndarray  # words in each window
    runs: np.ndarray  # hash of each word [window, width], padded with 0
    data: np.ndarray  # bytes of all windows
    starts: np.ndarray  # of each word in data [window, width]
    lengths: np.ndarray
    shingle_size: np.ndarray
    shingle: list[np.ndarray]  # of each window, by offset

    @staticmethod
    def of(items: list[str | None], windows: pa.Array, settings: Settings) -> Block:
        parts = list(words.slices(windows, words.PLAIN, 1 << 62))
        texts = parts[0] if parts else words.split(np.zeros(0, np.uint8), np.zeros(1, np.int64), words.PLAIN)
        size = texts.counts
        place = np.arange(len(texts.starts)) - texts.first_word[texts.doc]
        runs = np.zeros((len(size), settings.width), np.uint64)
        starts, lengths = np.zeros(runs.shape, np.int64), np.zeros(runs.shape, np.int32)
        runs[texts.doc, place] = texts.hashes(words.LOWERED)
        starts[texts.doc, place], lengths[texts.doc, place] = texts.starts, texts.ends - texts.starts
        shingle_size = np.minimum(size, settings.shingle)
        shingle: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(size)
        for n in np.unique(size):
            rows, k = np.flatnonzero(size == n), min(int(n), settings.shingle)
            by_offset = []
            for offset in range(n - k + 1):
                total = np.full(len(rows), k, np.uint64)
                for j in range(k):
                    total += runs[rows, offset + j] * words._STEPS[j]
                by_offset.append(words.mix(total))
            for i, row in zip(rows, np.stack(by_offset, axis=1)):
                shingle[i] = row
        return Block(items, size, runs, texts.data, starts, lengths, shingle_size, shingle)

    def equal(self, texts: words.Texts, start: np.ndarray, window: np.ndarray, size: int) -> np.ndarray:
        """Whether the `size` words from `start` on are those of each window, byte by byte."""
        word = start[:, None] + np.arange(size)
        at, length = texts.starts[word], (texts.ends - texts.starts)[word]
        same = (length == self.lengths[window, :size]).all(axis=1)
        chosen = np.flatnonzero(same)
        for low in range(0, len(chosen), 4096):
            rows = chosen[low: low + 4096]
            n = length[rows].ravel()
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            ours = _LOWER[texts.data[np.repeat(at[rows].ravel(), n) + within]]
            theirs = self.data[np.repeat(self.starts[window[rows], :size].ravel(), n) + within]
            wrong = np.add.reduceat((ours != theirs).astype(np.int64), np.cumsum(length[rows].sum(axis=1)) - length[rows].sum(axis=1))
            same[rows[wrong > 0]] = False
        return same

    def keys(self) -> list[tuple[int, np.ndarray]]:
        """For each shingle size its distinct hashes, sorted."""
        return [(int(k), np.unique(np.concatenate([self.shingle[i] for i in np.flatnonzero(self.shingle_size == k)])))
                for k in np.unique(self.shingle_size)]


class Lookup:
    """Positions of known hashes among many: a bit table answers nearly all misses, a sorted search the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(12, int(np.ceil(np.log2(max(len(keys), 1) * 32))))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self._slot(keys)] = True

    def _slot(self, values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in `values`, position in `keys`) of every value that is a key."""
        maybe = np.flatnonzero(self.table[self._slot(values)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, values[maybe]), len(self.keys) - 1)
        good = self.keys[at] == values[maybe]
        return maybe[good], at[good]


def document_frequencies(docs: DataFrame, block: Block) -> dict[int, np.ndarray]:
    """In how many documents each shingle of the block occurs, over all documents (a text counts once per batch row)."""
    keys = block.keys()
    starts = np.cumsum([0] + [len(values) for _, values in keys])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = [(k, Lookup(values)) for k, values in keys]
        total = np.zeros(starts[-1], np.int64)
        for batch in batches:
            for texts in words.slices(batch.column("text"), words.PLAIN):
                hashed = texts.hashes(words.LOWERED)
                for (k, lookup), start in zip(lookups, starts):
                    at, value = words.windows(hashed, texts.doc, k)
                    place, key = lookup.find(value)
                    pairs = np.unique(texts.doc[at[place]] * np.int64(max(len(lookup.keys), 1)) + key)
                    total += np.bincount(start + pairs % max(len(lookup.keys), 1), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "n"])
    chosen = docs.select(F.col("text").cast("string").alias("text"))
    found = frames.map_rows(chosen, task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(starts[-1], np.int64)
    count[found["key"].to_numpy()] = found["n"].to_numpy()
    return {k: count[a:b] for (k, _), a, b in zip(keys, starts, starts[1:])}


@dataclass
class Index:
    """Rarest shingle of each window, grouped for lookup: windows order[first[key]:first[key + 1]] hang on a key."""

    block: Block
    lookups: list[tuple[int, Lookup, np.ndarray, np.ndarray, np.ndarray]]  # size, keys, first, windows, offsets

    @staticmethod
    def of(block: Block, frequency: dict[int, np.ndarray]) -> Index:
        out = []
        for k, keys in block.keys():
            own = np.flatnonzero(block.shingle_size == k)
            best, offset = np.zeros(len(own), np.uint64), np.zeros(len(own), np.int64)
            for n, i in enumerate(own):
                offset[n] = int(np.argmin(frequency[k][np.searchsorted(keys, block.shingle[i])]))
                best[n] = block.shingle[i][offset[n]]
            order = np.argsort(best, kind="stable")
            prefix, count = np.unique(best, return_counts=True)
            out.append((k, Lookup(prefix), np.concatenate(([0], np.cumsum(count))), own[order], offset[order]))
        return Index(block, out)

    def occurrences(self, texts: words.Texts, hashed: np.ndarray, chunk: int = 1 << 18) -> Iterator[tuple]:
        """(first word, window) of every occurrence of a window in the texts."""
        begin = texts.first_word
        end = begin + texts.counts
        for k, lookup, first, window, offset in self.lookups:
            at, value = words.windows(hashed, texts.doc, k)
            place, key = lookup.find(value)
            each = first[key + 1] - first[key]
            ends = np.cumsum(each)
            i = 0
            while i < len(place):  # so many matches that their windows fit into a chunk
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chunk, "right")))
                n = each[i:j]
                position = np.repeat(at[place[i:j]], n)
                slot = np.repeat(first[key[i:j]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w, start = window[slot], position - offset[slot]
                doc = texts.doc[position]
                fits = (start >= begin[doc]) & (start + self.block.size[w] <= end[doc])
                w, start = w[fits], start[fits]
                for size in np.unique(self.block.size[w]):
                    own = self.block.size[w] == size
                    same = np.all(hashed[start[own][:, None] + np.arange(size)] == self.block.runs[w[own], :size], axis=1)
                    own_start, own_window = start[own][same], w[own][same]
                    same = self.block.equal(texts, own_start, own_window, int(size))
                    yield own_start[same], own_window[same]
                i = j


def _ranges(mask: np.ndarray, texts: words.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Runs of hit words as flat (first, after last) word numbers, and how many numbers each text has."""
    before, after = np.zeros(len(mask), bool), np.zeros(len(mask), bool)
    before[1:] = mask[:-1] & (texts.doc[1:] == texts.doc[:-1])
    after[:-1] = mask[1:] & (texts.doc[1:] == texts.doc[:-1])
    start, last = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after)
    doc = texts.doc[start]
    flat = np.column_stack((start, last + 1)) - texts.first_word[doc][:, None]
    return flat.ravel(), 2 * np.bincount(doc, minlength=len(texts))


def _scan(index: Index, last: bool):
    """Adds what the windows of one block hit to the columns n_words, spans and items of each row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = index.block.items
        for batch in batches:
            counts, spans, items = [], [], []
            for texts in words.slices(frames.text_of(batch), words.PLAIN):
                hashed = texts.hashes(words.LOWERED)
                steps = np.zeros(len(hashed) + 1, np.int64)
                pairs = []
                for start, window in index.occurrences(texts, hashed):
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + index.block.size[window], -1)
                    pairs.append(np.unique(texts.doc[start] * np.int64(len(names)) + window))
                known = [set(x or ()) for x in batch.column("items").slice(texts.first, len(texts)).to_pylist()]
                for d, old in enumerate(batch.column("spans").slice(texts.first, len(texts)).to_pylist()):
                    for low, high in zip((old or [])[::2], (old or [])[1::2]):
                        steps[texts.first_word[d] + low] += 1
                        steps[texts.first_word[d] + high] -= 1
                for pair in np.unique(np.concatenate(pairs)) if pairs else ():
                    if names[pair % len(names)] is not None:
                        known[pair // len(names)].add(names[pair % len(names)])
                flat, sizes = _ranges(np.cumsum(steps[:-1]) > 0, texts)
                counts.append(texts.counts)
                spans.append(pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32())))
                items.append(pa.array([sorted(x) for x in known], pa.list_(pa.string())))
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            done = {"n_words": pa.array(n, pa.int64()),
                    "spans": pa.concat_arrays(spans) if spans else pa.array([], pa.list_(pa.int32())),
                    "items": pa.concat_arrays(items) if items else pa.array([], pa.list_(pa.string()))}
            passed = [name for name in batch.schema.names if name in ("row", "text") and not (last and name == "text")]
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), *done.values()], names=[*passed, *done])
    return task


def judge(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(),
          keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) of every document as a struct `row`, with n_words, spans (flat [first, after
    last) hit word numbers), items (ids of items with occurring windows), n_hit and contaminated."""
    found = stage(window_rows(benchmark, settings), "benchmark-windows")
    blocks = max(1, -(-found.count() // settings.block))
    found = found.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)))
    state = frames.packed(docs, keep)
    passed = state.schema.fields
    state = state.withColumns({
        "n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    done = [StructField("n_words", LongType()), StructField("spans", ArrayType(IntegerType())),
            StructField("items", ArrayType(StringType()))]
    for number in range(blocks):
        rows = found.where(F.col("block") == number).select("item", "window").toArrow()
        block = Block.of(rows["item"].to_pylist(), rows["window"].combine_chunks(), settings)
        index = Index.of(block, document_frequencies(docs, block) if block.items else {})
        last = number + 1 == blocks
        state = frames.map_rows(state, _scan(index, last), StructType((passed[:1] if last else passed) + done))
        if not last:
            state = stage(state, "decontaminate")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: x - total)
    return state.withColumns({
        "n_hit": n_hit, "contaminated": (n_hit > 0) & (n_hit * settings.one_in >= F.col("n_words"))})
