"""Words of whole texts as 64-bit hashes, computed for many texts at once on their UTF-8 bytes.

Both word patterns used here split at ASCII characters only, so bytes suffice: a byte of 0x80 or more always
belongs to a word. The hash of a word of up to `SHORT` bytes is a polynomial over per-byte random values modulo 2**64, mixed at
the end. Of longer words such polynomials can agree by their structure (a sequence and its complement), so those get a
cryptographic digest. Hashes of another `seed` are independent: callers that must not err on equal hashes compare those, or the
bytes. Memory is bounded by `SLICE` bytes of text or by the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Bytes of the longest word that is hashed by a polynomial.
SHORT = 64
_BASE = 0x9E3779B97F4A7C15
_FULL = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    byte = np.arange(256)
    upper = (byte >= 0x41) & (byte <= 0x5A)
    lower = np.where(upper, byte + 32, byte)
    spaced = ~((byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D)))
    plain = ((lower >= 0x30) & (lower <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A)) | (byte >= 0x80)
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    return spaced, plain, values, values[lower]


#: Bytes of words of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, values of bytes as they are and
#: with A-Z lower-cased.
SPACED, PLAIN, CASED, LOWERED = _tables()

_steps: dict[int, list[np.ndarray]] = {}


def _powers(n: int, seed: int) -> list[np.ndarray]:
    """Powers of the seed's base and of its inverse, at least `n` each."""
    found = _steps.setdefault(seed, [np.ones(1, np.uint64)] * 2)
    if len(found[0]) < n:
        base = (_BASE + 0x632BE59BD9B4E01A * seed) % _FULL | 1
        for k, step in enumerate((base, pow(base, -1, _FULL))):
            steps = np.full(n, step, np.uint64)
            steps[0] = 1
            found[k] = np.cumprod(steps, dtype=np.uint64)
    return found


@dataclass
class Texts:
    """Some texts, their words in order, and which text each word belongs to."""

    first: int  # position of the first text in its batch
    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # len + 1 offsets of the texts in data
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    doc: np.ndarray  # number of the text of each word
    counts: np.ndarray  # words in each text

    def __len__(self) -> int:
        return len(self.counts)

    @property
    def first_word(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    def hashes(self, values: np.ndarray, seed: int = 0) -> np.ndarray:
        """Of every word; `values` is CASED or LOWERED."""
        return span_hashes(self.data, self.starts, self.ends, values, seed)

    def characters(self) -> np.ndarray:
        """Code points in the words of each text."""
        head = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return np.bincount(self.doc, head[self.ends] - head[self.starts], len(self)).astype(np.int64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each non-overlapping, ascending span of `data`; `values` is CASED or LOWERED."""
    out = np.empty(len(starts), np.uint64)
    of_byte = mix(values + np.uint64(seed)) if seed else values
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        low = int(starts[i])
        high = min(int(ends[j - 1]), low + 2 * SLICE)  # only a long span, digested below, can reach beyond
        powers, inverses = _powers(high - low + 1, seed)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(of_byte[data[low:high]] * powers[: high - low], dtype=np.uint64, out=sums[1:])
        s, e = starts[i:j] - low, np.minimum(ends[i:j] - low, high - low)
        out[i:j] = (sums[e] - sums[s]) * inverses[s] + (e - s).astype(np.uint64)
        i = j
    out = mix(out)
    lower = values[0x41] == values[0x61]
    for i in np.flatnonzero(ends - starts > SHORT).tolist():
        span = data[starts[i]: ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(span.lower() if lower else span, digest_size=8, salt=seed.to_bytes(8, "little")).digest())
    return out


def slices(column: pa.Array, table: np.ndarray, limit: int = SLICE) -> Iterator[Texts]:
    """The texts of an Arrow column (null: empty) in order, about `limit` bytes at a time."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        last = min(last, len(column), first + limit)
        low, high = int(bounds[first]), int(bounds[last])
        yield split(data[low:high], bounds[first: last + 1] - low, table, first)
        first = last


def split(data: np.ndarray, bounds: np.ndarray, table: np.ndarray, first: int = 0) -> Texts:
    inside = table[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    before[edges] = False  # a word never reaches into the next text
    edges = bounds[1:][bounds[1:] > 0] - 1
    after[edges] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(bounds[1:], starts, "right")
    return Texts(first, data, bounds, starts, ends, doc, np.bincount(doc, minlength=len(bounds) - 1))


_STEPS = mix(np.arange(101, 165, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of k words inside one text."""
    if len(hashes) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1:])
    out = np.full(len(at), k, np.uint64)
    for j in range(k):
        out += hashes[at + j] * _STEPS[j]
    return at, mix(out)


def owned(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts as well."""
    return mix(hashes + doc.astype(np.uint64) * np.uint64(_BASE))


def shingles(texts: Texts, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles of each text, sorted by both.

    A text of fewer words, but not none, has its whole sequence as the only shingle.
    """
    at, found = windows(hashes, texts.doc, k)
    docs = [texts.doc[at]]
    hashed = [found]
    for n in range(1, k):
        short = np.flatnonzero(texts.counts == n)
        if len(short):
            docs.append(short)
            first = texts.first_word[short]
            hashed.append(mix(sum((hashes[first + j] * _STEPS[j] for j in range(n)), np.full(len(short), n, np.uint64))))
    doc, found = np.concatenate(docs), np.concatenate(hashed)
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[keep], found[keep]
