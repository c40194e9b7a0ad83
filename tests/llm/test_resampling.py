import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crowdlens.llm import resampling, words
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def runs(text, s):
    w = split(text)
    return [zlib.crc32(" ".join(w[i: i + k]).encode()) % s.buckets for k in range(1, s.longest_run + 1) for i in range(len(w) - k + 1)]


def plain(docs, goal, s):
    """One document after another."""
    count = [[0] * s.buckets, [0] * s.buckets]
    for side, texts in enumerate(([t for _, t in docs], goal)):
        for text in texts:
            for b in runs(text, s):
                count[side][b] += 1
    big_s, big_t = (sum(c) + s.buckets for c in count)
    gain = [math.floor(1000 * math.log((t + 1.0) * big_s / ((n + 1.0) * big_t))) for n, t in zip(*count)]
    rows = []
    for i, text in docs:
        found = runs(text, s)
        h = int(hashlib.sha256(f"{s.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        rows.append([i, len(split(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= s.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, row in enumerate(able[: s.percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(str, rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=20), st.integers(0, 2**31))
def test_spans_have_their_crc(lengths, seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    ends = rng.integers(700, 3000, len(lengths))
    starts = ends - np.array(lengths)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resampling.crc32(data, starts, ends).tolist() == want


def test_very_long_spans():
    data = np.frombuffer(random.Random(1).randbytes(5 << 20), np.uint8)
    for n in (63, 64, 65, 128, 1 << 20, (5 << 20) - 1, 5 << 20):
        assert resampling.crc32(data, np.array([0]), np.array([n])).tolist() == [zlib.crc32(data[:n].tobytes())]


@pytest.mark.parametrize("longest", [1, 3])
def test_features_are_the_runs(odd_texts, longest):
    s = resampling.Settings(longest_run=longest, buckets=977)
    texts = [t for _, t in odd_texts]
    found = {}
    for part in words.slices(pa.array(texts, pa.string()), words.PLAIN, 1000):
        for doc, bucket in zip(*resampling.features(part, s)):
            found.setdefault(part.first + int(doc), []).append(int(bucket))
    for i, text in enumerate(texts):
        assert sorted(found.get(i, [])) == sorted(runs(text, s))


@pytest.mark.parametrize("s", [resampling.Settings(), resampling.Settings(longest_run=2, buckets=50, least_words=3, percent=37)])
def test_equals_one_document_after_another(documents, odd_texts, s):
    docs = odd_texts + [(100 + i, prose(i, i % 60)) for i in range(150)] + [(400, prose(3, 40))] * 40 + [(None, prose(4, 40))] * 5
    goal = [prose(i, 50) for i in range(5)] + [None, ""]
    rows = resampling.resample(documents(docs), documents(goal), s).collect()
    assert sorted(str(list(r)) for r in rows) == plain(docs, goal, s)


def test_empty_tables(documents):
    s = resampling.Settings()
    assert resampling.resample(documents([]), documents([prose(1, 30)]), s).count() == 0
    docs = [(i, prose(i, 30)) for i in range(30)]
    assert sorted(str(list(r)) for r in resampling.resample(documents(docs), documents([]), s).collect()) == plain(docs, [], s)


def test_texts_like_the_target_are_preferred(documents):
    docs = [(i, " ".join(f"{'good' if i % 2 else 'other'}{random.Random(i * 99 + j).randrange(50)}" for j in range(40))) for i in range(400)]
    goal = [" ".join(f"good{j}" for j in range(50))] * 20
    drawn = [r.doc_id for r in resampling.resample(documents(docs), documents(goal)).collect() if r.rank]
    assert len(drawn) == 40 and sum(i % 2 for i in drawn) >= 38
