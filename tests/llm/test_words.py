import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from crowdlens.llm import words

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
texts_ = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 \n\t\x0b\x0c\r\x1f.,|éÉK漢😀", max_size=30)), max_size=8)


def split(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


@settings(max_examples=150, deadline=None)
@given(texts_, st.integers(1, 40))
def test_words_equal_the_patterns(batch, limit):
    for pattern, table in ((SPACED, words.SPACED), (PLAIN, words.PLAIN)):
        counts, by_word = [], {}
        for part in words.slices(pa.array(batch, pa.string()), table, limit):
            counts += part.counts.tolist()
            hashed = part.hashes(words.LOWERED)
            flat = [w for text in batch[part.first: part.first + len(part)] for w in split(text, pattern)]
            assert len(flat) == len(hashed)
            for word, value in zip(flat, hashed.tolist()):
                assert by_word.setdefault(word, value) == value
        assert counts == [len(split(text, pattern)) for text in batch]
        assert len(set(by_word.values())) == len(by_word)


@settings(max_examples=100, deadline=None)
@given(texts_, st.integers(1, 4))
def test_shingles_are_the_distinct_runs(batch, k):
    got = {}
    for part in words.slices(pa.array(batch, pa.string()), words.SPACED):
        doc, hashed = words.shingles(part, part.hashes(words.LOWERED), k)
        for d, value in zip(doc.tolist(), hashed.tolist()):
            got.setdefault(part.first + d, []).append(value)
    for i, text in enumerate(batch):
        w = split(text, SPACED)
        runs = {tuple(w[j: j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        assert len(got.get(i, [])) == len(runs)
        assert got.get(i, []) == sorted(set(got.get(i, [])))


def test_long_words_and_long_texts_hash_alike_in_any_slice():
    text = "short " + "y" * (3 << 20) + " " + "z w " * 1000
    whole = next(words.slices(pa.array([text]), words.SPACED, 1 << 30)).hashes(words.CASED)
    tail = next(words.slices(pa.array(["z w " * 1000]), words.SPACED)).hashes(words.CASED)
    assert np.array_equal(whole[2:], tail)
    assert len(set(whole.tolist())) == 4


def thue_morse(order, first="a", second="b"):
    word = first
    for _ in range(order):
        word += word.translate(str.maketrans(first + second, second + first))
    return word


def test_words_built_alike_have_different_hashes():
    """A Thue-Morse word and its complement agree under every polynomial hash modulo a power of two, once they are long enough."""
    for order in range(1, 14):
        a = thue_morse(order)
        b = a.translate(str.maketrans("ab", "ba"))
        for values in (words.CASED, words.LOWERED):
            for seed in (0, 1):
                part = next(words.slices(pa.array([f"{a} {b} {a}"]), words.SPACED))
                x, y, z = part.hashes(values, seed).tolist()
                assert x == z != y


def test_long_words_are_lower_cased_like_short_ones():
    text = "É" + "aBc" * 50
    first, second = next(words.slices(pa.array([f"{text} {text.replace('B', 'b')}"]), words.SPACED)).hashes(words.LOWERED).tolist()
    assert first == second
    first, second = next(words.slices(pa.array([f"{text} {text.replace('B', 'b')}"]), words.SPACED)).hashes(words.CASED).tolist()
    assert first != second


def test_seeds_are_independent():
    part = next(words.slices(pa.array([" ".join(map(str, range(5000)))]), words.SPACED))
    a, b = part.hashes(words.CASED, 0), part.hashes(words.CASED, 1)
    assert len(set(a.tolist())) == len(set(b.tolist())) == 5000 and not set(a.tolist()) & set(b.tolist())
    same = np.array([bin(x).count("1") for x in (a ^ b).tolist()])
    assert abs(same.mean() - 32) < 1
