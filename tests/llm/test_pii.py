import time
import random
import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crowdlens.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, x in enumerate(reversed(d)):
        x = int(x) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def brute(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


PIECES = ["a@b.c", "@", ".", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "41",
          "+1 (640) 555-0953", "+", "+1", " ", "-", "é", "😀", "a.b%c+d@mail-1.example.com", "00.001.02.3", "\u0661", "z", "9" * 30]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=9).map("".join),
                 st.text(alphabet="a@.1+- 4()é", max_size=40)))
def test_base_spans_equal_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "a." * 150_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000,
                                  "1 " * 150_000, "+1" + " " * 300_000, "A1" * 150_000])
def test_long_texts_take_linear_time(text):
    pii.base_spans(text)
    pii.wider_spans(text)


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(40_000) < 0.3
    right = np.array([0.95, 0.8, 0.65])
    said = np.where((rng.random((40_000, 3)) < right) == truth[:, None], 1, -1)
    patterns, inverse, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    got = pii.expectation_maximisation(patterns, counts.astype(float), 500)
    share = np.bincount(inverse.ravel(), truth) / counts
    assert np.abs(got - share).max() < 0.12
    clear = np.abs(share - 0.5) > 0.12  # beyond the tolerance above
    assert ((got > 0.5) == (share > 0.5))[clear].all() and clear.sum() >= 6
    assert len(pii.expectation_maximisation(np.zeros((0, 3), int), np.zeros(0))) == 0


SECRET = 'token = "2b0cb261201f091f991b2c11447ab3'
MADE = [f"write to u{i}@mail.example.com or call +1 (640) 555-09{i:02d} now" for i in range(30)] + [
    f'here the token = "{i:02d}b0cb261201f09{i:02d}91b2c1144ab" ends' for i in range(20)] + [
    f"part {i}-ab/cd/ef/gh/12/zz/yy/xx of http://host/long-path-name-{i}/page" for i in range(20)]


def test_secrets_are_added_and_base_spans_stay(documents):
    found = pii.find(documents(MADE)).select("row.doc_id", "row.text", "base", "spans").collect()
    for r in found:
        base, spans = [tuple(s) for s in r.base], [tuple(s) for s in r.spans]
        assert base == brute(r.text) and set(base) <= set(spans)
        more = [s for s in spans if s not in base]
        if "token" in r.text:
            assert [s[0] for s in more] == ["secret"] and len(r.text[more[0][1]: more[0][2]]) >= 16
        else:
            assert not more


def test_masks_leave_no_base_span_and_clean_texts_alone(documents, odd_texts):
    docs = odd_texts + [(100 + i, t) for i, t in enumerate(MADE)]
    got = pii.find(documents(docs), mask=True).select("row.*", "masked").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(docs)
    for r in got:
        assert (r.masked is None) == (r.text is None)
        assert not r.text or not brute(r.masked)
        if r.text and not brute(r.text) and "token" not in r.text:
            assert r.masked == r.text
    assert pii.masked("ab cd ef", [("card", 0, 5), ("phone", 3, 5), ("ip", 6, 8)]) == "<CARD> <IP>"


def test_no_candidates_and_no_rows(documents):
    assert pii.find(documents([])).count() == 0
    assert [tuple(r) for r in pii.find(documents([None, "", "plain"])).select("base", "spans").collect()] == [([], [])] * 3


def test_a_long_secret_is_judged_by_the_whole_of_it():
    rng = random.Random(5)
    mixed = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(200))
    assert pii._check("secret", "A" * 64 + mixed) == 1 and pii._check("secret", mixed[:64] + "a" * 4000) == -1


def test_choosing_spans_takes_linear_time():
    """Twice the base and wider spans take at most 2.5 times as long."""
    model = pii.Model(np.zeros(pii.design(np.zeros((1, 1 + pii.LABELERS + 3), int)).shape[1]))

    def seconds(n):
        text = " ".join(f"a{i}@b.org ssn {100 + i % 500}-22-{1000 + i % 9000}" for i in range(n))
        best = 1e9
        for _ in range(3):
            start = time.process_time()
            base, spans = pii.all_spans(text, model)
            best = min(best, time.process_time() - start)
        assert len(base) == n and len(spans) == 2 * n
        return best
    assert seconds(16_000) < 2.5 * seconds(8_000)


def test_wider_spans_give_way_to_all_they_meet():
    """The sweep takes the spans that comparing with every earlier one takes."""
    model = pii.Model(np.zeros(pii.design(np.zeros((1, 1 + pii.LABELERS + 3), int)).shape[1]))
    rng = random.Random(8)
    parts = ["a.b@c.org", "123-45-6789", "4111 1111 1111 1111", "(212) 555-0100", "+1 212 555 0100", "Mr. Anna Karl", "DE89 3704 0044 0532 0130 00",
             "sk_live1234567890abcdef", "10.0.0.1", "key=", "x"]
    for _ in range(200):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", ",", "\n"]) for _ in range(12))
        base, spans = pii.all_spans(text, model)
        taken, more = [s[1:] for s in base], []
        for span in pii.wider_spans(text):
            if all(span[2] <= s or e <= span[1] for s, e in taken) and model.accepts(text, span):
                taken.append(span[1:])
                more.append(span)
        assert spans == sorted(base + more, key=pii._order)
