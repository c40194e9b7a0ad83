import re

from crowdlens.llm import licenses
from tests.llm.conftest import prose

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    w = PLAIN.findall((text or "").translate(LOWER))
    base, labels, best = [], set(), 0.0
    for t in licenses.templates():
        for s in range(-len(t.words), len(w)):
            def at(o):
                return w[s + o] if 0 <= s + o < len(w) else None
            if all(at(o + j) == t.words[o + j] for o, n in t.phrases for j in range(n)):
                labels.add(t.label)
                share = sum(at(j) == x for j, x in enumerate(t.words)) / len(t.words)
                if t.base:
                    base.append((s, t.label))
                else:
                    best = max(best, share)
    return (len(w), len(base), min((s for s, _ in base), default=None), max((s for s, _ in base), default=None),
            ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best)


TEXTS = ["MIT License", "the mit license. THE MIT-LICENSE", prose(1, 30) + " Licensed under the Apache License, Version 2.0. " + prose(2, 9),
         "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
         "gnu general gnu general public license", "cc by cc by cc by", "licen\u017fe mit \u212a", "MIT LICEN\u212aSE", "Permission is hereby granted",
         "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
         "files (the software), to deal in the software without restriction", "SPDX-License-Identifier: MIT", "Apache License",
         "version 2.0 apache license", "apache\u0130 license cc by\u0130", "mit license " * 3000]


def test_scan_equals_trying_every_place(documents, odd_texts):
    docs = odd_texts + [(100 + i, t) for i, t in enumerate(TEXTS)]
    short = [(i, t) for i, t in docs if not t or len(t) < 50_000]
    got = licenses.summary(licenses.scan(documents(docs))).collect()
    assert len(got) == len(docs)
    rows = sorted(repr(tuple(r)) for r in got if r.doc_id not in (6, 7))
    assert rows == sorted(repr((i, *brute(t))) for i, t in short if i not in (6, 7))
    assert [r.n_base for r in got if r.doc_id in (6, 7)] == [0, 0]
    assert licenses.summary(licenses.scan(documents([]))).count() == 0


def test_the_rarest_words_are_the_index():
    t = licenses.template("x", "under the |mit license| of |1998 mit|")
    assert t.phrases == ((2, 2), (5, 2))
    frequency = {"under": 0, "the": 9, "mit": 5, "license": 3, "of": 0, "1998": 3}
    assert licenses.anchors(t, frequency) == [3, 5, 2]
    assert licenses.anchors(licenses.template("y", "|mit mit|"), frequency) == [0, 0, 0]


def test_templates_that_share_the_rarest_word_are_told_apart_by_the_others(documents):
    """Both have `zyx` as rarest word; where only one of them stands, the intersected starts are its own. (Of `c` only the two
    words between the bars are mandatory, at their distance.)"""
    known = [licenses.template("a", "|zyx red blue|"), licenses.template("b", "|green zyx red|"), licenses.template("c", "red |zyx| x |red|")]
    texts = ["zyx red blue", "green zyx red", "green zyx red blue", "blue red zyx", "red zyx x red", "zyx blue red", "zyx " * 50 + "red blue"]
    rows = {r.doc_id: sorted((p.label, p.start) for p in r.places) for r in licenses.scan(documents(texts), known).collect()}
    assert rows == {0: [("a", 0)], 1: [("b", 0)], 2: [("a", 1), ("b", 0)], 3: [], 4: [("c", 0)], 5: [("c", -1)],
                    6: [("a", 49), ("c", 47)]}
    frequency = {"zyx": 1, "red": 5, "blue": 3, "green": 2, "x": 9}
    assert [licenses.anchors(t, frequency)[0] for t in known] == [0, 1, 1]


def test_full_notices_are_found_whole(documents):
    full = {t.label: " ".join(t.words) for t in licenses.templates() if len(t.words) > 40}
    assert {"mit", "isc", "bsd", "apache-2.0", "gpl"} <= set(full)
    rows = {r.doc_id: r for r in licenses.summary(licenses.scan(documents(list(full.values())))).collect()}
    for i, label in enumerate(full):
        assert label in rows[i].labels.split(",") and rows[i].score == 1.0


def test_no_python_in_the_plan(documents):
    plan = licenses.summary(licenses.scan(documents(TEXTS)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
