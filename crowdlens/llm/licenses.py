"""License scan: a positional index of rare words finds where license texts may start, key phrases verify them.

Everything is a DataFrame expression on one row: no join, no shuffle of texts, and a file is never spread over rows.

1. `word_frequencies`: in how many files each word of the templates occurs, over the whole corpus (one small table).
2. Each template is indexed by its `POSTINGS` rarest key-phrase words (highest IDF first), each with its offset.
3. In each file the rarest words it has are looked up; each occurrence is a posting that says where the template would start. The
   starts that the second and third words' postings give are intersected with them, as (template, start) numbers; a file
   without any of the rarest words is done after the first lookup.
4. All mandatory key phrases must stand at their offsets from a start that is left; since the indexed words belong to them, no
   place is missed. The score of a place is the share of the template's words that stand where the template has them.

Odd cases: a null text is empty; without words there are no places, labels are empty and the score is 0. Repeated rows are
scanned alike. Extra columns are ignored; only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that the contract names, and license notices with their mandatory phrases. `|` encloses a phrase.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("gpl", "this work is licensed under the |gnu general public license|"),
    ("apache", "licensed under the |apache license| version"),
    ("cc-by", "licensed under |cc by|"),
    ("mit", "released under the |mit license|"),
    ("gpl-2.0", "this program is free software under the |gnu general public license| |version 2|"),
    ("gpl-3.0", "this work is licensed under the |gnu general public license| |version 3|"),
    ("apache-2.0", "licensed under the |apache license| |version 2 0|"),
    ("cc-by-4.0", "licensed under |cc by 4 0|"),
    ("cc-by-sa-4.0", "licensed under |cc by sa 4 0|"),
    ("cc-by-nc-4.0", "licensed under |cc by nc 4 0|"),
    ("cc-by-nd-4.0", "licensed under |cc by nd 4 0|"),
    ("cc-by-4.0", "|creative commons attribution 4 0 international| license"),
    ("cc0-1.0", "|cc0 1 0 universal|"),
    ("mit", "|permission is hereby granted free of charge to any person obtaining a copy of this software| and associated "
            "documentation files the software |to deal in the software without restriction|"),
    ("isc", "|permission to use copy modify and or distribute this software| for any purpose with or without fee is hereby "
            "granted"),
    ("bsd", "|redistribution and use in source and binary forms with or without modification| are permitted provided that the "
            "following conditions are met"),
    ("lgpl", "under the terms of the |gnu lesser general public license|"),
    ("agpl", "under the terms of the |gnu affero general public license|"),
    ("mpl-2.0", "this source code form is subject to the terms of the |mozilla public license| v |2 0|"),
    ("epl-2.0", "made available under the terms of the |eclipse public license| |2 0|"),
    ("unlicense", "this is |free and unencumbered software released into the public domain|"),
    ("mit", "|spdx license identifier mit|"),
    ("apache-2.0", "|spdx license identifier apache 2 0|"),
    ("mit", "|permission is hereby granted free of charge to any person obtaining a copy of this software| and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy "
            "modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software "
            "is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the software the software is provided as is without warranty of any "
            "kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose "
            "and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
            "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
            "other dealings in the software"),
    ("isc", "|permission to use copy modify and or distribute this software for any purpose| with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies the software is provided as is "
            "and the author disclaims all warranties with regard to this software including all implied warranties of merchantability "
            "and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any "
            "damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other "
            "tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd", "|redistribution and use in source and binary forms with or without modification are permitted| provided that the following "
            "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and "
            "the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of "
            "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("apache-2.0", "|licensed under the apache license version 2 0| the license you may not use this file except in compliance with the "
                   "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by "
                   "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                   "without warranties or conditions of any kind either express or implied see the license for the specific language "
                   "governing permissions and limitations under the license"),
    ("gpl", "|this program is free software you can redistribute it and or modify it under the terms of the gnu general public license| "
            "as published by the free software foundation either version 3 of the license or at your option any later version this "
            "program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
            "merchantability or fitness for a particular purpose see the gnu general public license for more details"),
)

#: Words by which a template is indexed.
POSTINGS = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, int], ...]  # (offset, words) of each mandatory phrase
    base: bool = False


def template(label: str, text: str, base: bool = False) -> Template:
    words: list[str] = []
    phrases = []
    for number, part in enumerate(text.split("|")):
        own = part.split()
        if number % 2 and own:
            phrases.append((len(words), len(own)))
        words += own
    return Template(label, tuple(words), tuple(phrases) or ((0, len(words)),), base)


def templates() -> list[Template]:
    return [template(*entry, base=True) for entry in BASE] + [template(*entry) for entry in NOTICES]


#: Everything but digits, a-z and non-ASCII characters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def file_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null: none."""
    # Two characters whose lower case is (or holds) a plain letter must stay what they are: not plain.
    plain = F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("K"), F.lit("ß")),
                      F.lit("İ"), F.lit("ß"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def _texts(values) -> Column:
    return F.array(*[F.lit(value) for value in values])


def word_frequencies(files: DataFrame, known: list[Template]) -> dict[str, int]:
    """Number of files with each template word; at most as many rows as the templates have words."""
    vocabulary = sorted({w for t in known for w in t.words})
    found = files.select(F.explode(F.array_intersect("words", _texts(vocabulary))).alias("word")).groupBy("word").count()
    counted = {row["word"]: row["count"] for row in found.collect()}
    return {word: counted.get(word, 0) for word in vocabulary}


def anchors(t: Template, frequency: dict[str, int], postings: int = POSTINGS) -> list[int]:
    """Offsets of the rarest words of the template's phrases, the rarest first (of equally rare ones, and of repeated ones, the
    first). Where there are fewer different words the rarest stands for the rest."""
    offsets = sorted((start + j for start, n in t.phrases for j in range(n)), key=lambda o: (frequency[t.words[o]], o))
    found = list({t.words[o]: o for o in reversed(offsets)}.values())[::-1][:postings]
    return found + found[:1] * (postings - len(found))


# A template and a start as one number: (template << 40) + start + 2 ** 30.
_SHIFT, _BIAS = 1 << 40, 1 << 30


def _starts(postings: list[tuple[str, int]]) -> Column:
    """Starts of all templates that the postings of one rank give: (word, offset) of each template, on the column `words`."""
    index = F.array(*[F.struct(F.lit(word).alias("word"), F.lit(number * _SHIFT + _BIAS - offset).alias("code"))
                      for number, (word, offset) in enumerate(postings)])
    known = _texts(sorted({word for word, _ in postings}))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))),
                    lambda x: F.array_contains(known, x["word"]))
    codes = F.flatten(F.transform(hits, lambda x: F.transform(
        F.filter(index, lambda p: p["word"] == x["word"]), lambda p: p["code"] + x["at"])))
    return F.when(F.arrays_overlap("words", known), codes).otherwise(F.array().cast("array<bigint>"))


def scan(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words and `places`: label, base, start (word number of the template's start; may be negative where a file
    begins inside a template) and share of every verified template."""
    known = templates() if known is None else known
    files = docs.select("doc_id", file_words(F.col("text")).alias("words"))
    frequency = word_frequencies(files, known)
    offsets = [anchors(t, frequency) for t in known]
    table = F.array(*[F.struct(
        F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _texts(t.words).alias("words"),
        F.array(*[F.struct(F.lit(o).alias("offset"), _texts(t.words[o: o + n]).alias("words")) for o, n in t.phrases])
        .alias("phrases")) for t in known])

    # One posting list after the other: what the rarest words give, cut down by the next ones.
    left = _starts([(t.words[own[0]], own[0]) for t, own in zip(known, offsets)])
    files = files.withColumn("starts", left)
    for rank in range(1, POSTINGS):
        more = _starts([(t.words[own[rank]], own[rank]) for t, own in zip(known, offsets)])
        files = files.withColumn("starts", F.when(F.size("starts") > 0, F.array_intersect("starts", more)).otherwise(F.col("starts")))
    starts = F.transform("starts", lambda code: F.struct(
        F.get(table, F.floor(code / _SHIFT).cast("int")).alias("template"),
        (F.pmod(code, F.lit(_SHIFT)) - _BIAS).cast("int").alias("start")))

    def verified(c: Column) -> Column:
        return F.forall(c["template"]["phrases"], lambda p: (c["start"] + p["offset"] >= 0) & (
            F.slice("words", F.greatest(c["start"] + p["offset"], F.lit(0)) + 1, F.size(p["words"])) == p["words"]))

    def place(c: Column) -> Column:
        own = c["template"]["words"]
        same = F.size(F.filter(F.transform(own, lambda w, j: F.when(
            c["start"] + j >= 0, F.get("words", F.greatest(c["start"] + j, F.lit(0))) == w)), lambda equal: equal))
        return F.struct(c["template"]["label"].alias("label"), c["template"]["base"].alias("base"),
                        c["start"].cast("long").alias("start"), (same / F.size(own)).alias("share"))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    return files.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.when(F.size("starts") > 0, F.transform(F.filter(starts, verified), place)).otherwise(none).alias("places"))


def summary(scanned: DataFrame) -> DataFrame:
    """One row per file: counts, first and last base place, labels, and the best share of a notice's words."""
    base = F.filter("places", lambda p: p["base"])

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    shares = F.transform(F.filter("places", lambda p: ~p["base"]), lambda p: p["share"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"))
