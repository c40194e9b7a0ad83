"""Text statistics, fingerprints and tokens as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a word is a run of at least two letters, digits or underscores in any script.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def word_count(text: Column) -> Column:
    """Pieces between white space after trimming blanks; an empty text has one piece, null stays null."""
    return F.array_size(F.split(F.trim(text), r"\s+"))


def fingerprint_text(text: Column, order: str = "reference") -> Column:
    """Text reduced to [a-z0-9].

    `reference` strips before lower-casing, so capitals are lost ("Great FOOD 5" -> "reat5").
    `lower_first` keeps them ("greatfood5").
    """
    if order == "reference":
        return F.lower(F.regexp_replace(text, r"[^a-z0-9]+", ""))
    if order == "lower_first":
        return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "")
    raise ValueError(f"unknown fingerprint order: {order!r}")


def text_fingerprint(text: Column, order: str = "reference", min_chars: int = 0) -> Column:
    """64-bit hash of the reduced text. Null text hashes to the constant 42.

    With `min_chars`, shorter reduced texts (emoji, other scripts, null) get null: no fingerprint.
    """
    reduced = fingerprint_text(text, order)
    if min_chars <= 0:
        return F.xxhash64(reduced)
    return F.when(F.length(reduced) >= min_chars, F.xxhash64(reduced))


@lru_cache(maxsize=1)
def _accent_rules() -> tuple[str, str, tuple, tuple]:
    """Compatibility decomposition without combining marks, derived from the Unicode tables.

    Returns letters with a one-letter result and their results (combining marks at the end, so that
    `translate` deletes them), and letters with a longer result with theirs. Hangul stays composed.
    """
    single_from, single_to, marks, long_from, long_to = [], [], [], [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base == char or not base:
            continue
        if len(base) == 1:
            single_from.append(char)
            single_to.append(base)
        else:
            long_from.append(char)
            long_to.append(base)
    return "".join(single_from + marks), "".join(single_to), tuple(long_from), tuple(long_to)


def _ranges(chars: tuple) -> str:
    """A character class of sorted characters, with neighbours joined to ranges."""
    runs: list[list[int]] = []
    for code in map(ord, chars):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in runs) + "]"


def strip_accents(text: Column) -> Column:
    """Letters without their accents; ligatures and similar signs are written out.

    Plain texts pass unchanged after one quick scan, and the per-character map runs only on the rare rows
    that hold a sign with a longer form.
    """
    singles_from, singles_to, long_from, long_to = _accent_rules()
    separator = "\x1f"
    table = F.map_from_arrays(
        F.split(F.lit(separator.join(long_from)), separator), F.split(F.lit(separator.join(long_to)), separator)
    )
    written_out = F.array_join(
        F.transform(F.split(text, ""), lambda char: F.coalesce(F.try_element_at(table, char), char)), ""
    )
    has_long_form = text.rlike(r"[\u00bc-\u00be\u0100-\uffff]") & text.rlike(_ranges(long_from))
    return (
        F.when(~text.rlike(r"[^\x00-\x7f]"), text)
        .when(has_long_form, F.translate(written_out, singles_from, singles_to))
        .otherwise(F.translate(text, singles_from, singles_to))
    )


def words(text: Column, accents: bool = False) -> Column:
    """Lower-case words in text order; null text has none. Accents are removed unless kept."""
    prepared = F.lower(F.coalesce(text, F.lit("")))
    if not accents:
        prepared = strip_accents(prepared)
    return F.regexp_extract_all(prepared, F.lit(WORD_PATTERN), F.lit(0))


def word_ngrams(tokens: Column, sizes: tuple = (1, 2)) -> Column:
    """All n-grams of the given sizes, blank-joined.

    Neighbours are paired with shifted slices, so no lambda refers back to the token array.
    """
    grams, parts = tokens, []
    for size in range(1, max(sizes) + 1):
        if size > 1:
            count = F.greatest(F.array_size(grams) - F.lit(1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), count),
                F.slice(tokens, F.lit(size), count),
                lambda left, right: F.concat(left, F.lit(" "), right),
            )
        if size in sizes:
            parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def runs_of_words(tokens: Column, sizes: tuple = (1, 2)) -> Column:
    """`word_ngrams` of tokens that hold no blank, such as those of `words`.

    Each match looks ahead over a whole run and consumes its first word, so one scan of the joined words finds all runs of a
    size; pairing slices with a lambda costs some ten times as much.
    """
    joined = F.array_join(tokens, " ")
    parts = [
        tokens if size == 1 else F.regexp_extract_all(joined, F.lit(f"(?=([^ ]+(?: [^ ]+){{{size - 1}}}))[^ ]+ "), F.lit(1))
        for size in sorted(set(sizes))
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def runs_of_equals(values: Column) -> Column:
    """Each different string of a list as often as it occurs, joined by newlines; no string may hold one or be empty.

    One scan of the sorted list, joined, finds them all. A possessive repetition needs no stack, however long the run.
    """
    return F.regexp_extract_all(F.array_join(F.sort_array(values), "\n"), F.lit(r"([^\n]+)(?:\n\1(?![^\n]))*+"), F.lit(0))
