"""Personal data: candidate spans, labelers that vote on them, and a span classifier trained on what the votes agree on.

1. Candidates: e-mail addresses, IP addresses, card and phone numbers by fixed patterns (`base_spans`: always reported), and
   wider ones (`wider_spans`): account numbers, identity numbers, national phone numbers, keys and tokens, names after a cue.
2. Labelers vote +1, -1 or 0 on each candidate: shape (regex), word lists (gazetteer), words before it (context), check digits,
   counter-evidence, and clean borders.
3. Tasks count candidates by (kind, votes, form) over ALL documents; these counts, of which there is a fixed maximum, reach the
   driver. Expectation-maximisation estimates how reliable each labeler is and how likely each voting pattern is to be right.
4. A logistic model on votes and form is trained on these likelihoods, weighted by the counts. A wider candidate becomes a span
   if the model gives it at least `threshold`, it overlaps no base span and no earlier one.

Odd cases: a null text is empty and has no spans. Repeated rows are searched alike, but count each in training. Without any
candidate the prior decides, and nothing is there to decide on. Patterns and the choice of spans take linear time
on any text. Extra columns pass through.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from crowdlens.llm import frames

BASE_KINDS = ("email", "ip", "card", "phone")
WIDER_KINDS = ("iban", "name", "national_phone", "secret", "ssn")
KINDS = BASE_KINDS + WIDER_KINDS

Span = tuple[str, int, int]

# ---------------------------------------------------------------- base patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def digits_of(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the address reaches back from an @ to the first character that cannot be part of it, or to the
    end of the match before. (An @ is never part of a name, so looking back takes linear time in all.)"""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield "email", start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """E-mail, IP, card and phone spans, in order of their start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = digits_of(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(digits_of(m.group())) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


# ---------------------------------------------------------------- wider candidates

_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_CUES = ("name is ", "Name: ", "Mr. ", "Mrs. ", "Ms. ", "Dr. ")
_NAME = re.compile(r"[^\W\d_a-zà-ÿ][^\W\d_]+(?: [^\W\d_a-zà-ÿ][^\W\d_]+){0,2}")

# Word lists of the gazetteer and context labelers.
FIRST_NAMES = frozenset(
    "Alice Anna Antonio Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emma Eva Hans Isabel James Jean "
    "Jennifer Joachim John Jose Juan Julia Karl Laura Linda Lucas Luis Maria Marie Mark Martin Mary Michael Michel Monika "
    "Patricia Paul Peter Pierre Richard Robert Sarah Sophie Susan Thomas William Wolfgang".split())
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SK".split())
KEY_STARTS = ("sk_", "pk_", "sk-", "ghp_", "gho_", "xox", "AKIA", "AIza", "eyJ")
CONTEXT = {
    "iban": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "name": ("my name", "signed", "contact", "dear", "name:"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "key"),
    "ssn": ("ssn", "social security", "tax id"),
    "email": ("mail", "contact", "write to"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta"), "phone": ("phone", "tel", "call", "mobile", "fax"),
}
COUNTER = ("version", "http:", "https:", "isbn", "sha1", "sha256", "md5", "commit", "uuid", "example:")


def wider_spans(text: str) -> list[Span]:
    found = []
    if _DIGIT.search(text):
        found += [("iban", *m.span()) for m in _IBAN.finditer(text)]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        found += [("national_phone", *m.span()) for m in _NATIONAL.finditer(text)]
        for m in _SECRET.finditer(text):
            if _DIGIT.search(m.group()) and any(c.isalpha() for c in m.group()):
                found.append(("secret", *m.span()))
    for cue in _CUES:
        at = text.find(cue)
        while at >= 0:
            if m := _NAME.match(text, at + len(cue)):
                found.append(("name", *m.span()))
            at = text.find(cue, at + len(cue))
    return sorted(set(found), key=_order)


# ---------------------------------------------------------------- labelers

def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _check(kind: str, value: str) -> int:
    if kind in ("card", "ip", "email", "phone"):
        return 1
    if kind == "iban":
        plain = value.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(number) % 97 == 1 else -1
    if kind == "ssn":
        area, group, serial = value.split("-")
        return -1 if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000" else 1
    if kind == "national_phone":
        d = digits_of(value)
        return 1 if d[0] > 1 and d[3] > 1 else -1
    if kind == "secret":
        return 1 if _entropy(value) >= 3.0 else -1
    return 0


def _gazetteer(kind: str, value: str) -> int:
    if kind == "name":
        return 1 if value.split(" ")[0] in FIRST_NAMES else 0
    if kind == "iban":
        return 1 if value[:2] in IBAN_COUNTRIES else -1
    if kind == "secret":
        return 1 if value.startswith(KEY_STARTS) else 0
    if kind == "email":
        return 1 if value.rpartition(".")[2].isalpha() else -1
    return 0


def _shape(kind: str, value: str) -> int:
    if kind in BASE_KINDS or kind in ("ssn", "iban"):
        return 1
    if kind == "secret":
        plain = value.rstrip("=")
        return 1 if re.fullmatch(r"[0-9a-f]{16,}|[A-Za-z0-9]{20,}", plain) else -1 if "/" in plain or plain.count("-") > 2 else 0
    if kind == "national_phone":
        return 1 if value[0] == "(" or value.count("-") == 2 else 0
    return 1 if " " in value else 0


def votes(text: str, span: Span) -> tuple[int, ...]:
    """One vote of each labeler: shape, gazetteer, context, check digits, counter-evidence, borders."""
    kind, start, end = span
    value, before = text[start:end], text[max(0, start - 30): start].lower()
    borders = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    counter = any(word in before for word in COUNTER) or text[max(0, start - 1): start] in ("/", "#", "$", "€")
    return (_shape(kind, value), _gazetteer(kind, value), 1 if any(word in before for word in CONTEXT[kind]) else 0,
            _check(kind, value), -1 if counter else 0, 1 if borders else -1)


LABELERS = 6


def form(text: str, span: Span) -> tuple[int, int, int]:
    """Length class, share of digits in quarters, whether letters of both cases occur."""
    value = text[span[1]: span[2]]
    digits = sum("0" <= c <= "9" for c in value)
    return (min(3, len(value) // 12), min(3, 4 * digits // max(1, len(value))),
            int(value.lower() != value and value.upper() != value))


def pattern(text: str, span: Span) -> str:
    return ",".join(map(str, (KINDS.index(span[0]), *votes(text, span), *form(text, span))))


# ---------------------------------------------------------------- training

def expectation_maximisation(votes_: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Likelihood that the candidates of each voting pattern are right, from one row of votes and a count per pattern.

    Labelers are taken as independent given the truth; each has a table of how often it votes -1, 0, 1 on right and on wrong
    candidates. The tables start from a majority vote, with one smoothing count that favours a labeler's own vote.
    """
    if not len(counts):
        return np.zeros(0)
    right = 1 / (1 + np.exp(-1.5 * votes_.sum(axis=1)))
    favour = np.array([[2.0, 2.0, 1.0], [1.0, 2.0, 2.0]])  # wrong, right: votes -1, 0, 1
    for _ in range(rounds):
        prior = (counts @ right + 1) / (counts.sum() + 2)
        score = np.full(len(counts), math.log(prior / (1 - prior)))
        for j in range(votes_.shape[1]):
            table = favour.copy()
            for v in (-1, 0, 1):
                own = votes_[:, j] == v
                table[0, v + 1] += counts[own] @ (1 - right[own])
                table[1, v + 1] += counts[own] @ right[own]
            table /= table.sum(axis=1, keepdims=True)
            score += np.log(table[1] / table[0])[votes_[:, j] + 1]
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - right).max() < 1e-6:
            break
        right = new
    return right


def design(patterns: np.ndarray) -> np.ndarray:
    """Indicators of kind, each vote, and form, and a constant."""
    columns = [patterns[:, 0] == k for k in range(len(KINDS))]
    for j in range(LABELERS):
        columns += [patterns[:, 1 + j] == v for v in (-1, 1)]
    columns += [patterns[:, 1 + LABELERS] == v for v in range(1, 4)] + [patterns[:, 2 + LABELERS] == v for v in range(1, 4)]
    columns += [patterns[:, 3 + LABELERS] == 1, np.ones(len(patterns), bool)]
    return np.column_stack(columns).astype(np.float64)


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model for soft targets, by Newton steps on the weighted mean."""
    weight = weight / max(weight.sum(), 1)
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - ridge * beta
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(beta)), gradient)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    threshold: float = 0.5
    known: dict = field(default_factory=dict, compare=False, repr=False)  # patterns are few: each is decided once

    def accepts(self, text: str, span: Span) -> bool:
        of = pattern(text, span)
        if of not in self.known:
            row = np.array([list(map(int, of.split(",")))])
            self.known[of] = float((design(row) @ self.weights)[0]) >= math.log(self.threshold / (1 - self.threshold))
        return self.known[of]


def fit(docs: DataFrame, threshold: float = 0.5) -> Model:
    """Model from all candidates of all documents."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    counted.update(pattern(text, span) for span in [*base_spans(text), *wider_spans(text)])
        yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())],
                                         names=["pattern", "n"])
    chosen = docs.select(F.col("text").cast("string").alias("text"))
    found = frames.map_rows(chosen, task, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy(
        "pattern").toArrow()
    patterns = np.array([list(map(int, p.split(","))) for p in found["pattern"].to_pylist()], np.int64).reshape(
        -1, 1 + LABELERS + 3)
    counts = found["n"].to_numpy().astype(np.float64)
    right = expectation_maximisation(patterns[:, 1: 1 + LABELERS], counts)
    x = design(patterns)
    # Square roots: a frequent kind shall not decide alone.
    return Model(logistic(x, right, np.sqrt(counts)) if len(counts) else np.zeros(x.shape[1]), threshold)


# ---------------------------------------------------------------- spans

def all_spans(text: str, model: Model) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and accepted wider spans."""
    base = base_spans(text)
    # Base spans of different kinds may overlap, so their covered stretches are joined first: sorted, none touching another.
    starts, ends = [], []
    for _, s, e in sorted(base, key=lambda x: x[1:]):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    more = []
    last = 0  # end of the last accepted wider span
    for span in wider_spans(text):  # by their start, so an accepted one can only be met by the next ones
        at = bisect_right(ends, span[1])  # the first stretch that ends after the span's start
        if span[1] >= last and (at == len(starts) or span[2] <= starts[at]) and model.accepts(text, span):
            last = span[2]
            more.append(span)
    return base, sorted(base + more, key=_order)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the kind of its first."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, model: Model | None = None, keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """The columns `keep` (default: all) of every document as a struct `row`, with `base` and `spans` (kind, start, end in code
    points, end exclusive), and with `mask` also `masked`: the text without its spans (null stays null)."""
    model = fit(docs) if model is None else model
    rows = frames.packed(docs, keep)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full, clean = [], [], []
            for text in frames.text_of(batch).cast(pa.string()).to_pylist():
                b, f = all_spans(text, model) if text else ([], [])
                base.append([dict(zip(("kind", "start", "end"), s)) for s in b])
                full.append([dict(zip(("kind", "start", "end"), s)) for s in f])
                if mask:
                    clean.append(masked(text, f) if text else text)
            columns = [batch.column("row"), pa.array(base, kind), pa.array(full, kind)]
            names = ["row", "base", "spans"]
            if mask:
                columns.append(pa.array(clean, pa.string()))
                names.append("masked")
            yield pa.RecordBatch.from_arrays(columns, names=names)
    span_type = _parse_datatype_string(SPANS)
    fields = [frames.row_field(rows), StructField("base", span_type), StructField("spans", span_type)]
    if mask:
        fields.append(StructField("masked", StringType()))
    return frames.map_rows(rows, task, StructType(fields))


def listed(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
