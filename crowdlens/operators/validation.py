"""Row validation with named errors: bad rows are set aside, never defaulted."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdlens.params import SIGNALS


@dataclass(frozen=True)
class Rule:
    """A check on one field. The row is in error when `holds` is false or null."""

    pointer: str
    detail: str
    holds: Callable[[], Column]


def _required(name: str) -> Rule:
    return Rule(f"/{name}", "required", lambda: F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))


def _finite(name: str) -> Rule:
    return Rule(f"/{name}", "must be finite",
                lambda: F.col(name).isNull() | (F.abs(F.col(name).cast("double")) < F.lit(float("inf"))) | F.isnan(name))


def _within(name: str, low: float, high: float | None) -> Rule:
    if high is None:
        return Rule(f"/{name}", f"must be >= {low:g}", lambda: F.col(name).isNull() | (F.col(name) >= low))
    return Rule(
        f"/{name}", f"must be in [{low:g}, {high:g}]", lambda: F.col(name).isNull() | F.col(name).between(low, high)
    )


def signal_rules() -> list[Rule]:
    """n_reviews and all five signals present and in range."""
    # Signals that are shares.
    shares = ("duplication", "rating_extremity")
    rules = [_required("n_reviews"), _within("n_reviews", 1, None)]
    for name in SIGNALS:
        rules += [_required(name), _within(name, 0, 1 if name in shares else None), _finite(name)]
    return rules


def review_rules(text: str = "text", top_k: str | None = None, threshold: str | None = None,
                 max_chars: int = 20_000) -> list[Rule]:
    """Text of 1 to `max_chars` characters; optional columns for top k (1..50) and threshold (0..1)."""
    rules = [
        Rule(f"/{text}", "required", lambda: F.col(text).isNotNull()),
        Rule(f"/{text}", f"length must be in [1, {max_chars}]",
             lambda: F.col(text).isNull() | F.length(text).between(1, max_chars)),
    ]
    if top_k:
        rules += [_required(top_k), _within(top_k, 1, 50)]
    if threshold:
        rules += [_required(threshold), _within(threshold, 0, 1)]
    return rules


def with_errors(df: DataFrame, rules: Sequence[Rule], out: str = "errors") -> DataFrame:
    """Add the array of errors (pointer, detail) of each row; empty for a valid row."""
    found = [
        F.when(
            ~F.coalesce(rule.holds(), F.lit(False)),
            F.struct(F.lit(rule.pointer).alias("pointer"), F.lit(rule.detail).alias("detail")),
        )
        for rule in rules
    ]
    return df.withColumn(out, F.filter(F.array(*found), lambda error: error.isNotNull()))


def validate(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors)."""
    checked = with_errors(df, rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def validate_signals(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, signal_rules())
