"""The list of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL equivalent if there is one."""
    def register(function: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


# Far above the error of a sum, far below what a result shows.
NUDGE = 1e-10


def rounded(df: DataFrame, *names: str, dp: int = 6) -> DataFrame:
    """Doubles to `dp` decimals: sums of floating-point numbers depend on the order of the rows.

    The nudge makes values that lie halfway round up whatever their last bit is.
    """
    chosen = names or [field.name for field in df.schema.fields if field.dataType.typeName() == "double"]
    return df.withColumns({name: F.round(F.col(name) + NUDGE, dp) for name in chosen})


def rounded_sql(expression: str, dp: int = 6) -> str:
    """What `rounded` does, in SQL."""
    return f"round({expression} + {NUDGE}, {dp})"


def six(*names: str) -> str:
    """`rounded` columns as SQL select items."""
    return ", ".join(f"{rounded_sql(name)} AS {name}" for name in names)
