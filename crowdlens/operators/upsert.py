"""Merging keyed results into a table of earlier ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def metrics_upsert(old: DataFrame, new: DataFrame, key: Sequence[str] = ("arm",)) -> DataFrame:
    """Rows of `new`, and the rows of `old` whose key is not replaced."""
    untouched = old.join(new.select(*key).distinct(), list(key), "left_anti")
    return untouched.unionByName(new, allowMissingColumns=True)
