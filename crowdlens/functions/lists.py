"""Comma-joined lists kept in string columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_list(text: Column, sep: str = ",") -> Column:
    """Trimmed, non-empty items; null becomes an empty array."""
    items = F.filter(F.transform(F.split(text, re.escape(sep)), lambda item: F.trim(item)), lambda item: F.length(item) > 0)
    return F.coalesce(items, F.array().cast("array<string>"))


def counted_list(text: Column, empty: tuple = ("None",), sep: str = ",") -> Column:
    """Number of items, without keeping them; null and the `empty` markers count 0."""
    is_empty = text.isNull()
    if empty:
        is_empty = is_empty | text.isin(*empty)
    return F.when(is_empty, F.lit(0)).otherwise(F.array_size(F.split(text, re.escape(sep))))
