"""From per-label probabilities to the categories shown to a reader."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def topk_categories(probabilities: Column, categories: Sequence[str], k: int = 5, floor: float = 0.0, dp: int = 5) -> Column:
    """The `k` most probable categories, best first, then without those below `floor`.

    array<struct<category, probability>>; equal probabilities keep label order.
    """
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    if not 0.0 <= floor <= 1.0:
        raise ValueError("floor must be between 0 and 1")
    names = F.from_json(F.lit(json.dumps(list(categories))), "array<string>")
    ranked = F.array_sort(F.transform(
        probabilities, lambda p, i: F.struct((-p).alias("negated"), i.alias("idx"))
    ))
    best = F.filter(F.slice(ranked, 1, k), lambda item: -item["negated"] >= F.lit(floor))
    return F.transform(best, lambda item: F.struct(
        F.element_at(names, item["idx"] + 1).alias("category"),
        F.round(-item["negated"], dp).alias("probability"),
    ))
