"""Build the labelled review table from the ingested entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crowdlens.operators.features import review_labeled
from crowdlens.operators.labels import label_vocabulary, vocabulary_list
from crowdlens.operators.split import split_leakage, split_summary
from crowdlens.params import LabelParams
from crowdlens.session import stage
from crowdlens.sources.lake import write_parquet


class LeakingSplit(RuntimeError):
    """A group has rows on both sides of the split."""


def run(spark: SparkSession, root: str, out: str, params: LabelParams = LabelParams()) -> DataFrame:
    """Write the vocabulary and the table (one folder per side of the split); return the summary."""
    businesses = spark.read.parquet(f"{root}/business")
    vocabulary = stage(label_vocabulary(businesses, k=params.top_k, stoplist=params.stoplist), "vocabulary")
    write_parquet(vocabulary, f"{out}/category_vocab")
    table = review_labeled(
        spark.read.parquet(f"{root}/review"), businesses, spark.read.parquet(f"{root}/user"),
        vocabulary_list(vocabulary), params,
    )
    write_parquet(table.hint("rebalance", "split"), f"{out}/review_labeled", ["split"])
    written = spark.read.parquet(f"{out}/review_labeled")
    if split_leakage(written).head().leaking_groups:
        raise LeakingSplit("a business has reviews on both sides of the split")
    return split_summary(written)
