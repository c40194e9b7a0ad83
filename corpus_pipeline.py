"""From raw documents to packed batches: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all rows its predecessor kept and returns the columns of the documents, but for the last, which returns
one row per text with its place in a batch. Odd rows are treated as the operators say; empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.llm import classifier, decontaminate, jaccard_join, packing, pii
from crowdlens.llm.queries import LEARN, table
from crowdlens.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good stay."""
    return classifier.judge(docs, table(spark, sf_dir, "labels"), LEARN).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles, similarity 0.8 or more."""
    return jaccard_join.one_of_each(docs, jaccard_join.Settings(k=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated with benchmark items go."""
    return decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, personal data is replaced by its kind, and n_chars follows the text."""
    row = F.col("row").withField("text", F.col("masked"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("masked").cast(docs.schema["n_chars"].dataType))
    return pii.find(docs, mask=True).select(row.alias("row")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text with its place in a batch; nothing is dropped, and null or empty texts are packed as `packing` says."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Trained models and connected components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
