"""The test tables in the roles of businesses, reviews, users and labelled documents.

One SQL text per role serves Spark (`{part}` is a DataFrame) and the check in SQL (`{part}` is a view).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.functions.text import text_fingerprint, word_count

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

BUSINESS = """
SELECT p_partkey AS business_id, p_name AS name, p_brand AS city, p_type AS state,
       concat_ws(', ', p_type, p_brand, replace(p_name, ' ', ', ')) AS categories,
       CAST(p_size % 2 AS INT) AS is_open
FROM {part}
"""

REVIEW = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING)) AS review_id,
       o_custkey AS user_id, l_partkey AS business_id,
       CAST(1 + CAST(l_quantity AS INT) % 5 AS DOUBLE) AS stars,
       concat_ws(' ', p_name, l_returnflag, l_linestatus, o_orderpriority) AS text,
       l_shipdate AS ts, CAST(l_shipdate AS DATE) AS review_date, CAST(year(l_shipdate) AS INT) AS year
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""

USER = """
SELECT c_custkey AS user_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS fans,
       CAST(c_custkey % 200 AS BIGINT) AS review_count, CAST(c_nationkey * 3 AS BIGINT) AS useful,
       CAST(1 + (c_custkey % 41) / 10.0e0 AS DOUBLE) AS average_stars,
       CAST(CAST('1995-01-01' AS DATE) + CAST(c_custkey % 1500 AS INT) AS DATE) AS yelping_since,
       CASE WHEN c_custkey % 7 = 0 THEN 'None'
            ELSE concat(repeat('x,', CAST(c_custkey % 5 AS INT)), 'x') END AS friends,
       CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '2010,2011' END AS elite
FROM {customer}
"""

# Documents with six labels in fixed order, and six scores that need no training (with ties).
LABEL_NAMES = ("en", "fr", "de", "es", "quality", "toxic")
LABELLED_DOCUMENT = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic,
       d.n_chars / (d.n_chars + 1000.0e0) AS base
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""
SCORE_TERMS = (
    "base", "1.0e0 - base", "(doc_id % 10) / 10.0e0", "(n_chars % 100) / 100.0e0", "base",
    "(doc_id % 7 + n_chars % 5) / 11.0e0",
)
LABEL_TERMS = (
    *[f"CASE WHEN lang = '{name}' THEN 1 ELSE 0 END" for name in LABEL_NAMES[:4]],
    *[f"CAST({name} AS INT)" for name in LABEL_NAMES[4:]],
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _role(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    return spark.sql(text, **{name: read(spark, sf_dir, name) for name in names})


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role(spark, sf_dir, BUSINESS, "part")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the columns that ingest derives."""
    raw = _role(spark, sf_dir, REVIEW, "lineitem", "orders", "part")
    return raw.withColumns({
        "text_len": F.length("text"),
        "word_count": word_count(F.col("text")),
        "text_hash": text_fingerprint(F.col("text")),
    })


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _role(spark, sf_dir, USER, "customer")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their label vector and score vector."""
    docs = _role(spark, sf_dir, LABELLED_DOCUMENT, "documents", "labels")
    return docs.withColumns({
        "labels": F.array(*[F.expr(term) for term in LABEL_TERMS]),
        "scores": F.array(*[F.expr(term) for term in SCORE_TERMS]),
    })


def _views(text: str) -> str:
    return text.format(**{name: name for name in TABLES}).strip()


# The same roles as common table expressions of the SQL checks.
CTE_BUSINESS = f"business AS ({_views(BUSINESS)})"
CTE_REVIEW = f"review AS ({_views(REVIEW)})"
CTE_USER = f"user_profile AS ({_views(USER)})"
CTE_DOCUMENT = f"labelled AS ({_views(LABELLED_DOCUMENT)})"
CTE_SCORES = CTE_DOCUMENT + ", scores AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {j} AS label, {y} AS y, {s} AS score FROM labelled"
    for j, (y, s) in enumerate(zip(LABEL_TERMS, SCORE_TERMS))
) + ")"
