"""Label vocabulary, vectors, the labelled review table, split and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.catalog import tables
from crowdlens.catalog.registry import query, rounded
from crowdlens.catalog.tables import CTE_BUSINESS, CTE_DOCUMENT, CTE_REVIEW, CTE_USER, LABEL_TERMS
from crowdlens.functions.lists import clean_list, counted_list
from crowdlens.functions.numeric import finite_or_zero
from crowdlens.operators import features, labels, split
from crowdlens.params import LabelParams
from crowdlens.session import stage_path
from crowdlens.sources import lake

K = 12
STOPLIST = ("STANDARD", "ECONOMY")
PARAMS = LabelParams(top_k=K, stoplist=STOPLIST, min_chars=24, split_hash="md5")


def listed_businesses(spark, sf) -> DataFrame:
    return tables.businesses(spark, sf).withColumn("category_list", clean_list(F.col("categories")))


def categories(spark, sf) -> list[str]:
    return labels.vocabulary_list(labels.label_vocabulary(listed_businesses(spark, sf), k=K, stoplist=STOPLIST))


def labelled_reviews(spark, sf) -> DataFrame:
    users = tables.users(spark, sf).select(
        "user_id", "review_count", "average_stars", "fans", "useful",
        counted_list(F.col("friends"), ("None",)).alias("friend_count"),
        counted_list(F.col("elite"), ("",)).alias("elite_years"),
        F.col("yelping_since").alias("yelping_since_ts"),
    )
    return features.review_labeled(
        tables.reviews(spark, sf), listed_businesses(spark, sf), users, categories(spark, sf), PARAMS
    )


_STOP = ", ".join(f"'{name}'" for name in STOPLIST)
CTE_VOCABULARY = f"""{CTE_BUSINESS},
vocabulary AS (
  SELECT CAST(row_number() OVER (ORDER BY n DESC, category) - 1 AS INT) AS idx, category, n FROM (
    SELECT category, count(*) AS n FROM (SELECT trim(unnest(string_split(categories, ','))) AS category FROM business)
    WHERE category NOT IN ({_STOP}) AND len(category) > 0 GROUP BY category ORDER BY n DESC, category LIMIT {K}
  )
)"""
CTE_VECTORS = f"""{CTE_VOCABULARY},
flags AS (
  SELECT business_id, idx, CAST(list_contains(string_split(categories, ', '), category) AS INT) AS flag
  FROM business CROSS JOIN vocabulary
),
vectors AS (
  SELECT business_id, string_agg(flag::VARCHAR, ',' ORDER BY idx) AS labels, CAST(sum(flag) AS INT) AS n_labels
  FROM flags GROUP BY business_id HAVING sum(flag) > 0
)"""


def split_sql(key: str) -> str:
    return (f"CASE WHEN ('0x' || substr(md5('cci-v1|' || {key}), 1, 8))::BIGINT % 1000 < 200 "
            "THEN 'test' ELSE 'train' END")


CTE_LABELLED = f"""{CTE_VECTORS}, {CTE_REVIEW}, {CTE_USER},
labelled AS (
  SELECT review_id, business_id, r.user_id, text, CAST(length(text) AS INT) AS text_len, review_date,
         stars AS review_stars, labels, n_labels, review_count AS user_review_count, fans AS user_fans,
         CAST(review_date - yelping_since AS INT) AS account_age_days_at_review,
         round(stars - coalesce(average_stars, stars) + 1e-10, 6) AS star_deviation_from_user_mean,
         CAST(CASE WHEN friends = 'None' THEN 0 ELSE len(string_split(friends, ',')) END AS INT) AS friend_count,
         {split_sql('business_id::VARCHAR')} AS split
  FROM review r JOIN vectors USING (business_id) LEFT JOIN user_profile u ON u.user_id = r.user_id
  WHERE length(text) >= 24 AND r.user_id IS NOT NULL
)"""


@query("label_vocabulary", f"WITH {CTE_VOCABULARY} SELECT idx, category, n FROM vocabulary")
def label_vocabulary(spark, sf):
    return labels.label_vocabulary(listed_businesses(spark, sf), k=K, stoplist=STOPLIST)


@query("attach_labels", f"WITH {CTE_VECTORS} SELECT business_id, labels, n_labels FROM vectors")
def attach_labels(spark, sf):
    found = labels.attach_labels(listed_businesses(spark, sf), categories(spark, sf))
    return found.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), ","))


@query("label_cooccurrence", f"""WITH {CTE_VECTORS}, totals AS (SELECT idx, sum(flag) AS c FROM flags GROUP BY idx),
pairs AS (
  SELECT a.idx AS idx_a, b.idx AS idx_b, count(*) AS n_both FROM flags a JOIN flags b
  ON a.business_id = b.business_id AND a.idx < b.idx AND a.flag = 1 AND b.flag = 1 GROUP BY ALL
)
SELECT idx_a, idx_b, n_both, round(n_both / (a.c + b.c - n_both) + 1e-10, 6) AS jaccard
FROM pairs JOIN totals a ON a.idx = idx_a JOIN totals b ON b.idx = idx_b""")
def label_cooccurrence(spark, sf):
    return rounded(labels.label_cooccurrence(labels.attach_labels(listed_businesses(spark, sf), categories(spark, sf))))


@query("reviewer_features", f"""WITH {CTE_USER}
SELECT user_id, review_count AS user_review_count, average_stars AS user_average_stars, fans AS user_fans,
       useful AS user_useful_votes FROM user_profile""")
def reviewer_features(spark, sf):
    return features.reviewer_features(tables.users(spark, sf), features.AUTHOR_COLUMNS[:4])


@query("review_labeled", f"WITH {CTE_LABELLED} SELECT * FROM labelled")
def review_labeled(spark, sf):
    return rounded(labelled_reviews(spark, sf).select(
        "review_id", "business_id", "user_id", "text", "text_len", "review_date", "review_stars",
        F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"), "n_labels", "user_review_count",
        "user_fans", "account_age_days_at_review", "star_deviation_from_user_mean", "friend_count", "split",
    ), "star_deviation_from_user_mean")


@query("grouped_split", f"SELECT doc_id, source, {split_sql('source')} AS split FROM documents")
def grouped_split(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "source")
    return split.grouped_split(docs, "source", method="md5")


@query("grouped_split_xxhash64", """SELECT doc_id, source, TRUE AS whole_group FROM documents""")
def grouped_split_xxhash64(spark, sf):
    """The default hash, which the checking engine does not have: every group lies whole on one side."""
    docs = split.grouped_split(tables.read(spark, sf, "documents").select("doc_id", "source"), "source")
    sides = docs.groupBy("source").agg((F.min("split") == F.max("split")).alias("whole_group"))
    return docs.select("doc_id", "source").join(sides, "source").select("doc_id", "source", "whole_group")


@query("split_summary", f"""WITH {CTE_LABELLED}
SELECT split, count(*) AS rows, count(DISTINCT business_id) AS businesses, count(DISTINCT user_id) AS users,
       round(avg(n_labels), 3) AS avg_labels FROM labelled GROUP BY split""")
def split_summary(spark, sf):
    return split.split_summary(labelled_reviews(spark, sf))


@query("split_leakage", f"""WITH {CTE_LABELLED}, sides AS (
  SELECT business_id, count(DISTINCT split) AS s, min(split) AS low FROM labelled GROUP BY business_id
)
SELECT count(*) AS groups, count_if(s > 1)::BIGINT AS leaking_groups,
       round(avg(CASE WHEN low = 'test' THEN 1.0 ELSE 0.0 END) + 1e-10, 6) AS test_share FROM sides""")
def split_leakage(spark, sf):
    return rounded(split.split_leakage(labelled_reviews(spark, sf)))


@query("split_slice", f"WITH {CTE_LABELLED} SELECT review_id, business_id, text FROM labelled WHERE split = 'test'")
def split_slice(spark, sf):
    """The table written with one folder per side, and one side read back."""
    path = stage_path(spark, "review-labeled")
    lake.write_parquet(labelled_reviews(spark, sf).hint("rebalance", "split"), path, ["split"])
    return split.split_slice(spark.read.parquet(path), "test").select("review_id", "business_id", "text")


@query("label_prevalence", f"""WITH {CTE_DOCUMENT}, scores AS ({' UNION ALL '.join(
    f'SELECT {j} AS idx, {term} AS y FROM labelled' for j, term in enumerate(LABEL_TERMS))})
SELECT idx, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS positives, round(avg(y) + 1e-10, 6) AS prevalence,
       sum(y) = 0 OR sum(y) = count(*) AS is_constant FROM scores GROUP BY idx""")
def label_prevalence(spark, sf):
    return rounded(labels.label_prevalence(tables.labelled_documents(spark, sf)))


@query("label_class_weights", f"""WITH {CTE_DOCUMENT}, scores AS ({' UNION ALL '.join(
    f'SELECT {j} AS idx, {term} AS y FROM labelled' for j, term in enumerate(LABEL_TERMS))}),
counts AS (SELECT idx, CAST(sum(y) AS BIGINT) AS positives, (count(*) - sum(y)) / greatest(sum(y), 1) AS ratio
           FROM scores GROUP BY idx)
SELECT idx, positives, round(least(greatest(ratio, 1.0), 20.0)::DOUBLE + 1e-10, 6) AS pos_weight,
       CASE WHEN positives > 0 THEN round(greatest(ratio, 1.0)::DOUBLE + 1e-10, 6) END AS scale_pos_weight FROM counts""")
def label_class_weights(spark, sf):
    prevalence = labels.label_prevalence(tables.labelled_documents(spark, sf))
    return rounded(labels.label_class_weights(prevalence))


@query("clean_numeric", """SELECT doc_id, coalesce(CASE WHEN n_chars % 4 = 0 THEN NULL WHEN n_chars % 4 = 1 THEN 0.0
       WHEN n_chars % 4 = 2 THEN 0.0 ELSE n_chars / 7.0 END, 0.0)::DOUBLE AS number FROM documents""")
def clean_numeric(spark, sf):
    """Null, NaN and infinity in place of three of four numbers."""
    number = (
        F.when(F.col("n_chars") % 4 == 0, F.lit(None).cast("double"))
        .when(F.col("n_chars") % 4 == 1, F.lit(float("nan")))
        .when(F.col("n_chars") % 4 == 2, F.lit(float("-inf")))
        .otherwise(F.col("n_chars") / 7.0)
    )
    return tables.read(spark, sf, "documents").select("doc_id", finite_or_zero(number).alias("number"))


@query("hash_sample", f"""SELECT doc_id, source, lang FROM documents
WHERE md5('17|' || doc_id) < '{split.md5_threshold(0.25)}'""")
def hash_sample(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "source", "lang")
    return split.hash_sample(docs, "doc_id", 0.25, method="md5")


@query("bounded_sample", "SELECT doc_id, quality FROM labels ORDER BY md5('17|' || doc_id), doc_id LIMIT 100")
def bounded_sample(spark, sf):
    """100 rows of a larger table."""
    found = tables.read(spark, sf, "labels").select("doc_id", "quality")
    return split.bounded_sample(found, "doc_id", 100, method="md5")
