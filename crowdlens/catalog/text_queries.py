"""Tokens, TF-IDF, term selection and the text models on the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.catalog import tables
from crowdlens.catalog.registry import query, rounded, six
from crowdlens.catalog.tables import CTE_DOCUMENT, LABEL_TERMS
from crowdlens.operators import terms
from crowdlens.params import TextParams

# The sizes of the jobs: 200,000 terms, 20,000 selected. Each query has a second name, `..._full`, from when the first one was smaller.
PARAMS = TextParams()
MIN_DF, MAX_FEATURES, SELECT_K = PARAMS.min_df, PARAMS.max_features, PARAMS.select_k


def tokens_sql(source: str) -> str:
    return f"""words AS (
  SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {source}
),
grams AS (
  SELECT doc_id, unnest(w) AS term FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
),
tokens AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL)"""


def tfidf_sql(source: str, max_features: int = MAX_FEATURES) -> str:
    return f"""{tokens_sql(source)},
stats AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS term_count, count(*) AS df FROM tokens GROUP BY term
  HAVING count(*) >= {MIN_DF} ORDER BY term_count DESC, term LIMIT {max_features}
),
raw_weights AS (
  SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + df)) + 1) AS w
  FROM tokens JOIN stats USING (term)
),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw_weights)"""


def weighted(docs: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    n_docs, chars = terms.text_size(docs)
    vocabulary = terms.vocabulary_of(docs, MIN_DF, max_features, chars=chars)
    return terms.tfidf(terms.tokenise(docs, chars=chars), vocabulary, n_docs, vocabulary_rows=max_features)


@query("tokenise", f"WITH {tokens_sql('documents')} SELECT doc_id, term, tf FROM tokens")
def tokenise(spark, sf):
    return terms.tokenise(tables.read(spark, sf, "documents"))


TERM_STATS = f"""WITH {tokens_sql('documents')}
SELECT term, CAST(sum(tf) AS BIGINT) AS term_count, count(*) AS df FROM tokens GROUP BY term
HAVING count(*) >= {MIN_DF} ORDER BY term_count DESC, term LIMIT {MAX_FEATURES}"""


@query("term_stats_full", TERM_STATS)
@query("term_stats", TERM_STATS)
def term_stats(spark, sf):
    return terms.vocabulary_of(tables.read(spark, sf, "documents"), MIN_DF, MAX_FEATURES)


TFIDF = f"WITH {tfidf_sql('documents')} SELECT doc_id, term, {six('w')} FROM weights"


@query("tfidf_full", TFIDF)
@query("tfidf", TFIDF)
def tfidf(spark, sf):
    return rounded(weighted(tables.read(spark, sf, "documents")))


@query("tfidf_unbounded", f"""WITH {tokens_sql('documents')},
stats AS (SELECT term, count(*) AS df FROM tokens GROUP BY term HAVING count(*) >= {MIN_DF}),
raw_weights AS (
  SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w
  FROM tokens JOIN stats USING (term)
)
SELECT doc_id, count(*) AS terms, round(max(w) / sqrt(sum(w * w)) + 1e-10, 6) AS top_weight FROM raw_weights GROUP BY doc_id""")
def tfidf_unbounded(spark, sf):
    """No limit on the vocabulary: frequent terms are broadcast, the others shuffled."""
    docs = tables.read(spark, sf, "documents")
    n_docs, chars = terms.text_size(docs)
    vocabulary = terms.vocabulary_of(docs, MIN_DF, None, chars=chars)
    weights = terms.tfidf(terms.tokenise(docs, chars=chars), vocabulary, n_docs, hot_rows=200, parts=terms.text_parts(docs, chars))
    return rounded(weights.groupBy("doc_id").agg(F.count("*").alias("terms"), F.max("w").alias("top_weight")))


_LABEL_COLUMNS = ", ".join(f"{term} AS y{j}" for j, term in enumerate(LABEL_TERMS))
_SUMS = ", ".join(f"sum(w * y{j}) AS o{j}" for j in range(len(LABEL_TERMS)))
_SHARES = ", ".join(f"avg(y{j}) AS p{j}" for j in range(len(LABEL_TERMS)))
_CHI2 = ", ".join(
    f"CASE WHEN p{j} > 0 AND p{j} < 1 THEN (o{j} - p{j} * f) ** 2 / (p{j} * f) + "
    f"((f - o{j}) - (1 - p{j}) * f) ** 2 / ((1 - p{j}) * f) END" for j in range(len(LABEL_TERMS))
)


CHI2 = f"""WITH {CTE_DOCUMENT}, {tfidf_sql('labelled')},
targets AS (SELECT doc_id, {_LABEL_COLUMNS} FROM labelled), shares AS (SELECT {_SHARES} FROM targets),
sums AS (SELECT term, sum(w) AS f, {_SUMS} FROM weights JOIN targets USING (doc_id) GROUP BY term),
scored AS (SELECT term, greatest({_CHI2}) AS chi2 FROM sums CROSS JOIN shares)
SELECT term, round(round(chi2, 9) + 1e-10, 6) AS chi2, CAST(row_number() OVER (ORDER BY round(chi2, 9) DESC, term) AS INT) AS rank
FROM scored ORDER BY round(chi2, 9) DESC, term LIMIT {SELECT_K}"""


@query("chi2_select_full", CHI2)
@query("chi2_select", CHI2)
def chi2_select(spark, sf):
    docs = tables.labelled_documents(spark, sf)
    scores = terms.chi2_scores(weighted(docs), docs)
    return rounded(terms.chi2_select(scores.withColumn("chi2", F.round("chi2", 9)), SELECT_K))
