"""Text models on the labelled documents: fitted on one side of a grouped split, scored on the other.

"""

from __future__ import annotations

from functools import partial

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.catalog import tables
from crowdlens.catalog.label_queries import split_sql
from crowdlens.catalog.registry import query
from crowdlens.catalog.tables import CTE_DOCUMENT, CTE_SCORES
from crowdlens.catalog.text_queries import tokens_sql
from crowdlens.operators import split
from crowdlens.operators.latency import sweep_pct_of_best
from crowdlens.operators.metrics import gap_decomposition
from crowdlens.operators.text_model import TextModel, fit_text_model
from crowdlens.params import TextParams
from crowdlens.plans.baselines import Baselines
from crowdlens.session import stage, stage_path

# The full sizes of terms, selection, dimensions, iterations, boosting and widths.
PARAMS = TextParams()
WIDTHS = (256, 1_000, 5_000, 20_000, 100_000, 200_000)

# Fits are iterative, so SQL checks what must hold of them: which rows and labels are scored, and that every score is a
# probability, every arm better than chance.
TEST_ROWS = f"""WITH {CTE_SCORES}, held AS (
  SELECT doc_id FROM documents WHERE {split_sql('source')} = 'test')
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(label AS INT) AS label, CAST(y AS INT) AS y, TRUE AS is_probability
FROM scores JOIN held USING (doc_id)"""
SIDES = f"""WITH {CTE_DOCUMENT}, side AS (
  SELECT labelled.doc_id, s AS split FROM labelled JOIN (SELECT doc_id, {split_sql('source')} AS s FROM documents) USING (doc_id))"""


def sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = tables.labelled_documents(spark, sf).select("doc_id", "source", "text", "n_chars", "labels")
    docs = stage(split.grouped_split(docs, "source", method="md5"), "split")
    return split.split_slice(docs, "train"), split.split_slice(docs, "test")


def baselines(spark, sf) -> Baselines:
    return Baselines(*sides(spark, sf), PARAMS, numeric=["n_chars"])


def _arm(spark, sf, arm: str) -> DataFrame:
    return baselines(spark, sf).scores(arm).select(
        "doc_id", F.col("label").cast("int").alias("label"), F.col("y").cast("int").alias("y"),
        F.col("score").between(0.0, 1.0).alias("is_probability"))


for _name, _key in (("linear_tfidf", "fit_linear"), ("linear_svd_meta", "fit_linear_dense"), ("xgb_svd_meta", "fit_gbt")):
    query(_key, TEST_ROWS)(partial(_arm, arm=_name))


@query("text_svd", f"""{SIDES} SELECT doc_id, split, least(256, (SELECT count(*) FROM side WHERE split = 'train') - 1)::INT AS dims,
       TRUE AS explains_a_share FROM side""")
def text_svd(spark, sf):
    """Projection of both sides; with fewer documents than dimensions the rank is one less than the documents."""
    left, right, explained = baselines(spark, sf).projected()
    both = left.select("doc_id", "svd", F.lit("train").alias("split")).unionByName(
        right.select("doc_id", "svd", F.lit("test").alias("split")))
    return both.select("doc_id", "split", F.size(vector_to_array("svd")).alias("dims"),
                       F.lit(0.0 < explained <= 1.0 + 1e-9).alias("explains_a_share"))


@query("baseline_report", f"""{SIDES}, held AS (SELECT count(*) AS n FROM side WHERE split = 'test')
SELECT arm, n AS test_rows, TRUE AS above_floor, TRUE AS gap_adds_up
FROM held, (VALUES ('linear_tfidf'), ('xgb_svd_meta'), ('linear_svd_meta'), ('linear_svd_only')) AS a(arm)""")
def baseline_report(spark, sf):
    """All arms are measured on the same rows, so that their gaps can be taken apart: the linear arm on the trees' features lies between
    the sparse arm and the trees."""
    found = stage(baselines(spark, sf).report(), "report")
    gap = gap_decomposition(found, "linear_tfidf", "linear_svd_meta", "xgb_svd_meta").head()
    adds_up = abs(gap.representation_gap + gap.model_gap - gap.total_gap) < 1e-9
    return found.select("arm", "test_rows", (F.col("macro_average_precision") > F.col("macro_prevalence_floor")).alias(
        "above_floor"), F.lit(adds_up).alias("gap_adds_up"))


@query("vocab_sweep", f"""{SIDES}, train AS (
  SELECT doc_id, text FROM documents JOIN (SELECT doc_id FROM side WHERE split = 'train') USING (doc_id)),
{tokens_sql('train')},
available AS (SELECT count(*) AS n FROM (SELECT term FROM tokens GROUP BY term HAVING count(*) >= {PARAMS.min_df}))
SELECT least(k, n)::INT AS k, TRUE AS above_floor, TRUE AS is_share FROM available, (VALUES {', '.join(f'({k})' for k in WIDTHS)}) AS p(k)""")
def vocab_sweep(spark, sf):
    """One row for each width; those beyond the available terms stand for all of them."""
    found = sweep_pct_of_best(stage(baselines(spark, sf).sweep(WIDTHS), "sweep"))
    return found.select("k", (F.col("macro_average_precision") > F.col("macro_prevalence_floor")).alias("above_floor"),
                        F.col("pct_of_best").between(0, 100).alias("is_share"))


@query("score_reviews", "SELECT doc_id, TRUE AS has_at_most_three, TRUE AS in_order FROM documents")
def score_reviews(spark, sf):
    """A fitted, saved and loaded model on all documents, labelled or not."""
    train, _ = sides(spark, sf)
    path = stage_path(spark, "model")
    fit_text_model(train, tables.LABEL_NAMES, PARAMS).save(path)
    best = TextModel.load(spark, path).predict(tables.read(spark, sf, "documents").select("doc_id", "text"), 3, 0.1)
    p = F.transform("predictions", lambda x: x["probability"])
    return best.select("doc_id", (F.size("predictions") <= 3).alias("has_at_most_three"),
                       ((p == F.reverse(F.array_sort(p))) & F.forall(p, lambda x: (x >= 0.1) & (x <= 1))).alias("in_order"))
