"""Ranking metrics, comparisons of runs, predictions and validation on the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.catalog import tables
from crowdlens.catalog.registry import query, rounded, six
from crowdlens.catalog.tables import CTE_DOCUMENT, CTE_SCORES, LABEL_NAMES, SCORE_TERMS
from crowdlens.operators import latency, metrics, predictions, upsert, validation


def document_scores(spark, sf) -> DataFrame:
    return metrics.scores_long(tables.labelled_documents(spark, sf), "labels", "scores", ["doc_id"])


def report_ctes(scores: str, prefix: str = "") -> str:
    """SQL of the per-label and overall report on a table (label, y, score)."""
    return f"""{prefix}points AS (SELECT label, score, sum(y) AS tp, count(*) AS n FROM {scores} GROUP BY ALL),
{prefix}curve AS (
  SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER p AS pos, sum(n) OVER p AS total
  FROM {prefix}points WINDOW w AS (PARTITION BY label ORDER BY score DESC), p AS (PARTITION BY label)
),
{prefix}areas AS (
  SELECT label, max(total) AS n_rows, max(pos) AS positives, max(pos)::DOUBLE / max(total) AS prevalence,
         sum(tp * ctp::DOUBLE / cn) / max(pos) AS ap,
         sum(tp * ((total - pos) - (cn - ctp) + (n - tp) / 2.0::DOUBLE)) / (max(pos) * (max(total) - max(pos))) AS auc
  FROM {prefix}curve GROUP BY label
),
{prefix}per_label AS (
  SELECT label, n_rows, positives, prevalence,
         CASE WHEN positives > 0 AND positives < n_rows THEN ap END AS average_precision,
         CASE WHEN positives > 0 AND positives < n_rows THEN auc END AS roc_auc,
         CASE WHEN positives > 0 AND positives < n_rows THEN ap / prevalence END AS lift
  FROM {prefix}areas
),
{prefix}micro AS (
  SELECT sum(tp * ctp::DOUBLE / cn) / sum(tp) AS micro_average_precision FROM (
    SELECT tp, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(n) OVER (ORDER BY score DESC) AS cn
    FROM (SELECT score, sum(y) AS tp, count(*) AS n FROM {scores} GROUP BY score))
),
{prefix}report AS (
  SELECT avg(average_precision) AS macro_average_precision,
         avg(prevalence) FILTER (average_precision IS NOT NULL) AS macro_prevalence_floor,
         (SELECT micro_average_precision FROM {prefix}micro) AS micro_average_precision,
         count(average_precision) AS n_labels_scored, CAST(max(n_rows) AS BIGINT) AS test_rows,
         avg(average_precision) / avg(prevalence) FILTER (average_precision IS NOT NULL) AS macro_lift
  FROM {prefix}per_label
)"""


_REPORT = report_ctes("scores")
_REPORT_COLUMNS = (
    f"{six('macro_average_precision', 'macro_prevalence_floor', 'micro_average_precision')}, "
    f"n_labels_scored, test_rows, {six('macro_lift')}"
)


@query("average_precision", f"""WITH {CTE_SCORES}, {_REPORT}
SELECT CAST(label AS INT) AS label, {six('prevalence', 'average_precision', 'lift')} FROM per_label""")
def average_precision(spark, sf):
    found = metrics.label_metrics(document_scores(spark, sf))
    return rounded(found.select("label", "prevalence", "average_precision", "lift"))


@query("roc_auc", f"WITH {CTE_SCORES}, {_REPORT} SELECT CAST(label AS INT) AS label, {six('roc_auc')} FROM per_label")
def roc_auc(spark, sf):
    return rounded(metrics.label_metrics(document_scores(spark, sf)).select("label", "roc_auc"))


@query("multilabel_report", f"WITH {CTE_SCORES}, {_REPORT} SELECT {_REPORT_COLUMNS} FROM report")
def multilabel_report(spark, sf):
    return rounded(metrics.multilabel_report(document_scores(spark, sf)))


@query("per_label_report", f"""WITH {CTE_SCORES}, {_REPORT}
SELECT CAST(label AS INT) AS label, CAST(n_rows AS BIGINT) AS n_rows, CAST(positives AS BIGINT) AS positives,
       {six('prevalence', 'average_precision', 'roc_auc', 'lift')} FROM per_label ORDER BY coalesce(lift, 0) DESC, label""")
def per_label_report(spark, sf):
    return rounded(metrics.per_label_report(metrics.label_metrics(document_scores(spark, sf))))


# A second run on the same rows: every score is pulled towards the label.
_AFTER = "after_scores AS (SELECT doc_id, label, y, score * 0.5e0 + y * 0.3e0 + (doc_id % 5) / 20.0e0 AS score FROM scores)"


def after_scores(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.expr("score * 0.5e0 + y * 0.3e0 + (doc_id % 5) / 20.0e0"))


@query("label_delta_regression", f"""WITH {CTE_SCORES}, {_AFTER}, {report_ctes('scores', 'b_')}, {report_ctes('after_scores', 'a_')},
deltas AS (
  SELECT b.prevalence, log10(b.prevalence) AS x, a.average_precision - b.average_precision AS delta
  FROM b_per_label b JOIN a_per_label a USING (label)
  WHERE a.average_precision IS NOT NULL AND b.average_precision IS NOT NULL
),
fit AS (
  SELECT count(*) AS n_labels, regr_slope(delta, x) AS slope, corr(delta, x) AS r, avg(delta) AS mean_delta,
         avg(delta) FILTER (prevalence < 0.01) AS mean_delta_rare, avg(delta) FILTER (prevalence >= 0.10) AS mean_delta_common FROM deltas
),
-- Student's t as a finite series in the angle, by the parity of the degrees of freedom v.
angle AS (SELECT n_labels - 2 AS v, asin(least(abs(r), 1)) AS a FROM fit),
term AS (
  SELECT v, a, k, CASE WHEN v % 2 = 1 THEN cos(a) ** (2 * k - 1) * coalesce(list_product(list_transform(range(1, k), lambda i: 2.0e0 * i / (2 * i + 1))), 1)
                       ELSE cos(a) ** (2 * k - 2) * coalesce(list_product(list_transform(range(1, k), lambda i: (2.0e0 * i - 1) / (2 * i))), 1) END AS t
  FROM angle, unnest(range(1, 1 + v // 2)) AS n(k)
),
series AS (SELECT any_value(angle.v) AS v, any_value(angle.a) AS a, coalesce(sum(t), 0) AS s FROM angle LEFT JOIN term ON true),
tail AS (SELECT CASE WHEN v % 2 = 1 THEN 1 - 2 / pi() * (a + sin(a) * s) ELSE 1 - sin(a) * s END AS p_value FROM series)
SELECT n_labels, round(slope + 1e-10, 6) AS slope, round(r + 1e-10, 6) AS r, round(mean_delta + 1e-10, 6) AS mean_delta,
       round(mean_delta_rare + 1e-10, 6) AS mean_delta_rare, round(mean_delta_common + 1e-10, 6) AS mean_delta_common,
       round(p_value + 1e-10, 6) AS p_value FROM fit, tail""")
def label_delta_regression(spark, sf):
    scores = document_scores(spark, sf)
    return rounded(metrics.label_delta_regression(
        metrics.label_metrics(scores), metrics.label_metrics(after_scores(scores))
    ))


def arms(spark, sf) -> DataFrame:
    """Reports of three scorings of the same rows."""
    scores = document_scores(spark, sf)
    variants = {
        "linear_tfidf": after_scores(scores),
        "linear_svd_meta": scores.withColumn("score", F.expr("score * 0.5e0 + y * 0.1e0")),
        "trees_svd_meta": scores,
    }
    table = None
    for name, variant in variants.items():
        row = metrics.multilabel_report(variant).withColumn("arm", F.lit(name))
        table = row if table is None else table.unionByName(row)
    return table


_MIDDLE = "middle_scores AS (SELECT doc_id, label, y, score * 0.5e0 + y * 0.1e0 AS score FROM scores)"
CTE_ARMS = f"""{CTE_SCORES}, {_AFTER}, {_MIDDLE}, {report_ctes('after_scores', 's_')}, {report_ctes('middle_scores', 'd_')},
{report_ctes('scores', 't_')}, arms AS (
  SELECT 'linear_tfidf' AS arm, * FROM s_report UNION ALL SELECT 'linear_svd_meta', * FROM d_report
  UNION ALL SELECT 'trees_svd_meta', * FROM t_report
)"""


@query("arm_comparison", f"WITH {CTE_ARMS} SELECT arm, {_REPORT_COLUMNS} FROM arms")
def arm_comparison(spark, sf):
    return rounded(arms(spark, sf))


@query("gap_decomposition", f"""WITH {CTE_ARMS}, wide AS (
  SELECT max(test_rows) AS test_rows, max(macro_average_precision) FILTER (arm = 'linear_tfidf') AS s,
         max(macro_average_precision) FILTER (arm = 'linear_svd_meta') AS d,
         max(macro_average_precision) FILTER (arm = 'trees_svd_meta') AS t FROM arms
)
SELECT test_rows, round(s - t + 1e-10, 6) AS total_gap, round(s - d + 1e-10, 6) AS representation_gap, round(d - t + 1e-10, 6) AS model_gap,
       round((s - d) / (s - t) + 1e-10, 6) AS representation_share FROM wide""")
def gap_decomposition(spark, sf):
    return rounded(metrics.gap_decomposition(arms(spark, sf), "linear_tfidf", "linear_svd_meta", "trees_svd_meta"))


@query("metrics_upsert", f"""WITH {CTE_ARMS}
SELECT arm, CASE WHEN arm = 'trees_svd_meta' THEN 'first' ELSE 'second' END AS run,
       round(CASE WHEN arm = 'trees_svd_meta' THEN macro_average_precision ELSE micro_average_precision END + 1e-10, 6) AS value
FROM arms""")
def metrics_upsert(spark, sf):
    """A second run reports two of three arms; the third keeps its first result."""
    found = arms(spark, sf)
    old = found.select("arm", F.lit("first").alias("run"), F.col("macro_average_precision").alias("value"))
    new = found.where(F.col("arm").startswith("linear")).select(
        "arm", F.lit("second").alias("run"), F.col("micro_average_precision").alias("value")
    )
    return rounded(upsert.metrics_upsert(old, new))


_PROBABILITIES = ", ".join(f"({term})::DOUBLE" for term in SCORE_TERMS)
_NAMES = ", ".join(f"'{name}'" for name in LABEL_NAMES)


@query("topk_categories", f"""WITH {CTE_DOCUMENT}, p AS (SELECT doc_id, [{_PROBABILITIES}] AS v FROM labelled),
flat AS (SELECT doc_id, unnest(v) AS probability, generate_subscripts(v, 1) AS idx FROM p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, idx) AS place FROM flat)
SELECT doc_id, CAST(place AS INT) AS place, [{_NAMES}][idx] AS category, round(probability, 5) AS probability
FROM ranked WHERE place <= 3 AND probability >= 0.4""")
def topk_categories(spark, sf):
    docs = tables.labelled_documents(spark, sf)
    best = predictions.topk_categories(F.col("scores"), LABEL_NAMES, 3, 0.4)
    return docs.select("doc_id", F.posexplode(best).alias("_place", "_best")).select(
        "doc_id", (F.col("_place") + 1).alias("place"), "_best.category", "_best.probability"
    )


@query("validate_reviews", """SELECT doc_id, CASE WHEN length(text) < 1 OR length(text) > 20000 THEN '/text'
       WHEN doc_id % 60 < 1 OR doc_id % 60 > 50 THEN '/top_k' END AS first_error
FROM documents WHERE length(text) < 1 OR length(text) > 20000 OR doc_id % 60 < 1 OR doc_id % 60 > 50""")
def validate_reviews(spark, sf):
    """Documents as scoring requests with a top-k; the rejected ones and their first error."""
    requests = tables.read(spark, sf, "documents").select(
        "doc_id", "text", (F.col("doc_id") % 60).alias("top_k"), F.lit(0.5).alias("threshold")
    )
    _, rejected = validation.validate(requests, validation.review_rules("text", "top_k", "threshold"))
    return rejected.select("doc_id", F.col("errors")[0]["pointer"].alias("first_error"))


@query("latency_summary", """SELECT event_type, count(value) AS n, round(avg(value) + 1e-10, 2) AS mean_ms,
       round(quantile_cont(value, 0.5) + 1e-10, 2) AS p50_ms, round(quantile_cont(value, 0.95) + 1e-10, 2) AS p95_ms,
       round(quantile_cont(value, 0.99) + 1e-10, 2) AS p99_ms, round(max(value) + 1e-10, 2) AS max_ms
FROM events GROUP BY event_type""")
def latency_summary(spark, sf):
    found = latency.latency_summary(tables.read(spark, sf, "events"), "value", ["event_type"], dp=9)
    return rounded(found, dp=2)


@query("latency_summary_overall", """SELECT count(value) AS n, round(avg(value) + 1e-10, 2) AS mean_ms,
       round(quantile_cont(value, 0.5) + 1e-10, 2) AS p50_ms, round(quantile_cont(value, 0.95) + 1e-10, 2) AS p95_ms,
       round(quantile_cont(value, 0.99) + 1e-10, 2) AS p99_ms, round(max(value) + 1e-10, 2) AS max_ms FROM events""")
def latency_summary_overall(spark, sf):
    found = latency.latency_summary(tables.read(spark, sf, "events"), "value", dp=9)
    return rounded(found, dp=2)


@query("latency_summary_sketch", """SELECT event_type, count(value) AS n, round(avg(value) + 1e-10, 2) AS mean_ms,
       round(quantile_disc(value, 0.5) + 1e-10, 2) AS p50_ms, round(quantile_disc(value, 0.95) + 1e-10, 2) AS p95_ms,
       round(quantile_disc(value, 0.99) + 1e-10, 2) AS p99_ms, round(max(value) + 1e-10, 2) AS max_ms
FROM events GROUP BY event_type""")
def latency_summary_sketch(spark, sf):
    """The sketch keeps every rank of up to its accuracy of values, so at that size it is exact."""
    found = latency.latency_summary(tables.read(spark, sf, "events"), "value", ["event_type"], exact=False, dp=9,
                                    accuracy=1_000_000)
    return rounded(found, dp=2)


_NULLED = """SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE event_type END AS kind, ts, event_id,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events"""


@query("latency_summary_nulls", f"""SELECT kind, count(value) AS n, round(avg(value) + 1e-10, 2) AS mean_ms,
       round(quantile_cont(value, 0.5) + 1e-10, 2) AS p50_ms, round(quantile_cont(value, 0.95) + 1e-10, 2) AS p95_ms,
       round(quantile_cont(value, 0.99) + 1e-10, 2) AS p99_ms, round(max(value) + 1e-10, 2) AS max_ms
FROM ({_NULLED}) GROUP BY kind""")
def latency_summary_nulls(spark, sf):
    """A null key is a key like others; null values are no values."""
    return rounded(latency.latency_summary(_nulled(spark, sf), "value", ["kind"], dp=9), dp=2)


def _nulled(spark, sf):
    return spark.sql(_NULLED.replace("FROM events", "FROM {events}"), events=tables.read(spark, sf, "events"))


ROLLING_N = 500


@query("rolling_latency", f"""SELECT event_type, event_id, count(value) OVER w AS n, round(avg(value) OVER w + 1e-10, 4) AS mean_ms,
       round(quantile_cont(value, 0.5) OVER w + 1e-10, 4) AS p50_ms, round(quantile_cont(value, 0.95) OVER w + 1e-10, 4) AS p95_ms,
       round(quantile_cont(value, 0.99) OVER w + 1e-10, 4) AS p99_ms, round(max(value) OVER w + 1e-10, 4) AS max_ms
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {ROLLING_N - 1} PRECEDING AND CURRENT ROW)""")
def rolling_latency(spark, sf):
    events = tables.read(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    found = latency.rolling_latency(events, "event_type", ["ts", "event_id"], "value", ROLLING_N, dp=9, block=2 * ROLLING_N)
    return rounded(found.drop("ts"), dp=4)


_OVER = (f"OVER (PARTITION BY kind ORDER BY ts, event_id ROWS BETWEEN {ROLLING_N // 10 - 1} PRECEDING AND CURRENT ROW)")


@query("rolling_latency_nulls", f"""SELECT kind, event_id, count(value) {_OVER} AS n, round(avg(value) {_OVER} + 1e-10, 4) AS mean_ms,
       round(quantile_cont(value, 0.5) {_OVER} + 1e-10, 4) AS p50_ms, round(quantile_cont(value, 0.95) {_OVER} + 1e-10, 4) AS p95_ms,
       round(quantile_cont(value, 0.99) {_OVER} + 1e-10, 4) AS p99_ms, round(max(value) {_OVER} + 1e-10, 4) AS max_ms
FROM ({_NULLED}) WHERE value IS NOT NULL""")
def rolling_latency_nulls(spark, sf):
    """Windows count values, not rows, and a null key is a key like others."""
    found = latency.rolling_latency(_nulled(spark, sf), "kind", ["ts", "event_id"], "value", ROLLING_N // 10, dp=9, block=ROLLING_N)
    return rounded(found.drop("ts"), dp=4)


_CURVE = """curve AS (
  SELECT event_type, CAST(batch_size AS BIGINT) AS batch_size, sum(total) / count(*) AS throughput_per_sec FROM (
    SELECT event_type, user_id, CAST(ts AS DATE) AS day, count(*) AS batch_size, sum(value) AS total
    FROM events GROUP BY ALL) GROUP BY ALL
)"""


def throughput_curve(spark, sf) -> DataFrame:
    """A user's events of a type on one day as a batch: mean total value by batch size, per event type."""
    batches = tables.read(spark, sf, "events").groupBy("event_type", "user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("batch_size"), F.sum("value").alias("_total")
    )
    return batches.groupBy("event_type", "batch_size").agg(F.avg("_total").alias("throughput_per_sec"))


@query("throughput_knee", f"""WITH {_CURVE}, steps AS (
  SELECT *, coalesce(throughput_per_sec >= 1.10 * lag(throughput_per_sec) OVER w, true) AS ok
  FROM curve WINDOW w AS (PARTITION BY event_type ORDER BY batch_size)
), reached AS (SELECT *, bool_and(ok) OVER (PARTITION BY event_type ORDER BY batch_size) AS still FROM steps)
SELECT event_type, max(batch_size) AS knee FROM reached WHERE still GROUP BY event_type""")
def throughput_knee(spark, sf):
    return latency.throughput_knee(throughput_curve(spark, sf), keys=["event_type"])


@query("sweep_pct_of_best", f"""WITH {_CURVE}
SELECT event_type, batch_size, {six('throughput_per_sec')},
       round(100.0 * throughput_per_sec / max(throughput_per_sec) OVER (PARTITION BY event_type) + 1e-10, 6) AS pct_of_best
FROM curve""")
def sweep_pct_of_best(spark, sf):
    return rounded(latency.sweep_pct_of_best(throughput_curve(spark, sf), "throughput_per_sec", ["event_type"]))


