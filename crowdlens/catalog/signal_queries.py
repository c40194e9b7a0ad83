"""Author signals, the scaler, account scores and the review queue."""

from __future__ import annotations

from dataclasses import replace
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.catalog import tables
from crowdlens.catalog.registry import ORACLES, query, rounded, rounded_sql, six
from crowdlens.catalog.tables import CTE_REVIEW, CTE_USER
from crowdlens.functions.numeric import AS241_CENTRE, AS241_FAR_TAIL, AS241_NEAR_TAIL, norm_ppf
from crowdlens.operators import parity, scaler, scoring, signals, validation
from crowdlens.params import SHRUNK_SIGNALS, SIGNALS, QueueParams
from crowdlens.session import stage

# Thresholds at which the filters bite on the test tables.
PARAMS = QueueParams(
    start_date="1995-07-01", end_date="2001-01-01", min_reviews_per_author=25, min_reviews_per_business=30,
    exact_quantiles=True,
)
STEPS = PARAMS.cdf_points - 1


def history(spark, sf) -> DataFrame:
    return signals.reviews_in_window(tables.reviews(spark, sf), PARAMS.start_date, PARAMS.end_date)


def user_dimension(spark, sf) -> DataFrame:
    return tables.users(spark, sf).select(
        "user_id", F.col("yelping_since").alias("yelping_since_ts"), F.col("fans").alias("user_fans"),
    )


def account_signals(spark, sf) -> DataFrame:
    """Signals of all accounts, written once. Nine decimals, so that equal values are equal in any engine."""
    found = signals.reviewer_signals(tables.reviews(spark, sf), user_dimension(spark, sf), PARAMS)
    return stage(found.withColumns({name: F.round(name, 9) for name in SIGNALS}), "signals")


CTE_HISTORY = f"""{CTE_REVIEW},
history AS (
  SELECT * FROM review
  WHERE review_date >= DATE '{PARAMS.start_date}' AND review_date < DATE '{PARAMS.end_date}' AND user_id IS NOT NULL
)"""
CTE_CONSENSUS = f"""consensus AS (
  SELECT business_id, avg(stars) AS business_mean_stars, count(*) AS business_n_reviews
  FROM history GROUP BY business_id HAVING count(*) >= {PARAMS.min_reviews_per_business}
)"""
CTE_BURST = """burst AS (
  SELECT user_id, max(c) AS max_reviews_per_day, count(*) AS active_days, max(c) / count(*)::DOUBLE AS burstiness
  FROM (SELECT user_id, review_date, count(*) AS c FROM history GROUP BY ALL) GROUP BY user_id
)"""
FINGERPRINT = "lower(regexp_replace(text, '[^a-z0-9]+', '', 'g'))"
CTE_DUPLICATION = f"""dup AS (
  SELECT user_id, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS duplicate_reviews,
         sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / sum(c) AS duplication
  FROM (SELECT user_id, {FINGERPRINT} AS t, count(*) AS c FROM history GROUP BY ALL) GROUP BY user_id
)"""
CTE_PROFILE = f"""profile AS (
  SELECT user_id, count(*) AS n_reviews,
         avg(CASE WHEN stars IN (1.0, 5.0) THEN 1.0 ELSE 0.0 END) AS rating_extremity,
         avg(abs(stars - business_mean_stars)) AS deviation,
         min(review_date) AS first_review_date, max(review_date) AS last_review_date,
         avg(length(text)) AS avg_text_len
  FROM history LEFT JOIN consensus USING (business_id)
  GROUP BY user_id HAVING count(*) >= {PARAMS.min_reviews_per_author}
)"""
CTE_SIGNALS = f"""{CTE_HISTORY}, {CTE_USER}, {CTE_CONSENSUS}, {CTE_BURST}, {CTE_DUPLICATION}, {CTE_PROFILE},
signals AS (
  SELECT user_id, n_reviews, first_review_date, last_review_date, avg_text_len, max_reviews_per_day, active_days,
         duplicate_reviews, yelping_since AS yelping_since_ts, fans AS user_fans,
         first_review_date - yelping_since AS days_to_first_review,
         round(burstiness, 9) AS burstiness, round(coalesce(duplication, 0), 9) AS duplication,
         round(rating_extremity, 9) AS rating_extremity, round(coalesce(deviation, 0), 9) AS deviation,
         round(1.0 / ln(greatest(coalesce(first_review_date - yelping_since, 0), 0) + 2.0), 9) AS precocity
  FROM profile LEFT JOIN burst USING (user_id) LEFT JOIN dup USING (user_id) LEFT JOIN user_profile USING (user_id)
)"""
_PRIORS = ", ".join(f"avg({name}) AS {name}" for name in SHRUNK_SIGNALS)
_SHRUNK = ", ".join(
    f"(n_reviews * s.{name} + 10.0 * p.{name}) / (n_reviews + 10.0) AS s_{name}" for name in SHRUNK_SIGNALS
)
CTE_SHRUNK = f"""{CTE_SIGNALS}, priors AS (SELECT {_PRIORS} FROM signals),
shrunk AS (SELECT s.*, {_SHRUNK}, s.precocity AS s_precocity FROM signals s CROSS JOIN priors p)"""
_LONG = " UNION ALL ".join(f"SELECT '{name}' AS signal, s_{name} AS value FROM shrunk" for name in SIGNALS)
CTE_BREAKPOINTS = f"""{CTE_SHRUNK}, melted AS ({_LONG}),
curve AS (
  SELECT signal, value, sum(count(*)) OVER (PARTITION BY signal ORDER BY value) AS upto,
         sum(count(*)) OVER (PARTITION BY signal) AS n
  FROM melted GROUP BY signal, value
),
breakpoints AS (
  SELECT c.signal, CAST(i.idx AS INT) AS idx, min(c.value) AS value
  FROM range({STEPS + 1}) AS i(idx) JOIN curve c ON c.upto * {STEPS} >= i.idx * c.n GROUP BY c.signal, i.idx
)"""
# Normal quantile of (number of breakpoints at or below the value) / 1001, from a table of all 1002 shares.
_NORMAL = NormalDist()
_POINTS = PARAMS.cdf_points
_QUANTILES = "[" + ", ".join(
    f"{_NORMAL.inv_cdf(min(max(i / _POINTS, 0.5 / _POINTS), 1 - 0.5 / _POINTS))!r}::DOUBLE" for i in range(_POINTS + 1)
) + "]"
_LISTS = ", ".join(
    f"(SELECT list(value ORDER BY idx) FROM breakpoints WHERE signal = '{name}') AS b_{name}" for name in SIGNALS
)
_Z = ", ".join(
    f"q[1 + len(list_filter(b_{name}, lambda b: b <= s_{name}))] AS z_{name}" for name in SIGNALS
)
_CLIPPED = " + ".join(f"least(greatest(z_{name}, -5.0), 8.0)" for name in SIGNALS)
CTE_SCORED = f"""{CTE_BREAKPOINTS}, lists AS (SELECT {_LISTS}, {_QUANTILES} AS q),
ranked AS (SELECT shrunk.*, {_Z} FROM shrunk CROSS JOIN lists),
scored AS (SELECT *, {_CLIPPED} AS anomaly_score, ({_CLIPPED}) * ln(1.0 + n_reviews) AS queue_score FROM ranked)"""


def scored_accounts(spark, sf) -> tuple[DataFrame, scaler.Scaler]:
    found = account_signals(spark, sf)
    fitted = scaler.fit_scaler(found, PARAMS)
    return scoring.score_signals(found, fitted), fitted


@query("reviews_in_window", f"WITH {CTE_HISTORY} SELECT user_id, business_id, stars, text, review_date, year FROM history")
def reviews_in_window(spark, sf):
    return history(spark, sf).select("user_id", "business_id", "stars", "text", "review_date", "year")


@query("business_consensus", f"""WITH {CTE_HISTORY}, {CTE_CONSENSUS}
SELECT business_id, {six('business_mean_stars')}, business_n_reviews FROM consensus""")
def business_consensus(spark, sf):
    return rounded(signals.business_consensus(history(spark, sf), min_reviews=PARAMS.min_reviews_per_business))


@query("burstiness", f"""WITH {CTE_HISTORY}, {CTE_BURST}
SELECT user_id, max_reviews_per_day, active_days, {six('burstiness')} FROM burst""")
def burstiness(spark, sf):
    return rounded(signals.burstiness(history(spark, sf)))


@query("duplication", f"""WITH {CTE_HISTORY}, {CTE_DUPLICATION}
SELECT user_id, duplicate_reviews, {six('duplication')} FROM dup""")
def duplication(spark, sf):
    return rounded(signals.duplication(history(spark, sf)))


@query("hash_repeats", f"""WITH {CTE_HISTORY}
SELECT user_id, business_id, text, count(*) OVER (PARTITION BY user_id, {FINGERPRINT}) AS hash_repeats FROM history""")
def hash_repeats(spark, sf):
    kept = history(spark, sf).select("user_id", "business_id", "text", "text_hash")
    return signals.hash_repeats(kept).drop("text_hash")


@query("rating_deviation", f"""WITH {CTE_HISTORY}, {CTE_CONSENSUS}
SELECT user_id, business_id, stars, {six('business_mean_stars')},
       {rounded_sql('abs(stars - business_mean_stars)')} AS star_gap
FROM history LEFT JOIN consensus USING (business_id)""")
def rating_deviation(spark, sf):
    kept = history(spark, sf).select("user_id", "business_id", "stars")
    consensus = signals.business_consensus(kept, min_reviews=PARAMS.min_reviews_per_business)
    found = signals.rating_deviation(kept, consensus, PARAMS)
    return rounded(found.select("user_id", "business_id", "stars", "business_mean_stars", "star_gap"))


@query("rating_deviation_leave_one_out", f"""WITH {CTE_HISTORY}, {CTE_CONSENSUS}
SELECT user_id, business_id, stars,
       round(abs(stars - (business_mean_stars * business_n_reviews - stars) / (business_n_reviews - 1)) + 1e-10, 6) AS star_gap
FROM history LEFT JOIN consensus USING (business_id)""")
def rating_deviation_leave_one_out(spark, sf):
    kept = history(spark, sf).select("user_id", "business_id", "stars")
    consensus = signals.business_consensus(kept, min_reviews=PARAMS.min_reviews_per_business)
    found = signals.rating_deviation(kept, consensus, replace(PARAMS, leave_one_out=True))
    return rounded(found.select("user_id", "business_id", "stars", "star_gap"))


@query("reviewer_profile", f"""WITH {CTE_HISTORY}, {CTE_CONSENSUS}, {CTE_PROFILE}
SELECT user_id, n_reviews, {six('rating_extremity', 'deviation', 'avg_text_len')}, first_review_date, last_review_date
FROM profile""")
def reviewer_profile(spark, sf):
    kept = history(spark, sf)
    consensus = signals.business_consensus(kept, min_reviews=PARAMS.min_reviews_per_business)
    return rounded(signals.reviewer_profile(kept, consensus, PARAMS))


@query("precocity", f"""WITH {CTE_SIGNALS}
SELECT user_id, CAST(days_to_first_review AS INT) AS days_to_first_review, {six('precocity')},
       days_to_first_review IS NULL OR days_to_first_review < 0 AS precocity_imputed FROM signals""")
def precocity(spark, sf):
    found = signals.reviewer_signals(tables.reviews(spark, sf), user_dimension(spark, sf), PARAMS)
    return rounded(found.select("user_id", "days_to_first_review", "precocity", "precocity_imputed"))


@query("reviewer_signals", f"""WITH {CTE_SIGNALS}
SELECT user_id, n_reviews, first_review_date, last_review_date, max_reviews_per_day, active_days, duplicate_reviews,
       yelping_since_ts, user_fans, CAST(days_to_first_review AS INT) AS days_to_first_review,
       {six('avg_text_len', *SIGNALS)},
       days_to_first_review IS NULL OR days_to_first_review < 0 AS precocity_imputed
FROM signals""")
def reviewer_signals(spark, sf):
    found = signals.reviewer_signals(tables.reviews(spark, sf), user_dimension(spark, sf), PARAMS)
    return rounded(found, "avg_text_len", *SIGNALS)


@query("signal_priors", f"WITH {CTE_SHRUNK} SELECT {six(*SHRUNK_SIGNALS)} FROM priors")
def signal_priors(spark, sf):
    found = signals.reviewer_signals(tables.reviews(spark, sf), user_dimension(spark, sf), PARAMS)
    return rounded(scaler.signal_priors(found))


@query("shrink_signals", f"""WITH {CTE_SHRUNK}
SELECT user_id, n_reviews, {six(*[f's_{name}' for name in SIGNALS])} FROM shrunk""")
def shrink_signals(spark, sf):
    found = account_signals(spark, sf)
    prior = scaler.signal_priors(found).head().asDict()
    shrunk = scaler.shrink_signals(found, prior, PARAMS.pseudo_count)
    return rounded(shrunk.select("user_id", "n_reviews", *[f"s_{name}" for name in SIGNALS]))


def _shrunk(spark, sf) -> DataFrame:
    found = account_signals(spark, sf)
    return scaler.shrink_signals(found, scaler.signal_priors(found).head().asDict(), PARAMS.pseudo_count)


@query("cdf_breakpoints", f"WITH {CTE_BREAKPOINTS} SELECT signal, idx, {six('value')} FROM breakpoints")
def cdf_breakpoints(spark, sf):
    columns = {name: f"s_{name}" for name in SIGNALS}
    return rounded(scaler.cdf_breakpoints(_shrunk(spark, sf), columns, PARAMS.cdf_points, exact=True))


@query("cdf_breakpoints_sketch", ORACLES["cdf_breakpoints"])
def cdf_breakpoints_sketch(spark, sf):
    columns = {name: f"s_{name}" for name in SIGNALS}
    return rounded(scaler.cdf_breakpoints(_shrunk(spark, sf), columns, PARAMS.cdf_points))


def _as241(p: str) -> str:
    def ratio(coefficients, x):
        def horner(terms):
            text = repr(terms[0]) + "::DOUBLE"
            for term in terms[1:]:
                text = f"({text} * {x} + {term!r}::DOUBLE)"
            return text
        return f"({horner(coefficients[0])} / {horner(coefficients[1])})"

    centred, tail = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    centre = ratio(AS241_CENTRE, f"(0.180625 - {centred} * {centred})")
    near, far = ratio(AS241_NEAR_TAIL, f"({tail} - 1.6)"), ratio(AS241_FAR_TAIL, f"({tail} - 5.0)")
    return (f"CASE WHEN abs({centred}) <= 0.425 THEN {centred} * {centre} "
            f"ELSE sign({centred}) * CASE WHEN {tail} <= 5.0 THEN {near} ELSE {far} END END")


@query("norm_ppf", f"""WITH shares AS (SELECT doc_id, (n_chars + 0.5) / (n_chars + 40.0e0) AS p FROM documents)
SELECT doc_id, round({_as241('p')} + 1e-10, 6) AS z FROM shares""")
def norm_ppf_query(spark, sf):
    share = (F.col("n_chars") + 0.5) / (F.col("n_chars") + 40.0)
    return tables.read(spark, sf, "documents").select("doc_id", F.round(norm_ppf(share) + 1e-10, 6).alias("z"))


@query("rank_normalise", f"""WITH {CTE_SCORED}
SELECT user_id, {six(*[f'z_{name}' for name in SIGNALS])} FROM scored""")
def rank_normalise(spark, sf):
    scored, _ = scored_accounts(spark, sf)
    return rounded(scored.select("user_id", *[f"z_{name}" for name in SIGNALS]))


@query("anomaly_score", f"WITH {CTE_SCORED} SELECT user_id, {six('anomaly_score')} FROM scored")
def anomaly_score(spark, sf):
    return rounded(scored_accounts(spark, sf)[0].select("user_id", "anomaly_score"))


@query("queue_score", f"WITH {CTE_SCORED} SELECT user_id, n_reviews, {six('queue_score')} FROM scored")
def queue_score(spark, sf):
    return rounded(scored_accounts(spark, sf)[0].select("user_id", "n_reviews", "queue_score"))


_SUMS = ", ".join(
    f"round((SELECT sum(value) FROM breakpoints WHERE signal = '{name}'), 4) AS sum_{name}" for name in SIGNALS
)


@query("anomaly_scaler", f"""WITH {CTE_BREAKPOINTS}
SELECT 'rank_normal' AS method, CAST({_POINTS} AS INT) AS cdf_points, 10.0::DOUBLE AS pseudo_count,
       -5.0::DOUBLE AS clip_low, 8.0::DOUBLE AS clip_high, {_SUMS},
       {', '.join(f'round((SELECT {name} FROM priors) + 1e-10, 6) AS prior_{name}' for name in SHRUNK_SIGNALS)}""")
def anomaly_scaler(spark, sf):
    """The persisted scaler, read back and summed up per signal."""
    fitted = scaler.fit_scaler(account_signals(spark, sf), PARAMS)
    table = stage(fitted.to_table(spark), "scaler")
    total = {
        f"sum_{name}": F.round(F.aggregate(F.col("cdf_breakpoints")[name], F.lit(0.0), lambda a, b: a + b), 4)
        for name in SIGNALS
    }
    prior = {f"prior_{name}": F.round(F.col("prior_mean")[name] + 1e-10, 6) for name in SHRUNK_SIGNALS}
    return table.select(
        "method", "cdf_points", "pseudo_count", "clip_low", "clip_high",
        *[column.alias(name) for name, column in {**total, **prior}.items()],
    )


_COMPONENTS = ", ".join(
    f"round(least(greatest(z_{name}, -5.0), 8.0), 4) AS component_{name}" for name in SIGNALS
)


@query("score_accounts", f"""WITH {CTE_SCORED}
SELECT user_id, n_reviews, round(anomaly_score, 4) AS anomaly_score, round(queue_score, 4) AS queue_score, {_COMPONENTS}
FROM scored""")
def score_accounts(spark, sf):
    """Accounts given as aggregates, scored with a scaler that was saved and loaded."""
    found = account_signals(spark, sf)
    saved = stage(scaler.fit_scaler(found, PARAMS).to_table(spark), "scaler")
    valid, _ = validation.validate_signals(found)
    return scoring.score_accounts(valid, scaler.Scaler.from_table(saved)).drop("model_version")


@query("scoring_parity", f"WITH {CTE_SCORED} SELECT 'ok' AS status, count(*) AS accounts FROM scored")
def scoring_parity(spark, sf):
    """Batch scores against a second scoring with the saved scaler: every account must agree."""
    found = account_signals(spark, sf)
    fitted = scaler.fit_scaler(found, PARAMS)
    saved = stage(fitted.to_table(spark), "scaler")
    batch = scoring.score_signals(found, fitted).withColumnsRenamed({f"z_{s}": f"component_{s}" for s in SIGNALS})
    served = scoring.score_accounts(found, scaler.Scaler.from_table(saved))
    compared = parity.compare_scores(batch, served, "user_id", [f"component_{name}" for name in SIGNALS])
    return parity.parity_summary(compared)


@query("scoring_parity_mismatch", f"""WITH {CTE_SCORED}, served AS (
  SELECT *, CASE WHEN user_id % 5 = 0 THEN 2 * z_duplication ELSE z_duplication END AS w FROM scored
), totals AS (
  SELECT user_id, round(anomaly_score, 4) AS batch, round(anomaly_score - z_duplication + w, 4) AS served FROM served
)
SELECT user_id, batch, served, round(abs(served - batch), 6) AS delta, 'mismatch' AS status, 'duplication' AS suspect
FROM totals WHERE round(abs(served - batch), 6) > 1e-6""")
def scoring_parity_mismatch(spark, sf):
    """A second run that doubles one component for some accounts: the audit must name it."""
    scored, _ = scored_accounts(spark, sf)
    batch = stage(scored.select("user_id", "anomaly_score", *[F.col(f"z_{s}").alias(s) for s in SIGNALS]), "batch")
    wrong = F.when(F.col("user_id") % 5 == 0, F.col("duplication") * 2).otherwise(F.col("duplication"))
    served = batch.withColumn("_wrong", wrong).withColumn(
        "anomaly_score", F.col("anomaly_score") - F.col("duplication") + F.col("_wrong")
    ).withColumn("duplication", F.col("_wrong"))
    return parity.scoring_parity(batch, served, "user_id", SIGNALS)


@query("review_queue_top", f"""WITH {CTE_SCORED}
SELECT user_id, n_reviews, {six('queue_score', 'anomaly_score')},
       {', '.join(f'round({name}, 4) AS {name}' for name in SIGNALS)}, max_reviews_per_day, duplicate_reviews,
       {six('avg_text_len')}
FROM scored ORDER BY round(queue_score, 9) DESC, user_id LIMIT 200""")
def review_queue_top(spark, sf):
    """The flagship: from reviews to the ordered queue of accounts."""
    scored, _ = scored_accounts(spark, sf)
    top = scoring.review_queue_top(scored.withColumn("queue_score", F.round("queue_score", 9)), 200)
    return rounded(top, "queue_score", "anomaly_score", "avg_text_len")


@query("review_queue_top_by_anomaly", f"""WITH {CTE_SCORED}
SELECT user_id, n_reviews, {six('anomaly_score')} FROM scored ORDER BY round(anomaly_score, 9) DESC, user_id LIMIT 50""")
def review_queue_top_by_anomaly(spark, sf):
    scored, _ = scored_accounts(spark, sf)
    top = scoring.review_queue_top(
        scored.withColumn("anomaly_score", F.round("anomaly_score", 9)), 50, "anomaly_score"
    )
    return rounded(top.select("user_id", "n_reviews", "anomaly_score"))


_ROBUST = ("burstiness", "rating_extremity", "deviation")


@query("robust_z", f"""WITH {CTE_SHRUNK}, medians AS (
  SELECT {', '.join(f'quantile_disc(s_{name}, 0.5) AS m_{name}' for name in _ROBUST)} FROM shrunk
), spread AS (
  SELECT {', '.join(f'quantile_disc(abs(s_{name} - m_{name}), 0.5) AS d_{name}' for name in _ROBUST)}
  FROM shrunk CROSS JOIN medians
)
SELECT user_id, {', '.join(f'round((s_{name} - m_{name}) / d_{name} + 1e-10, 4) AS z_{name}' for name in _ROBUST)}
FROM shrunk CROSS JOIN medians CROSS JOIN spread""")
def robust_z(spark, sf):
    """The older scaling on signals it can scale (duplication is mostly zero and would be refused)."""
    found = account_signals(spark, sf)
    fitted = scaler.fit_robust_scaler(found, PARAMS, _ROBUST)
    scored = scoring.score_signals(found, fitted)
    return rounded(scored.select("user_id", *[f"z_{name}" for name in _ROBUST]), dp=4)


@query("validate_signals", f"""WITH {CTE_SIGNALS}, doubtful AS (
  SELECT user_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE duplication END AS duplication,
         CASE WHEN user_id % 13 = 0 THEN -deviation ELSE deviation END AS deviation FROM signals
)
SELECT user_id, duplication IS NULL AS lacks_duplication, deviation < 0 AS bad_deviation
FROM doubtful WHERE duplication IS NULL OR deviation < 0""")
def validate_signals(spark, sf):
    """Accounts with a missing or negative signal are rejected with the reason."""
    found = signals.reviewer_signals(tables.reviews(spark, sf), user_dimension(spark, sf), PARAMS)
    doubtful = found.withColumns({
        "duplication": F.when(F.col("user_id") % 11 != 0, F.col("duplication")),
        "deviation": F.when(F.col("user_id") % 13 == 0, -F.col("deviation")).otherwise(F.col("deviation")),
    })
    _, rejected = validation.validate_signals(doubtful)
    return rejected.select(
        "user_id",
        F.array_contains("errors.pointer", "/duplication").alias("lacks_duplication"),
        F.array_contains("errors.pointer", "/deviation").alias("bad_deviation"),
    )
