"""Ingest, lake tables and SQL reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.catalog import tables
from crowdlens.catalog.registry import query, rounded, six
from crowdlens.catalog.signal_queries import FINGERPRINT
from crowdlens.catalog.tables import CTE_BUSINESS, CTE_REVIEW, CTE_USER
from crowdlens.functions.lists import clean_list, counted_list
from crowdlens.functions.text import fingerprint_text, text_fingerprint, word_count
from crowdlens.operators import features, signals
from crowdlens.session import stage, stage_path
from crowdlens.sources import lake, raw

FORMAT = "yyyy-MM-dd HH:mm:ss"
# Every 97th line of the raw review files is cut short, as a broken transfer would.
BROKEN_EVERY = 97


def raw_business_lines(spark, sf) -> DataFrame:
    return tables.businesses(spark, sf).select(F.to_json(F.struct(
        F.col("business_id").cast("string").alias("business_id"), "name", "city", "state", "categories", "is_open",
        F.create_map(F.lit("WiFi"), F.when(F.col("is_open") == 1, "free").otherwise("no")).alias("attributes"),
    )).alias("value"))


def raw_review_lines(spark, sf) -> DataFrame:
    whole = tables.reviews(spark, sf).select(
        F.to_json(F.struct(
            "review_id", F.col("user_id").cast("string").alias("user_id"),
            F.col("business_id").cast("string").alias("business_id"), "stars", "text",
            F.date_format("ts", FORMAT).alias("date"),
        )).alias("value"),
        (F.col("user_id") % BROKEN_EVERY == 0).alias("_broken"),
    )
    cut = F.substring("value", 1, 30)
    return whole.select(F.when(F.col("_broken"), cut).otherwise(F.col("value")).alias("value"))


def raw_user_lines(spark, sf) -> DataFrame:
    return tables.users(spark, sf).select(F.to_json(F.struct(
        F.col("user_id").cast("string").alias("user_id"), "name", "review_count",
        F.date_format("yelping_since", FORMAT).alias("yelping_since"), "friends", "useful", "fans", "elite",
        "average_stars",
    )).alias("value"))


LINES = {"business": raw_business_lines, "review": raw_review_lines, "user": raw_user_lines}


def write_raw(spark, sf, entity: str) -> str:
    path = stage_path(spark, f"raw-{entity}")
    LINES[entity](spark, sf).write.text(path)
    return path


@query("scan_json_explicit", f"""WITH {CTE_BUSINESS}
SELECT CAST(business_id AS VARCHAR) AS business_id, name, city, state, categories, is_open,
       CASE WHEN is_open = 1 THEN 'free' ELSE 'no' END AS wifi, CAST(NULL AS DOUBLE) AS stars FROM business""")
def scan_json_explicit(spark, sf):
    found = raw.read_raw(spark, "business", write_raw(spark, sf, "business"))
    return found.select(
        "business_id", "name", "city", "state", "categories", "is_open", F.col("attributes")["WiFi"].alias("wifi"), "stars"
    )


@query("category_list", f"""WITH {CTE_BUSINESS}, split AS (
  SELECT business_id, list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)), lambda x: len(x) > 0) AS c
  FROM business
) SELECT business_id, array_to_string(c, '|') AS category_list, CAST(len(c) AS INT) AS n_categories FROM split""")
def category_list(spark, sf):
    listed = tables.businesses(spark, sf).select("business_id", clean_list(F.col("categories")).alias("c"))
    return listed.select("business_id", F.array_join("c", "|").alias("category_list"), F.size("c").alias("n_categories"))


@query("transform_business", f"""WITH {CTE_BUSINESS}
SELECT CAST(business_id AS VARCHAR) AS business_id, name, CAST(is_open AS BOOLEAN) AS is_open,
       CAST(len(string_split(categories, ', ')) AS INT) AS n_categories,
       replace(categories, ', ', '|') AS category_list FROM business""")
def transform_business(spark, sf):
    usable, _ = raw.set_aside_broken(raw.read_raw(spark, "business", write_raw(spark, sf, "business")), "business")
    return raw.transform_business(usable).select(
        "business_id", "name", "is_open", "n_categories", F.array_join("category_list", "|").alias("category_list")
    )


@query("transform_review", f"""WITH {CTE_REVIEW}
SELECT review_id, stars, date_trunc('second', ts) AS ts, review_date, year, CAST(length(text) AS INT) AS text_len,
       CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS INT) AS word_count
FROM review WHERE user_id % {BROKEN_EVERY} <> 0""")
def transform_review(spark, sf):
    usable, _ = raw.set_aside_broken(raw.read_raw(spark, "review", write_raw(spark, sf, "review")), "review")
    return raw.transform_review(usable).select(
        "review_id", "stars", "ts", "review_date", "year", "text_len",
        "word_count",
    )


@query("transform_user", f"""WITH {CTE_USER}
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(yelping_since AS DATE) AS joined_on,
       CAST(CASE WHEN friends = 'None' THEN 0 ELSE len(string_split(friends, ',')) END AS INT) AS friend_count,
       CAST(CASE WHEN elite = '' THEN 0 ELSE len(string_split(elite, ',')) END AS INT) AS elite_years
FROM user_profile""")
def transform_user(spark, sf):
    usable, _ = raw.set_aside_broken(raw.read_raw(spark, "user", write_raw(spark, sf, "user")), "user")
    return raw.transform_user(usable).select(
        "user_id", F.to_date("yelping_since_ts").alias("joined_on"), "friend_count", "elite_years"
    )


@query("transform_checkin", """SELECT CAST(l_partkey AS VARCHAR) AS business_id,
       CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS INT) AS checkin_count FROM lineitem""")
def transform_checkin(spark, sf):
    """Each line item as a check-in record whose list repeats its time once per line number; line 1 is empty."""
    time = F.date_format("l_shipdate", FORMAT)
    times = F.array_join(F.transform(F.sequence(F.lit(1), "l_linenumber"), lambda _: time), ", ")
    records = tables.read(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("business_id"),
        F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(times).alias("date"),
    )
    return raw.transform_checkin(records)


@query("transform_tip", """SELECT user_id, CAST(event_id AS VARCHAR) AS business_id, event_type AS text,
       CAST(event_id % 3 AS BIGINT) AS compliment_count, CAST(ts AS DATE) AS tip_date FROM events""")
def transform_tip(spark, sf):
    tips = tables.read(spark, sf, "events").select(
        "user_id", F.col("event_id").cast("string").alias("business_id"), F.col("event_type").alias("text"),
        F.date_format("ts", FORMAT).alias("date"), (F.col("event_id") % 3).alias("compliment_count"),
    )
    return raw.transform_tip(tips).drop("ts")


@query("list_counts", f"""WITH {CTE_USER}
SELECT user_id, CAST(CASE WHEN friends IS NULL OR friends = 'None' THEN 0 ELSE len(string_split(friends, ',')) END AS INT) AS friend_count,
       CAST(CASE WHEN elite IS NULL OR elite = '' THEN 0 ELSE len(string_split(elite, ',')) END AS INT) AS elite_years
FROM user_profile""")
def list_counts(spark, sf):
    return tables.users(spark, sf).select(
        "user_id", counted_list(F.col("friends"), ("None",)).alias("friend_count"),
        counted_list(F.col("elite"), ("",)).alias("elite_years"),
    )


@query("text_stats", """SELECT doc_id, CAST(length(text) AS INT) AS text_len,
       CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS INT) AS word_count FROM documents""")
def text_stats(spark, sf):
    return tables.read(spark, sf, "documents").select(
        "doc_id", F.length("text").alias("text_len"), word_count(F.col("text")).alias("word_count")
    )


@query("text_fingerprint", f"""SELECT doc_id, {FINGERPRINT} AS reference_text,
       regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS lower_first_text,
       count(*) OVER (PARTITION BY {FINGERPRINT}) AS same_fingerprint FROM documents""")
def text_fingerprint_query(spark, sf):
    """Both orders of the fingerprint text, and how many documents share the hash."""
    docs = tables.read(spark, sf, "documents").select("doc_id", "text").withColumn(
        "text_hash", text_fingerprint(F.col("text"))
    )
    return signals.hash_repeats(docs, ["text_hash"]).select(
        "doc_id", fingerprint_text(F.col("text")).alias("reference_text"),
        fingerprint_text(F.col("text"), "lower_first").alias("lower_first_text"),
        F.col("hash_repeats").alias("same_fingerprint"),
    )


@query("eligible_reviews", f"""WITH {CTE_REVIEW}
SELECT review_id, user_id, business_id, text FROM review
WHERE text IS NOT NULL AND length(text) >= 24 AND business_id IS NOT NULL AND user_id IS NOT NULL""")
def eligible_reviews(spark, sf):
    return features.eligible_reviews(tables.reviews(spark, sf), 24).select("review_id", "user_id", "business_id", "text")


@query("ingest_row_audit", f"""WITH {CTE_REVIEW}, {CTE_BUSINESS}, {CTE_USER}
SELECT 'business' AS entity, count(*) AS rows_in, count(*) AS rows_written, CAST(0 AS BIGINT) AS rows_quarantined FROM business
UNION ALL SELECT 'user', count(*), count(*), 0 FROM user_profile
UNION ALL SELECT 'review', count(*), CAST(count_if(user_id % {BROKEN_EVERY} <> 0) AS BIGINT),
       CAST(count_if(user_id % {BROKEN_EVERY} = 0) AS BIGINT) FROM review""")
def ingest_row_audit(spark, sf):
    """A full ingest of three entities: rows read, written and quarantined."""
    paths = {entity: write_raw(spark, sf, entity) for entity in LINES}
    results = raw.ingest(spark, paths, stage_path(spark, "ingest"))
    return spark.createDataFrame(
        [(r.entity, r.rows_in, r.rows_written, r.rows_quarantined) for r in results],
        "entity string, rows_in bigint, rows_written bigint, rows_quarantined bigint",
    )


def partitioned_reviews(spark, sf) -> str:
    """Reviews written with one folder per year."""
    path = stage_path(spark, "review")
    lake.write_parquet(tables.reviews(spark, sf).hint("rebalance", "year"), path, ["year"])
    return path


@query("partitioned_roundtrip", f"""WITH {CTE_REVIEW}
SELECT year, count(*) AS reviews, {six('stars')} FROM (SELECT year, avg(stars) OVER (PARTITION BY year) AS stars FROM review)
GROUP BY year, stars""")
def partitioned_roundtrip(spark, sf):
    found = spark.read.parquet(partitioned_reviews(spark, sf))
    return rounded(found.groupBy("year").agg(F.count("*").alias("reviews"), F.avg("stars").alias("stars")))


@query("year_pruned_count", f"""WITH {CTE_REVIEW}
SELECT count(*) AS reviews, round(avg(stars), 3) AS avg_stars FROM review WHERE year = 1998""")
def year_pruned_count(spark, sf):
    return lake.reviews_of_year(spark.read.parquet(partitioned_reviews(spark, sf)), 1998)


@query("stars_by_region", f"""WITH {CTE_REVIEW}, {CTE_BUSINESS}
SELECT state, count(*) AS n, round(avg(stars), 3) AS avg_stars FROM review JOIN business USING (business_id)
WHERE review.year BETWEEN 1996 AND 1999 GROUP BY state ORDER BY n DESC, state LIMIT 20""")
def stars_by_region(spark, sf):
    return lake.stars_by_region(tables.reviews(spark, sf), tables.businesses(spark, sf), 1996, 1999)


@query("same_day_bursts", """SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS same_day_reviews FROM events
GROUP BY ALL HAVING count(*) > 4 ORDER BY same_day_reviews DESC, user_id, day LIMIT 100""")
def same_day_bursts(spark, sf):
    events = tables.read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"))
    return lake.same_day_bursts(events, "user_id", "day", more_than=4)


@query("review_day_bursts", f"""WITH {CTE_REVIEW}
SELECT user_id, review_date, count(*) AS same_day_reviews FROM review WHERE year = 1998
GROUP BY ALL HAVING count(*) > 1 ORDER BY same_day_reviews DESC, user_id, review_date LIMIT 100""")
def review_day_bursts(spark, sf):
    of_year = tables.reviews(spark, sf).where(F.col("year") == 1998)
    return lake.same_day_bursts(of_year, "user_id", "review_date", more_than=1)


@query("external_table_count", f"""WITH {CTE_REVIEW} SELECT year, count(*) AS reviews FROM review GROUP BY year""")
def external_table_count(spark, sf):
    """The partitioned files registered as an external table and queried by name."""
    path = partitioned_reviews(spark, sf)
    name = "crowdlens_review_" + path.rsplit("-", 1)[1]
    lake.register_table(spark, name, path, ["year"])
    found = stage(spark.sql(f"SELECT year, count(*) AS reviews FROM {name} GROUP BY year"), "external")
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    return found


@query("landing_manifest", f"""WITH {CTE_REVIEW}
SELECT DISTINCT 'year=' || year AS partition, TRUE AS has_files, TRUE AS has_bytes FROM review""")
def landing_manifest(spark, sf):
    """Number and size of the files depend on the writer; that every partition has some does not."""
    found = lake.landing_manifest(spark, partitioned_reviews(spark, sf))
    return found.select("partition", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))
