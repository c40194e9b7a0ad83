"""The operators as named queries over the whole test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.llm import (
    centroids, classifier, decontaminate, jaccard_join, licenses, near_vectors, packing, pii, reply_trees, resampling, rules_forest,
    url_filter, warc,
)

QUERIES = {}
ORACLES: dict[str, str] = {}

#: Labels of these documents may be learned from; the others measure what was learned.
LEARN = "crc32(CAST(doc_id AS STRING)) % 5 <> 0"
#: The rules of the URL query.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Fixed value: the conversation that the chat query adds, in which both turns say template tokens.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL words: A-Z lower-cased, split at ASCII characters other than digits and letters.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PLAIN_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACED_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+')"


@query("op1_isolation_forest_rules")
def isolation_forest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_forest.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _license_sql() -> str:
    """The scan without an index: every template is tried at every place."""
    def array(words) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(
        f"({number}, '{t.label}', {str(t.base).lower()}, {array(t.words)}, ["
        + ", ".join(f"{{'o': {o}, 'p': {array(t.words[o: o + n])}}}" for o, n in t.phrases) + "])"
        for number, t in enumerate(licenses.templates()))
    return f"""
WITH template(t, label, base, words, phrases) AS (VALUES {rows}),
file AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
start AS (
    SELECT doc_id, w, template.*, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(phrases[1].p)] = phrases[1].p)) - phrases[1].o AS s
    FROM file JOIN template ON list_has_all(w, words[phrases[1].o + 1:phrases[1].o + len(phrases[1].p)])),
place AS (
    SELECT doc_id, label, base, s,
           len(list_filter(range(0, len(words)), lambda j: s + j >= 0 AND w[s + j + 1] = words[j + 1])) / len(words) AS share
    FROM start WHERE len(list_filter(phrases, lambda x: s + x.o < 0 OR w[s + x.o + 1:s + x.o + len(x.p)] <> x.p)) = 0),
found AS (
    SELECT doc_id, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) FILTER (NOT base) AS score
    FROM place GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM file LEFT JOIN found USING (doc_id)"""


@query("op2_license_scan", _license_sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


@query("op3_nb_svm_quality")
def nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), LEARN, keep=["doc_id"])
    doc = F.col("row.doc_id")
    return judged.select(doc.alias("doc_id"), F.coalesce(F.crc32(doc.cast("string")) % 5 == 0, F.lit(True)).alias("held_out"),
                         "score", "predicted")


@query("op4_prefix_filter_decontamination", rf"""
WITH item AS (SELECT item_id, {PLAIN_WORDS} AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda i: w[i:i + 12])
                                         WHEN len(w) > 0 THEN [w] ELSE [] END) AS win FROM item),
doc AS (SELECT doc_id, {PLAIN_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT len(win) AS n FROM win),
place AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS win
    FROM doc CROSS JOIN size WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, s, n FROM place JOIN win USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""")
def prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return judged.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_weak_supervision_pii")
def weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "row.doc_id", *[pii.counted("base", kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@query("op6_length_bucket_packing")
def length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


_RULES_SQL = ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in URL_RULES)


@query("op7_url_hash_prefix_filter", rf"""
WITH rule(action, rhost, rpath) AS (VALUES {_RULES_SQL}),
part AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
best AS (
    SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
    FROM part JOIN rule ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM part LEFT JOIN best USING (page_id)""")
def url_hash_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES_SQL} AS rule(action, host, path)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


_BITS = "list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 5), lambda j: (bits[5 * i + j + 1]::INT) << (4 - j))))"


@query("op8_warc_round_trip", f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bit AS (SELECT *, string_split(list_aggregate(list_transform(range(1, 41), lambda i:
        substr(bin(strpos('0123456789abcdef', hex[i]) + 15), 2)), 'string_agg', ''), '') AS bits FROM page),
coded AS (SELECT page_id, html, list_aggregate(list_transform({_BITS}, lambda v:
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v::INT + 1, 1)), 'string_agg', '') AS payload_digest FROM bit),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM coded GROUP BY payload_digest)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM coded JOIN firsts USING (payload_digest)""")
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_parity_sketch_join", rf"""
WITH RECURSIVE doc AS (SELECT doc_id, {SPACED_WORDS} AS w FROM documents),
shingle AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])
                                        WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM doc),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
           GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(node, other) AS (SELECT a, b FROM link UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id)
LEFT JOIN (SELECT node AS doc_id, min(other) AS low FROM reach GROUP BY node) USING (doc_id)""")
def parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.join(table(spark, sf_dir, "documents"), jaccard_join.Settings(k=3, percent=90))
    return jaccard_join.components(joined).select("doc_id", "n_shingles", "component_id")


_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
_TEXT, _ROLE = "coalesce(text, '')", "coalesce(role, '')"


@query("op10_reply_tree_chat", f"""
WITH turns AS (
    SELECT conv_id, turn, {_ROLE} AS role, {_TEXT} AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || replace({_ESCAPED.format("role")}, chr(10), '<\\n') || chr(10)
                       || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""")
def reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql(f"""SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{CONTROL_TEXT}' AS text
                          FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    back = reply_trees.read_back(reply_trees.formatted(reply_trees.paths(reply_trees.linear(rows))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def _clusters_sql(clusters: int = 8, rounds: int = 10) -> str:
    """Every round as a table: all distances in whole numbers, then floored averages."""
    def assigned(number: int) -> str:
        return f"""a{number} AS MATERIALIZED (
    SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
        SELECT row, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
        FROM vec, c{number}) GROUP BY row)"""

    def moved(number: int) -> str:
        return f"""c{number + 1} AS MATERIALIZED (
    SELECT old.c, coalesce(new.w, old.w) AS w FROM c{number} old LEFT JOIN (
        SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS w FROM (
            SELECT c, p, sum(x) AS s, count(*)::HUGEINT AS n
            FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM vec JOIN a{number} USING (row)) GROUP BY c, p)
        GROUP BY c) new USING (c))"""
    steps = [f"{assigned(number)},\n{moved(number)}" for number in range(rounds)]
    return f"""
WITH vec AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v AS w FROM vec QUALIFY c < {clusters}),
{", ".join(steps)},
{assigned(rounds)}
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} JOIN vec USING (row) JOIN c{rounds} USING (c)"""


@query("op11_equal_average_clustering", _clusters_sql())
def equal_average_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), centroids.Settings(
        clusters=8, dimensions=64, scale=1024, rounds=10, seed=3))


def _crc_sql(word: str) -> str:
    """CRC-32 of a string byte by byte; the table of single bytes follows from the polynomial."""
    entries = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ resampling.POLYNOMIAL * (byte & 1)
        entries.append(byte)
    digits = f"hex(encode({word}))"
    byte = f"(strpos('123456789ABCDEF', {digits}[2 * i + 1]) * 16 + strpos('123456789ABCDEF', {digits}[2 * i + 2]))"
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen({word})), lambda i: {byte})), lambda r, b: "
            f"xor(r >> 8, ({entries}::BIGINT[])[(xor(r, b) & 255) + 1])), 4294967295)")


@query("op12_position_table_resampling", rf"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, {PLAIN_WORDS} AS w FROM documents),
word AS (SELECT row, unnest(w) AS word FROM doc),
goal AS (SELECT unnest({PLAIN_WORDS}) AS word FROM benchmark),
bucket AS MATERIALIZED (
    SELECT word, {_crc_sql("word")} % 10000 AS b FROM (SELECT word FROM word UNION SELECT word FROM goal)),
s AS (SELECT b, count(*) AS s FROM word JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM goal JOIN bucket USING (word) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM word) AS big_s, (SELECT count(*) FROM goal) AS big_t),
gain AS (
    SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS gain
    FROM (SELECT DISTINCT b FROM bucket) LEFT JOIN s USING (b) LEFT JOIN t USING (b) CROSS JOIN total),
weighed AS (SELECT row, count(*) AS n, sum(gain) AS g FROM word JOIN bucket USING (word) JOIN gain USING (b) GROUP BY row),
scored AS (
    SELECT row, doc_id, len(w) AS n_features, coalesce(((g - ((g % n) + n) % n) // n)::BIGINT, 0) AS weight,
           ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM doc LEFT JOIN weighed USING (row)),
noisy AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (
    SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n
    FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM noisy LEFT JOIN ranked USING (row)""")
def position_table_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), resampling.Settings(
        longest_run=1, buckets=10_000, seed=2024, least_words=20, percent=10))


@query("op13_multi_index_search")
def multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, near_vectors.Settings(k=10))
