"""Events as messages, and the batch operators run on streams of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from crowdlens.catalog import tables
from crowdlens.catalog.metric_queries import ROLLING_N
from crowdlens.catalog.registry import ORACLES, query, rounded
from crowdlens.catalog.signal_queries import PARAMS, account_signals
from crowdlens.catalog.tables import LABEL_NAMES
from crowdlens.operators import latency, scaler, scoring, validation
from crowdlens.params import SIGNALS
from crowdlens.session import stage_path
from crowdlens.sources import events as messages
from crowdlens.streaming import drain, last_values, offset_log, progress, scorer

EVENT = StructType([
    StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("event_type", StringType()),
    StructField("value", DoubleType()), StructField("props", StringType()),
])
# Every 89th message is cut short.
BROKEN_EVERY = 89


def event_messages(spark, sf) -> DataFrame:
    whole = messages.as_messages(
        tables.read(spark, sf, "events"), "user_id", ["event_id", "user_id", "event_type", "value", "props"]
    )
    number = F.get_json_object("value", "$.event_id").cast("long")
    return whole.withColumn(
        "value", F.when(number % BROKEN_EVERY == 0, F.substring("value", 1, 12)).otherwise(F.col("value"))
    )


@query("events_as_json", """SELECT CAST(user_id AS VARCHAR) AS key,
       to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type, 'value': value})::VARCHAR AS value
FROM events""")
def events_as_json(spark, sf):
    return messages.as_messages(
        tables.read(spark, sf, "events"), "user_id", ["event_id", "user_id", "event_type", "value"]
    )


@query("parse_events", f"""SELECT event_id, user_id, event_type, value, CAST(props->>'$.k' AS INT) AS k
FROM events WHERE event_id % {BROKEN_EVERY} <> 0""")
def parse_events(spark, sf):
    good, _ = messages.parse_events(event_messages(spark, sf), EVENT)
    return good.select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


@query("parse_events_quarantine", f"""SELECT substr('{{"event_id":' || event_id, 1, 12) AS raw, count(*) AS n
FROM events WHERE event_id % {BROKEN_EVERY} = 0 GROUP BY ALL""")
def parse_events_quarantine(spark, sf):
    _, bad = messages.parse_events(event_messages(spark, sf), EVENT)
    return bad.groupBy("raw").agg(F.count("*").alias("n"))


def run_stream(spark, lines: DataFrame, operator, schema: StructType, quarantine: bool = False):
    """Write messages to a folder, stream them through `operator`, and return (query, rows, quarantine path)."""
    source, out, aside = (stage_path(spark, name) for name in ("messages", "landed", "quarantine"))
    lines.select("value").repartition(4).write.text(source)
    stream = scorer.read_messages(spark, source, max_per_batch=2)
    running = scorer.score_stream(
        stream, operator, out, stage_path(spark, "stream"), schema, aside if quarantine else None
    )
    running.awaitTermination()
    return running, scorer.landed(spark, out), aside


@query("stream_events", f"SELECT event_id, user_id, event_type, value FROM events WHERE event_id % {BROKEN_EVERY} <> 0")
def stream_events(spark, sf):
    """Messages in several micro-batches, through parsing, to Parquet."""
    _, rows, _ = run_stream(spark, event_messages(spark, sf), lambda batch: batch.drop("props"), EVENT)
    return rows


@query("stream_quarantine", f"SELECT count(*) AS quarantined FROM events WHERE event_id % {BROKEN_EVERY} = 0")
def stream_quarantine(spark, sf):
    _, _, aside = run_stream(spark, event_messages(spark, sf), lambda batch: batch, EVENT, quarantine=True)
    return scorer.landed(spark, aside, "raw string").agg(F.count("*").alias("quarantined"))


@query("delivery_audit", f"""SELECT count(*) AS sent, count_if(event_id % {BROKEN_EVERY} <> 0)::BIGINT AS landed,
       count_if(event_id % {BROKEN_EVERY} = 0)::BIGINT AS undelivered, 0::BIGINT AS surplus FROM events""")
def delivery_audit(spark, sf):
    """Events sent against events landed: the broken ones are missing."""
    _, rows, _ = run_stream(spark, event_messages(spark, sf), lambda batch: batch, EVENT)
    return messages.delivery_audit(tables.read(spark, sf, "events"), rows, "event_id")


@query("stream_score_accounts", ORACLES["score_accounts"])
def stream_score_accounts(spark, sf):
    """Accounts arrive as messages; the same scoring as in the batch, with the saved scaler."""
    found = account_signals(spark, sf)
    fitted = scaler.fit_scaler(found, PARAMS)
    fields = ["user_id", "n_reviews", *SIGNALS]
    schema = StructType([found.schema[name] for name in fields])
    lines = messages.as_messages(found, "user_id", fields)

    def score(batch: DataFrame) -> DataFrame:
        valid, _ = validation.validate_signals(batch)
        return scoring.score_accounts(valid, fitted)

    return run_stream(spark, lines, score, schema)[1].drop("model_version")


@query("stream_predictions", ORACLES["topk_categories"].replace("0.4", "0.0"))
def stream_predictions(spark, sf):
    """Labelled documents as review events, scored and reduced to their top categories."""
    docs = tables.labelled_documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("business_id"),
        F.col("lang").alias("user_id"), "text", "scores",
        F.unix_millis(F.current_timestamp()).cast("double").alias("produced_at_ms"),
    )
    schema = StructType([*docs.schema.fields])
    _, rows, _ = run_stream(
        spark, messages.as_messages(docs, "business_id"),
        lambda batch: scorer.scored_events(batch, F.col("scores"), LABEL_NAMES, 3), schema,
    )
    return rows.select(F.col("review_id").cast("long").alias("doc_id"), F.posexplode("predictions").alias("_p", "_b")).select(
        "doc_id", (F.col("_p") + 1).alias("place"), "_b.category", "_b.probability"
    )


@query("stream_report", """SELECT count(*) AS events_scored, 2::BIGINT AS batches, round(count(*) / 2, 2) AS batch_size_mean,
       0::BIGINT AS final_lag, TRUE AS has_times FROM events""")
def stream_report(spark, sf):
    """Four files, two in each micro-batch. Times differ from run to run; that there are some does not."""
    log = progress.ProgressLog()
    spark.streams.addListener(log)
    try:
        running, _, _ = run_stream(spark, event_messages(spark, sf), lambda batch: batch, EVENT)
        found = log.report(spark, running)
    finally:
        spark.streams.removeListener(log)
    return found.select("events_scored", "batches", "batch_size_mean", "final_lag",
                        ((F.col("wall_seconds") > 0) & (F.col("throughput_per_sec") > 0)).alias("has_times"))


@query("stream_rolling_latency", """WITH hours AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(value) AS n, avg(value) AS mean, max(value) AS top
  FROM events GROUP BY ALL
)
SELECT window_start, event_type, n, round(mean + 1e-10, 3) AS mean_ms, round(top + 1e-10, 3) AS max_ms FROM hours
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_rolling_latency(spark, sf):
    """Event-time windows over a stream, emitted once the watermark has passed them."""
    source, out = stage_path(spark, "events"), stage_path(spark, "latency")
    events = tables.read(spark, sf, "events").select("ts", "event_type", "value")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    windows = scorer.rolling_window_latency(stream, "ts", "value", "event_type", dp=9)
    running = (
        windows.writeStream.outputMode("append")
        .foreachBatch(lambda batch, batch_id: scorer.write_batch(batch, batch_id, out))
        .option("checkpointLocation", stage_path(spark, "stream")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return rounded(scorer.landed(spark, out).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "mean_ms", "max_ms"
    ), dp=3)


@query("stream_last_n_latency", ORACLES["rolling_latency"])
def stream_last_n_latency(spark, sf):
    """The last values of each key as a stream: events in order through a message log, some thousand in each micro-batch, state per key."""
    rows = tables.read(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    folder, out = stage_path(spark, "log"), stage_path(spark, "latency")
    lines = messages.as_messages(rows.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))), "event_type",
                                 ["event_type", "micros", "event_id", "value"])
    in_order = lines.withColumns({name: F.get_json_object("value", f"$.{name}").cast("long") for name in ("micros", "event_id")})
    total = sum(offset_log.append(in_order, folder, 4, ("micros", "event_id")).values())
    schema = "event_type string, micros bigint, event_id bigint, value double"
    stop = drain.Drain()
    stream = offset_log.read_log(spark, folder, True, max(1, -(-total // 3)), position=stage_path(spark, "position") + ".json")
    parsed = stream.select(F.from_json("value", schema).alias("e")).select("e.*")
    found = last_values.last_n_latency(parsed, "event_type", ["micros", "event_id"], "value", ROLLING_N, dp=9)
    running = (
        found.writeStream.outputMode("append")
        .foreachBatch(stop.around(lambda batch, batch_id: scorer.write_batch(batch, batch_id, out)))
        .option("checkpointLocation", stage_path(spark, "stream")).trigger(processingTime="100 milliseconds").start()
    )
    running.processAllAvailable()
    stop.request()
    stop.wait(running)
    return rounded(scorer.landed(spark, out).drop("micros"), dp=4)


@query("stream_log_lag", """WITH t AS (SELECT count(*) AS n, ceil(count(*) / 4)::BIGINT AS size FROM events)
SELECT i AS batch, least(size, n - i * size) AS rows, greatest(n - (i + 1) * size, 0) AS lag FROM t, range(4) AS r(i)""")
def stream_log_lag(spark, sf):
    """Events through a message log, a quarter in each micro-batch: what is left falls to nothing."""
    folder = stage_path(spark, "log")
    total = sum(offset_log.append(event_messages(spark, sf), folder, 4).values())
    log, stop = progress.ProgressLog(head=lambda: offset_log.head(folder)), drain.Drain()
    spark.streams.addListener(log)
    try:
        stream = scorer.read_messages(spark, log=folder, from_beginning=True, max_per_batch=max(1, -(-total // 4)),
                                      position=stage_path(spark, "position") + ".json")
        running = scorer.score_stream(stream, lambda batch: batch, stage_path(spark, "landed"), stage_path(spark, "stream"), EVENT,
                                      wait="100 milliseconds", drain=stop)
        running.processAllAvailable()
        stop.request()
        stop.wait(running)
        log.report(spark, running)  # after all progress has arrived
    finally:
        spark.streams.removeListener(log)
    rows = log.table(spark).where("rows > 0")
    return rows.select("batch_id", "rows", "lag").select(F.col("batch_id").alias("batch"), "rows", "lag")


@query("event_latency_by_day", """SELECT CAST(ts AS DATE) AS day, count(value) AS n, round(avg(value) + 1e-10, 2) AS mean_ms,
       round(quantile_cont(value, 0.5) + 1e-10, 2) AS p50_ms, round(quantile_cont(value, 0.95) + 1e-10, 2) AS p95_ms,
       round(quantile_cont(value, 0.99) + 1e-10, 2) AS p99_ms, round(max(value) + 1e-10, 2) AS max_ms
FROM events GROUP BY ALL""")
def event_latency_by_day(spark, sf):
    daily = tables.read(spark, sf, "events").select(F.to_date("ts").alias("day"), "value")
    return rounded(latency.latency_summary(daily, "value", ["day"], dp=9), dp=2)
