"""Read events, apply a batch operator, write each micro-batch exactly once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from crowdlens.operators.predictions import topk_categories
from crowdlens.sources.events import as_messages, parse_events, write_messages
from crowdlens.sources.schemas import EVENT_SCHEMA
from crowdlens.streaming import manifest
from crowdlens.streaming.drain import Drain
from crowdlens.streaming.offset_log import read_log


def read_messages(
    spark: SparkSession, path: str | None = None, kafka: dict | None = None, from_beginning: bool = False,
    max_per_batch: int | None = None, min_per_batch: int | None = None, max_delay_ms: int | None = None, log: str | None = None,
    position: str | None = None,
) -> DataFrame:
    """Stream of `value` messages from Kafka, from a message log (`log`), or from a folder of JSON lines (`path`).

    `max_per_batch` bounds a micro-batch: messages, but files for a folder. With `min_per_batch` a micro-batch waits until so many
    messages are there or `max_delay_ms` have passed; a folder can't wait. `from_beginning` picks the start when there is no
    checkpoint yet.
    """
    if path and min_per_batch:
        raise ValueError("a folder of lines has no offsets to wait for: use a message log or Kafka")
    if kafka is not None:
        return spark.readStream.format("kafka").options(**kafka_options(
            kafka, from_beginning, max_per_batch, min_per_batch, max_delay_ms)).load()
    if log is not None:
        return read_log(spark, log, from_beginning, max_per_batch, min_per_batch, None if max_delay_ms is None else max_delay_ms / 1000,
                        position)
    reader = spark.readStream.schema("value string")
    if max_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_per_batch)
    return reader.text(path)


def kafka_options(
    kafka: dict, from_beginning: bool, max_per_batch: int | None, min_per_batch: int | None, max_delay_ms: int | None,
) -> dict:
    sides = {"maxOffsetsPerTrigger": max_per_batch, "minOffsetsPerTrigger": min_per_batch,
             "maxTriggerDelay": None if max_delay_ms is None else f"{max_delay_ms}ms"}
    return {**kafka, "startingOffsets": "earliest" if from_beginning else "latest",
            **{name: str(value) for name, value in sides.items() if value is not None}}


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch to its own partition. A batch run again after a crash replaces itself."""
    (
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    )


def score_stream(
    messages: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    schema: StructType = EVENT_SCHEMA, quarantine: str | None = None, wait: str | None = None,
    before_commit: Callable[[int], None] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None,
    publish: Callable[[DataFrame, int], None] | None = None, drain: Drain | None = None,
) -> StreamingQuery:
    """Start parse → `operator` → Parquet → manifest → publish. The offset is committed after all of them.

    A batch is entered in the manifest of `out` once it is on disk; `landed` and `publish` see such batches only. A batch that is
    run again replaces its rows and its entry. `finish` runs on the computed result, so that a time it takes includes the work
    of `operator`. `publish` gets what was written and may send it on; after a crash it gets the batch again (at least once), and a
    batch without rows is not published. Without `wait` the query takes what is there and stops by itself; with it, it triggers at
    that interval. `drain` stops it between batches. `operator` is any batch operator; it may join and aggregate within the
    micro-batch.
    """
    def handle(batch: DataFrame, batch_id: int) -> int:
        spark = batch.sparkSession
        kept = batch.persist()           # read the source once for both outputs
        scored = None
        try:
            good, bad = parse_events(kept, schema)
            scored = operator(good)
            if finish:
                scored = scored.persist()
                scored.count()               # everything is computed before the clock is read
                write_batch(finish(scored), batch_id, out)
            else:
                write_batch(scored, batch_id, out)
            if quarantine:
                write_batch(bad, batch_id, quarantine)
            written = manifest.commit(spark, out, batch_id)
            if publish and written["rows"]:
                publish(spark.read.parquet(f"{out}/batch_id={batch_id}"), batch_id)
            if before_commit:
                before_commit(batch_id)
            return kept.count() if drain else 0
        finally:
            if finish and scored is not None:
                scored.unpersist()
            kept.unpersist()

    def undrained(batch: DataFrame, batch_id: int) -> None:
        handle(batch, batch_id)

    writer = messages.writeStream.foreachBatch(drain.around(handle) if drain else undrained).option("checkpointLocation", checkpoint)
    if wait:
        return writer.trigger(processingTime=wait).start()
    return writer.trigger(availableNow=True).start()


def landed(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Committed rows written by `score_stream`. With their `schema`, a stream that wrote none has an empty table."""
    reader = spark.read.schema(f"{schema}, batch_id bigint") if schema else spark.read
    return manifest.committed(reader.parquet(path), path).drop("batch_id")


def stamped(scored: DataFrame, now_ms: float | None = None) -> DataFrame:
    """Scored events with the time at which their scores were there, and the time since production."""
    now = F.lit(float(now_ms if now_ms is not None else time.time() * 1000))
    return scored.withColumns({"scored_at_ms": now, "e2e_ms": F.round(now - F.col("produced_at_ms"), 2)})


def publish_messages(scored: DataFrame, batch_id: int, target: str, kafka: dict | None = None) -> None:
    """Scored events as messages keyed by business: to a Kafka topic, or as JSON lines of one folder per batch."""
    keyed = as_messages(scored, "business_id")
    if kafka is not None:
        write_messages(keyed, target, kafka)
    else:
        keyed.write.mode("overwrite").json(f"{target}/batch_id={batch_id}")


def scored_events(
    events: DataFrame, probabilities: Column, categories: list, k: int = 3, now_ms: Column | None = None
) -> DataFrame:
    """Events with their top categories, the time of scoring and the time since production."""
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp()).cast("double")
    return events.select(
        "review_id", "business_id", "user_id",
        topk_categories(probabilities, categories, k).alias("predictions"),
        "produced_at_ms",
        now.alias("scored_at_ms"),
        F.round(now - F.col("produced_at_ms"), 2).alias("e2e_ms"),
    )


def rolling_window_latency(
    events: DataFrame, ts: str, value: str, key: str, window: str = "1 hour", slide: str | None = None,
    late: str = "10 minutes", accuracy: int = 10_000, dp: int = 3,
) -> DataFrame:
    """Latency summary per key and event-time window; rows later than `late` are dropped by the watermark."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    marks = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), accuracy)
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(frame.alias("_window"), key)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean_ms"), marks.alias("_p"), F.max(value).alias("max_ms"))
        .select(
            F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), key, "n",
            F.round("mean_ms", dp).alias("mean_ms"),
            *[F.round(F.col("_p")[i], dp).alias(f"{name}_ms") for i, name in enumerate(("p50", "p95", "p99"))],
            F.round("max_ms", dp).alias("max_ms"),
        )
    )
