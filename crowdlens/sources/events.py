"""Review events: keyed JSON messages, their parsing and the audit of a delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from crowdlens.sources.schemas import EVENT_SCHEMA


def as_messages(df: DataFrame, key: str, fields: Sequence[str] | None = None) -> DataFrame:
    """(key, value) messages with the row as JSON. Equal keys share a partition of the topic."""
    return df.select(
        F.col(key).cast("string").alias("key"), F.to_json(F.struct(*(fields or df.columns))).alias("value")
    )


def review_events(labelled: DataFrame, produced_at_ms: Column | None = None) -> DataFrame:
    """The message fields of a labelled review, stamped with the time of production."""
    stamp = produced_at_ms if produced_at_ms is not None else F.unix_millis(F.current_timestamp()).cast("double")
    return labelled.select(
        "review_id", "business_id", "user_id", "text", F.col("review_stars").alias("stars"),
        stamp.alias("produced_at_ms"),
    )


def write_messages(messages: DataFrame, target: str, options: dict | None = None) -> None:
    """Send messages to Kafka when `options` are given (target = topic), else write them as JSON lines."""
    if options is not None:
        messages.write.format("kafka").options(**options).option("topic", target).save()
    else:
        messages.select("value").write.mode("overwrite").text(target)


def parse_events(
    messages: DataFrame, schema: StructType = EVENT_SCHEMA, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """(parsed events, quarantined messages with their text). Works on batches and streams."""
    checked = StructType([*schema.fields]).add("_corrupt", StringType())
    parsed = messages.withColumn(
        "_event",
        F.from_json(F.col(value).cast("string"), checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}),
    )
    readable = F.col("_event").isNotNull() & F.col("_event._corrupt").isNull()
    good = parsed.where(readable).select(*[F.col(f"_event.{field.name}").alias(field.name) for field in schema.fields])
    bad = parsed.where(~readable).select(F.col(value).cast("string").alias("raw"))
    return good, bad


class UndeliveredEvents(RuntimeError):
    """The sink holds fewer distinct rows than were sent, or more."""


def delivery_audit(sent: DataFrame, landed: DataFrame, key: str) -> DataFrame:
    """One row: rows sent, rows landed, sent but missing, landed but never sent, landed twice."""
    left = sent.groupBy(key).agg(F.count("*").alias("_sent"))
    right = landed.groupBy(key).agg(F.count("*").alias("_landed"))
    both = left.join(right, key, "full_outer").select(
        F.coalesce("_sent", F.lit(0)).alias("_sent"), F.coalesce("_landed", F.lit(0)).alias("_landed")
    )
    gap = F.col("_sent") - F.col("_landed")
    return both.agg(
        F.coalesce(F.sum("_sent"), F.lit(0)).alias("sent"),
        F.coalesce(F.sum("_landed"), F.lit(0)).alias("landed"),
        F.coalesce(F.sum(F.when(gap > 0, gap).otherwise(0)), F.lit(0)).alias("undelivered"),
        F.coalesce(F.sum(F.when(gap < 0, -gap).otherwise(0)), F.lit(0)).alias("surplus"),
    )


def assert_delivered(audit: DataFrame) -> None:
    row = audit.head()
    if row.undelivered or row.surplus:
        raise UndeliveredEvents(f"sent {row.sent}, landed {row.landed}: {row.undelivered} missing, {row.surplus} extra")
