"""Score review events as they arrive with a stored text model."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from crowdlens.operators.text_model import TextModel
from crowdlens.streaming.drain import Drain
from crowdlens.streaming.scorer import publish_messages, read_messages, score_stream, scored_events, stamped


def score_events(events: DataFrame, model: TextModel, k: int = 3) -> DataFrame:
    """Events with their top categories. Events are numbered within the batch; their own ids may repeat.

    Both sides of the join see the same numbers: they depend on the place in the micro-batch alone, which `score_stream` keeps
    and whose source repeats it. So nothing is staged for each batch.
    """
    numbered = events.withColumn("_event", F.monotonically_increasing_id())
    scores = model.probabilities(numbered.select("_event", "text"), "_event")
    joined = numbered.join(scores, "_event")
    return scored_events(joined, F.col("probabilities"), list(model.categories), k)


def run(
    spark: SparkSession, model_path: str, out: str, checkpoint: str, path: str | None = None, kafka: dict | None = None,
    from_beginning: bool = False, max_per_batch: int | None = None, wait: str | None = None, k: int = 3,
    publish_to: str | None = None, min_per_batch: int | None = None, max_delay_ms: int | None = None, log: str | None = None,
    drain: Drain | None = None,
) -> StreamingQuery:
    """Start the scorer on a folder of JSON lines, a message log or a Kafka topic. The model is read once, at the start.

    Scored events go to Parquet and, with `publish_to` (a topic of the same brokers, or a folder), out as keyed messages.
    """
    brokers = {"kafka.bootstrap.servers": kafka["kafka.bootstrap.servers"]} if kafka else None
    model = TextModel.load(spark, model_path)
    messages = read_messages(spark, path, kafka, from_beginning, max_per_batch, min_per_batch, max_delay_ms, log,
                             f"{checkpoint}-position.json" if log else None)
    return score_stream(
        messages, lambda batch: score_events(batch, model, k), f"{out}/scored", checkpoint,
        quarantine=f"{out}/quarantine", wait=wait, finish=stamped, drain=drain,
        publish=partial(publish_messages, target=publish_to, kafka=brokers) if publish_to else None,
    )
