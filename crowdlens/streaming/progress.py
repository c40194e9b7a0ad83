"""Run reports from the progress that Spark records for each micro-batch."""

from __future__ import annotations

import json
import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS_DDL = "run_id string, batch_id bigint, rows bigint, duration_ms bigint, lag bigint"
TOTALS_DDL = "run_id string, events_scored bigint, duration_ms bigint, batches bigint, final_lag bigint"


def _offset_total(offset) -> int:
    """Sum over the partitions of a Kafka offset {topic: {partition: n}} or a log's {partition: n}; 0 for sources without one."""
    if isinstance(offset, str):
        try:
            offset = json.loads(offset)
        except ValueError:
            return 0
    if not isinstance(offset, dict):
        return 0
    if not all(str(name).isdigit() for name in offset):
        offset = {(topic, p): n for topic, parts in offset.items() if isinstance(parts, dict) for p, n in parts.items()}
    return sum(n for n in offset.values() if isinstance(n, int))


def progress_row(progress, head: dict | None = None) -> tuple:
    """One micro-batch: rows, duration and messages still behind the head of the source. Sources that plan less than there is
    call that their latest offset; the `head` of a log {partition: n} tells how much there is."""
    record = json.loads(progress.json) if hasattr(progress, "json") else dict(progress)
    lag = sum(
        max((_offset_total(source.get("latestOffset")) if head is None else sum(head.values())) - _offset_total(source.get("endOffset")), 0)
        for source in record.get("sources", ())
    )
    return (
        str(record["runId"]), int(record["batchId"]), int(record["numInputRows"]),
        int(record.get("batchDuration") or record.get("durationMs", {}).get("triggerExecution", 0)), lag,
    )


class ProgressLog(StreamingQueryListener):
    """Exact totals of each run of the session's queries, however many micro-batches it has; a small row for each of the last
    `keep` micro-batches, printed if asked. Memory grows with the number of runs, not of batches."""

    def __init__(self, echo: bool = False, keep: int = 100_000, head: Callable[[], dict] | None = None):
        self.head = head  # of the log that is read, if it is one
        self.rows: deque = deque(maxlen=keep)
        self.echo = echo
        self._totals: dict[str, list] = {}  # run_id -> rows, milliseconds, batches, last batch, its lag
        self._ended: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = progress_row(event.progress, self.head() if self.head else None)
        run_id, batch_id, rows, duration, lag = row
        with self._changed:
            self.rows.append(row)
            if rows > 0:
                total = self._totals.setdefault(run_id, [0, 0, 0, -1, 0])
                total[0], total[1], total[2] = total[0] + rows, total[1] + duration, total[2] + 1
                if batch_id >= total[3]:
                    total[3:] = batch_id, lag
        if self.echo:
            rate = rows / (duration / 1000.0) if duration else 0.0
            print(f"batch {batch_id}: {rows} rows, {rate:,.0f}/s, lag {lag}")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self._changed:
            self._ended.add(str(event.runId))
            self._changed.notify_all()

    def table(self, spark: SparkSession) -> DataFrame:
        with self._changed:
            rows = list(self.rows)
        return spark.createDataFrame(rows, PROGRESS_DDL)

    def report(self, spark: SparkSession, query: StreamingQuery, timeout: float = 60.0) -> DataFrame:
        """The report of one run, over all its micro-batches; of a run that goes on, over those so far.

        Spark tells listeners later than the query: the end of a run comes after all its progress, so it is waited for.
        """
        run_id = str(query.runId)
        with self._changed:
            if not query.isActive and not self._changed.wait_for(lambda: run_id in self._ended, timeout):
                raise TimeoutError(f"the end of run {run_id} did not reach the progress log in {timeout:g} seconds")
            total = self._totals.get(run_id)
            rows = [(run_id, *total[:3], total[4])] if total else []
        return _figures(spark.createDataFrame(rows, TOTALS_DDL))


def progress_table(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The recent progress of one query as rows: at most the last spark.sql.streaming.numRecentProgressUpdates (100)
    micro-batches. Reports of whole runs come from `ProgressLog.report`."""
    return spark.createDataFrame([progress_row(item) for item in query.recentProgress], PROGRESS_DDL)


def stream_report(progress: DataFrame) -> DataFrame:
    """Per run of the given progress rows: events, seconds, events per second, batches, mean batch and the last lag."""
    return _figures(progress.where(F.col("rows") > 0).groupBy("run_id").agg(
        F.sum("rows").alias("events_scored"), F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("batches"),
        F.max_by("lag", "batch_id").alias("final_lag"),
    ))


def _figures(totals: DataFrame) -> DataFrame:
    seconds = F.col("duration_ms") / 1000.0
    return totals.select(
        "run_id", "events_scored",
        F.round(seconds, 2).alias("wall_seconds"),
        F.round(F.try_divide(F.col("events_scored"), seconds), 1).alias("throughput_per_sec"),
        "batches",
        F.round(F.col("events_scored") / F.col("batches"), 2).alias("batch_size_mean"),
        "final_lag",
    )
