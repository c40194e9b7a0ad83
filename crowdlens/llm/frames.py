"""Small helpers shared by the operators: passing whole rows through Arrow tasks under safe names."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from crowdlens.session import ship_package

#: Rows that one Arrow batch holds: with texts of some kB, one or two MB.
BATCH_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, whatever the session's default is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(
    rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str | StructType,
) -> DataFrame:
    """`mapInArrow` with small batches, by workers that know this package and give memory back after each task."""
    bounded_batches(rows.sparkSession)
    ship_package(rows.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()
    return rows.mapInArrow(task, schema)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and an executor's limit counts what they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others have none
    if trim is not None:
        trim(0)


def packed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`row`: the columns `keep` (default: all) under their own names, so that none can clash; and `text`.

    Where `row` holds the text already, it isn't carried twice; `text_of` finds it in either place.
    """
    keep = docs.columns if keep is None else keep
    row = F.struct(*[docs[_quoted(name)] for name in keep]).alias("row")
    return docs.select(row) if "text" in keep else docs.select(row, docs["text"].cast("string").alias("text"))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text")


def row_field(packed_rows: DataFrame) -> StructField:
    return packed_rows.schema["row"]


def small_side(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """`rows` marked for broadcast if their number, counted first, is at most `most`; else as they are, to be shuffled.

    For narrow rows only (ids, marks, short strings). The join gives the same rows either way.
    """
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def last_mark(marks: DataFrame, wanted: int, most: int | None = None) -> int | None:
    """Of different (_mark, _size) the `wanted` smallest marks, and with `most` only as many as have that size together, but one at
    least: the largest mark of them, or None without any."""
    # At most `wanted` rows in these windows.
    chosen = marks.orderBy("_mark").limit(wanted)
    before = F.sum("_size").over(W.orderBy("_mark").rowsBetween(W.unboundedPreceding, 0))
    first = F.row_number().over(W.orderBy("_mark")) == 1
    kept = chosen.select("_mark", F.coalesce(before, F.lit(0)).alias("_sum"), first.alias("_first"))
    return (kept if most is None else kept.where((F.col("_sum") <= most) | F.col("_first"))).agg(F.max("_mark")).head()[0]


def bottom_rows(rows: DataFrame, by: list[str], wanted: int) -> DataFrame:
    """At most `wanted` different rows (in the columns `by`), those of the smallest hashes.

    Equal rows meet as one key whose parts combine before the shuffle, so a row that is repeated any number of times counts as
    one and the bound holds. Only hashes are shuffled until the chosen ones are known. Of different rows with one hash one is taken.
    """
    marked = rows.withColumn("_mark", F.xxhash64(*by))
    last = last_mark(marked.select("_mark", F.lit(0).cast("long").alias("_size")).distinct(), wanted)
    return rows.limit(0) if last is None else marked.where(F.col("_mark") <= F.lit(last)).dropDuplicates(["_mark"]).drop("_mark")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
