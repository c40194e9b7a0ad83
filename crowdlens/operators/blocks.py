"""Training rows packed into blocks of arrays, and sums of arrays over all blocks.

A block holds some hundred rows: their labels and either a dense matrix or the cells of a sparse one. Tasks read blocks,
add up arrays of a fixed length, and Spark adds up those of the tasks; only the sum reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.session import ship_package, stage

BLOCK_DDL = "n_rows int, labels binary, bounds binary, columns binary, place binary, value binary"
BLOCK_ROWS, BLOCK_CELLS = 1_000, 400_000
#: Numbers in one row of a sum: 2 MB.
PART = 1 << 18
#: Numbers that the driver adds up itself: 32 MB.
DIRECT_NUMBERS = 4_000_000


@dataclass
class Block:
    """Row i of a sparse block has value[k] at columns[place[k]] for k in bounds[i]:bounds[i + 1]; a dense one has no places."""

    labels: np.ndarray  # rows x labels
    bounds: np.ndarray
    columns: np.ndarray
    place: np.ndarray
    value: np.ndarray

    @property
    def dense(self) -> bool:
        return not len(self.place) and len(self.value) > 0

    @property
    def matrix(self) -> np.ndarray:
        return self.value.reshape(len(self.labels), -1)

    def row_of_cell(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.labels)), np.diff(self.bounds))

    def first_columns(self, width: int) -> Block:
        """The block without the columns from `width` on."""
        if self.dense:
            return self if self.matrix.shape[1] <= width else replace(self, value=self.matrix[:, :width].ravel())
        known = int(np.searchsorted(self.columns, width))
        if known == len(self.columns):
            return self
        own = self.place < known
        bounds = np.concatenate(([0], np.cumsum(own)))[self.bounds]
        return Block(self.labels, bounds, self.columns[:known], self.place[own], self.value[own])

    def times(self, right: np.ndarray) -> np.ndarray:
        """The block's rows times a matrix whose rows are all columns."""
        if self.dense:
            return self.matrix @ right
        # One column after another: sums of contiguous numbers cost a sixth of sums of short rows.
        out, filled = np.zeros((len(self.labels), right.shape[1])), np.flatnonzero(np.diff(self.bounds))
        if not len(filled):
            return out
        first = self.bounds[filled]
        for j, own in enumerate(right.T):
            cells = own.take(self.columns).take(self.place)
            cells *= self.value
            out[filled, j] = np.add.reduceat(cells, first)
        return out

    def transposed_times(self, right: np.ndarray, out: np.ndarray) -> None:
        """Add columns x (columns of `right`) to `out`."""
        if self.dense:
            out += self.matrix.T @ right
            return
        row, place = self.row_of_cell(), self.place.astype(np.int64)  # what bincount would convert for each column
        for j, own in enumerate(np.ascontiguousarray(right.T)):
            cells = own.take(row)
            cells *= self.value
            out[self.columns, j] += np.bincount(place, cells, len(self.columns))

    def squares(self, out: np.ndarray) -> None:
        if self.dense:
            out += (self.matrix ** 2).sum(axis=0)
        else:
            out[self.columns] += np.bincount(self.place, self.value ** 2, len(self.columns))


def _encode(labels: np.ndarray, sizes: np.ndarray, index: np.ndarray | None, value: np.ndarray) -> pa.RecordBatch:
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    columns, place = (np.zeros(0, np.int32),) * 2
    if index is not None:
        columns, place = np.unique(index, return_inverse=True)
    arrays = (labels.astype(np.int8), bounds, columns.astype(np.int32), place.astype(np.int32), value.astype(np.float64))
    return pa.RecordBatch.from_arrays(
        [pa.array([len(labels)], pa.int32()), *[pa.array([x.tobytes()]) for x in arrays]],
        names=["n_rows", "labels", "bounds", "columns", "place", "value"])


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    kinds = (("labels", np.int8), ("bounds", np.int64), ("columns", np.int32), ("place", np.int32), ("value", np.float64))
    for batch in batches:
        for i in range(batch.num_rows):
            labels, *rest = (np.frombuffer(batch.column(name)[i].as_py(), kind) for name, kind in kinds)
            yield Block(labels.reshape(batch.column("n_rows")[i].as_py(), -1), *rest)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pack_task(sparse: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = _matrix(batch.column("labels"))
            size = np.diff(np.asarray(batch.column("value").offsets))
            total = np.cumsum(size)
            low = 0
            while low < len(size):
                reach = (total[low - 1] if low else 0) + BLOCK_CELLS
                high = min(max(low + 1, int(np.searchsorted(total, reach, "right"))), low + BLOCK_ROWS)
                own = batch.slice(low, high - low)
                index = own.column("index").flatten().to_numpy(zero_copy_only=False) if sparse else None
                yield _encode(labels[low:high], size[low:high], index, own.column("value").flatten().to_numpy(zero_copy_only=False))
                low = high
    return task


def pack(rows: DataFrame) -> DataFrame:
    """Blocks, written once, of rows (labels, value) with as many values each, or (labels, index, value) with sparse ones."""
    ship_package(rows.sparkSession)
    sparse = "index" in rows.columns
    chosen = rows.select(
        F.col("labels").cast("array<int>"), *([F.col("index").cast("array<int>")] if sparse else []),
        F.col("value").cast("array<double>"))
    return stage(chosen.mapInArrow(_pack_task(sparse), BLOCK_DDL), "blocks")


def sparse_cells(docs: DataFrame, cells: DataFrame, id_col: str) -> DataFrame:
    """(labels, index, value) for each of `docs` from cells (id, idx, w); a document without any has empty lists."""
    gathered = cells.groupBy(id_col).agg(F.collect_list(F.struct("idx", "w")).alias("_cells"))
    some = F.coalesce("_cells", F.array().cast("array<struct<idx:int,w:double>>"))
    return docs.select(id_col, "labels").join(gathered, id_col, "left").select(
        "labels", some["idx"].alias("index"), some["w"].alias("value"))


def _total_task(function: Callable[[Iterator[Block]], np.ndarray], size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.ascontiguousarray(function(blocks_of(batches)), np.float64).ravel()
        for part in range(-(-size // PART)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([total[part * PART: (part + 1) * PART].tobytes()])], names=["part", "total"])
    return task


def _add(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in parts["total"])
    return pa.table({"part": parts["part"][:1].cast(pa.int32()), "total": pa.array([total.tobytes()])})


def total(
    blocks: DataFrame, function: Callable[[Iterator[Block]], np.ndarray], size: int, direct: int | None = None, tasks: int | None = None,
) -> np.ndarray:
    """Sum over all tasks of `function` of their blocks: `size` numbers. More than `direct` tasks add up in parts first.

    By default that is when they send more than DIRECT_NUMBERS, at least eight. `tasks` saves asking for their number again.
    """
    found = blocks.mapInArrow(_total_task(function, size), "part int, total binary")
    direct = max(8, DIRECT_NUMBERS // max(size, 1)) if direct is None else direct
    if (tasks or blocks.rdd.getNumPartitions()) > direct:
        found = found.groupBy("part").applyInArrow(_add, "part int, total binary")
    out = np.zeros(size)
    for row in found.collect():
        part = np.frombuffer(row["total"], np.float64)
        out[row["part"] * PART: row["part"] * PART + len(part)] += part
    return out
