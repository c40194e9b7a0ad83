"""Truncated singular value decomposition of a sparse table by a randomised range finder.

The table is cells (id, idx, w). They are packed once as blocks of arrays: the ids are dealt over `SLABS` slabs, the columns
cut into chunks of `CHUNK`. A tall and narrow table over the columns is kept as one row for each chunk, holding a small matrix. A product
with the table and its transpose is one job: every slab meets the chunks one after another, adds up its own rows of the product, then hands
out its part of the transposed product chunk by chunk, and the parts are added up by chunk. So a slab's task holds its cells and its rows
(ids / SLABS x width) and one chunk; no cell ever carries a vector through a shuffle, and no table of vectors is broadcast.

Only the chunks move, so the table is turned where it has fewer rows than columns: then the chunks hold documents and the slabs terms.

Between the products a table is made orthonormal: every chunk is reduced to a small triangle, the triangles are stacked
and reduced again, and the rows are divided by the result. Only triangles of the rank's size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.session import ship_package, stage

OVERSAMPLING = 10
POWERS = 5
#: Numbers of a table that may be broadcast: 32 MB.
BROADCAST_NUMBERS = 4_000_000
SLABS = 8
CHUNK = 4_096
#: Rows of a slab, from where on there are more slabs than SLABS.
SLAB_ROWS = 50_000
#: Numbers that a product multiplies at once: 256 kB, which stay in a core's cache.
AT_ONCE = 32_000
REDUCED = "part int, triangle binary"
BLOCKS = "slab int, chunk int, doc binary, idx binary, w binary"
VECTORS = "chunk int, idx binary, v binary"


def weighted_sums(cells: DataFrame, vectors: DataFrame, on: str, by: str, bounded: bool = False) -> DataFrame:
    """(by, v): for each value of `by` the sum of the vectors (on, v) times the weights of its cells.

    The sums are plain ones, one for each place of the vectors, so that each task adds up what it has of a value before it sends it.
    """
    size = vectors.select(F.max(F.size("v"))).head()[0] or 0
    rows = cells.join(F.broadcast(vectors) if bounded else vectors, on)
    sums = rows.groupBy(by).agg(F.count("*").alias("_n"), *[F.sum(F.col("v")[j] * F.col("w")).alias(f"_v{j}") for j in range(size)])
    return sums.select(by, F.array(*[F.col(f"_v{j}") for j in range(size)]).cast("array<double>").alias("v"))


def projected(cells: DataFrame, basis: DataFrame, by: str, bounded: bool = False) -> DataFrame:
    """(by, svd): for each value of `by` the sum of the basis rows (idx, v) times the weights of its cells, as vectors.

    A basis that is not `bounded` meets the cells in blocks.
    """
    if bounded:
        found = weighted_sums(cells, basis, "idx", by, True)
    else:
        width = basis.select(F.max(F.size("v"))).head()[0] or 0
        known = cells.join(basis.select("idx"), "idx", "left_semi")
        blocks, ids, slabs = packed(known, by, "idx", None)
        found = rows_by_id(product(blocks, chunked(basis), width, right=False, slabs=slabs), ids, width, by)
    return found.select(by, array_to_vector("v").alias("svd"))


# ---------------------------------------------------------------- blocks

def _pack(rows: pa.Table) -> pa.Table:
    doc, idx, w = (rows[name].to_numpy() for name in ("doc", "idx", "w"))
    order = np.lexsort((idx, doc))
    return pa.table({
        "slab": rows["slab"][:1].cast(pa.int32()), "chunk": rows["chunk"][:1].cast(pa.int32()),
        "doc": [doc[order].astype(np.int32).tobytes()], "idx": [(idx[order] % CHUNK).astype(np.int16).tobytes()],
        "w": [w[order].astype(np.float64).tobytes()]})


def slabs_for(rows: int) -> int:
    """Few slabs for few rows, since each slab meets all chunks; SLABS until one has SLAB_ROWS rows, and more beyond."""
    return max(min(SLABS, -(-rows // 2_000)), -(-rows // SLAB_ROWS), 1)


def packed(cells: DataFrame, id_col: str, idx_col: str = "idx", slabs: int | None = SLABS):
    """(blocks, ids): a row of cells for each slab and chunk, and the slab and number (`doc`) of each id; both written once.

    Without a number of `slabs`, their rows decide on it, and it is the third result.
    """
    ship_package(cells.sparkSession)
    ids = cells.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    asked, slabs = slabs, slabs or slabs_for(ids.count())
    number = F.row_number().over(Window.partitionBy("slab").orderBy(id_col)) - 1
    ids = stage(ids.withColumn("slab", F.pmod(F.xxhash64(id_col), F.lit(slabs)).cast("int")).withColumn("doc", number), "svd-ids")
    dealt = cells.join(ids, id_col).select(
        "slab", (F.col(idx_col) / CHUNK).cast("int").alias("chunk"), "doc", F.col(idx_col).alias("idx"), F.col("w").cast("double"))
    blocks = stage(dealt.groupBy("slab", "chunk").applyInArrow(_pack, BLOCKS), "svd-blocks")
    return (blocks, ids) if asked else (blocks, ids, slabs)


def _sums(matrix: np.ndarray, take: np.ndarray, w: np.ndarray, into: np.ndarray, out: np.ndarray) -> None:
    """Add w[k] * matrix[take[k]] to out[into[k]]; `into` ascends.

    Runs of one length at a time, each a product of its weights with the rows they take: adding up short runs of rows costs ten times as much.
    """
    first = np.flatnonzero(np.concatenate((np.ones(min(len(into), 1), bool), into[1:] != into[:-1])))
    length = np.diff(np.append(first, len(into)))
    by_length = np.argsort(length, kind="stable")
    bounds = np.flatnonzero(np.diff(length[by_length], prepend=-1, append=-1))
    for begin, end in zip(bounds[:-1], bounds[1:]):
        runs = first[by_length[begin:end]]
        n = length[by_length[begin]]
        some = max(1, AT_ONCE // max(n * matrix.shape[1], 1))
        for low in range(0, len(runs), some):
            own = runs[low: low + some]
            cells = own[:, None] + np.arange(n)
            out[into[own]] += (w[cells][:, None] @ matrix[take[cells]])[:, 0]


def _numbers(row: dict, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["idx"], np.int16), np.frombuffer(row["v"]).reshape(-1, width)


def _slab_task(width: int, left: bool, right: bool):
    """Of one slab: its cells, then the chunks of a table or (without `left`) its own rows; hands out what VECTORS says.

    With `left` alone, one row (chunk: the slab) of the product; with `right`, the transposed product by chunk.
    """
    def cells_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row["doc"], np.int32), np.frombuffer(row["idx"], np.int16), np.frombuffer(row["w"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, rows, slab = {}, None, None
        for batch in batches:
            for row in batch.to_pylist():
                slab = row["slab"]
                if row["w"] is not None:
                    cells[row["chunk"]] = cells_of(row)
                    continue
                if not cells:
                    continue
                if rows is None and left:
                    rows = np.zeros((1 + max(int(doc[-1]) for doc, _, _ in cells.values()), width))
                if not left:
                    rows = np.frombuffer(row["v"]).reshape(-1, width)
                elif row["chunk"] in cells:
                    doc, idx, w = cells[row["chunk"]]
                    known, matrix = _numbers(row, width)
                    place = np.zeros(CHUNK, np.int64)
                    place[known] = np.arange(len(known))
                    _sums(matrix, place[idx], w, doc, rows)
        if rows is None:
            return
        if not right:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([slab], pa.int32()), "idx": [b""], "v": [rows.tobytes()]})
            return
        for chunk, (doc, idx, w) in cells.items():
            order = np.argsort(idx, kind="stable")
            own = idx[order]
            known, into = np.unique(own, return_inverse=True)
            out = np.zeros((len(known), width))
            _sums(rows, doc[order], w[order], into, out)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "idx": [known.tobytes()], "v": [out.tobytes()]})
    return task


def _add(width: int):
    def task(rows: pa.Table) -> pa.Table:
        out, seen = np.zeros((CHUNK, width)), np.zeros(CHUNK, bool)
        parts = [_numbers(row, width) for row in rows.select(["idx", "v"]).to_pylist()]
        for known, matrix in sorted(parts, key=lambda x: (len(x[0]), x[0].tobytes(), x[1].tobytes())):  # whatever order they came in
            out[known] += matrix
            seen[known] = True
        known = np.flatnonzero(seen).astype(np.int16)
        return pa.table({"chunk": rows["chunk"][:1].cast(pa.int32()), "idx": [known.tobytes()], "v": [out[seen].tobytes()]})
    return task


def product(blocks: DataFrame, vectors: DataFrame, width: int, left: bool = True, right: bool = True, slabs: int = SLABS) -> DataFrame:
    """The table times `vectors` (`left`), its transpose times that (`right`), or the transpose times rows kept by slab; written once."""
    by_slab = vectors.withColumn("slab", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1)))) if left else vectors.withColumn("slab", F.col("chunk"))
    none = F.lit(None).cast("binary")
    both = blocks.select("slab", F.lit(0).alias("kind"), "chunk", "doc", "idx", "w", none.alias("v")).unionByName(
        by_slab.select("slab", F.lit(1).alias("kind"), "chunk", none.alias("doc"), "idx", none.alias("w"), "v"))
    dealt = both.repartitionById(slabs, F.col("slab")).sortWithinPartitions("kind", "chunk").select("slab", "chunk", "doc", "idx", "w", "v")
    found = dealt.mapInArrow(_slab_task(width, left, right), VECTORS)
    return stage(found.groupBy("chunk").applyInArrow(_add(width), VECTORS) if right else found, "svd-product")


# ---------------------------------------------------------------- tall and narrow tables

def _triangle_task(width: int, parts: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle, number = np.zeros((0, width)), 0
        for batch in batches:
            for row in batch.to_pylist():
                number = row["chunk"] % parts
                triangle = np.linalg.qr(np.vstack((triangle, np.frombuffer(row["v"]).reshape(-1, width))), mode="r")
        if len(triangle):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([triangle.tobytes()])], names=["part", "triangle"])
    return task


def _stacked(triangles: list[bytes], width: int) -> np.ndarray:
    return np.linalg.qr(np.vstack([np.frombuffer(x).reshape(-1, width) for x in triangles]), mode="r")


def triangle(table: DataFrame, width: int, parts: int = 8) -> np.ndarray:
    """R of the QR decomposition of a table's vectors `v`: width x width, or fewer rows. At most `parts` triangles reach the driver."""
    ship_package(table.sparkSession)

    def merged(rows: pa.Table) -> pa.Table:
        return pa.table({"part": rows["part"][:1].cast(pa.int32()), "triangle": [_stacked(sorted(rows["triangle"].to_pylist()), width).tobytes()]})
    found = table.select("chunk", "v").mapInArrow(_triangle_task(width, parts), REDUCED).groupBy("part").applyInArrow(merged, REDUCED).collect()
    return _stacked([row["triangle"] for row in sorted(found)], width) if found else np.zeros((0, width))


def times(table: DataFrame, width: int, right: np.ndarray) -> DataFrame:
    """The table with every vector multiplied by a small matrix."""
    ship_package(table.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = np.frombuffer(row["v"]).reshape(-1, width) @ right
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([row["chunk"]], pa.int32()), "idx": [row["idx"]], "v": [out.tobytes()]})
    return table.mapInArrow(task, VECTORS)


def _rank(values: np.ndarray, least: float = 1e-10) -> int:
    return int((values > least * max(values.max(initial=0.0), 1e-300)).sum())


def orthonormal(table: DataFrame, width: int, least: float = 1e-10) -> tuple[DataFrame, int]:
    """A table whose columns are an orthonormal basis of the given columns, written once; directions without length are dropped."""
    _, values, right = np.linalg.svd(triangle(table, width))
    rank = _rank(values, least)
    return stage(times(table, width, right[:rank].T / values[:rank]), "svd-range"), rank


def _signs_task(width: int, seed: int, whole: bool):
    """+1 or -1 for every column that a chunk has, the same whenever a task is repeated; of a `whole` basis the rows of a unit matrix."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.sort(np.concatenate([np.zeros(0, np.int64), *[batch.column("idx").to_numpy() for batch in batches]]))
        for chunk in np.unique(columns // CHUNK).tolist():
            own = columns[columns // CHUNK == chunk]
            drawn = np.eye(width)[own] if whole else 2.0 * np.random.default_rng([seed, chunk]).integers(0, 2, (len(own), width)) - 1.0
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk], pa.int32()), "idx": [(own % CHUNK).astype(np.int16).tobytes()], "v": [drawn.tobytes()]})
    return task


def _lists(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    bounds = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.ascontiguousarray(matrix).ravel()))


def _rows_task(width: int, by_slab: bool):
    """(idx, v) of a table kept by chunk, or (slab, doc, v) of one kept by slab, whose rows are numbered as they come."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                idx, matrix = _numbers(row, width)
                idx = np.arange(len(matrix), dtype=np.int32) if by_slab else idx.astype(np.int32) + row["chunk"] * CHUNK
                for low in range(0, len(matrix), 1_000):
                    own = idx[low: low + 1_000]
                    slab = {"slab": pa.array(np.full(len(own), row["chunk"], np.int32))} if by_slab else {}
                    yield pa.RecordBatch.from_pydict({**slab, "doc" if by_slab else "idx": pa.array(own), "v": _lists(matrix[low: low + 1_000])})
    return task


def rows_by_id(table: DataFrame, ids: DataFrame, width: int, id_col: str) -> DataFrame:
    """(id, v) of a table kept by slab, whose rows `ids` numbers."""
    rows = table.mapInArrow(_rows_task(width, True), "slab int, doc int, v array<double>")
    return rows.join(ids, ["slab", "doc"]).select(id_col, "v")


def rows_by_column(table: DataFrame, width: int) -> DataFrame:
    """(idx, v) of a table kept by chunk."""
    return table.mapInArrow(_rows_task(width, False), "idx int, v array<double>")


def _chunk(rows: pa.Table) -> pa.Table:
    idx = rows["idx"].to_numpy()
    order = np.argsort(idx)
    values = rows["v"].combine_chunks()
    matrix = values.flatten().to_numpy(zero_copy_only=False).reshape(len(idx), -1)[order]
    return pa.table({"chunk": pa.array([idx[0] // CHUNK], pa.int32()), "idx": [(idx[order] % CHUNK).astype(np.int16).tobytes()],
                     "v": [matrix.astype(np.float64).tobytes()]})


def chunked(basis: DataFrame) -> DataFrame:
    """A table (idx, v) kept by chunk."""
    ship_package(basis.sparkSession)
    return basis.groupBy((F.col("idx") / CHUNK).cast("int")).applyInArrow(_chunk, VECTORS)


def decomposed(cells: DataFrame, rank: int, id_col: str = "doc_id", seed: int = 17, powers: int = POWERS,
               oversampling: int = OVERSAMPLING) -> tuple[DataFrame, DataFrame, int]:
    """(idx, v): the leading right singular vectors of the cells; (id, v): the rows projected on them; how many they are.

    `rank` must be at most the number of rows and of columns; fewer vectors come back where the table has a smaller rank. Both are written once.
    """
    ship_package(cells.sparkSession)
    ids = stage(cells.select(id_col).where(F.col(id_col).isNotNull()).distinct(), "svd-rows")
    rows, columns = ids.count(), cells.select("idx").distinct().count()
    turned = rows < columns
    if turned:
        # Fewer rows than there are columns, whose numbers come from one task as well.
        numbers = stage(ids.withColumn("_number", F.row_number().over(Window.orderBy(id_col)) - 1), "svd-numbers")
        blocks, slab_ids = packed(cells.join(numbers, id_col), "idx", "_number")
        moved = numbers.select(F.col("_number").alias("idx"))
    else:
        blocks, slab_ids, slabs = packed(cells, id_col, "idx", None)
        moved = cells.select("idx").distinct()
    slabs = SLABS if turned else slabs
    # A partition for each few chunks: by their size alone, Spark would deal all columns to one task.
    moved = moved.repartitionById(4 * SLABS, F.pmod((F.col("idx") / CHUNK).cast("int"), F.lit(4 * SLABS)))
    width = min(rank + oversampling, rows)
    whole = turned and width == rows
    if width == rows:
        powers = 0  # the range is the whole table
    basis, n = stage(moved.mapInArrow(_signs_task(width, seed, whole), VECTORS), "svd-random"), width
    for _ in range(powers):
        # Lengths are squared here: a direction counts down to 1e-7 of the longest, about what rounding leaves of it.
        basis, n = orthonormal(product(blocks, basis, n, slabs=slabs), n, 1e-14)
    left, n = orthonormal(product(blocks, basis, n, right=False, slabs=slabs), n)
    # The table seen from the range found. Turned: documents x n, whose right singular vectors lead from the range to those of the cells.
    # Else: terms x n, whose left singular vectors are the right ones of the cells.
    seen = product(blocks, left, n, left=False, slabs=slabs)
    _, values, right = np.linalg.svd(triangle(seen, n))
    kept = min(rank, _rank(values))
    if turned:
        vectors = stage(rows_by_id(times(left, n, right[:kept].T), slab_ids, kept, "idx"), "svd-basis")
        back = rows_by_column(times(seen, n, right[:kept].T), kept).withColumnRenamed("idx", "_number")
        return vectors, stage(back.join(numbers, "_number").select(id_col, "v"), "svd-projected"), kept
    table = stage(times(seen, n, right[:kept].T / values[:kept]), "svd-chunks")
    own = rows_by_id(product(blocks, table, kept, right=False, slabs=slabs), slab_ids, kept, id_col)
    return stage(rows_by_column(table, kept), "svd-basis"), stage(own, "svd-projected"), kept


def right_vectors(cells: DataFrame, rank: int, id_col: str = "doc_id", seed: int = 17, powers: int = POWERS,
                  oversampling: int = OVERSAMPLING) -> tuple[DataFrame, int]:
    """(idx, v): the leading right singular vectors of the cells as a table, written once, and how many they are. See `decomposed`."""
    basis, _, kept = decomposed(cells, rank, id_col, seed, powers, oversampling)
    return basis, kept
