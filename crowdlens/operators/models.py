"""Multi-label baselines: features of the training rows, the arms fitted on them, and scores of any number of test rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlens.functions.numeric import finite_or_zero, logistic
from crowdlens.operators import blocks, boosting, linear, svd
from crowdlens.operators.linear import LinearFit
from crowdlens.operators.metrics import multilabel_report
from crowdlens.session import stage

BROADCAST_TERMS = 1_000_000


def indexed_terms(weights: DataFrame, index: DataFrame, index_rows: int | None = None) -> DataFrame:
    """(id, idx, w) for terms of a fixed index (term, idx); the index is broadcast up to a million terms."""
    bounded = index_rows is not None and index_rows <= BROADCAST_TERMS
    return weights.join(F.broadcast(index) if bounded else index, "term").drop("term")


def sparse_features(docs: DataFrame, weights: DataFrame, index: DataFrame, width: int, id_col: str = "doc_id") -> DataFrame:
    """Packed blocks of the term weights and `labels` of `docs`; a document without any known term has no cells.

    For training rows, whose number is bounded. Other rows are scored by `linear_scores` or projected by `project`, which are joins.
    """
    return blocks.pack(blocks.sparse_cells(docs, indexed_terms(weights, index, width), id_col))


def n_labels(docs: DataFrame, labels_col: str = "labels") -> int:
    return docs.select(F.max(F.array_size(labels_col))).head()[0] or 0


def fit_sparse(
    docs: DataFrame, weights: DataFrame, index: DataFrame, width: int, id_col: str = "doc_id", c: float = 4.0,
    max_iter: int = 400,
) -> LinearFit:
    """One logistic regression per label with inverse penalty `c` on the terms of `index`, all labels in the same passes."""
    return linear.fit(sparse_features(docs, weights, index, width, id_col), width, n_labels(docs), c, max_iter)


def fit_sparse_widths(
    docs: DataFrame, weights: DataFrame, index: DataFrame, widths: Sequence[int], id_col: str = "doc_id", c: float = 4.0,
    max_iter: int = 400,
) -> dict[int, LinearFit]:
    """`fit_sparse` on the first k terms of `index` for each k of `widths`, all widths and labels in the same passes."""
    packed = sparse_features(docs, weights, index, max(widths), id_col)
    return linear.fit_widths(packed, widths, n_labels(docs), c, max_iter)


def linear_scores(
    docs: DataFrame, weights: DataFrame, index: DataFrame, fitted: LinearFit, id_col: str = "doc_id",
    keep: Sequence[str] = ("doc_id", "labels"),
) -> DataFrame:
    """`keep` and `scores` of a linear fit for any number of documents, by one join and one aggregation.

    A document without any known term has the margin of the intercepts.
    """
    size = len(fitted.intercepts)
    known = weights.join(bounded(coefficient_table(docs.sparkSession, index, fitted), len(fitted.coefficients) * size), "term")
    sums = known.groupBy(id_col).agg(*[F.sum(F.col("w") * F.col("coefs")[j]).alias(f"_m{j}") for j in range(size)])
    margins = [F.coalesce(F.col(f"_m{j}"), F.lit(0.0)) + F.lit(float(fitted.intercepts[j])) for j in range(size)]
    scored = docs.join(sums, id_col, "left")
    return scored.select(*keep, F.array(*[logistic(margin) for margin in margins]).alias("scores"))


def bounded(table: DataFrame, numbers: int) -> DataFrame:
    """`table` marked for broadcast if it has at most so many numbers, else as it is, to be shuffled."""
    return F.broadcast(table) if numbers <= svd.BROADCAST_NUMBERS else table


def coefficient_table(spark, index: DataFrame, fitted: LinearFit) -> DataFrame:
    """(term, coefs) of the selected terms; a constant label has zeros."""
    import pyarrow as pa

    rows = pa.table({"idx": pa.array(range(len(fitted.coefficients)), pa.int32()),
                     "coefs": pa.array(list(fitted.coefficients), pa.list_(pa.float64()))})
    return index.join(spark.createDataFrame(rows), "idx").select("term", "coefs")


def fit_linear_dense(
    train: DataFrame, test: DataFrame, features_col: str = "features", keep: Sequence[str] = ("doc_id", "labels"), c: float = 4.0,
    max_iter: int = 400,
) -> DataFrame:
    """The same regression on standardised dense features; mean and deviation come from the training rows alone."""
    return fit_linear_dense_widths(train, test, [None], features_col, keep, c, max_iter)[None]


def fit_linear_dense_widths(
    train: DataFrame, test: DataFrame, widths: Sequence[int | None], features_col: str = "features",
    keep: Sequence[str] = ("doc_id", "labels"), c: float = 4.0, max_iter: int = 400,
) -> dict[int | None, DataFrame]:
    """`fit_linear_dense` on the first k features for each k of `widths` (None: all), in passes that all widths and labels share."""
    scaler = StandardScaler(inputCol=features_col, outputCol="_standard", withMean=True, withStd=True).fit(train)
    left, right = (scaler.transform(side).withColumn("value", vector_to_array("_standard")) for side in (train, test))
    sizes = {k: len(scaler.mean) if k is None else k for k in widths}
    fitted = linear.fit_widths(blocks.pack(left.select("labels", "value")), list(sizes.values()), n_labels(train), c, max_iter)
    return {k: linear.dense_scores(right.withColumn("value", F.slice("value", 1, size)), "value", fitted[size], list(keep))
            for k, size in sizes.items()}


def fit_gbt(
    train: DataFrame, test: DataFrame, features_col: str = "features", keep: Sequence[str] = ("doc_id", "labels"),
    params: boosting.BoostParams = boosting.BoostParams(),
) -> DataFrame:
    """Boosted trees per label, positives weighted by the negatives per positive; returns `keep` and `scores`."""
    left, right = (side.withColumn("value", vector_to_array(features_col)) for side in (train, test))
    return boosting.scores(right, boosting.fit(left, n_labels(train), "value", params), "value", list(keep))


def text_svd(
    train: DataFrame, test: DataFrame, width: int, dims: int = 256, id_col: str = "doc_id"
) -> tuple[DataFrame, DataFrame, float]:
    """Project (id, idx, w) rows onto the leading right singular vectors of the training rows.

    Uncentred, as for sparse text. Returns (id, svd) of all documents with a known term on both sides, and the share of the
    training variance explained. The basis (width x dims) is a table; only matrices of dims x dims reach the driver.
    """
    documents = train.select(id_col).distinct().count()
    rank = max(1, min(dims, min(documents, width) - 1))
    basis, own, rank = svd.decomposed(train, rank, id_col)
    left = own.select(id_col, array_to_vector("v").alias("svd"))
    return left, project(test, basis, width * rank, id_col), _explained(left, train, documents)


def project(cells: DataFrame, basis: DataFrame, numbers: int, id_col: str = "doc_id") -> DataFrame:
    """(id, svd): for every id the sum of its weights times the basis rows of its terms. `numbers`: of the basis."""
    return svd.projected(cells, basis, id_col, numbers <= svd.BROADCAST_NUMBERS)


def with_projection(docs: DataFrame, projected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` with `svd`; a document without any known term has the zero vector."""
    size = projected.select(F.max(F.size(vector_to_array("svd")))).head()[0] or 1
    zeros = array_to_vector(F.array_repeat(F.lit(0.0), size))
    return docs.join(projected, id_col, "left").withColumn("svd", F.coalesce("svd", zeros))


def _explained(projected: DataFrame, cells: DataFrame, documents: int) -> float:
    """Variance of the projected columns over the variance of the term columns."""
    kept = projected.select(F.posexplode(vector_to_array("svd")).alias("dim", "v")).groupBy("dim").agg(
        F.var_pop("v").alias("var")).agg(F.sum("var")).head()[0] or 0.0
    moments = cells.groupBy("idx").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    total = moments.agg(
        F.sum(F.col("q") / documents - (F.col("s") / documents) * (F.col("s") / documents))
    ).head()[0] or 0.0
    return float(kept / total) if total else 0.0


def dense_features(
    df: DataFrame, numeric: Sequence[str] = (), vector: str = "svd", drop_metadata: bool = False, out: str = "features"
) -> DataFrame:
    """The projection and the numeric columns (null, NaN and infinity as 0) in one vector."""
    if drop_metadata or not numeric:
        return df.withColumn(out, F.col(vector))
    cleaned = df.withColumns({f"_n_{name}": finite_or_zero(F.col(name)) for name in numeric})
    assembled = VectorAssembler(inputCols=[vector, *[f"_n_{name}" for name in numeric]], outputCol=out)
    return assembled.transform(cleaned).drop(*[f"_n_{name}" for name in numeric])


def swept(sizes: Sequence[int], available: int) -> list[int]:
    return [min(k, available) for k in sizes]


def vocab_sweep(
    sizes: Sequence[int], fit_and_score: Callable[[int], DataFrame], available: int
) -> DataFrame:
    """Report per vocabulary width: `fit_and_score(k)` returns long scores (label, y, score).

    Widths beyond the available terms stand for all of them and are scored once.
    """
    widths = swept(sizes, available)
    reports = {k: multilabel_report(fit_and_score(k)).withColumn("k", F.lit(k)) for k in dict.fromkeys(widths)}
    points = reports[widths[0]]
    for k in widths[1:]:
        points = points.unionByName(reports[k])
    return points
