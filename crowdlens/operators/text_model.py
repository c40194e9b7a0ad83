"""A linear multi-label text model kept as a table of terms, so that scoring is one join and one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdlens.functions.numeric import logistic
from crowdlens.operators.linear import LinearFit
from crowdlens.operators.models import BROADCAST_TERMS, bounded, coefficient_table, fit_sparse
from crowdlens.operators.predictions import topk_categories
from crowdlens.operators.terms import assert_some_term_scores, chi2_scores, chi2_select, term_stats, tfidf, tokenise
from crowdlens.params import TextParams
from crowdlens.session import stage

TERMS_DDL = "term string, idf double, coefs array<double>"


def term_index(selected: DataFrame) -> DataFrame:
    """(term, idx) of a selected vocabulary, numbered by name. At most the selected terms, one task."""
    return selected.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("idx"))


@dataclass(frozen=True)
class TextModel:
    """Vocabulary with idf, coefficients of the selected terms (null for the others) and intercepts.

    The unselected terms stay because they count in the length of a document's vector.
    """

    terms: DataFrame
    intercepts: tuple
    categories: tuple
    ngrams: tuple = (1, 2)

    def save(self, path: str) -> None:
        spark = self.terms.sparkSession
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        head = [(list(self.intercepts), list(self.categories), list(self.ngrams))]
        spark.createDataFrame(head, "intercepts array<double>, categories array<string>, ngrams array<int>").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        head = spark.read.parquet(f"{path}/head").head()
        terms = spark.read.schema(TERMS_DDL).parquet(f"{path}/terms")
        return cls(terms, tuple(head.intercepts), tuple(head.categories), tuple(head.ngrams))

    def probabilities(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, probabilities) of every document; one without a known term gets the intercepts.

        A model of at most BROADCAST_TERMS terms is broadcast: then each document's sums are formed where its text is,
        and the only data moved is the text itself. A larger one meets the terms in a shuffle.
        """
        tokens = tokenise(docs, id_col, text_col, self.ngrams)
        bounded = self.terms.count() <= BROADCAST_TERMS
        known = tokens.join(F.broadcast(self.terms) if bounded else self.terms, "term").select(
            id_col, ((F.log("tf") + 1.0) * F.col("idf")).alias("_w"), "coefs"
        )
        size = len(self.intercepts)
        sums = known.groupBy(id_col).agg(
            F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"),
            *[F.sum(F.col("_w") * F.col("coefs")[j]).alias(f"_m{j}") for j in range(size)],
        )
        margins = [
            F.coalesce(F.col(f"_m{j}") / F.col("_norm"), F.lit(0.0)) + F.lit(float(self.intercepts[j]))
            for j in range(size)
        ]
        scored = docs.select(id_col).join(sums, id_col, "left")
        return scored.select(id_col, F.array(*[logistic(margin) for margin in margins]).alias("probabilities"))

    def predict(self, docs: DataFrame, k: int = 5, floor: float = 0.0, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
        """(id, predictions): the top categories of every document."""
        return self.probabilities(docs, id_col, text_col).select(
            id_col, topk_categories(F.col("probabilities"), self.categories, k, floor).alias("predictions")
        )


@dataclass(frozen=True)
class TrainingTerms:
    """TF-IDF of the training documents, written once: every later step starts from it."""

    weights: DataFrame
    vocabulary: DataFrame
    n_docs: int
    ranking: DataFrame


def training_terms(
    train: DataFrame, params: TextParams = TextParams(), id_col: str = "doc_id", text_col: str = "text",
    labels_col: str = "labels",
) -> TrainingTerms:
    """Vocabulary, weights and chi-squared ranking, from the training documents alone."""
    tokens = stage(tokenise(train, id_col, text_col, params.ngrams), "tokens")
    vocabulary = stage(term_stats(tokens, params.min_df, params.max_features), "vocabulary")
    n_docs = train.count()
    weights = stage(tfidf(tokens, vocabulary, n_docs, id_col, params.max_features), "weights")
    scores = assert_some_term_scores(stage(chi2_scores(weights, train, id_col, labels_col), "chi2"))
    return TrainingTerms(weights, vocabulary, n_docs, scores)


def fit_text_model(
    train: DataFrame, categories: Sequence[str], params: TextParams = TextParams(), id_col: str = "doc_id",
    text_col: str = "text", c: float = 4.0, max_iter: int = 400, prepared: TrainingTerms | None = None,
    fitted: tuple[DataFrame, LinearFit] | None = None,
) -> TextModel:
    """TF-IDF, chi-squared selection of `select_k` terms and one logistic regression per label.

    The coefficients of the selected terms pass through the driver: select_k × labels numbers. `fitted` takes the term
    index and the result of an earlier fit on the same terms instead of fitting again.
    """
    spark = train.sparkSession
    found = prepared or training_terms(train, params, id_col, text_col)
    if fitted is None:
        index = stage(term_index(chi2_select(found.ranking, params.select_k)), "terms")
        result = fit_sparse(train.select(id_col, "labels"), found.weights, index, index.count(), id_col, c, max_iter)
    else:
        index, result = fitted
    coefficients = coefficient_table(spark, index, result)
    idf = F.log((1.0 + found.n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    terms = (
        found.vocabulary.select("term", idf.alias("idf"))
        .join(bounded(coefficients, result.coefficients.size), "term", "left")
        .select("term", "idf", "coefs")
    )
    return TextModel(stage(terms, "text-model"), tuple(float(x) for x in result.intercepts), tuple(categories), params.ngrams)
