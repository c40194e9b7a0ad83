"""Fit the text baselines on one side of the split and report them on the other."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdlens.operators.boosting import BoostParams
from crowdlens.operators.latency import sweep_pct_of_best
from crowdlens.operators.metrics import label_metrics, multilabel_report, scores_long
from crowdlens.operators.models import (
    dense_features, fit_gbt, fit_linear_dense_widths, fit_sparse, fit_sparse_widths, indexed_terms, linear_scores, swept, text_svd, vocab_sweep,
    with_projection,
)
from crowdlens.operators.split import bounded_sample, split_slice
from crowdlens.operators.terms import chi2_select, tfidf, tokenise
from crowdlens.operators.text_model import TrainingTerms, fit_text_model, term_index, training_terms
from crowdlens.params import NUMERIC_FEATURES, TextParams
from crowdlens.plans.metrics_store import record
from crowdlens.session import stage

# Names of the model arms.
ARMS = ("linear_tfidf", "xgb_svd_meta", "linear_svd_meta", "linear_svd_only")
DENSE_LINEAR = ("linear_svd_meta", "linear_svd_only")


class Baselines:
    """Training terms and test weights shared by all arms, so that they differ only in what they should."""

    def __init__(
        self, train: DataFrame, test: DataFrame, params: TextParams = TextParams(), id_col: str = "doc_id",
        numeric: Sequence[str] = (), max_iter: int = 400, boost: BoostParams = BoostParams(),
        sample_by: str | None = None,
    ):
        self.params, self.id_col, self.numeric = params, id_col, tuple(numeric)
        self.max_iter, self.boost = max_iter, boost
        self.train = bounded_sample(train, sample_by or id_col, params.train_rows, params.seed)
        self.test = test
        self.terms: TrainingTerms = training_terms(self.train, params, id_col)
        self.test_weights = stage(
            tfidf(tokenise(test, id_col, ngrams=params.ngrams), self.terms.vocabulary, self.terms.n_docs, id_col,
                  params.max_features),
            "test-weights",
        )
        self._dense, self._dense_fits = None, {}
        self.linear_models = None  # term index and result of the whole linear arm, once fitted

    def linear(self, k: int | None = None) -> DataFrame:
        """Logistic regression on the `k` best terms."""
        index = stage(term_index(chi2_select(self.terms.ranking, k or self.params.select_k)), "terms")
        width = index.count()
        keep = [self.id_col, "labels"]
        fitted = fit_sparse(self.train.select(*keep), self.terms.weights, index, width, self.id_col, max_iter=self.max_iter)
        if k is None:
            self.linear_models = (index, fitted)
        return self._long(linear_scores(self.test, self.test_weights, index, fitted, self.id_col, keep))

    def projected(self) -> tuple[DataFrame, DataFrame, float]:
        """SVD of the whole vocabulary; both sides with labels and numeric columns."""
        if self._dense is None:
            index = stage(term_index(self.terms.vocabulary), "terms")
            width = index.count()
            sides = [indexed_terms(w, index, width) for w in (self.terms.weights, self.test_weights)]
            left, right, explained = text_svd(*sides, width, self.params.svd_dims, self.id_col)
            columns = [self.id_col, "labels", *self.numeric]
            self._dense = (
                stage(with_projection(self.train.select(*columns), left, self.id_col), "svd-train"),
                stage(with_projection(self.test.select(*columns), right, self.id_col), "svd-test"),
                explained,
            )
        return self._dense

    def dense(self, arm: str, beside: Sequence[str] = ()) -> DataFrame:
        left, right, _ = self.projected()
        keep = [self.id_col, "labels"]
        if arm == "xgb_svd_meta":
            sides = [dense_features(side, self.numeric) for side in (left, right)]
            return self._long(fit_gbt(*sides, keep=keep, params=self.boost))
        if arm not in self._dense_fits:
            arms = [name for name in DENSE_LINEAR if name == arm or name in beside]
            alone = arms == ["linear_svd_only"]
            sides = [dense_features(side, self.numeric, drop_metadata=alone) for side in (left, right)]
            # The projection comes first among the features, so the arm without metadata has the first of the other's.
            widths = {name: self._svd_size() if name == "linear_svd_only" else None for name in arms}
            fitted = fit_linear_dense_widths(*sides, list(dict.fromkeys(widths.values())), keep=keep, max_iter=self.max_iter)
            self._dense_fits |= {name: fitted[width] for name, width in widths.items()}
        return self._long(self._dense_fits[arm])

    def _svd_size(self) -> int:
        return len(self.projected()[0].select("svd").head()[0])

    def scores(self, arm: str, beside: Sequence[str] = ()) -> DataFrame:
        """Scores of one arm; linear dense arms of `beside`, asked for later, are fitted in the same passes."""
        if arm not in ARMS:
            raise ValueError(f"unknown arm: {arm!r}")
        return self.linear() if arm == "linear_tfidf" else self.dense(arm, beside)

    def report(self, arms: Sequence[str] = ARMS) -> DataFrame:
        """One report row per arm, with the size of the test set and the seconds that fitting and scoring took.

        What several arms need, the projection and the passes of the linear dense arms, counts for the first of them. The metrics per label behind each row stay in `per_label`.
        """
        rows, self.per_label = None, None
        for arm in arms:
            start = time.perf_counter()
            scores = self.scores(arm, arms)
            took = round(time.perf_counter() - start, 3)
            row = multilabel_report(scores).withColumns({"arm": F.lit(arm), "fit_seconds": F.lit(took)})
            labels = label_metrics(scores).withColumn("arm", F.lit(arm))
            rows = row if rows is None else rows.unionByName(row)
            self.per_label = labels if self.per_label is None else self.per_label.unionByName(labels)
        return rows

    def sweep(self, sizes: Sequence[int]) -> DataFrame:
        """Report of the linear arm per vocabulary width; the ranking is computed once, on training rows.

        The terms are numbered by rank, so each width has the first of the widest one's features, and all are fitted together.
        """
        available = self.terms.vocabulary.count()
        widths = swept(sizes, available)
        ranked = chi2_select(self.terms.ranking, max(widths))
        index = stage(ranked.select("term", (F.col("rank") - 1).alias("idx")), "terms")
        keep = [self.id_col, "labels"]
        fitted = fit_sparse_widths(self.train.select(*keep), self.terms.weights, index, widths, self.id_col, max_iter=self.max_iter)

        def scored(k: int) -> DataFrame:
            return self._long(linear_scores(self.test, self.test_weights, index, fitted[k], self.id_col, keep))
        return vocab_sweep(sizes, scored, available)

    def _long(self, scored: DataFrame) -> DataFrame:
        return stage(scores_long(scored, "labels", "scores", [self.id_col]), "scores")


def run(
    spark: SparkSession, table: str, out: str, categories: Sequence[str], arms: Sequence[str] = ("linear_tfidf",),
    params: TextParams = TextParams(), sweep: Sequence[int] = (), id_col: str = "review_number",
) -> DataFrame:
    """Fit `arms` on the labelled table, record their reports, and store the linear model for scoring.

    The table gets whole-number row ids, written once, since the projection of the dense arms needs them. If `params.train_rows`
    asks for a sample, it is drawn by review_id, so that the choice does not depend on how the table is stored.
    """
    numbered = stage(
        spark.read.parquet(table).withColumn(id_col, F.monotonically_increasing_id()).select(
            id_col, "review_id", "split", "text", "labels", *NUMERIC_FEATURES),
        "labelled",
    )
    train, test = (split_slice(numbered, side).drop("split") for side in ("train", "test"))
    fitted = Baselines(train, test, params, id_col, NUMERIC_FEATURES, sample_by="review_id")
    merged = record(fitted.report(arms), f"{out}/baseline_metrics")
    record(fitted.per_label, f"{out}/label_metrics")
    if sweep:
        record(sweep_pct_of_best(fitted.sweep(sweep)), f"{out}/vocab_sweep", "k")
    model = fit_text_model(fitted.train, categories, params, id_col, prepared=fitted.terms, fitted=fitted.linear_models)
    model.save(f"{out}/text_model")
    return merged
