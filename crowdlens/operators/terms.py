"""Text features in long form (id, term, weight): term counts, TF-IDF and multi-label chi-squared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdlens.functions.text import runs_of_equals, runs_of_words, words
from crowdlens.operators.ordering import largest, running_totals
from crowdlens.session import stage

#: Characters of text in one task: sorting the weights of its n-grams takes some 50 times as many bytes.
TASK_CHARS = 4_000_000
#: The same for counting the vocabulary. Each task shuffles a row for each of its different terms, most of which it finds once: four
#: times the characters have only some three times the terms. Their hash table takes 13 to 21 bytes a character.
COUNT_CHARS = 4 * TASK_CHARS
#: Terms of a vocabulary that may be broadcast.
BROADCAST_TERMS = 1_000_000


def text_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and characters of the documents, from one scan."""
    size = docs.agg(F.count("*"), F.sum(F.length(text_col))).head()
    return size[0], size[1] or 0


def text_parts(docs: DataFrame, chars: int, task_chars: int | None = None) -> int | None:
    """Partitions for texts of so many characters; None, where one task could hold them all: then Spark decides."""
    task_chars = task_chars or TASK_CHARS
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // task_chars)) if chars > task_chars else None


def tokenise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngrams: Sequence[int] = (1, 2),
    keep_accents: bool = False, chars: int | None = None, task_chars: int | None = None,
) -> DataFrame:
    """Terms of each document with their counts as (id, term, tf). `id_col` is a unique key; texts of one id are counted together.

    The texts are partitioned by id first. They are several times smaller than their n-grams, and every
    later step per document (norms, labels) then needs no further shuffle. A document's terms are counted in its own row:
    a hash table of (id, term) would hold all n-grams of a task, and twice, since it would be filled before and after a shuffle
    that isn't there. The number of partitions follows the
    characters: left to itself, Spark merges partitions by the size of the texts, and sorting the weights of one then spills.
    It is left to itself where one task could hold all texts. `chars` is their number, counted here unless given; a task gets
    some `task_chars` of them (TASK_CHARS).
    """
    chosen = docs.select(id_col, text_col)
    chars = text_size(chosen, text_col)[1] if chars is None else chars
    parts = text_parts(docs, chars, task_chars)
    dealt = chosen.repartition(parts, F.col(id_col)) if parts else chosen.repartition(F.col(id_col))
    tokens = dealt.groupBy(id_col).agg(F.collect_list(text_col).alias("_texts")).select(
        id_col, F.transform("_texts", lambda text: words(text, keep_accents)).alias("_words"))
    terms = F.flatten(F.transform("_words", lambda tokens: runs_of_words(tokens, tuple(ngrams))))
    return tokens.select(id_col, F.explode(runs_of_equals(terms)).alias("_run")).select(
        id_col, F.substring_index("_run", "\n", 1).alias("term"), "_run").select(
        id_col, "term", F.expr("(octet_length(_run) + 1) div (octet_length(term) + 1)").alias("tf"))


def term_stats(
    terms: DataFrame, min_df: int = 3, max_features: int | None = 200_000
) -> DataFrame:
    """Corpus count and document count of terms in at least `min_df` documents, the most frequent first.

    At most `max_features` terms are kept, ties by name; None keeps all.
    """
    stats = (
        terms.groupBy("term").agg(F.sum("tf").alias("term_count"), F.count("*").alias("df"))
        .where(F.col("df") >= min_df)
    )
    if max_features is None:
        return stats
    return largest(stats, "term_count", "term", max_features)


def vocabulary_of(
    docs: DataFrame, min_df: int = 3, max_features: int | None = 200_000, id_col: str = "doc_id", text_col: str = "text",
    ngrams: Sequence[int] = (1, 2), chars: int | None = None,
) -> DataFrame:
    """`term_stats` of the documents' terms, counted in larger tasks than weights are: fewer partial counts are shuffled."""
    tokens = tokenise(docs, id_col, text_col, ngrams, chars=chars, task_chars=COUNT_CHARS)
    return term_stats(tokens, min_df, max_features)


def tfidf(
    terms: DataFrame, vocabulary: DataFrame, n_docs: int, id_col: str = "doc_id", vocabulary_rows: int | None = None,
    hot_rows: int = 5_000_000, parts: int | None = None,
) -> DataFrame:
    """Weights (1 + ln tf)·(ln((1+N)/(1+df)) + 1), scaled to length 1 per document, as (id, term, w).

    `vocabulary` and `n_docs` come from the training documents. A vocabulary of at most `vocabulary_rows`
    terms is broadcast. One without that bound is written once; of it the terms in `hot_rows` documents are broadcast, and the next
    frequent ones up to BROADCAST_TERMS. These meet their documents where these are: only the other terms are shuffled, and come back
    to the `parts` (see `text_parts`) that `terms` are dealt in; without that number, the frequent ones join them in a shuffle by document.
    """
    idf = vocabulary.select("term", (F.log((1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"), "df")
    bounded = vocabulary_rows is not None and vocabulary_rows <= BROADCAST_TERMS
    if not bounded:
        idf = stage(idf, "idf")
        bounded = idf.count() <= BROADCAST_TERMS
    if bounded:
        joined = terms.join(F.broadcast(idf.drop("df")), "term")
    else:
        curve = running_totals(idf.groupBy("df").agg(F.count("*").alias("_n")), [], [F.col("df").desc()], ["_n"])
        least = curve.where(F.col("cum__n") <= BROADCAST_TERMS).agg(F.min("df")).head()[0]
        is_hot = F.coalesce(F.col("df") >= (hot_rows if least is None else min(hot_rows, least)), F.lit(False))
        hot, cold = (idf.where(side).drop("df") for side in (is_hot, ~is_hot))
        rest = terms.join(F.broadcast(hot.select("term")), "term", "left_anti").select(id_col, "term", "tf")
        rest = rest.join(cold, "term").select(id_col, "term", "tf", "idf")
        joined = terms.join(F.broadcast(hot), "term").select(id_col, "term", "tf", "idf").unionByName(
            rest.repartition(parts, F.col(id_col)) if parts else rest)
    weighted = joined.select(id_col, "term", ((F.log("tf") + 1.0) * F.col("idf")).alias("_w"))
    # One document at a time: its terms already share a partition.
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return weighted.withColumn("w", F.col("_w") / norm).select(id_col, "term", "w")


class DegenerateTarget(ValueError):
    """No label separates the rows, so no term can be ranked."""


def chi2_scores(
    weights: DataFrame, labels: DataFrame, id_col: str = "doc_id", labels_col: str = "labels"
) -> DataFrame:
    """Chi-squared of each term per label on the weights, as the maximum over labels: (term, chi2).

    For term t and label l with prevalence p, F = sum of weights and O = sum over positives give
    (O - pF)²/(pF) + (F - O - (1-p)F)²/((1-p)F). Constant labels are skipped; if all are, this raises.
    All label sums of a term come from one aggregation that combines before its only shuffle.
    """
    size = labels.select(F.max(F.array_size(labels_col))).head()[0] or 0
    shares = labels.agg(F.count("*").alias("n"), *[
        F.avg(F.col(labels_col)[j].cast("double")).alias(f"p{j}") for j in range(size)
    ]).head()
    usable = {j: shares[f"p{j}"] for j in range(size) if shares[f"p{j}"] and shares[f"p{j}"] < 1.0}
    if not usable:
        raise DegenerateTarget("every label is constant")

    flagged = weights.join(labels.select(id_col, labels_col), id_col)
    sums = flagged.groupBy("term").agg(
        F.sum("w").alias("_f"),
        *[F.sum(F.when(F.col(labels_col)[j] == 1, F.col("w")).otherwise(0.0)).alias(f"_o{j}") for j in usable],
    )

    def statistic(j: int, p: float) -> Column:
        gap = F.col(f"_o{j}") - F.lit(p) * F.col("_f")
        return gap * gap / (F.lit(p) * F.col("_f")) + gap * gap / (F.lit(1.0 - p) * F.col("_f"))

    scores = [statistic(j, p) for j, p in usable.items()]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return sums.where(F.col("_f") > 0).select("term", best.alias("chi2"))


def assert_some_term_scores(scores: DataFrame) -> DataFrame:
    """`scores`, unless no term has a positive one: then a selection would be arbitrary."""
    if not scores.where(F.col("chi2") > 0).limit(1).count():
        raise DegenerateTarget("no term has a positive chi-squared score")
    return scores


def chi2_select(scores: DataFrame, k: int = 20_000) -> DataFrame:
    """The `k` best terms as (term, chi2, rank); ties by name."""
    best = largest(scores, "chi2", "term", k)
    # At most k rows are left, so numbering them in one task is fine.
    ranked = Window.orderBy(F.desc("chi2"), F.asc("term"))
    return best.select("term", "chi2", F.row_number().over(ranked).alias("rank"))
