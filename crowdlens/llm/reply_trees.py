"""Chat formatting: conversations are trees of replies; the best root-to-leaf paths become chat texts.

Only joins, windows and expressions. Ancestors are found by self-joins with doubling steps: after j of them every node
knows the one 2**j levels above it, so a tree of depth d needs log2(d) joins, not d. The chosen leaves then walk back up
with the same tables, each join doubling the nodes of a path. Branches are ranked by score before that, so rows grow with
what is formatted, not with all pairs of nodes and ancestors.

Template: `<|im_start|>` role newline text `<|im_end|>` newline for every turn. In roles and texts a backslash is doubled
and `<|` gets one between its characters; in roles a line break is written `<`, backslash, `n`. Only the template can
therefore contain `<|`, and `read_back` restores every text. The loss mask is the list of (start, end) code points of the
formatted text that hold assistant texts.

Odd cases: a null text or role is empty. Rows of a conversation are ordered by turn (null first), then role, then text;
repeated rows are turns of their own. Null conv_ids form one conversation. A reply to a missing turn starts a new root;
replies that form a loop have no root and are left out, as no path from a root reaches them. Empty tables give no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crowdlens.session import stage

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


# ---------------------------------------------------------------- template

def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def restored(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def restored_role(role: Column) -> Column:
    return restored(F.replace(role, F.lit("<\\n"), F.lit("\n")))


# ---------------------------------------------------------------- trees

def linear(rows: DataFrame) -> DataFrame:
    """Nodes of plain conversations: every row replies to the row before it, by turn."""
    text, role = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("text", "role"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return numbered.withColumn("node", F.row_number().over(order).cast("long")).withColumn(
        "parent", F.when(F.col("node") > 1, F.col("node") - 1))


def branching(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes of conversations whose rows name themselves (`node`, unique in a conversation) and what they reply to."""
    text, role = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("text", "role"))
    nodes = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        F.col(node).cast("long").alias("node"), F.col(parent).cast("long").alias("reply_to"))
    known = nodes.select(F.col("conv_id").alias("_conv"), F.col("node").alias("parent"))
    match = nodes["conv_id"].eqNullSafe(known["_conv"]) & (nodes["reply_to"] == known["parent"])
    return nodes.join(known, match, "left").drop("_conv", "reply_to")


def _beside(left: DataFrame, right: DataFrame, at: str, how: str) -> DataFrame:
    """Join of `left` with the node that column `at` names, whose columns are `_conv`, `_node` and others."""
    return left.join(right, left["conv_id"].eqNullSafe(right["_conv"]) & (left[at] == right["_node"]), how).drop("_conv", "_node")


def paths(nodes: DataFrame, score: Column | None = None, best: int = 1) -> DataFrame:
    """conv_id, branch (1: best), depth (0: root), role, text of the `best` branches of every conversation.

    A branch is scored by the mean of `score` over its nodes (default: 1 for a TRAINED node with text, else 0), then by
    its length, then by the smaller leaf.
    """
    if score is None:
        score = ((F.col("role") == TRAINED) & (F.col("text") != "")).cast("double")
    nodes = stage(nodes.withColumn("score", score.cast("double")), "reply-nodes")
    # up: the ancestor after `steps` = 2**j levels (null: the walk has ended at a root), and totals over the way there.
    # Walks that have ended wait for the others: only nodes at least 2**j below their root take part in join j.
    jumps = [stage(nodes.select("conv_id", "node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"),
                                F.col("score").alias("total")), "reply-jumps")]
    longest = nodes.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).head()[0] or 0
    for _ in range(max(longest - 1, 0).bit_length()):
        last = jumps[-1]
        above = last.select(F.col("conv_id").alias("_conv"), F.col("node").alias("_node"), F.col("up").alias("_up"),
                            F.col("steps").alias("_steps"), F.col("total").alias("_total"))
        further = _beside(last.where("up IS NOT NULL"), above, "up", "inner").select(
            "conv_id", "node", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("total") + F.col("_total")).alias("total"))
        jumps.append(stage(last.where("up IS NULL").union(further), "reply-jumps"))
    parents = nodes.where("parent IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("parent").alias("_node")).distinct()
    ends = jumps[-1].where("up IS NULL")  # in a loop there is always something above
    leaves = ends.join(parents, ends["conv_id"].eqNullSafe(parents["_conv"]) & (ends["node"] == parents["_node"]), "left_anti")
    order = W.partitionBy("conv_id").orderBy((F.col("total") / F.col("steps")).desc(), F.col("steps").desc(), "node")
    ways = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= best).select(
        "conv_id", "branch", "node", (F.col("steps") - 1).alias("depth"))
    for j in reversed(range(len(jumps) - 1)):
        above = jumps[j].where("up IS NOT NULL").select(
            F.col("conv_id").alias("_conv"), F.col("node").alias("_node"), F.col("up").alias("_up"))
        ways = stage(ways.union(_beside(ways, above, "node", "inner").select(
            "conv_id", "branch", F.col("_up").alias("node"), (F.col("depth") - 2**j).alias("depth"))), "reply-paths")
    texts = nodes.select(F.col("conv_id").alias("_conv"), F.col("node").alias("_node"), "role", "text")
    return _beside(ways, texts, "node", "inner").select("conv_id", "branch", "depth", "role", "text")


# ---------------------------------------------------------------- formatting and reading back

def formatted(path_rows: DataFrame) -> DataFrame:
    """conv_id, branch, formatted, and loss_mask: (start, end) code points of the assistant texts in `formatted`."""
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    pieces = path_rows.select("conv_id", "branch", "depth", (F.col("role") == TRAINED).alias("trained"), head.alias("head"),
                              escaped(F.col("text")).alias("body"))
    earlier = W.partitionBy("conv_id", "branch").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    start = F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.length("head")
    turn = F.struct("depth", "trained", "start", (F.col("start") + F.length("body")).alias("end"),
                    F.concat("head", "body", F.lit(END + "\n")).alias("piece"))
    turns = pieces.withColumn("start", start).groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"], t["end"]))
    return turns.select("conv_id", "branch", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                        mask.alias("loss_mask"))


def read_back(texts: DataFrame) -> DataFrame:
    """conv_id, branch, turns (role, text) and loss_text, restored from `formatted` and `loss_mask` alone."""
    parts = F.split("formatted", r"<\|im_start\|>")
    parts = F.slice(parts, 2, F.size(parts))  # nothing stands before the first mark
    turns = F.transform(parts, lambda p: F.struct(
        restored_role(F.substring_index(p, "\n", 1)).alias("role"),
        restored(F.substring(F.substring_index(p, END, 1), F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p)))
        .alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda m: restored(F.substring(
        F.col("formatted"), (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")
    return texts.select("conv_id", "branch", "formatted", turns.alias("turns"), loss.alias("loss_text"))
