"""Chat formatting: reply trees become one formatted conversation for each chosen branch. Native operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtlens.llm.common import checkpoint

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Escapes, in the order in which they are applied; reading back goes the other way round. Afterwards no text or role
#: holds "<" or "[", with which every control string of the known templates begins.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.replace(text, F.lit("\n"), F.lit("&#10;")) if role else text


def unescape(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("&#10;"), F.lit("\n")) if role else text
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def best_branches(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The nodes of the best root-to-leaf paths: (tree, leaf, branch, depth, node).

    ``nodes``: tree, node, parent, score. Ancestor pointers double in iterative self-joins (1, 2, 4, ... replies up)
    and sum the scores, so a tree of depth d takes log2(d) joins. Leaves rank by their path's score, then by length,
    longer first, then by the smaller id. A parent that is missing from its tree makes a root; nodes whose ancestors
    form a circle reach no root and have no path; null scores count 0; in a null tree each node is a root. An empty table gives
    an empty table; other columns are ignored.
    """
    small = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = small.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    step = checkpoint(
        small.join(known, ["tree", "parent"], "left")
        .select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    )
    ups, n = [step.select("tree", "node", "up")], step.count()
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        if step.where("up is not null").isEmpty():
            break
        other = step.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        # nodes that have reached their root wait; each step's others are those of twice the depth
        higher = (
            step.where("up is not null").join(other, ["tree", "up"])
            .select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("depth") + F.col("d2")).alias("depth"))
        )
        step = checkpoint(step.where("up is null").unionByName(higher))
        ups.append(step.select("tree", "node", "up"))
    inner = ups[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    rank = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    leaves = (
        step.where("up is null").join(inner, ["tree", "node"], "left_anti")
        .withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
        .select("tree", F.col("node").alias("leaf"), "branch", "node")
    )
    # every ancestor is some sum of powers of two above the leaf
    marked = leaves
    for up in reversed(ups[:-1] or ups):
        both = F.array_compact(F.array("node", "up"))
        marked = marked.join(up, ["tree", "node"], "left").select("tree", "leaf", "branch", F.explode(both).alias("node"))
    return marked.distinct().join(step.where("up is null").select("tree", "node", "depth"), ["tree", "node"])


def format_paths(paths: DataFrame) -> DataFrame:
    """One conversation for each (tree, leaf): formatted text, and the spans (start, len; code points) under the loss.

    ``paths``: tree, leaf, branch, depth, role, text. Null texts and roles are empty. Assistant texts bear the loss.
    """
    role = F.coalesce("role", F.lit(""))
    line = F.concat(F.lit(OPEN), F.col("r"), F.lit("\n"), F.col("t"), F.lit(CLOSE))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = (
        paths.select("tree", "leaf", "branch", "depth", (role == "assistant").alias("trained"), escape(role, True).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("t"))
        .withColumn("line", line)
        .withColumn("start", F.coalesce(F.sum(F.char_length("line")).over(before), F.lit(0)) + len(OPEN) + F.char_length("r") + 1)
        .select("tree", "leaf", "branch", F.struct("depth", "line", "trained", "start", F.char_length("t").alias("len")).alias("turn"))
    )
    kept = turns.groupBy("tree", "leaf", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return kept.select(
        "tree", "leaf", "branch",
        F.array_join(F.transform("turns", lambda x: x["line"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> parsed out of the formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")
    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        skip = F.char_length(role) + 1
        body = F.substring(piece, skip + 1, F.char_length(piece) - skip - len(CLOSE))
        return F.struct(unescape(role, True).alias("role"), unescape(body).alias("text"))
    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["len"].cast("int")))), "")


def turn_tree(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as trees of nodes: each turn replies to the one before it.

    Equal or null turns go by role and text, nulls first; repeated rows stay separate turns. Rows without a
    conversation id form one conversation of their own.
    """
    w = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = turns.select(F.struct(F.col(conv).alias("id")).alias("tree"), F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return rows.withColumn("node", F.row_number().over(w).cast("long")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Format the best branches of each tree: tree, leaf, branch, formatted, loss_spans.

    Of rows with the same tree and node the one with the least (parent, role, text) counts; rows without a node id are
    no part of a tree. An empty table gives an empty table; other columns are ignored.
    """
    one = (
        nodes.where("node is not null").groupBy("tree", "node")
        .agg(F.min(F.struct("parent", "role", "text", "score")).alias("x")).select("tree", "node", "x.*")
    )
    one = checkpoint(one)
    return format_paths(best_branches(one, branches).join(one.select("tree", "node", "role", "text"), ["tree", "node"]))
