"""Chat formatting of reply trees with DataFrame functions alone.

``reply_paths`` lists, for the best leaves of every tree, each message on the way from the root. Iterative self-joins
double the reach of every pointer: ``jump[k]`` leads from a message to its ancestor 2^k replies up, so a tree of depth d
takes log2(d) joins up and log2(d) joins down, and no intermediate table is larger than messages times log2(d) or than
the result. ``format_chat`` then writes each path as one conversation, and ``read_chat`` reads it back.

Template, one turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. In texts and roles every ``<`` followed by
n > 0 bars gets one more bar, so ``<|im_end|>`` inside a text becomes ``<||im_end|>`` and no control string remains; one
bar less restores it. A newline or backslash in a role is written ``\\n`` or ``\\\\``.

Nulls: a null tree is one tree like any other, and a message without an id is left out; a null text or role is empty, a null parent (or one that is not in the table) makes a root, a null score counts
as 0. Messages on or below a cycle have no root and are on no path. Repeated message ids: the row that sorts first by
its columns is kept. Empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

START, END = "<|im_start|>", "<|im_end|>"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\|+)", r"<|$1")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def escape_role(role: Column) -> Column:
    role = F.replace(F.coalesce(role, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return escape_text(F.replace(role, F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # A backslash is parked at a code point that the escaped form cannot hold before a letter.
    parked = F.replace(unescape_text(role), F.lit("\\\\"), F.lit("\\0"))
    return F.replace(F.replace(parked, F.lit("\\n"), F.lit("\n")), F.lit("\\0"), F.lit("\\"))


def chain_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before it; equal turns in order of role and text."""
    order = [F.col(turn_col).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    place = F.row_number().over(W.partitionBy(conv_col).orderBy(*order))
    placed = turns.select(F.col(conv_col).alias("tree"), place.alias("place"), "role", "text")
    return placed.select(
        "tree",
        F.col("place").cast("long").alias("message"),
        F.when(F.col("place") > 1, F.col("place") - 1).cast("long").alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def _keyed(df: DataFrame) -> DataFrame:
    """With the tree as a struct, which equals itself where the tree is null; without messages that have no id."""
    return df.filter("message is not null").withColumn("tree", F.struct("tree"))


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, message) for the ``keep`` best branches of each tree.

    ``messages`` has tree, message, parent, score. A branch's score is the sum over its messages; ties go to the longer
    branch, then to the smaller leaf id.
    """
    nodes = _keyed(messages).groupBy("tree", "message").agg(
        F.min(F.struct(F.col("parent"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))).alias("_first")
    ).select("tree", "message", "_first.parent", "_first.score")
    ids = nodes.select("tree", F.col("message").alias("parent"), F.lit(True).alias("_there"))
    jump = nodes.join(ids, ["tree", "parent"], "left").select(
        "tree", "message", F.when(F.col("_there"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("length")
    )
    jump = materialize(jump, "jump")
    inner = jump.filter("up is not null").select("tree", F.col("up").alias("message")).distinct()
    leaves = jump.select("tree", "message").join(inner, ["tree", "message"], "left_anti")
    levels = []
    limit = max(1, nodes.count()).bit_length() + 1
    while not jump.filter("up is not null").isEmpty() and len(levels) < limit:
        # Only messages whose pointer is not yet past the root are joined again.
        active, settled = jump.filter("up is not null"), jump.filter("up is null")
        levels.append(active)
        above = jump.select("tree", F.col("message").alias("up"), F.col("up").alias("_up2"), F.col("sum").alias("_sum2"), F.col("length").alias("_length2"))
        farther = active.join(above, ["tree", "up"]).select(
            "tree", "message", F.col("_up2").alias("up"), (F.col("sum") + F.col("_sum2")).alias("sum"), (F.col("length") + F.col("_length2")).alias("length")
        )
        jump = materialize(settled.unionByName(farther), "jump")
    best = W.partitionBy("tree").orderBy(F.col("sum").desc(), F.col("length").desc(), "message")
    chosen = (
        leaves.join(jump.filter("up is null"), ["tree", "message"])
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= keep)
    )
    path = chosen.select("tree", F.col("message").alias("leaf"), "rank", F.col("length").alias("depth"), "message")
    for k in reversed(range(len(levels))):
        step = levels[k].select("tree", "message", "up")
        both = F.array(
            F.struct(F.col("depth"), F.col("message")),
            F.struct((F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("message")),
        )
        path = (
            path.join(step, ["tree", "message"], "left")
            .select("tree", "leaf", "rank", F.explode(F.when(F.col("up").isNull(), F.slice(both, 1, 1)).otherwise(both)).alias("_at"))
            .select("tree", "leaf", "rank", "_at.depth", "_at.message")
        )
    return path.select("tree.tree", "leaf", "rank", "depth", "message")


def format_chat(messages: DataFrame, paths: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss_spans): spans are (start, chars), start from 1 in code points.

    A conversation is one value of the result and so is built in one task; a tree's branches are built apart.
    """
    texts = _keyed(messages).groupBy("tree", "message").agg(
        F.min(F.struct(F.col("parent"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"), "role", "text")).alias("_first")
    ).select("tree", "message", escape_role(F.col("_first.role")).alias("role"), escape_text(F.col("_first.text")).alias("text"))
    turns = _keyed(paths).join(texts, ["tree", "message"]).select(
        "tree", "leaf", "rank", "depth",
        F.concat(F.lit(START), "role", F.lit("\n")).alias("head"), "text", (F.col("role") == F.lit(trained_role)).alias("trained"),
    )
    whole = F.concat("head", "text", F.lit(END + "\n"))
    before = W.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.select(
        "tree", "leaf", "rank", "depth", whole.alias("turn"),
        F.when(
            F.col("trained"),
            F.struct(
                (F.coalesce(F.sum(F.length(whole)).over(before), F.lit(0)) + F.length("head") + 1).cast("int").alias("start"),
                F.length("text").cast("int").alias("chars"),
            ),
        ).alias("span"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("depth", "turn", "span")))
    return turns.groupBy("tree", "leaf", "rank").agg(F.count("*").alias("n_turns"), ordered.alias("_turns")).select(
        "tree.tree", "leaf", "rank", "n_turns",
        F.array_join("_turns.turn", "").alias("formatted"),
        F.filter("_turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape_text(
                F.substr(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(END) - 1)
            ).alias("text"),
        ),
    )


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape_text(F.substr(formatted, s["start"], s["chars"]))), "")
