"""Chat formatting of reply trees, in DataFrame operations only.

Messages name the message they answer. Root-to-leaf paths are found by self-joins
that double their reach every round: first up the tree, which gives every message
its depth and the score of its branch, then from the chosen leaves down the stored
rounds, which gives all messages of a path. Rounds grow with the logarithm of the
depth. Texts join in at the end.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Control strings of
this and of other common templates are escaped in roles and texts: a word joiner
is put behind the first character of the string, one more where there are some
already, so the strings never occur and the way back is exact.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.tables import stored

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates give a meaning. None overlaps with another.
CONTROL = (
    START,
    SEPARATOR,
    END,
    "<|endoftext|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
JOINER = "⁠"
_TAILS = {first: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) for first in ("<", "[")}
_FOUND = "|".join(rf"(?<={re.escape(f)}){{}}(?={JOINER}*(?:{tails}))" for f, tails in _TAILS.items())


def escape(text: Column) -> Column:
    """The text with one more joiner in each control string."""
    return F.regexp_replace(text, _FOUND.replace("{}", ""), JOINER)


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, _FOUND.replace("{}", JOINER), "")


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and branch score of every node that a root reaches, and the ancestors 1, 2, 4, ... steps up."""
    parents = nodes.select("tree", F.col("node").alias("parent"))
    linked = nodes.join(parents.withColumn("there", F.lit(True)), ["tree", "parent"], "left")
    now = linked.select(
        "tree",
        "node",
        F.when(F.col("there"), F.col("parent")).alias("up"),
        F.coalesce("score", F.lit(0.0)).alias("total"),
        F.lit(1).cast("bigint").alias("depth"),
    )
    now = stored(now)
    rounds = []
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while not now.filter("up is not null").isEmpty():
        rounds.append(now.filter("up is not null").select("tree", "node", "up"))
        if 1 << (len(rounds) - 1) > most:
            # What has not ended by now goes round in a circle.
            break
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("far"))
        # Only messages that still have someone above are joined; the others are done.
        further = now.filter("up is not null").join(above, ["tree", "up"]).select(
            "tree",
            "node",
            F.col("next").alias("up"),
            (F.col("total") + F.col("more")).alias("total"),
            (F.col("depth") + F.col("far")).alias("depth"),
        )
        now = stored(further.unionByName(now.filter("up is null")))
    return now.filter("up is null"), rounds


def paths(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """``(tree, leaf, rank, node, position)``: the messages of the chosen root-to-leaf paths.

    Branches of a tree are ranked by the mean score of their messages, the highest
    first, then by leaf; ``top`` keeps that many of each tree, None keeps all.
    """
    reached, rounds = _climb(nodes)
    answered = nodes.filter("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = reached.join(answered, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(best))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    now = stored(
        ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", (F.col("depth") - 1).alias("position"))
    )
    for number in range(len(rounds) - 1, -1, -1):
        up = now.join(rounds[number], ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("up").alias("node"), (F.col("position") - (1 << number)).alias("position")
        )
        now = stored(now.union(up))
    return now


def format_trees(messages: DataFrame, top: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """``(tree, leaf, rank, n_turns, formatted, loss)``: one row for each chosen path.

    ``messages`` has ``tree``, ``node`` (unique in its tree), ``parent`` (null at a
    root), ``role``, ``text`` and ``score``. ``loss`` lists the spans ``(start, end)`` of
    ``formatted``, in code points, that hold the texts of ``loss_role``. Null roles and
    texts are empty, null scores 0. A message whose parent is missing is a root;
    messages in a circle belong to no path. An empty table gives no rows.
    """
    chosen = paths(messages.select("tree", "node", "parent", F.col("score").cast("double").alias("score")), top)
    turns = chosen.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), escape(F.coalesce("role", F.lit(""))), F.lit(SEPARATOR))
    turns = turns.withColumns({"head": head, "body": escape(F.coalesce("text", F.lit("")))})
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(f"{END}\n")))
    begin = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("begin", begin.cast("bigint"))
    span = F.when(
        F.col("role") == loss_role,
        F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("body")).cast("bigint").alias("end")),
    )
    rows = turns.groupBy("tree", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("position", "turn", span.alias("span")))).alias("turns")
    )
    return rows.select(
        "tree",
        "leaf",
        "rank",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.col("turns.turn"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """Role, line feed, text, line feed of every turn, from the formatted text."""
    out = F.replace(formatted, F.lit(START), F.lit(""))
    out = F.replace(out, F.lit(SEPARATOR), F.lit("\n"))
    return unescape(F.replace(out, F.lit(f"{END}\n"), F.lit("\n")))


def count_turns(formatted: Column) -> Column:
    gone = F.length(formatted) - F.length(F.replace(formatted, F.lit(START), F.lit("")))
    return (gone / len(START)).cast("bigint")


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    parts = F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(parts, "")
