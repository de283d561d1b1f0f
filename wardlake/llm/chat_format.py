"""Reply trees as training conversations, with DataFrame operations only.

A node is a message with a link to its parent. Iterative self-joins double the reach of
every link (parent, its parent, four up, ...); beginning with the leaves, each round joins the
members found so far with the links of that reach, so all root-to-leaf paths are listed after as
many rounds as the depth has binary digits. Branches of a tree are ranked by the mean score of
their messages, and each chosen path becomes one conversation.

The template is ``<|turn|>role<|text|>text<|end|>`` for each turn. Inside roles and texts ``&``
becomes ``&amp;``, and the first character of every control string becomes an entity, so no
text can end its turn and everything can be read back.

Defined results: null texts and roles are empty; null scores count as 0; a node whose parent is not
in its tree is a root; a cycle without a leaf below it is left out, and a path that runs into a cycle is an error; turns that share a
number are ordered by role and text, and repeated rows are turns of their own; rows with a null
conversation id form one conversation with a null id; an empty table gives an empty table;
further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.ordered import block_chunk, running_count
from wardlake.llm.tables import kept

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other common templates, as patterns of what follows the first character.
_ANGLE = r"<(?=\||/?s>|/?<?/?SYS>>|/?(?:system|user|assistant|im_start|im_end)>)"
_SQUARE = r"\[(?=/?INST\]|/?SYS\])"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, "&lt;"), _SQUARE, "&lsqb;")


def unescaped(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&lsqb;", "["), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, distance from the leaf) of every member of every root-to-leaf path.

    nodes: tree, node, parent (null for a root); tree and node identify a message.
    """
    nodes = kept(nodes.select("tree", "node", "parent"), "nodes")
    parents = nodes.select("tree", F.col("parent").alias("node")).where(F.col("node").isNotNull()).distinct()
    present = nodes.select("tree", F.col("node").alias("parent"))
    links = kept(nodes.where(F.col("parent").isNotNull()).join(present, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")), "links")
    members = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    reach, known, total = 1, members.count(), nodes.count()
    while True:
        further = members.join(links, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("distance") + reach).alias("distance"))
        members = kept(members.unionByName(further), "paths")
        found = members.count()
        if found == known:
            break
        if reach > total:
            raise ValueError("a path runs into a cycle of parent links")
        onward = links.select("tree", F.col("node").alias("up"), F.col("up").alias("_far"))
        links = kept(links.join(onward, ["tree", "up"]).select("tree", "node", F.col("_far").alias("up")), "links")
        known, reach = found, 2 * reach
    return members


def conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """The best ``branches`` of every tree (None: all), formatted.

    nodes: tree, node, parent, score, role, text. Returns tree, leaf, branch (rank by score), score, formatted, and
    loss_spans: code-point ranges [start, end) of the assistant's texts in ``formatted``.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nodes = kept(nodes, "messages")
    member = paths(nodes)
    scored = member.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = scored.withColumn("branch", rank)
    if branches is not None:
        chosen = chosen.where(F.col("branch") <= branches)
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    turn = nodes.select("tree", "node", (F.col("role") == "assistant").alias("learn"), head.alias("head"), escaped(F.col("text")).alias("body"))
    full = F.concat("head", "body", F.lit(END))
    turns = member.join(turn, ["tree", "node"]).select("tree", "leaf", "distance", "learn", F.length("head").alias("before"), F.length("body").alias("size"), full.alias("turn"))
    past = Window.partitionBy("tree", "leaf").orderBy(F.desc("distance")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn").cast("long")).over(past), F.lit(0)) + F.col("before")
    placed = turns.withColumn("start", start)
    order = F.array_sort(F.collect_list(F.struct("start", "turn")))
    spans = F.array_sort(F.collect_list(F.when(F.col("learn"), F.struct("start", (F.col("start") + F.col("size")).alias("end")))))
    text = placed.groupBy("tree", "leaf").agg(F.array_join(F.transform(order, lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))
    return text.join(chosen, ["tree", "leaf"]).select("tree", "leaf", "branch", "score", "formatted", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted text holds: turns (role, text) and loss_text, the text under the mask."""
    cut = F.split("formatted", F.lit(r"<\|end\|>"), -1)
    parts = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), lambda t: F.split(F.substring(t, len(TURN) + 1, 2**31 - 1), F.lit(r"<\|text\|>"), 2))
    turns = F.transform(parts, lambda p: F.struct(unescaped(F.get(p, F.lit(0))).alias("role"), unescaped(F.get(p, F.lit(1))).alias("text")))
    under = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(under, "")})


def chains(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations without links as trees: each turn's parent is the turn before it.

    A conversation's turns are numbered in blocks, so a very long one is no single task.
    """
    tree = F.coalesce(F.col(conv_id).cast("string"), F.lit("none")).alias("tree")
    at = F.coalesce(F.col(turn).cast("long"), F.lit(-(2**62)))
    work = rows.select(tree, at.alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = running_count(work, ["tree"], block_chunk(F.col("turn")), [F.col("turn"), F.col("role"), F.col("text")], "node")
    before = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", before.alias("parent"), F.lit(0.0).alias("score"), "role", "text")
