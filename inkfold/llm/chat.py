r"""Chat formatting of reply trees (operator 7); column functions only.

Messages name their parent.  Self-joins that double the reach of each pointer
find every message's depth and the score of its path from the root, so a path of
n messages takes log2(n) rounds.  Branches of a tree are ranked by their leaf's
mean score, the chosen leaves' paths are marked by walking the same pointers, and
each chosen path becomes one text.

The template writes a turn as ``### role: text</turn>`` and a newline.  Inside
texts a backslash is doubled, and the control strings are broken by one: ``##``
becomes ``#\#`` and ``</turn>`` becomes ``<\/turn>``, so a control string in the
output is always a real one, and the text can be read back exactly.  The loss
mask lists the code point spans of assistant texts.

Defined results: null texts are empty and a null role is an empty role; rows of
a null conversation form one conversation; equal turns follow each other by role
and text; an empty table gives an empty result; extra columns are left aside.
Repeated rows of a node all count, as turns that follow each other; if they name
different parents or scores, the smallest (parent, score) holds for the node, a
null parent before all others.  Rows without a node, and nodes whose way up ends
in a cycle, have no place in a tree: they are left out of the paths and returned
by ``rejects``; the rest of their conversation stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import written

OPEN, CLOSE = "### ", "</turn>\n"
COLUMNS = ["conv", "node", "parent", "role", "text", "score"]


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.regexp_replace(out, "#(?=#)", r"#\\")
    return F.replace(out, F.lit("</turn>"), F.lit(r"<\/turn>"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/ ])", "$1")


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(": "), F.lit(":\\ "))


def as_replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: ``conv, node, parent, role, text, score``."""
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    own = turns.select(F.col(conv).alias("conv"), F.row_number().over(order).cast("bigint").alias("node"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return own.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def paths(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Depth and path score of every node, the pointers of 1, 2, 4, ... steps that were used, and the nodes that never reach a root.

    ``nodes``: ``conv, node, parent, score``.  A parent that is not there, or a
    node of itself, makes a root.  A pointer that is open after as many steps as
    the largest conversation has nodes runs in a cycle.
    """
    one = nodes.filter("node is not null").groupBy("conv", "node").agg(F.min(F.struct("parent", "score")).alias("up"))
    one = one.select("conv", "node", "up.parent", "up.score")
    known = one.select("conv", F.col("node").alias("p"))
    up = one.alias("a").join(known.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.parent") == F.col("b.p")) & (F.col("a.parent") != F.col("a.node")), "left")
    state = up.select("a.conv", "a.node", F.col("b.p").alias("jump"), F.lit(0).cast("bigint").alias("depth"), F.col("a.score").alias("total"))
    state = written(state.withColumn("depth", F.when(F.col("jump").isNotNull(), 1).otherwise(0).cast("bigint")), "replies")
    most = state.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    used, steps = [state], 1
    while steps <= most and not state.filter("jump is not null").isEmpty():
        settled = state.filter("jump is null")  # only pointers that have not come to a root go on
        a, b = state.filter("jump is not null").alias("a"), state.alias("b")
        far = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.jump") == F.col("b.node")), "left")
        far = far.select(
            "a.conv", "a.node", F.col("b.jump").alias("jump"),
            (F.col("a.depth") + F.coalesce(F.col("b.depth"), F.lit(0))).alias("depth"),
            (F.col("a.total") + F.coalesce(F.col("b.total"), F.lit(0.0))).alias("total"),
        )
        state = written(settled.unionByName(far), "replies")
        used.append(state)
        steps *= 2
    return state.filter("jump is null").select("conv", "node", "depth", "total"), used, state.filter("jump is not null").select("conv", "node")


def rejects(replies: DataFrame) -> DataFrame:
    """``conv, node, reason`` of what has no place in a tree: rows without a node, and nodes whose way up ends in a cycle."""
    nowhere = replies.filter("node is null").select("conv", "node", F.lit("no node").alias("reason"))
    return nowhere.union(paths(replies.select("conv", "node", "parent", "score"))[2].withColumn("reason", F.lit("cycle")))


def choose_paths(replies: DataFrame, per_tree: int = 1) -> DataFrame:
    """``conv, node, depth, path``: the nodes of the ``per_tree`` best paths of each conversation.

    Leaves are ranked by the mean score of their path, then longer paths first, then by node.
    """
    reach, used, _ = paths(replies)
    parents = used[0].filter("jump is not null").select("conv", F.col("jump").alias("node")).distinct()  # a node of itself is nobody's parent
    a, b = reach.alias("a"), parents.alias("b")
    leaves = a.join(b, F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.node") == F.col("b.node")), "left_anti")
    best = Window.partitionBy("conv").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), F.col("depth").desc(), F.col("node"))
    marked = leaves.withColumn("path", F.row_number().over(best)).filter(F.col("path") <= per_tree).select("conv", "node", "path")
    marked = written(marked, "paths")
    for hop in reversed(used[:-1]):
        h = hop.filter("jump is not null").alias("h")
        m = marked.alias("m")
        more = m.join(h, F.col("m.conv").eqNullSafe(F.col("h.conv")) & (F.col("m.node") == F.col("h.node"))).select("m.conv", F.col("h.jump").alias("node"), "m.path")
        marked = written(marked.union(more).distinct(), "paths")  # a plan that names itself twice would double every round
    r, m = reach.alias("r"), marked.alias("m")
    return m.join(r, F.col("m.conv").eqNullSafe(F.col("r.conv")) & (F.col("m.node") == F.col("r.node"))).select("m.conv", "m.node", "r.depth", "m.path")


def format_replies(replies: DataFrame, per_tree: int = 1) -> DataFrame:
    """``conv, path, n_turns, formatted, loss_spans``: one row for each chosen path."""
    replies = written(replies.select(*COLUMNS), "replies")  # texts are ordered once
    chosen = choose_paths(replies.select("conv", "node", "parent", "score"), per_tree)
    c, r = chosen.alias("c"), replies.alias("r")
    turns = r.join(c, F.col("c.conv").eqNullSafe(F.col("r.conv")) & (F.col("c.node") == F.col("r.node")))
    head = F.concat(F.lit(OPEN), escaped_role(F.coalesce("r.role", F.lit(""))), F.lit(": "))
    part = F.struct("c.depth", head.alias("head"), escaped(F.coalesce("r.text", F.lit(""))).alias("body"), (F.col("r.role") == "assistant").alias("learned"))
    rows = turns.groupBy("c.conv", "c.path").agg(F.array_sort(F.collect_list(part)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(t["learned"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return rows.select("conv", "path", F.size("turns").cast("bigint").alias("n_turns"), formatted.alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    turns = F.slice(F.split(formatted, F.lit(CLOSE), -1), 1, F.greatest(F.size(F.split(formatted, F.lit(CLOSE), -1)) - 1, F.lit(0)))

    def turn(t: Column) -> Column:
        at = F.locate(": ", t)
        role = F.substr(t, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(t, at + 2)).alias("text"))

    return F.transform(turns, turn)


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss_spans, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
