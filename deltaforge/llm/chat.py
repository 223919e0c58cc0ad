"""Chat formatting of reply trees, in DataFrame operations only.

Root-to-leaf paths are enumerated by self-joins that double in reach: after k rounds every message knows its ancestor
2 ** k steps up and the score of the messages between. Leaves are ranked within their tree by the score of their path;
the messages of a chosen path are gathered by walking the same tables, again in as many rounds as the depth has bits.

In the formatted text a turn is ``<turn:role>``, a newline, its text, ``</turn>`` and a newline. Inside roles and texts
``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so that no text can hold a mark of the template, and
reading back gives what went in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaforge.llm.work import Scratch

LOSS_ROLES = ("assistant",)


def _key(c: Column) -> Column:
    """A string that is never null, unlike for unlike values."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees without branches: each row replies to the one before it by turn, role and text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", F.row_number().over(w).cast("long").alias("node"), "role", "text")
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The best root-to-leaf paths of each tree.

    :param messages: tree, node, parent, role, text, score; one row per node of a tree (of repeated nodes one is kept).
        A message whose parent is null or missing is a root. Null scores count as 0. Messages on a cycle of parents, or
        below one, have no root and so no path.
    :param paths: how many branches of a tree to keep, by the sum of their scores, then by the smaller leaf.
    :returns: tree, path (from 1), score, turns array<struct<role, text>> from the root down. No messages, no rows.
    """
    spark = messages.sparkSession
    scratch = Scratch(spark, "paths")
    rows = messages.select(_key(F.col("tree")).alias("t"), _key(F.col("node")).alias("n"), F.when(F.col("parent").isNotNull(), _key(F.col("parent"))).alias("p"), "tree", "node", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy("t", "n").agg(F.min(F.struct("p", "tree", "node", "role", "text", "score")).alias("m")).select("t", "n", "m.*")
    rows = scratch.write(rows, "messages")
    nodes = rows.select("t", "n")
    known = rows.where("p is not null").join(nodes.withColumnRenamed("n", "p"), ["t", "p"], "left_semi").select("t", "n", "p")
    step = scratch.write(rows.select("t", "n", "score").join(known.withColumnRenamed("p", "up"), ["t", "n"], "left"), "step")
    size = rows.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while not (ahead := step.where("up is not null").select("t", "n", "up")).isEmpty() and 1 << len(jumps) <= size:
        jumps.append(ahead)
        far = step.select("t", F.col("n").alias("up"), F.col("up").alias("up2"), F.col("score").alias("more"))
        reached = step.where("up is null")  # the root: nothing more to look up
        further = step.where("up is not null").join(far, ["t", "up"], "left").select("t", "n", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), F.col("up2").alias("up"))
        step = scratch.write(reached.select("t", "n", "score", "up").unionByName(further), "step")
    leaves = step.where("up is null").join(known.select("t", F.col("p").alias("n")).distinct(), ["t", "n"], "left_anti")
    leaves = leaves.join(rows.select("t", "n", "node"), ["t", "n"])
    ranked = leaves.withColumn("path", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("score"), "node", "n"))).where(F.col("path") <= paths)
    chosen = scratch.write(ranked.select("t", "path", "n", F.col("score").alias("total"), F.lit(0).cast("long").alias("up")), "chosen")
    for k, jump in enumerate(jumps):
        more = chosen.join(jump.withColumnRenamed("up", "above"), ["t", "n"]).select("t", "path", F.col("above").alias("n"), "total", (F.col("up") + (1 << k)).alias("up"))
        chosen = scratch.write(chosen.unionByName(more), "chosen")
    full = chosen.join(rows.select("t", "n", "tree", "role", "text"), ["t", "n"])
    turns = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("place"), "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return full.groupBy("t", "path").agg(F.first("tree").alias("tree"), F.first("total").alias("score"), turns.alias("turns")).select("tree", "path", "score", "turns")


def format_turns(turns: Column) -> Column:
    """The formatted text of turns array<struct<role, text>>; null roles and texts count as empty."""
    return F.array_join(F.transform(turns, lambda m: F.concat(F.lit("<turn:"), escape(m["role"]), F.lit(">\n"), escape(m["text"]), F.lit("</turn>\n"))), "")


def read_turns(formatted: Column, loss_roles: tuple[str, ...] = LOSS_ROLES) -> Column:
    """Turns array<struct<role, text, loss>> of a formatted text; loss marks texts that are trained on."""
    parts = F.filter(F.split(formatted, "</turn>\n"), lambda s: s != "")

    def one(s: Column) -> Column:
        head = F.instr(s, ">\n")
        role = unescape(F.substring(s, F.lit(7), head - 7))
        return F.struct(role.alias("role"), unescape(F.substring(s, head + 2, F.length(s))).alias("text"), role.isin(*loss_roles).alias("loss"))

    return F.transform(parts, one)


def format_conversations(messages: DataFrame, paths: int = 1) -> DataFrame:
    """Each chosen path of a reply tree as one conversation: tree, path, score, formatted."""
    return best_paths(messages, paths).select("tree", "path", "score", format_turns(F.col("turns")).alias("formatted"))
