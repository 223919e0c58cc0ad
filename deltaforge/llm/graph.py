"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltaforge.llm.work import Scratch


#: Links from which a round writes what it joins, so that Spark can split the partition of a node of very many links.
MANY = 10_000


def _star(edges: DataFrame, small: bool, scratch: Scratch | None) -> DataFrame:
    """Hang each node's larger (small: smaller or equal) neighbours on its smallest neighbour."""
    if small:
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    if scratch:
        least = scratch.write(least, "least")
    found = both.join(least, "u")
    if small:
        out = found.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = found.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links(a, b)`` to ``(id, comp)`` for every id with a link; comp is the smallest id of its component.

    Nothing but two counts a round reaches the driver. An empty table of links gives an empty result.
    """
    edges = scratch.write(links.where("a <> b").select("a", "b").distinct(), "edges")
    seen, spread = None, scratch if edges.count() > MANY else None
    while True:
        large = _star(edges, False, spread)
        after = scratch.write(_star(scratch.write(large, "large") if spread else large, True, spread), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        scratch.drop(edges)
        edges = after
        if mark == seen:
            break
        seen = mark
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return stars.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp"))).distinct()
