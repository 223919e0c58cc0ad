"""Lineage of related models: edges (model_id, parent_id, seq) with ``base`` as the root."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE = "base"
#: Share of a whole model that a difference from a relative is taken to need.
SHARE = 0.3
LEVELS = 1000


def add_model(edges: DataFrame, model_id: str, parent: str | None = None) -> DataFrame:
    """Add a model under ``parent``, by default the one added last; a known id is refused, as it could close a cycle."""
    if not edges.where(F.col("model_id") == model_id).isEmpty() or model_id == BASE:
        raise ValueError(f"{model_id} is there already")
    last = edges.agg(F.max_by("model_id", "seq"), F.max("seq")).first()
    row = [(model_id, parent or last[0] or BASE, (last[1] if last[1] is not None else -1) + 1)]
    return edges.unionByName(edges.sparkSession.createDataFrame(row, edges.schema))


def depths(edges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Hops to the base: its direct children have 0. Models on or below a cycle, or whose ancestors are lost, have none."""
    return edges.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(model_id, depth) MAX RECURSION LEVEL {levels} AS (
          SELECT model_id, 0 FROM {{edges}} WHERE parent_id = '{BASE}' OR parent_id IS NULL
          UNION ALL SELECT e.model_id, w.depth + 1 FROM walk w JOIN {{edges}} e ON e.parent_id = w.model_id
        ) SELECT model_id, CAST(depth AS BIGINT) AS depth FROM walk""",
        edges=edges,
    )


def chains(edges: DataFrame, models: list[str] | None = None, levels: int = LEVELS) -> DataFrame:
    """(model_id, chain): from the base to the model. An unknown model hangs on the base."""
    spark = edges.sparkSession
    found = spark.sql(
        f"""
        WITH RECURSIVE walk(model_id, chain) MAX RECURSION LEVEL {levels} AS (
          SELECT model_id, array('{BASE}', model_id) FROM {{edges}} WHERE parent_id = '{BASE}' OR parent_id IS NULL
          UNION ALL SELECT e.model_id, array_append(w.chain, e.model_id) FROM walk w JOIN {{edges}} e ON e.parent_id = w.model_id
        ) SELECT model_id, chain FROM walk""",
        edges=edges,
    )
    if models is None:
        return found
    asked = spark.createDataFrame([(m,) for m in models], "model_id string")
    return asked.join(found, "model_id", "left").select("model_id", F.coalesce("chain", F.array(F.lit(BASE), "model_id")).alias("chain"))


def savings(edges: DataFrame) -> DataFrame:
    """Models, their mean depth and the share of room that storing differences saves, in percent."""
    n = F.col("n_models")
    got = edges.agg(F.count("*").alias("n_models")).crossJoin(depths(edges).agg(F.avg("depth").alias("avg_depth")))  # one row each
    kept = 1 + SHARE * (n - 1)
    return got.select("n_models", "avg_depth", F.when(n <= 1, F.lit(0.0)).otherwise((n - kept) / n * 100).alias("savings_percent"))


def best_parent(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """The model added last, or the base if there is none: one row (parent)."""
    return edges.agg(F.coalesce(F.max_by("model_id", "seq"), F.lit(BASE)).alias("parent"))


def nearest_parent(candidates: DataFrame, tensors: DataFrame, layers: int = 10) -> DataFrame:
    """The candidate (model_id, layer, idx, value) at the least distance over the first layers by name."""
    first = tensors.select("layer").distinct().orderBy("layer").limit(layers)
    other = tensors.join(F.broadcast(first), "layer").select("layer", "idx", F.col("value").alias("own"))
    d = F.col("value").cast("double") - F.col("own").cast("double")
    far = candidates.join(other, ["layer", "idx"]).groupBy("model_id").agg(F.sqrt(F.sum(d * d)).alias("distance"))
    return far.agg(F.min_by("model_id", F.struct("distance", "model_id")).alias("parent"), F.min("distance").alias("distance"))
