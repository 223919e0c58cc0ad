"""A base model, a fine-tune, and a base and derived dataset, derived from the driver's tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of the fixture: label, layer name, how many of 1000 elements change, divisor of the change.
LAYERS = [
    (0, "model.layers.0.self_attn.q_proj.weight", 50, 1000),
    (1, "model.layers.0.mlp.up_proj.weight", 300, 1000),
    (2, "model.embed_tokens.weight", 150, 1000),
    (3, "model.layers.0.input_layernorm.weight", 1000, 1000),
    (4, "lm_head.weight", 80, 1000),
    (5, "model.layers.1.mlp.down_proj.weight", 0, 1000),
    (6, "model.layers.1.self_attn.o_proj.weight", 900, 50),
    (7, "model.rotary.scale", 700, 1000),
    (8, "model.gate.weight", 900, 50),
    (9, "model.layers.1.self_attn.k_proj.weight", 900, 1000),
]


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for label, name, *_ in LAYERS for x in (label, name)])
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.posexplode("embedding").alias("pos", "value"))
    return rows.select(names[F.col("label")].alias("layer"), "label", (F.col("vec_id") * 64 + F.col("pos")).alias("idx"), "value")


def base_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).select("layer", "idx", "value")


def fine_tune(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut, div = (F.create_map(*[F.lit(x) for row in LAYERS for x in (row[0], row[k])])[F.col("label")] for k in (2, 3))
    h = (F.col("idx") * 7919) % 1000
    d = F.when(h < cut, (((h % 21) - 10).cast("double") / div).cast("float")).otherwise(F.lit(0).cast("float"))
    return _elements(spark, sf_dir).select("layer", "idx", (F.col("value") + d).cast("float").alias("value"))


#: The same two models in SQL, for the queries' oracles.
MODEL_SQL = (
    "WITH lay(label, layer, cut, div) AS (VALUES "
    + ", ".join(f"({a}, '{b}', {c}, {d})" for a, b, c, d in LAYERS)
    + """), el AS (
  SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings
), hh AS (
  SELECT lay.layer, cut, div, vec_id * 64 + pos AS idx, CAST(v AS FLOAT) AS base, ((vec_id * 64 + pos) * 7919) % 1000 AS h FROM el JOIN lay USING (label)
), pair AS (
  SELECT layer, idx, base, CAST(base + CASE WHEN h < cut THEN CAST(CAST((h % 21) - 10 AS DOUBLE) / div AS FLOAT) ELSE CAST(0 AS FLOAT) END AS FLOAT) AS ft FROM hh
), d AS (
  SELECT layer, idx, base, ft, CAST(ft - base AS FLOAT) AS delta FROM pair
)"""
)


def base_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 10 <> 0").select(F.col("doc_id").alias("id"), "text")


def derived_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), F.when(F.expr("doc_id % 13 = 0"), F.concat("text", F.lit(" [rev]"))).otherwise(F.col("text")).alias("text"))
    return own.unionByName(docs.where("doc_id % 20 = 0").select((F.col("doc_id") + 1_000_000).alias("id"), "text"))


DATASET_SQL = """WITH b AS (
  SELECT doc_id AS id, text, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE doc_id % 10 <> 0
), v0 AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN text || ' [rev]' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT doc_id + 1000000, text FROM documents WHERE doc_id % 20 = 0
), v AS (
  SELECT id, text, row_number() OVER (ORDER BY id) - 1 AS pos FROM v0
), i AS (
  SELECT id, max(pos) AS base_index FROM b GROUP BY id
), t AS (
  SELECT v.pos, v.id, v.text, i.base_index, i.id IS NOT NULL OR (v.id IS NULL AND i.base_index IS NOT NULL) AS hit
  FROM v LEFT JOIN i ON v.id IS NOT DISTINCT FROM i.id
), refs AS (
  SELECT pos, CASE WHEN base_index IS NOT NULL THEN 'reference' ELSE 'new' END AS type, base_index,
    CASE WHEN base_index IS NULL THEN sum(CASE WHEN base_index IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END AS new_index, id, text
  FROM t
)"""
