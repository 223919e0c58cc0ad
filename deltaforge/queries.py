"""The engine's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaforge import fixtures as fx, model
from deltaforge.operators import choose, codec, dataset as ds, diff, family, svd
from deltaforge.plans import artifact
from deltaforge.session import shared_dir, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("@scatter", f"'{choose.SCATTER}'")
        return f

    return add


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's differences. Both models come from one table here, but are joined as two."""
    return diff.difference(fx.base_model(spark, sf_dir), fx.fine_tune(spark, sf_dir))


def _r(c, name: str):
    return F.round(c, 6).alias(name)


_STATS = """, st AS (
  SELECT layer, count(*) AS numel, sqrt(sum(CAST(delta AS DOUBLE) * CAST(delta AS DOUBLE))) AS l2_norm, CAST(max(abs(delta)) AS DOUBLE) AS max_abs,
    avg(CASE WHEN abs(delta) < CAST(1e-6 AS FLOAT) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sparsity, avg(CAST(delta AS DOUBLE)) AS mean,
    stddev_samp(CAST(delta AS DOUBLE)) AS std, count(*) FILTER (WHERE abs(delta) >= CAST(1e-6 AS FLOAT)) AS nonzero
  FROM d GROUP BY layer
)"""
_TYPE = """, ty AS (
  SELECT layer, CASE
    WHEN contains(lower(layer), 'attn') OR contains(lower(layer), 'attention') OR contains(lower(layer), 'q_proj') OR contains(lower(layer), 'k_proj') OR contains(lower(layer), 'v_proj') THEN 'attention'
    WHEN contains(lower(layer), 'mlp') OR contains(lower(layer), 'ffn') OR contains(lower(layer), 'fc') OR contains(lower(layer), 'dense') THEN 'feedforward'
    WHEN contains(lower(layer), 'embed') OR contains(lower(layer), 'wte') OR contains(lower(layer), 'wpe') THEN 'embedding'
    WHEN contains(lower(layer), 'ln') OR contains(lower(layer), 'norm') THEN 'normalization'
    WHEN contains(lower(layer), 'lm_head') OR contains(lower(layer), 'output') THEN 'output'
    ELSE 'unknown' END AS layer_type FROM lay
)"""
_METHOD = """, me AS (
  SELECT st.*, layer_type, CASE WHEN max_abs < 1e-8::DOUBLE THEN 'zero'
    WHEN layer_type = 'attention' THEN CASE WHEN sparsity > 0.85::DOUBLE THEN @scatter WHEN max_abs < 0.1::DOUBLE THEN 'int8' ELSE 'hybrid' END
    WHEN layer_type = 'feedforward' THEN CASE WHEN sparsity > 0.95::DOUBLE THEN @scatter ELSE 'int8' END
    WHEN layer_type = 'embedding' THEN CASE WHEN sparsity > 0.80::DOUBLE THEN @scatter ELSE 'int8' END
    WHEN layer_type = 'normalization' THEN 'int8'
    WHEN layer_type = 'output' THEN CASE WHEN sparsity > 0.90::DOUBLE THEN @scatter ELSE 'int8' END
    ELSE CASE WHEN sparsity > 0.90::DOUBLE THEN @scatter WHEN max_abs < 0.15::DOUBLE THEN 'int8' ELSE 'hybrid' END END AS method
  FROM st JOIN ty USING (layer)
)"""
_SCALE = """, sc AS (
  SELECT layer, CASE WHEN max(abs(delta)) < CAST(1e-10 AS FLOAT) THEN CAST(1 AS FLOAT) ELSE CAST(max(abs(delta)) / CAST(127 AS FLOAT) AS FLOAT) END AS scale FROM d GROUP BY layer
), q8 AS (
  SELECT d.layer, idx, base, ft, delta, scale, CAST(round(greatest(CAST(-127 AS FLOAT), least(CAST(127 AS FLOAT), CAST(delta / scale AS FLOAT)))) AS INTEGER) AS q FROM d JOIN sc USING (layer)
)"""
_QUANT = """, qu AS (
  SELECT layer, quantile_cont(CAST(abs(delta) AS DOUBLE), 0.25) AS q25, quantile_cont(CAST(abs(delta) AS DOUBLE), 0.75) AS q75, quantile_cont(CAST(abs(delta) AS DOUBLE), 0.95) AS q95,
    quantile_cont(CAST(abs(delta) AS DOUBLE), 0.99) AS q99, quantile_disc(CAST(abs(delta) AS DOUBLE), 0.5) AS median, max(CAST(abs(delta) AS DOUBLE)) AS mx, min(CAST(abs(delta) AS DOUBLE)) AS mn,
    avg(CAST(delta AS DOUBLE)) AS mean, stddev_samp(CAST(delta AS DOUBLE)) AS std FROM d GROUP BY layer
)"""
_PARAMS = """, pa AS (
  SELECT me.layer, method, CASE WHEN method = @scatter THEN greatest(1e-6::DOUBLE, q25) WHEN method = 'hybrid' THEN median END AS threshold FROM me JOIN qu USING (layer)
)"""
M = fx.MODEL_SQL
#: x in half precision, where e is the distance of the numbers around it.
_HALF_OF = "CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE sign(x) * round_even(abs(x) / e, 0) * e END"


@query(M + " SELECT layer, idx, base, ft, delta FROM d")
def delta_elements(spark, sf_dir):
    """Differences of all elements."""
    return _deltas(spark, sf_dir)


_STATS_OUT = "SELECT layer, numel, round(l2_norm, 6) AS l2_norm, round(max_abs, 6) AS max_abs, round(sparsity, 6) AS sparsity, round(mean, 6) AS mean, round(std, 6) AS std FROM st"


def _stats_rounded(s: DataFrame) -> DataFrame:
    return s.select("layer", "numel", *[_r(c, c) for c in ("l2_norm", "max_abs", "sparsity", "mean", "std")])


@query(M + _STATS + _STATS_OUT)
def delta_stats_per_layer(spark, sf_dir):
    """Statistics of each layer's difference."""
    return _stats_rounded(diff.layer_stats(_deltas(spark, sf_dir)))


@query(M + _STATS + _STATS_OUT)
def delta_stats_from_blocks(spark, sf_dir):
    """The same from the physical form: dense indices, blocks, a fold in each block."""
    blocks = [model.to_blocks(model.dense(t), 1024) for t in (fx.base_model(spark, sf_dir), fx.fine_tune(spark, sf_dir))]
    return _stats_rounded(diff.block_stats(diff.block_differences(*blocks)))


@query(M + _QUANT + " SELECT layer, round(mean, 6) AS mean, round(std, 6) AS std, round(mx, 6) AS max, round(mn, 6) AS min, round(q25, 6) AS q25, round(q75, 6) AS q75, round(q95, 6) AS q95, round(q99, 6) AS q99, round(median, 6) AS median FROM qu")
def delta_distribution(spark, sf_dir):
    """Quantiles of each layer's changes."""
    d = diff.distribution(_deltas(spark, sf_dir))
    return d.select("layer", *[_r(c, c) for c in ("mean", "std", "max", "min", "q25", "q75", "q95", "q99", "median")])


@query(M + _TYPE + " SELECT layer, layer_type FROM ty WHERE layer IN (SELECT layer FROM d)")
def layer_type(spark, sf_dir):
    """Types of layers by their names."""
    return fx.base_model(spark, sf_dir).select("layer").distinct().select("layer", choose.layer_type(F.col("layer")).alias("layer_type"))


@query(M + _STATS + " SELECT layer, CASE WHEN max_abs < 1e-8::DOUBLE THEN 'zero' WHEN sparsity > 0.90::DOUBLE THEN @scatter ELSE 'int8' END AS method FROM st")
def method_basic(spark, sf_dir):
    """Encodings by statistics alone."""
    return diff.layer_stats(_deltas(spark, sf_dir)).select("layer", choose.method("basic").alias("method"))


@query(M + _STATS + _TYPE + _METHOD + " SELECT layer, method FROM me")
def method_smart(spark, sf_dir):
    """Encodings by layer type and statistics."""
    return _chosen(_deltas(spark, sf_dir)).select("layer", "method")


def _chosen(deltas: DataFrame) -> DataFrame:
    return diff.layer_stats(deltas).withColumn("method", choose.method("smart"))


def _params(deltas: DataFrame) -> DataFrame:
    return choose.parameters(_chosen(deltas).select("layer", "method").join(diff.distribution(deltas).select("layer", "q25", "median"), "layer"))


@query(M + _STATS + _TYPE + _METHOD + _QUANT + _PARAMS + " SELECT layer, method, round(threshold, 6) AS threshold FROM pa")
def compression_params(spark, sf_dir):
    """Thresholds of the chosen encodings."""
    return _params(_deltas(spark, sf_dir)).select("layer", "method", _r(F.col("threshold"), "threshold"))


@query(
    M + _STATS + _TYPE + _METHOD + _QUANT + _PARAMS + """, ct AS (
  SELECT layer, method, count(*) AS n, count(*) FILTER (WHERE CAST(abs(delta) AS DOUBLE) > threshold) AS k FROM d JOIN pa USING (layer) GROUP BY layer, method
) SELECT layer, method, round(CAST(2 * n AS DOUBLE) / CASE method WHEN @scatter THEN nullif(5 * k, 0) WHEN 'int8' THEN n + 4 WHEN 'hybrid' THEN 5 * k + (n - k) + 4 END, 6) AS ratio FROM ct"""
)
def estimated_ratio(spark, sf_dir):
    """How much smaller each layer should get; null for unchanged layers."""
    d = _deltas(spark, sf_dir)
    return choose.estimated_ratio(d, _params(d)).select("layer", "method", _r(F.col("ratio"), "ratio"))


_KEEP = "abs(delta) >= CAST(1e-6 AS FLOAT)"


@query(M + f" SELECT layer, idx, delta AS value FROM d WHERE {_KEEP}")
def nonzero_encode(spark, sf_dir):
    """Elements that change."""
    return codec.nonzero_encode(_deltas(spark, sf_dir))


@query(M + f" SELECT layer, idx, CASE WHEN {_KEEP} THEN delta ELSE CAST(0 AS FLOAT) END AS delta FROM d")
def scatter_decode(spark, sf_dir):
    """Changed elements scattered into zeros."""
    return codec.scatter_decode(codec.nonzero_encode(_deltas(spark, sf_dir)), fx.base_model(spark, sf_dir))


@query(M + f" SELECT layer, idx, CAST(CASE WHEN {_KEEP} THEN base + delta ELSE base END AS FLOAT) AS value FROM d")
def scatter_apply(spark, sf_dir):
    """Changed elements added to the base."""
    return codec.apply_scattered(fx.base_model(spark, sf_dir), codec.nonzero_encode(_deltas(spark, sf_dir)))


_DUP = "(VALUES ('l', CAST(0 AS BIGINT), 1.0, 0), ('l', 5, 2.0, 1), ('l', 0, 4.0, 2), ('l', 10, 3.0, 3), ('l', 99, 7.0, 4)) t(layer, idx, value, ord)"


def _repeats(spark):
    return spark.sql(f"SELECT layer, idx, CAST(value AS FLOAT) AS value, ord FROM VALUES {_DUP.removeprefix('(VALUES ').replace(') t(', ' AS t(', 1)}"), spark.range(15).select(F.lit("l").alias("layer"), F.col("id").alias("idx"), F.lit(1).cast("float").alias("value"))


@query(f"SELECT 'l' AS layer, r.range AS idx, CAST(coalesce(v.value, 0) AS FLOAT) AS delta FROM range(15) r LEFT JOIN (SELECT idx, arg_max(value, ord) AS value FROM (SELECT * FROM {_DUP}) GROUP BY idx) v ON v.idx = r.range")
def scatter_last_wins(spark, sf_dir):
    """Decoding repeated indices: the last counts, those out of range are ignored."""
    encoded, places = _repeats(spark)
    return codec.scatter_decode(codec.last_of_each(encoded), places)


@query(f"SELECT 'l' AS layer, r.range AS idx, CAST(1 + coalesce(v.value, 0) AS FLOAT) AS value FROM range(15) r LEFT JOIN (SELECT idx, sum(value) AS value FROM (SELECT * FROM {_DUP}) GROUP BY idx) v ON v.idx = r.range")
def scatter_accumulate(spark, sf_dir):
    """Applying repeated indices: they add up."""
    encoded, base = _repeats(spark)
    return codec.apply_scattered(base, encoded)


@query(M + _SCALE + " SELECT layer, scale FROM sc")
def int8_scales(spark, sf_dir):
    """Scales of the 8-bit codes."""
    return codec.int8_scales(_deltas(spark, sf_dir))


def _int8(spark, sf_dir):
    d = _deltas(spark, sf_dir)
    return d, codec.int8_encode(d, codec.int8_scales(d))


@query(M + _SCALE + " SELECT layer, idx, q FROM q8")
def int8_quantize(spark, sf_dir):
    """8-bit codes of all elements."""
    return _int8(spark, sf_dir)[1].select("layer", "idx", F.col("q").cast("int").alias("q"))


@query(M + _SCALE + " SELECT layer, idx, CAST(CAST(q AS FLOAT) * scale AS FLOAT) AS delta FROM q8")
def int8_dequantize(spark, sf_dir):
    """What the codes stand for."""
    return codec.int8_decode(_int8(spark, sf_dir)[1])


@query(M + _SCALE + " SELECT layer, idx, CAST(base + CAST(CAST(q AS FLOAT) * scale AS FLOAT) AS FLOAT) AS value FROM q8")
def int8_apply(spark, sf_dir):
    """Codes added to the base."""
    return codec.apply_int8(fx.base_model(spark, sf_dir), _int8(spark, sf_dir)[1])


@query(M + _SCALE + " SELECT layer, round(max(abs(CAST(delta AS DOUBLE) - CAST(CAST(CAST(q AS FLOAT) * scale AS FLOAT) AS DOUBLE))), 6) AS max_error, round(avg(abs(CAST(delta AS DOUBLE) - CAST(CAST(CAST(q AS FLOAT) * scale AS FLOAT) AS DOUBLE))), 6) AS mean_error FROM q8 GROUP BY layer")
def int8_quality(spark, sf_dir):
    """Errors of the 8-bit codes."""
    d, q = _int8(spark, sf_dir)
    return codec.error_by_layer(d, codec.int8_decode(q)).select("layer", _r(F.col("max_error"), "max_error"), _r(F.col("mean_error"), "mean_error"))


@query(
    M + """, me AS (SELECT layer, count(*) AS numel, row_number() OVER (ORDER BY layer) - 1 AS ord FROM d GROUP BY layer),
 la AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS rn, count(*) OVER () AS n FROM me WHERE contains(layer, 'weight') AND numel > 100)
 SELECT layer, numel, ord FROM la WHERE rn % greatest(1, n // 3) = 0 AND rn // greatest(1, n // 3) < 3"""
)
def every_kth_layer_sample(spark, sf_dir):
    """Three large layers, evenly spread."""
    meta = model.layer_meta(fx.base_model(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))
    return codec.every_kth_layer(meta, 3, 100)


_HYBRID = """, hm AS (SELECT layer, quantile_disc(CAST(abs(delta) AS DOUBLE), 0.5) AS threshold FROM d GROUP BY layer),
 hb AS (SELECT d.*, abs(delta) > CAST(threshold AS FLOAT) AS big FROM d JOIN hm USING (layer)),
 hs AS (SELECT layer, max(CASE WHEN big THEN CAST(0 AS FLOAT) ELSE abs(delta) END) AS top FROM hb GROUP BY layer),
 hc AS (SELECT layer, CASE WHEN top = 0 THEN CAST(0 AS FLOAT) WHEN top < CAST(1e-10 AS FLOAT) THEN CAST(1 AS FLOAT) ELSE CAST(top / CAST(127 AS FLOAT) AS FLOAT) END AS scale FROM hs),
 hq AS (SELECT hb.layer, idx, delta, big, scale, CASE WHEN scale > 0 THEN CAST(round(greatest(CAST(-127 AS FLOAT), least(CAST(127 AS FLOAT), CAST(CASE WHEN big THEN CAST(0 AS FLOAT) ELSE delta END / scale AS FLOAT)))) AS INTEGER) END AS q FROM hb JOIN hc USING (layer))"""


def _hybrid(spark, sf_dir):
    d = _deltas(spark, sf_dir)
    return codec.hybrid_encode(d, thresholds=diff.distribution(d).select("layer", F.col("median").alias("threshold")))


@query(M + _HYBRID + " SELECT layer, count(*) FILTER (WHERE big) AS exact, count(q) AS coded, CAST(coalesce(sum(q), 0) AS BIGINT) AS code_sum FROM hq GROUP BY layer")
def hybrid_split(spark, sf_dir):
    """Layers split at their median change: values above it exactly, the rest in codes."""
    exact, codes = _hybrid(spark, sf_dir)
    layers = fx.base_model(spark, sf_dir).select("layer").distinct()
    a = exact.groupBy("layer").agg(F.count("*").alias("exact"))
    b = codes.groupBy("layer").agg(F.count("*").alias("coded"), F.sum("q").alias("code_sum"))
    return layers.join(a, "layer", "left").join(b, "layer", "left").na.fill(0)


@query(M + _HYBRID + " SELECT layer, idx, CASE WHEN big THEN delta WHEN q IS NOT NULL THEN CAST(CAST(q AS FLOAT) * scale AS FLOAT) ELSE CAST(0 AS FLOAT) END AS delta FROM hq")
def hybrid_decode(spark, sf_dir):
    """The split layers put together."""
    return codec.hybrid_decode(*_hybrid(spark, sf_dir), fx.base_model(spark, sf_dir))


_BYTES = ", mb AS (SELECT *, 2 * numel AS ob, CASE method WHEN 'zero' THEN 0 WHEN @scatter THEN 6 * nonzero WHEN 'int8' THEN numel + 4 ELSE 2 * numel END AS cb, CASE method WHEN 'zero' THEN 0 WHEN @scatter THEN nonzero ELSE numel END AS ch FROM me)"


def _sizes(spark, sf_dir):
    n, k, m = F.col("numel"), F.col("nonzero"), F.col("method")
    return _chosen(_deltas(spark, sf_dir)).select("layer", "method", "numel", "nonzero", (2 * n).alias("original_bytes"), codec.packed_bytes(m, n, k).alias("compressed_bytes"), codec.changed(m, n, k).alias("changed_params"))


@query(M + _STATS + _TYPE + _METHOD + _BYTES + " SELECT layer, method, numel, nonzero, CAST(ob AS BIGINT) AS original_bytes, CAST(cb AS BIGINT) AS compressed_bytes, CAST(ch AS BIGINT) AS changed_params FROM mb")
def layer_manifest(spark, sf_dir):
    """Room that each layer takes."""
    return _sizes(spark, sf_dir)


@query(M + _STATS + _TYPE + _METHOD + _BYTES + " SELECT count(*) AS num_layers, CAST(sum(numel) AS BIGINT) AS total_params, CAST(sum(ch) AS BIGINT) AS changed_params, CAST(sum(ob) AS BIGINT) AS original_bytes, CAST(sum(cb) AS BIGINT) AS compressed_bytes, round(CAST(sum(ob) AS DOUBLE) / greatest(sum(cb), 1), 6) AS compression_ratio FROM mb")
def model_manifest(spark, sf_dir):
    """Room that the model takes."""
    s = _sizes(spark, sf_dir)
    sums = [F.sum(c).alias(n) for c, n in (("numel", "total_params"), ("changed_params", "changed_params"), ("original_bytes", "original_bytes"), ("compressed_bytes", "compressed_bytes"))]
    return s.agg(F.count("*").alias("num_layers"), *sums, _r(F.sum("original_bytes") / F.greatest(F.sum("compressed_bytes"), F.lit(1)), "compression_ratio"))


_REBUILT = _SCALE + f""", rb AS (
  SELECT q8.layer, idx, base, ft, method, CAST(base + CASE method WHEN 'zero' THEN CAST(0 AS FLOAT) WHEN @scatter THEN CASE WHEN {_KEEP} THEN delta ELSE CAST(0 AS FLOAT) END
    WHEN 'int8' THEN CAST(CAST(q AS FLOAT) * scale AS FLOAT) ELSE CASE WHEN abs(delta) > CAST(1e-6 AS FLOAT) THEN delta ELSE CAST(0 AS FLOAT) END END AS FLOAT) AS value FROM q8 JOIN me USING (layer)
)"""


def _rebuilt(spark, sf_dir):
    """Each layer encoded as chosen and decoded; hybrid with its exact values (codes hold dust below 1e-6 only, left out here)."""
    d = _deltas(spark, sf_dir)
    chosen = _chosen(d).select("layer", "method", codec.scale_of(F.col("max_abs").cast("float")).alias("scale"))
    value = (F.col("base") + codec.decoded(F.col("method"), F.col("delta"), F.col("scale"))).cast("float")
    return d.join(F.broadcast(chosen), "layer").select("layer", "idx", "ft", "method", value.alias("value"))


@query(M + _STATS + _TYPE + _METHOD + _REBUILT + " SELECT layer, idx, value FROM rb")
def reconstruct_model(spark, sf_dir):
    """The fine-tune rebuilt from the base and the chosen encodings."""
    return _rebuilt(spark, sf_dir).select("layer", "idx", "value")


@query(M + _STATS + _TYPE + _METHOD + _REBUILT + " SELECT method, count(*) AS n, round(max(abs(CAST(value AS DOUBLE) - CAST(ft AS DOUBLE))), 6) AS max_error, round(avg(abs(CAST(value AS DOUBLE) - CAST(ft AS DOUBLE))), 6) AS mean_error FROM rb GROUP BY method")
def reconstruct_error_by_method(spark, sf_dir):
    """How far the rebuilt model is from the fine-tune."""
    e = F.abs(F.col("value").cast("double") - F.col("ft").cast("double"))
    return _rebuilt(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"), _r(F.max(e), "max_error"), _r(F.avg(e), "mean_error"))


@query(
    M + """, a AS (SELECT DISTINCT layer FROM d WHERE layer NOT LIKE 'lm_head%'), b AS (SELECT DISTINCT layer FROM d WHERE layer NOT LIKE '%gate%')
 SELECT layer, CASE WHEN a.layer IS NULL THEN 'only derived' WHEN b.layer IS NULL THEN 'only base' ELSE 'both' END AS side FROM a FULL JOIN b USING (layer)"""
)
def missing_layer_policies(spark, sf_dir):
    """Layers that both models have, or one of them."""
    base, other = fx.base_model(spark, sf_dir).where("layer not like 'lm_head%'"), fx.fine_tune(spark, sf_dir).where("layer not like '%gate%'")
    found = diff.aligned_layers(base, other)
    return found.select("layer", F.when(F.col("base_numel").isNull(), "only derived").when(F.col("other_numel").isNull(), "only base").otherwise("both").alias("side"))


@query(M + " SELECT layer, count(*) AS n, CASE WHEN count(*) < 1024 THEN count(*) WHEN count(*) < 1000000 THEN 256 ELSE 1024 END AS tile FROM d GROUP BY layer")
def tile_size(spark, sf_dir):
    """Tiles by layer size."""
    return fx.base_model(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("n")).select("layer", "n", codec.tile_size(F.col("n")).alias("tile"))


@query(M + " SELECT layer, idx // 64 % 8 AS i, idx // 8 % 8 AS j, idx % 8 AS k, count(*) AS n FROM d WHERE abs(delta) > CAST(1e-6 AS FLOAT) GROUP BY ALL")
def coordinates(spark, sf_dir):
    """Changed elements by their place in an 8 x 8 x 8 tile."""
    c = codec.coordinates(F.col("idx"), [8, 8, 8])
    d = _deltas(spark, sf_dir).where(F.abs("delta") > F.lit(1e-6).cast("float"))
    return d.select("layer", c[0].alias("i"), c[1].alias("j"), c[2].alias("k")).groupBy("layer", "i", "j", "k").agg(F.count("*").alias("n"))


@query(M + ", m AS (SELECT layer, row_number() OVER (ORDER BY layer) - 1 AS ord FROM d GROUP BY layer) SELECT layer, ord, ord // 4 AS batch FROM m")
def layer_batches(spark, sf_dir):
    """Layers in batches of four, in order."""
    meta = model.layer_meta(fx.base_model(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))
    return diff.batches(meta, 4).select("layer", "ord", "batch")


def _svd(spark, sf_dir, rank):
    d = model.dense(_deltas(spark, sf_dir).select("layer", "idx", F.col("delta").alias("value"))).withColumnRenamed("value", "delta")
    shapes = d.groupBy("layer").agg((F.count("*") / 64).cast("long").alias("rows"))
    return d, svd.compress(d, shapes, rank)


@query()
def svd_rank_error(spark, sf_dir):
    """Errors of rank-16 factors by layer."""
    return _svd(spark, sf_dir, 16)[1].select("layer", "m", "n", "k", _r(F.col("mean_error"), "mean_error"), _r(F.col("max_error"), "max_error"))


@query()
def svd_manifest(spark, sf_dir):
    """Room and errors of rank-16 factors of the model."""
    return svd.summary(_svd(spark, sf_dir, 16)[1], 16)


@query()
def svd_reconstruct_product(spark, sf_dir):
    """Differences as their factors give them."""
    return svd.product(_svd(spark, sf_dir, 16)[1])


@query(M + ", c AS (SELECT layer, count(*) AS n FROM d GROUP BY layer) SELECT layer, true AS same, n FROM c")
def zstd_roundtrip(spark, sf_dir):
    """8-bit codes of blocks, compressed and expanded: equal in every layer."""
    from deltaforge.functions import int8_quantize as q, zstd_compress, zstd_decompress

    blocks = model.to_blocks(model.dense(_deltas(spark, sf_dir).select("layer", "idx", F.col("delta").alias("value"))), 4096)
    codes = blocks.select("layer", q("values")["codes"].alias("codes"))
    back = codes.select("layer", "codes", zstd_decompress(zstd_compress(3)("codes")).alias("back"))
    return back.groupBy("layer").agg(F.bool_and(F.col("codes") == F.col("back")).alias("same"), F.sum(F.octet_length("back").cast("long")).alias("n"))


@query("SELECT label, max(abs(x - v)) AS max_change FROM (SELECT label, CAST(v AS FLOAT) AS v, CAST(" + _HALF_OF + " AS FLOAT) AS x FROM (SELECT label, x AS v, CAST(x AS DOUBLE) AS x, pow(2.0::DOUBLE, greatest(CASE WHEN x = 0 THEN -24 ELSE floor(log2(abs(CAST(x AS DOUBLE)))) END, -14) - 10) AS e FROM (SELECT label, unnest(embedding) AS x FROM embeddings))) GROUP BY label")
def half_rounding(spark, sf_dir):
    """The largest change of each layer's base by half precision."""
    from deltaforge.functions import round_half

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "embedding")
    e = F.array_max(F.zip_with("embedding", round_half("embedding"), lambda x, y: F.abs(x - y)))
    return rows.select("label", e.alias("e")).groupBy("label").agg(F.max("e").alias("max_change"))


@query(M + ", dn AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY idx) - 1 AS idx, CAST(base + delta AS FLOAT) AS value FROM d), zero AS (SELECT layer FROM d GROUP BY layer HAVING max(abs(delta)) = 0) SELECT * FROM dn WHERE layer NOT IN (SELECT layer FROM zero)")
def streaming_blocks(spark, sf_dir):
    """Encoded blocks that arrive as files, applied batch by batch; layers without a difference send nothing."""
    from deltaforge.streaming.layers import apply_block_stream

    base, other = _blocks(spark, sf_dir)
    root = _folder(spark, "stream")
    artifact.compress_model(base, other, f"{root}/delta", mode="full")
    artifact.encoded_blocks(spark, f"{root}/delta").repartition(3, "layer", "block_id").write.parquet(f"{root}/in")
    apply_block_stream(base, f"{root}/in", f"{root}/out", f"{root}/state", 1).awaitTermination()
    return model.to_long(spark.read.parquet(f"{root}/out"))


def _data(spark, sf_dir):
    return ds.number(fx.base_dataset(spark, sf_dir), ["id"]), ds.number(fx.derived_dataset(spark, sf_dir), ["id"])


D = fx.DATASET_SQL


@query(D + " SELECT pos, type, base_index, CAST(new_index AS BIGINT) AS new_index, id FROM refs")
def dataset_refs(spark, sf_dir):
    """A derived dataset as references and new rows."""
    return ds.references(*_data(spark, sf_dir)).select("pos", "type", "base_index", "new_index", "id")


@query(D + " SELECT CAST(new_index AS BIGINT) AS new_index, id, text FROM refs WHERE type = 'new'")
def dataset_new_rows(spark, sf_dir):
    """Its new rows."""
    return ds.new_rows(ds.references(*_data(spark, sf_dir))).select("new_index", "id", "text")


@query(D + """ SELECT r.pos, CASE WHEN type = 'reference' THEN b.id ELSE r.id END AS id, CASE WHEN type = 'reference' THEN b.text ELSE r.text END AS text FROM refs r LEFT JOIN b ON r.base_index = b.pos""")
def dataset_reconstruct(spark, sf_dir):
    """The derived dataset rebuilt."""
    base, derived = _data(spark, sf_dir)
    refs = ds.references(base, derived)
    return ds.reconstruct(base, refs, ds.new_rows(refs))


@query(D + " SELECT r.pos, r.id FROM refs r JOIN b ON r.base_index = b.pos WHERE r.text <> b.text")
def dataset_silently_modified(spark, sf_dir):
    """Rows whose edits matching by id alone would lose."""
    return ds.references(*_data(spark, sf_dir), match="content").where("modified").select("pos", "id")


@query(D + """, e AS (SELECT r.pos, r.id, CASE WHEN r.text = b.text THEN r.base_index END AS base_index FROM refs r LEFT JOIN b ON r.base_index = b.pos)
 SELECT pos, id, base_index, CASE WHEN base_index IS NULL THEN 'new' ELSE 'reference' END AS type FROM e""")
def dataset_content_match(spark, sf_dir):
    """References that also compare content."""
    return ds.references(*_data(spark, sf_dir), match="content").select("pos", "id", "base_index", "type")


_TALKS = """WITH c AS (SELECT role, conv_id * 1000 + turn AS id, text, conv_id FROM conversations),
 b AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY id) - 1 AS pos FROM c WHERE conv_id % 5 <> 0 AND role <> 'system'),
 v AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY id) - 1 AS pos FROM c WHERE conv_id % 3 <> 0),
 r AS (SELECT v.role, v.pos, v.id, b.pos AS base_index FROM v LEFT JOIN b ON v.role = b.role AND v.id = b.id)"""


def _talks(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "conv_id")
    return ds.number(c.where("conv_id % 5 <> 0 and role <> 'system'"), ["id"], ["role"]), ds.number(c.where("conv_id % 3 <> 0"), ["id"], ["role"])


@query(_TALKS + " SELECT role, count(*) AS num_samples, count(*) FILTER (WHERE base_index IS NULL) AS num_new, count(base_index) AS num_referenced, role || '_refs.json' AS refs_file, CASE WHEN count(*) > count(base_index) THEN role || '_new.json' END AS new_samples_file FROM r GROUP BY role")
def dataset_split_summary(spark, sf_dir):
    """References by split; the base lacks one of them."""
    return ds.split_summary(ds.references(*_talks(spark, sf_dir), splits=["role"]), "role")


@query(_TALKS + " SELECT role, pos, id, base_index FROM r")
def dataset_refs_by_split(spark, sf_dir):
    """References within each split."""
    return ds.references(*_talks(spark, sf_dir), splits=["role"]).select("role", "pos", "id", "base_index")


_JSON = "strlen(CAST(to_json({'id': id, 'text': text}) AS VARCHAR))"


@query(
    D + f""", s AS (SELECT (SELECT sum({_JSON}) FROM b) AS bb, (SELECT sum({_JSON}) FROM v) AS db, (SELECT coalesce(sum({_JSON}), 0) FROM refs WHERE type = 'new') AS nb,
 (SELECT sum(strlen(CAST(to_json({{'type': type, 'base_index': base_index, 'new_index': CAST(new_index AS BIGINT)}}) AS VARCHAR))) FROM refs) AS rb)
 SELECT CAST(bb AS BIGINT) AS base_bytes, CAST(db AS BIGINT) AS derivative_bytes, CAST(nb + rb AS BIGINT) AS delta_bytes, round(greatest(0.0::DOUBLE, CAST(db - (nb + rb) AS DOUBLE) / greatest(db, 1) * 100), 6) AS savings_percent FROM s"""
)
def dataset_size_stats(spark, sf_dir):
    """Bytes of the datasets and of the delta."""
    base, derived = _data(spark, sf_dir)
    s = ds.size_stats(base, ds.references(base, derived), ["id", "text"])
    return s.select("base_bytes", "derivative_bytes", "delta_bytes", _r(F.col("savings_percent"), "savings_percent"))


@query(
    D + f""", b1 AS (SELECT DISTINCT id FROM b WHERE pos < 1000), v1 AS (SELECT * FROM v WHERE pos < 1000),
 g AS (SELECT count(b1.id) AS shared, count(*) - count(b1.id) AS nw, CAST(sum({_JSON.replace('id,', 'v1.id,')}) AS DOUBLE) / 1048576.0 AS mb, count(*) AS n FROM v1 LEFT JOIN b1 ON v1.id = b1.id)
 SELECT shared, nw AS new, CAST(0 AS BIGINT) AS modified, round(mb, 6) AS derivative_mb, round(0.001::DOUBLE * shared + nw * mb / n, 6) AS delta_mb, round((mb - (0.001::DOUBLE * shared + nw * mb / n)) / mb * 100, 6) AS savings_percent FROM g"""
)
def dataset_estimate(spark, sf_dir):
    """What a delta should save, by the first thousand rows."""
    e = ds.estimate(*_data(spark, sf_dir), payload=["id", "text"])
    return e.select("shared", "new", "modified", _r(F.col("derivative_mb"), "derivative_mb"), _r(F.col("delta_mb"), "delta_mb"), _r(F.col("savings_percent"), "savings_percent"))


@query(
    """WITH b(pos, id) AS (VALUES (0, 'a'), (1, 'b'), (2, 'a'), (3, NULL)), v(pos, id) AS (VALUES (0, 'a'), (1, 'c'), (2, NULL), (3, 'a'))
 SELECT CAST(v.pos AS BIGINT) AS pos, v.id, CAST(i.base_index AS BIGINT) AS base_index FROM v LEFT JOIN (SELECT id, max(pos) AS base_index FROM b GROUP BY id) i ON v.id IS NOT DISTINCT FROM i.id"""
)
def dataset_null_and_duplicate_ids(spark, sf_dir):
    """Of repeated ids the last counts, and null matches null."""
    base = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "pos long, id string")
    derived = spark.createDataFrame([(0, "a"), (1, "c"), (2, None), (3, "a")], "pos long, id string")
    return ds.references(base, derived).select("pos", "id", "base_index")


#: A family of models: id, parent, order.
EDGES = [("m1", "base", 0), ("m2", "m1", 1), ("m3", "m2", 2), ("m4", "base", 3), ("m5", "m1", 4)]
_EDGES = "WITH RECURSIVE e(model_id, parent_id, seq) AS (VALUES " + ", ".join(map(str, EDGES)) + ")"
_WALK = _EDGES + """, w(model_id, depth, chain) AS (SELECT model_id, 0, 'base,' || model_id FROM e WHERE parent_id = 'base'
 UNION ALL SELECT e.model_id, w.depth + 1, w.chain || ',' || e.model_id FROM w JOIN e ON e.parent_id = w.model_id)"""


def _edges(spark):
    return spark.createDataFrame(EDGES, "model_id string, parent_id string, seq long")


@query(_WALK + " SELECT model_id, CAST(depth AS BIGINT) AS depth FROM w")
def family_depth(spark, sf_dir):
    """Hops of each model to the base."""
    return family.depths(_edges(spark))


@query(_WALK + " SELECT model_id, chain FROM w UNION ALL SELECT 'm9', 'base,m9'")
def family_chain(spark, sf_dir):
    """Models from the base to each; an unknown one hangs on the base."""
    found = family.chains(_edges(spark), [m for m, *_ in EDGES] + ["m9"])
    return found.select("model_id", F.array_join("chain", ",").alias("chain"))


@query(_WALK + " SELECT count(*) AS n_models, round(avg(depth), 6) AS avg_depth, round((count(*) - (1 + 0.3::DOUBLE * (count(*) - 1))) / count(*) * 100, 6) AS savings_percent FROM w")
def family_savings(spark, sf_dir):
    """What storing a family as differences saves."""
    return family.savings(_edges(spark)).select("n_models", _r(F.col("avg_depth"), "avg_depth"), _r(F.col("savings_percent"), "savings_percent"))


@query(_EDGES + " SELECT arg_max(model_id, seq) AS parent FROM e")
def family_best_parent(spark, sf_dir):
    """The model added last."""
    return family.best_parent(spark, _edges(spark))


_DENSE = """, dn AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY idx) - 1 AS place, base, ft, value FROM rb)"""


def _blocks(spark, sf_dir, size: int = 4096):
    """Both models of the fixture in blocks, their elements numbered from 0."""
    return [written(model.to_blocks(model.dense(t), size), "blocks") for t in (fx.base_model(spark, sf_dir), fx.fine_tune(spark, sf_dir))]


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(M + _STATS + _TYPE + _METHOD + _REBUILT + _DENSE + " SELECT layer, place AS idx, round(CAST(value AS DOUBLE), 5) AS value FROM dn")
def artifact_reconstruct(spark, sf_dir):
    """An artifact written, read and applied by blocks: the fine-tune as its encodings keep it."""
    base, other = _blocks(spark, sf_dir)
    folder = _folder(spark, "artifact")
    artifact.compress_model(base, other, folder)
    return model.to_long(artifact.reconstruct_model(base, folder, strict=True)).select("layer", "idx", F.round(F.col("value").cast("double"), 5).alias("value"))


@query(M + ", dn AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY idx) - 1 AS idx, CAST(base + delta AS FLOAT) AS value FROM d) SELECT * FROM dn")
def artifact_reconstruct_full(spark, sf_dir):
    """The same without loss: differences stored whole."""
    base, other = _blocks(spark, sf_dir)
    folder = _folder(spark, "artifact")
    artifact.compress_model(base, other, folder, mode="full")
    return model.to_long(artifact.reconstruct_model(base, folder, strict=True))


@query(M + _STATS + _TYPE + _METHOD + _BYTES + " SELECT layer, layer_type, method, numel, nonzero, CAST(cb AS BIGINT) AS compressed_bytes, round(max_abs, 6) AS max_abs, round(l2_norm, 6) AS l2_norm, round(sparsity, 6) AS sparsity FROM mb")
def artifact_manifest_layers(spark, sf_dir):
    """The layers that an artifact's manifest lists, read back from its file."""
    folder = _folder(spark, "artifact")
    artifact.compress_model(*_blocks(spark, sf_dir), folder)
    rows = artifact.read_manifest(spark, folder)["layers"]
    fields = "layer string, layer_type string, method string, numel long, nonzero long, compressed_bytes long, max_abs double, l2_norm double, sparsity double"
    found = spark.createDataFrame(rows, fields)
    return found.select("layer", "layer_type", "method", "numel", "nonzero", "compressed_bytes", *[_r(c, c) for c in ("max_abs", "l2_norm", "sparsity")])


@query(M + " SELECT layer, count(*) AS n, true AS near FROM d GROUP BY layer")
def artifact_svd_full_rank(spark, sf_dir):
    """An artifact of factors of full rank gives every element back, but for half precision: within 0.002 of the fine-tune."""
    from deltaforge.plans import lossy

    base, other = (written(model.dense(t), "long") for t in (fx.base_model(spark, sf_dir), fx.fine_tune(spark, sf_dir)))
    folder = _folder(spark, "artifact")
    lossy.compress_model_svd(base, other, base.groupBy("layer").agg((F.count("*") / 64).cast("long").alias("rows")), folder, 64)
    both = lossy.reconstruct_model_svd(base, folder).join(other.withColumnRenamed("value", "ft"), ["layer", "idx"])
    return both.groupBy("layer").agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("value") - F.col("ft")) < 0.002).alias("near"))


#: An adapter of rank 2 for one layer: factors by rule, so that SQL can give them as well.
ADAPTED = fx.LAYERS[0][1]


@query(
    M + f""", w AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY idx) - 1 AS idx, base FROM d)
 SELECT layer, idx, round(CAST(base AS DOUBLE) + CASE WHEN layer = '{ADAPTED}' THEN 2.0::DOUBLE * (CAST(((idx // 64) % 5 - 2) / 8.0::DOUBLE AS FLOAT) * CAST((idx % 64 % 7 - 3) / 16.0::DOUBLE AS FLOAT)
   + CAST(((idx // 64) % 3 - 1) / 8.0::DOUBLE AS FLOAT) * CAST((idx % 64 % 4 - 1) / 16.0::DOUBLE AS FLOAT)) ELSE 0 END, 4) AS value FROM w"""
)
def artifact_adapter_merge(spark, sf_dir):
    """Base plus scale * B * A in the adapted layer."""
    base = _blocks(spark, sf_dir)[0]
    rows = base.where(F.col("layer") == ADAPTED).agg((F.sum(F.size("values").cast("long")) / 64).cast("long").alias("m"))
    x = lambda c: c.cast("float")
    b = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda i: F.array(x((i % 5 - 2) / 8), x((i % 3 - 1) / 8))))
    j = F.sequence(F.lit(0), F.lit(63))
    a = F.concat(F.transform(j, lambda i: x((i % 7 - 3) / 16)), F.transform(j, lambda i: x((i % 4 - 1) / 16)))
    factors = rows.select(F.lit(ADAPTED).alias("layer"), "m", F.lit(64).cast("long").alias("n"), F.lit(2).cast("long").alias("k"), a.alias("a"), b.alias("b"), F.lit(2.0).alias("scale"))
    return model.to_long(artifact.merge_adapter(base, factors)).select("layer", "idx", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("SELECT * FROM (VALUES ('same rows in another order', true), ('one element edited', false), ('one layer renamed', false)) t(change, same)")
def model_hash(spark, sf_dir):
    """What leaves a model's hash as it is, and what doesn't."""
    base = _blocks(spark, sf_dir)[0]
    edited = base.withColumn("values", F.when((F.col("layer") == ADAPTED) & (F.col("block_id") == 0), F.transform("values", lambda v, k: F.when(k == 7, v + 1).otherwise(v))).otherwise(F.col("values")))
    renamed = base.withColumn("layer", F.when(F.col("layer") == ADAPTED, "other").otherwise(F.col("layer")))
    whole = artifact.model_hash(base)
    changes = {"same rows in another order": base.repartition(3, "block_id"), "one element edited": edited, "one layer renamed": renamed}
    return spark.createDataFrame([(name, artifact.model_hash(df) == whole) for name, df in changes.items()], "change string, same boolean")


@query(M + _STATS + _TYPE + _METHOD + _REBUILT + _DENSE + " SELECT layer, place AS idx, round(CAST(value AS DOUBLE), 5) AS value FROM dn")
def cached_reconstruct(spark, sf_dir):
    """A model rebuilt by a cache's job and served from its folder."""
    return _cached(spark, sf_dir)[0].select("layer", "idx", F.round(F.col("value").cast("double"), 5).alias("value"))


def _cached(spark, sf_dir):
    from deltaforge.cache import DeltaCache, load

    base, other = _blocks(spark, sf_dir)
    root = _folder(spark, "cached")
    base.write.parquet(f"{root}/base.parquet")
    artifact.compress_model(base, other, f"{root}/delta", f"{root}/base.parquet")
    cache = DeltaCache(spark, f"{root}/cache")
    before = cache.key(f"{root}/base.parquet", f"{root}/delta")
    served = model.to_long(load(spark, f"{root}/delta", cache=cache))
    return served, cache, root, before, other


@query("SELECT * FROM (VALUES ('asked again', true, true), ('base overwritten', false, false)) t(when_asked, same_key, there)")
def cache_key(spark, sf_dir):
    """Whether a cache's key is the same, and the rebuilt model there, when it is asked again and when the base has changed."""
    _, cache, root, before, other = _cached(spark, sf_dir)
    where, rows = (f"{root}/base.parquet", f"{root}/delta"), []
    for what in ("asked again", "base overwritten"):
        if what != "asked again":
            other.write.mode("overwrite").parquet(where[0])
        rows.append((what, cache.key(*where) == before, cache.is_reconstructed(*where)))
    return spark.createDataFrame(rows, "when_asked string, same_key boolean, there boolean")


@query("SELECT * FROM (VALUES (768, 12, 50257), (4096, 32, 50000), (8192, 80, 32000)) t(hidden, layers, vocab), LATERAL (SELECT round((12.0::DOUBLE * hidden * hidden * layers + CAST(vocab AS DOUBLE) * hidden) / 1e9::DOUBLE, 6) AS billions, round(4.0::DOUBLE * hidden * hidden * layers / 1e9::DOUBLE, 6) AS billions_by_width) b, LATERAL (SELECT billions >= 30 OR billions_by_width > 10 AS large) c")
def model_size(spark, sf_dir):
    """Parameters of transformers by their shape, and which are large."""
    shapes = spark.createDataFrame([(768, 12, 50257), (4096, 32, 50000), (8192, 80, 32000)], "hidden int, layers int, vocab int")
    return choose.model_size(shapes).withColumns({c: F.round(c, 6) for c in ("billions", "billions_by_width")})


@query(M + _STATS + _TYPE + _METHOD + _BYTES + " SELECT layer, CAST(ob AS BIGINT) AS original_bytes, CAST(cb AS BIGINT) AS compressed_bytes, round(CASE WHEN cb = 0 THEN 'Infinity'::DOUBLE ELSE CAST(ob AS DOUBLE) / cb END, 6) AS compression_ratio, round(1 - CAST(cb AS DOUBLE) / ob, 6) AS sparsity FROM mb")
def compression_stats(spark, sf_dir):
    """Ratio and share of room saved by layer."""
    found = choose.compression_stats(_sizes(spark, sf_dir).select("layer", "original_bytes", "compressed_bytes"))
    return found.withColumns({c: F.round(c, 6) for c in ("compression_ratio", "sparsity")})


_STREAM_BYTES = ", mb AS (SELECT *, CASE method WHEN 'zero' THEN 0 WHEN @scatter THEN 6 * nonzero WHEN 'int8' THEN numel WHEN 'hybrid' THEN 6 * nonzero + numel ELSE 2 * numel END AS cb FROM me)"


@query(M + _STATS + _TYPE + _METHOD + _STREAM_BYTES + " SELECT layer, method, CAST(cb AS BIGINT) AS compressed_bytes FROM mb")
def layer_bytes_streaming(spark, sf_dir):
    """Room that each layer takes by the streaming profile."""
    chosen = _chosen(_deltas(spark, sf_dir))
    return chosen.select("layer", "method", codec.packed_bytes(F.col("method"), F.col("numel"), F.col("nonzero"), F.col("numel"), "streaming").alias("compressed_bytes"))


@query(M + _STATS + _TYPE + _METHOD + " SELECT layer, method, CASE method WHEN 'int8' THEN layer NOT LIKE '%layernorm%' WHEN 'hybrid' THEN true END AS per_channel FROM me")
def per_channel_flag(spark, sf_dir):
    """Which layers' 8-bit codes would have scales by row: matrices, here all but the norm."""
    d = _chosen(_deltas(spark, sf_dir)).select("layer", "method", F.lit(0.0).alias("q25"), F.lit(0.0).alias("median"), "numel")
    shapes = d.select("layer", F.when(F.contains("layer", F.lit("layernorm")), F.array("numel")).otherwise(F.array(F.floor(F.col("numel") / 64), F.lit(64).cast("long"))).alias("shape"))
    return choose.parameters(d, shapes).select("layer", "method", "per_channel")




@query(
    M + _SCALE + f""", h0 AS (SELECT layer, idx, CAST(base AS DOUBLE) AS x, CAST(CAST(q AS FLOAT) * scale AS FLOAT) AS dq FROM q8),
 h1 AS (SELECT *, pow(2.0::DOUBLE, greatest(CASE WHEN x = 0 THEN -24 ELSE floor(log2(abs(x))) END, -14) - 10) AS e FROM h0), h2 AS (SELECT layer, idx, dq, CAST({_HALF_OF} AS FLOAT) AS b FROM h1),
 h3 AS (SELECT layer, idx, CAST(CAST(b + dq AS FLOAT) AS DOUBLE) AS x FROM h2), h4 AS (SELECT *, pow(2.0::DOUBLE, greatest(CASE WHEN x = 0 THEN -24 ELSE floor(log2(abs(x))) END, -14) - 10) AS e FROM h3)
 SELECT layer, count(*) AS n, round(sum({_HALF_OF}), 4) AS total, round(max({_HALF_OF}), 6) AS most FROM h4 GROUP BY layer"""
)
def half_apply(spark, sf_dir):
    """8-bit codes added to a base in half precision: sums and maxima by layer."""
    from deltaforge.functions import int8_apply_half

    d, q = _int8(spark, sf_dir)
    rows = d.select("layer", "idx", "base").join(q, ["layer", "idx"])
    out = rows.select("layer", int8_apply_half(F.array("base"), F.unhex(F.right(F.hex(F.col("q").cast("long")), F.lit(2))), F.col("scale"))[0].cast("double").alias("v"))
    return out.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"), F.round(F.max("v"), 6).alias("most"))


@query(M + _SCALE + " SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY idx) - 1 AS idx, CAST(base + CAST(CAST(q AS FLOAT) * scale AS FLOAT) AS FLOAT) AS value FROM q8")
def reconstruct_function(spark, sf_dir):
    """Blocks rebuilt by the table function, from SQL."""
    from deltaforge import functions

    functions.register(spark)
    base, other = _blocks(spark, sf_dir)
    deltas = diff.block_differences(base, other)
    layers = artifact.layer_table(deltas).withColumn("method", F.lit("int8"))
    coded = artifact.encode_blocks(deltas.drop("base"), layers).select("layer", "block_id", "codes", "scale")
    rows = base.join(coded, ["layer", "block_id"]).select("layer", "start", "values", "codes", "scale")
    return spark.sql("SELECT * FROM reconstruct(TABLE({rows}))", rows=rows)


@query(
    """WITH e AS (SELECT user_id, max(ts) AS used, count(*) AS size FROM events GROUP BY user_id), r AS (SELECT user_id, size, sum(size) OVER (ORDER BY used DESC, user_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM e)
 SELECT user_id, size, held <= 200 AS kept FROM r"""
)
def lru_eviction_order(spark, sf_dir):
    """What a cache of 200 keeps, by last use: the rule that both caches evict by, over users and their events."""
    from deltaforge.cache import outlived

    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("used"), F.count("*").alias("size")).collect()
    gone = set(outlived([(r.user_id, r["size"], r.used) for r in e], 200))
    return spark.createDataFrame([(r.user_id, r["size"], r.user_id not in gone) for r in e], "user_id long, size long, kept boolean")


@query(M + _SCALE + " SELECT layer, idx, CAST(base + CAST(CAST(q AS FLOAT) * scale AS FLOAT) AS FLOAT) AS value FROM q8")
def streaming_apply(spark, sf_dir):
    """Codes that arrive as files, added to the base by a stream; the table it has written when all are done."""
    from deltaforge.streaming.layers import apply_stream, stream_chunks

    root = _folder(spark, "stream")
    _int8(spark, sf_dir)[1].select("layer", "idx", F.col("q").cast("byte").alias("q"), "scale").repartition(4, "layer").write.parquet(f"{root}/chunks")
    apply_stream(fx.base_model(spark, sf_dir), stream_chunks(spark, f"{root}/chunks", 2), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("layer", "idx", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
