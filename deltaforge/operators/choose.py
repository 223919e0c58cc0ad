"""Which encoding a layer gets, by its name and its difference's statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Parts of layer names by type; the first type with a match counts.
NAME_PARTS = {
    "attention": ("attn", "attention", "self_attn", "q_proj", "k_proj", "v_proj"),
    "feedforward": ("mlp", "ffn", "fc", "dense"),
    "embedding": ("embed", "wte", "wpe"),
    "normalization": ("ln", "norm", "layernorm"),
    "output": ("lm_head", "output"),
}
#: Fixed values by type: share of unchanged values above which storing the others by place pays, and largest change that int8 holds (None: any).
RULES = {
    "attention": (0.85, 0.1),
    "feedforward": (0.95, None),
    "embedding": (0.80, None),
    "normalization": (None, None),
    "output": (0.90, None),
    "unknown": (0.90, 0.15),
}
ZERO = 1e-8
#: Fixed value of manifests: the name of the encoding that stores a layer's changed values by their places.
SCATTER = "sparse"


def layer_type(name: Column) -> Column:
    low = F.lower(name)
    out = F
    for kind, parts in NAME_PARTS.items():
        out = out.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]), F.lit(kind))
    return out.otherwise(F.lit("unknown"))


def method(mode: str = "smart") -> Column:
    """The encoding, over the columns layer, max_abs and sparsity: ``smart`` by layer type, ``basic`` by statistics alone."""
    zero, sparsity, top = F.col("max_abs") < ZERO, F.col("sparsity"), F.col("max_abs")
    if mode == "basic":
        return F.when(zero, "zero").when(sparsity > 0.90, SCATTER).otherwise("int8")
    if mode != "smart":
        raise ValueError(mode)
    out, kind = F.when(zero, "zero"), layer_type(F.col("layer"))
    for name, (share, limit) in RULES.items():
        if share is not None:
            out = out.when((kind == name) & (sparsity > share), SCATTER)
        out = out.when(kind == name, "int8" if limit is None else F.when(top < limit, "int8").otherwise("hybrid"))
    return out


def parameters(chosen: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Parameters of each layer's encoding, over (layer, method, q25, median).

    threshold is max(1e-6, q25) for values by place, the median for hybrid. per_channel, for 8-bit codes, says whether each
    row of a matrix would have a scale of its own: of hybrid always, else of two dimensions and more than one row, by
    ``shapes(layer, shape)``; a layer of unknown shape counts as one row.
    """
    m = F.col("method")
    if shapes is None:
        chosen = chosen.withColumn("shape", F.lit(None).cast("array<bigint>"))
    else:
        chosen = chosen.join(shapes.select("layer", "shape"), "layer", "left")
    matrix = F.coalesce((F.size("shape") >= 2) & (F.get("shape", F.lit(0)) > 1), F.lit(False))
    threshold = F.when(m == SCATTER, F.greatest(F.lit(1e-6), F.col("q25"))).when(m == "hybrid", F.col("median"))
    return chosen.select("layer", "method", threshold.alias("threshold"), F.when(m == "int8", matrix).when(m == "hybrid", F.lit(True)).alias("per_channel"))


def estimated_ratio(deltas: DataFrame, params: DataFrame) -> DataFrame:
    """How many times smaller a layer gets, of 2 bytes an element; null for zero layers, which take no room."""
    counted = deltas.join(params, "layer").groupBy("layer", "method").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("delta")).cast("double") > F.col("threshold")).alias("nnz"))
    n, k, m = F.col("n"), F.col("nnz"), F.col("method")
    size = F.when(m == SCATTER, 5 * k).when(m == "int8", n + 4).when(m == "hybrid", 5 * k + (n - k) + 4).when(m == "full", n)
    return counted.select("layer", "method", F.try_divide(2 * n, size).alias("ratio"))


def size_ratio(original: Column, packed: Column) -> Column:
    """original / packed; infinite where nothing is left."""
    return F.when(packed == 0, F.lit(float("inf"))).otherwise(F.try_divide(original, packed))


def compression_stats(sizes: DataFrame) -> DataFrame:
    """Over original_bytes and compressed_bytes: the ratio, and the share of room that is saved as ``sparsity``."""
    o, c = F.col("original_bytes"), F.col("compressed_bytes")
    return sizes.select("*", size_ratio(o, c).alias("compression_ratio"), (1 - F.try_divide(c, o)).alias("sparsity"))


#: Billions of parameters from which a model is taken to be large, by either formula.
LARGE, LARGE_BY_WIDTH = 30, 10


def model_size(configs: DataFrame) -> DataFrame:
    """Billions of parameters of transformers by their shape, over (hidden, layers, vocab); nulls count as 4096, 32 and 50 000.

    ``billions`` counts blocks and embeddings, ``billions_by_width`` blocks alone, as attention; ``large`` asks for blocks
    to be read one by one.
    """
    h, n, v = (F.coalesce(F.col(c), F.lit(d)).cast("double") for c, d in (("hidden", 4096), ("layers", 32), ("vocab", 50_000)))
    whole, width = (12 * h * h * n + v * h) / 1e9, 4 * h * h * n / 1e9
    return configs.select("*", whole.alias("billions"), width.alias("billions_by_width"), ((whole >= LARGE) | (width > LARGE_BY_WIDTH)).alias("large"))
