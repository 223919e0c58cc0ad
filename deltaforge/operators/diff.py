"""Element-wise differences of aligned tensors, and what they look like layer by layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-6


def aligned_layers(base: DataFrame, other: DataFrame, shapes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Layers of both models with their sizes: layer, base_numel, other_numel; null where a model lacks the layer.

    Models in long form or in blocks. ``shapes`` are tables (layer, shape) of both: then also ``same_shape``, which is
    true as well where neither shape is known.
    """
    n = lambda df: F.sum(F.size("values").cast("long")) if "values" in df.columns else F.count("*")
    found = base.groupBy("layer").agg(n(base).alias("base_numel")).join(other.groupBy("layer").agg(n(other).alias("other_numel")), "layer", "full")
    if shapes is None:
        return found
    a, b = (s.select("layer", F.col("shape").alias(to)) for s, to in zip(shapes, ("_a", "_b"), strict=True))
    return found.join(a, "layer", "left").join(b, "layer", "left").withColumn("same_shape", F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")


def same_layers(base: DataFrame, other: DataFrame, on_missing: str = "intersect", shapes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Names of the layers that both models have in the same size, and in the same shape if shapes are given.

    :param on_missing: ``intersect`` or ``skip`` leave out layers that one side lacks; ``error`` raises for layers of ``base``
        that ``other`` lacks. Layers of unlike size or shape are left out whole in any case.
    """
    layers = aligned_layers(base, other, shapes)
    if on_missing == "error":
        lost = layers.where("other_numel is null").select("layer").limit(5).collect()
        if lost:
            raise KeyError(f"no such layers: {[r.layer for r in lost]}")
    elif on_missing not in ("intersect", "skip"):
        raise ValueError(on_missing)
    same = layers.where("base_numel = other_numel")
    return (same.where("same_shape") if shapes else same).select("layer")


def difference(base: DataFrame, other: DataFrame, on_missing: str = "intersect", shapes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``other - base`` by layer and idx: (layer, idx, base, ft, delta float), for ``same_layers``."""
    same = same_layers(base, other, on_missing, shapes)
    pairs = base.select("layer", "idx", F.col("value").alias("base")).join(other.select("layer", "idx", F.col("value").alias("ft")), ["layer", "idx"])
    return pairs.join(same, "layer", "left_semi").select("layer", "idx", "base", "ft", (F.col("ft") - F.col("base")).cast("float").alias("delta"))


def known(x: Column, threshold: float) -> Column:
    """|x| >= threshold; NaN isn't."""
    return (F.abs(x) >= F.lit(threshold).cast("float")) & ~F.isnan(x)


def layer_stats(deltas: DataFrame, threshold: float = EPS) -> DataFrame:
    """Norm, maximum, share of elements under the threshold, mean and deviation of each layer; partial, then final aggregates."""
    d = F.col("delta").cast("double")
    small = (F.abs(F.col("delta")) < F.lit(threshold).cast("float")) & ~F.isnan("delta")
    return deltas.groupBy("layer").agg(
        F.count("*").alias("numel"),
        F.sqrt(F.sum(d * d)).alias("l2_norm"),
        F.max(F.abs("delta")).cast("double").alias("max_abs"),
        F.avg(small.cast("double")).alias("sparsity"),
        F.avg(d).alias("mean"),
        F.stddev_samp(d).alias("std"),
        F.count_if(known(F.col("delta"), threshold)).alias("nonzero"),
    )


#: Steps of the histogram of sizes to a doubling; a step holds at most 4096 distinct floats.
STEPS = 2048


def ranked(deltas: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics of |delta| by layer: a row a layer with, for each name, the value of that rank (from 0).

    ``ranks`` are expressions of n, the layer's elements. Two passes, neither of which sorts a layer: a histogram of the
    logarithms of the sizes says which of its steps hold the ranks, and only the distinct values of these are ordered.
    """
    a = F.abs("delta").cast("double")
    step = F.when(a == 0, F.lit(-(1 << 30))).when(F.isnan(a), F.lit(1 << 30)).otherwise(F.floor(F.least(F.log2(a), F.lit(2000.0)) * STEPS)).cast("long")
    sized = deltas.select("layer", a.alias("a"), step.alias("step"))
    histogram = sized.groupBy("layer", "step").agg(F.count("*").alias("k"))
    w, up = Window.partitionBy("layer"), Window.partitionBy("layer").orderBy("step")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()])
    held = lambda before, k: F.filter("wanted", lambda r: (r["rank"] >= before) & (r["rank"] < before + k))
    steps = histogram.withColumn("n", F.sum("k").over(w)).withColumn("before", F.sum("k").over(up) - F.col("k")).withColumn("wanted", wanted)
    steps = steps.withColumn("wanted", held(F.col("before"), F.col("k"))).where(F.size("wanted") > 0).select("layer", "step", "before", "wanted")
    # a few rows a layer
    values = sized.join(F.broadcast(steps), ["layer", "step"]).groupBy("layer", "step", "before", "wanted", "a").agg(F.count("*").alias("k"))
    ahead = F.col("before") + F.sum("k").over(Window.partitionBy("layer", "step").orderBy("a")) - F.col("k")
    found = values.withColumn("ahead", ahead).select("layer", "a", F.explode(held(F.col("ahead"), F.col("k"))).alias("r"))
    return found.groupBy("layer").agg(*[F.max(F.when(F.col("r.name") == name, F.col("a"))).alias(name) for name in ranks])


def distribution(deltas: DataFrame, sample_one_in: int = 1, exact: bool = True) -> DataFrame:
    """Mean and deviation of the signed values, quantiles of the absolute ones, by layer.

    :param sample_one_in: look at one element in so many, by a hash of layer and idx.
    :param exact: exact quantiles by ``ranked``; else ``percentile_approx``, in one pass.
    """
    if sample_one_in > 1:
        deltas = deltas.where(F.pmod(F.xxhash64("layer", "idx"), F.lit(sample_one_in)) == 0)
    d, a = F.col("delta").cast("double"), F.abs(F.col("delta")).cast("double")
    shares = {"q25": 0.25, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    plain = [F.count("*").alias("_n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("std"), F.max(a).alias("max"), F.min(a).alias("min")]
    if not exact:
        return deltas.groupBy("layer").agg(*plain, *[F.percentile_approx(a, p, 10_000).alias(name) for name, p in (shares | {"median": 0.5}).items()]).drop("_n")
    n = F.col("n")
    place = {name: p * (n - 1) for name, p in shares.items()}
    ranks = {f"{name}_{side}": f(x) for name, x in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))} | {"median": F.ceil(0.5 * n) - 1}
    both = deltas.groupBy("layer").agg(*plain).join(ranked(deltas, ranks), "layer")
    between = lambda name, p: F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * (p * (F.col("_n") - 1) - F.floor(p * (F.col("_n") - 1)))
    return both.select("layer", "mean", "std", "max", "min", *[between(name, p).alias(name) for name, p in shares.items()], "median")


def block_differences(base: DataFrame, other: DataFrame, on_missing: str = "intersect", shapes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The same in block form: (layer, block_id, start, base, delta array<float>), joined by block, for ``same_layers``.

    Blocks of one layer that are cut unlike in the two models are an error.
    """
    same = same_layers(base, other, on_missing, shapes)
    pairs = base.select("layer", "block_id", "start", F.col("values").alias("base")).join(other.select("layer", "block_id", F.col("values").alias("ft")), ["layer", "block_id"]).join(same, "layer", "left_semi")
    unlike = F.raise_error(F.concat(F.lit("blocks of unlike size in layer "), "layer"))
    delta = F.when(F.size("base") == F.size("ft"), F.zip_with("ft", "base", lambda x, y: (x - y).cast("float"))).otherwise(unlike.cast("array<float>"))
    return pairs.select("layer", "block_id", "start", "base", delta.alias("delta"))


def block_stats(blocks: DataFrame, threshold: float = EPS) -> DataFrame:
    """``layer_stats`` from blocks: each block folds to one row before anything is shuffled."""
    zero = F.lit(0.0)
    d = lambda x: x.cast("double")
    small = lambda x: ((F.abs(x) < F.lit(threshold).cast("float")) & ~F.isnan(x)).cast("double")
    folded = blocks.select(
        "layer",
        F.size("delta").cast("long").alias("n"),
        F.aggregate("delta", zero, lambda s, x: s + d(x) * d(x)).alias("sq"),
        F.aggregate("delta", zero, lambda s, x: s + d(x)).alias("sum"),
        F.aggregate("delta", zero, lambda s, x: s + small(x)).alias("small"),
        F.array_max(F.transform("delta", lambda x: F.abs(x))).cast("double").alias("top"),
    )
    total = folded.groupBy("layer").agg(*[F.sum(c).alias(c) for c in ("n", "sq", "sum", "small")], F.max("top").alias("max_abs"))
    n = F.col("n")
    variance = F.greatest(zero, (F.col("sq") - F.col("sum") * F.col("sum") / n) / F.greatest(n - 1, F.lit(1)))
    return total.select("layer", n.alias("numel"), F.sqrt("sq").alias("l2_norm"), "max_abs", (F.col("small") / n).alias("sparsity"), (F.col("sum") / n).alias("mean"), F.sqrt(variance).alias("std"))


def batches(meta: DataFrame, size: int = 10) -> DataFrame:
    """Layers in order with the number of their batch of ``size``."""
    return meta.select("*", F.floor(F.col("ord") / size).alias("batch")).orderBy("ord")
