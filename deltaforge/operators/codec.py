"""Encodings of differences and their decoding, over (layer, idx, delta)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaforge.operators.choose import SCATTER
from deltaforge.operators.diff import EPS, known

#: Fixed values of the 8-bit encoding: largest code, and largest value below which the scale is 1.
TOP = 127
TINY = 1e-10


def nonzero_encode(deltas: DataFrame, threshold: float = EPS) -> DataFrame:
    """(layer, idx, value) of the elements of at least the threshold."""
    return deltas.where(known(F.col("delta"), threshold)).select("layer", "idx", F.col("delta").alias("value"))


def last_of_each(encoded: DataFrame, order: str = "ord") -> DataFrame:
    """One value for each index: the last by ``order``."""
    return encoded.groupBy("layer", "idx").agg(F.max_by("value", order).alias("value"))


def scatter_decode(encoded: DataFrame, places: DataFrame) -> DataFrame:
    """Scatter into zeros: a value for every place (layer, idx); indices beyond them are ignored."""
    return places.select("layer", "idx").join(encoded.select("layer", "idx", "value"), ["layer", "idx"], "left").select("layer", "idx", F.coalesce("value", F.lit(0).cast("float")).alias("delta"))


def apply_scattered(base: DataFrame, encoded: DataFrame) -> DataFrame:
    """Add values in place: those of one index add up, indices beyond the base are ignored."""
    total = encoded.groupBy("layer", "idx").agg(F.sum(F.col("value").cast("double")).cast("float").alias("delta"))
    return base.join(total, ["layer", "idx"], "left").select("layer", "idx", (F.col("value") + F.coalesce("delta", F.lit(0).cast("float"))).cast("float").alias("value"))


def scale_of(top: Column) -> Column:
    return F.when(top < F.lit(TINY).cast("float"), F.lit(1).cast("float")).otherwise((top / F.lit(TOP).cast("float")).cast("float"))


def int8_scales(deltas: DataFrame) -> DataFrame:
    """(layer, scale): one a layer, so small enough to broadcast for any model."""
    return deltas.groupBy("layer").agg(scale_of(F.max(F.when(F.isnan("delta"), 0).otherwise(F.abs("delta")).cast("float"))).alias("scale"))


def code(delta: Column, scale: Column) -> Column:
    """Divide, clamp, then round half away from zero; NaN is 0."""
    x = (delta / scale).cast("float")
    held = F.greatest(F.lit(-TOP).cast("float"), F.least(F.lit(TOP).cast("float"), x))
    return F.when(F.isnan(delta), 0).otherwise(F.round(held).cast("int"))


def int8_encode(deltas: DataFrame, scales: DataFrame) -> DataFrame:
    """(layer, idx, q tinyint, scale)."""
    return deltas.join(F.broadcast(scales), "layer").select("layer", "idx", code(F.col("delta"), F.col("scale")).cast("tinyint").alias("q"), "scale")


def int8_decode(encoded: DataFrame) -> DataFrame:
    return encoded.select("layer", "idx", (F.col("q").cast("float") * F.col("scale")).alias("delta"))


def apply_int8(base: DataFrame, encoded: DataFrame) -> DataFrame:
    """base + code * scale."""
    return base.join(encoded, ["layer", "idx"]).select("layer", "idx", (F.col("value") + F.col("q").cast("float") * F.col("scale")).cast("float").alias("value"))


def hybrid_encode(deltas: DataFrame, threshold: float = EPS, thresholds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Values strictly above the threshold exactly, the others as codes with a scale of their own (0 if all are zero).

    :param thresholds: (layer, threshold) instead of one for all, such as the median.
    """
    cut = deltas.withColumn("threshold", F.lit(threshold).cast("double")) if thresholds is None else deltas.join(F.broadcast(thresholds), "layer")
    big = F.abs(F.col("delta")).cast("double") > F.col("threshold").cast("float").cast("double")
    exact = cut.where(big & ~F.isnan("delta")).select("layer", "idx", F.col("delta").alias("value"))
    rest = cut.select("layer", "idx", F.when(big | F.isnan("delta"), F.lit(0).cast("float")).otherwise(F.col("delta")).alias("delta"))
    scales = rest.groupBy("layer").agg(F.max(F.abs("delta")).alias("top")).select("layer", F.when(F.col("top") == 0, F.lit(0).cast("float")).otherwise(scale_of(F.col("top"))).alias("scale"))
    codes = rest.join(F.broadcast(scales), "layer").where("scale > 0").select("layer", "idx", code(F.col("delta"), F.col("scale")).cast("tinyint").alias("q"), "scale")
    return exact, codes


def hybrid_decode(exact: DataFrame, codes: DataFrame, places: DataFrame) -> DataFrame:
    held = places.select("layer", "idx").join(exact, ["layer", "idx"], "left").join(codes, ["layer", "idx"], "left")
    return held.select("layer", "idx", F.coalesce("value", (F.col("q").cast("float") * F.col("scale")), F.lit(0).cast("float")).alias("delta"))


def decoded(method: Column, delta: Column, scale: Column, threshold: float = EPS) -> Column:
    """What an element's difference is after a trip through its layer's encoding, in one expression; hybrid keeps exact values only."""
    none, cut = F.lit(0).cast("float"), F.lit(threshold).cast("float")
    by_place = F.when(known(delta, threshold), delta).otherwise(none)
    above = F.when((F.abs(delta) > cut) & ~F.isnan(delta), delta).otherwise(none)
    return F.when(method == "zero", none).when(method == SCATTER, by_place).when(method == "int8", code(delta, scale).cast("tinyint").cast("float") * scale).otherwise(above)


def coordinates(idx: Column, shape: list[int]) -> Column:
    """Places in a tensor of this shape, row by row, of a flat index."""
    out, stride = [], 1
    for n in reversed(shape):
        out.insert(0, F.floor(idx / stride) % n)
        stride *= n
    return F.array(*out)


def tile_size(n: Column) -> Column:
    return F.when(n < 1024, n).when(n < 1_000_000, F.lit(256)).otherwise(F.lit(1024)).cast("long")


def packed_bytes(method: Column, numel: Column, nonzero: Column, dense_bytes: Column | None = None, profile: str = "standard") -> Column:
    """Bytes a layer takes: 4 + 2 for a value by place, 1 a code and 4 a scale, 2 an element stored whole.

    Profile ``streaming`` counts no scale, and its hybrid 6 a value and the codes' bytes.
    """
    out = F.when(method == "zero", 0).when(method == SCATTER, 6 * nonzero).when(method == "int8", numel + (0 if profile == "streaming" else 4))
    if profile == "streaming":
        out = out.when(method == "hybrid", 6 * nonzero + (F.lit(0) if dense_bytes is None else dense_bytes))
    return out.otherwise(2 * numel).cast("long")


def changed(method: Column, numel: Column, nonzero: Column) -> Column:
    return F.when(method == "zero", 0).when(method == SCATTER, nonzero).otherwise(numel).cast("long")


def every_kth_layer(meta: DataFrame, k: int, least: int = 1_000_000, part: str = "weight") -> DataFrame:
    """``k`` layers of those whose name holds ``part`` and that are larger than ``least``, evenly spread over their order."""
    large = meta.where(F.contains("layer", F.lit(part)) & (F.col("numel") > least))
    numbered = large.withColumn("rn", F.row_number().over(Window.orderBy("ord")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return numbered.where((F.col("rn") % step == 0) & (F.col("rn") / step < k)).select("layer", "numel", "ord")


def error_by_layer(true: DataFrame, decoded: DataFrame) -> DataFrame:
    """Largest and mean absolute error, and the error's mean relative to the mean size, of decoded deltas."""
    e = F.abs(F.col("delta").cast("double") - F.col("decoded").cast("double"))
    joined = true.select("layer", "idx", "delta").join(decoded.select("layer", "idx", F.col("delta").alias("decoded")), ["layer", "idx"])
    return joined.groupBy("layer").agg(F.max(e).alias("max_error"), F.avg(e).alias("mean_error"), (F.avg(e) / (F.avg(F.abs(F.col("delta").cast("double"))) + 1e-8)).alias("relative_error"))
