"""How well 8-bit codes keep a model, measured on layers spread over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltaforge.model import layer_meta
from deltaforge.operators import codec
from deltaforge.operators.diff import difference


def int8_quality(base: DataFrame, other: DataFrame, layers: int = 5, least: int = 1_000_000, part: str = "weight") -> DataFrame:
    """Errors and size ratio of ``layers`` large layers, evenly spread: layer, numel, ratio, max_error, mean_error, relative_error."""
    chosen = codec.every_kth_layer(layer_meta(base), layers, least, part)
    few = F.broadcast(chosen.select("layer"))  # at most ``layers`` rows
    deltas = difference(base.join(few, "layer", "left_semi"), other.join(few, "layer", "left_semi"))
    decoded = codec.int8_decode(codec.int8_encode(deltas, codec.int8_scales(deltas)))
    ratio = (2 * F.col("numel") / (F.col("numel") + 4)).alias("ratio")
    return codec.error_by_layer(deltas, decoded).join(F.broadcast(chosen.select("layer", "numel")), "layer").select("layer", "numel", ratio, "max_error", "mean_error", "relative_error")
