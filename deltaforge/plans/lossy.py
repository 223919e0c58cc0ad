"""Low-rank artifacts: factors of large matrices, other layers' differences whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltaforge.model import to_blocks
from deltaforge.operators import svd
from deltaforge.operators.diff import difference
from deltaforge.plans.artifact import check_base, read_manifest, write_manifest


def compress_model_svd(base: DataFrame, other: DataFrame, shapes: DataFrame, folder: str, rank: int = 16, base_id: str = "base", derived_id: str = "derived") -> dict:
    """``base`` and ``other`` in long form with dense idx; ``shapes`` (layer, rows) names the matrices among the layers."""
    spark = base.sparkSession
    deltas = difference(base, other).select("layer", "idx", "delta")
    sizes = deltas.groupBy("layer").agg(F.count("*").alias("numel"))
    large = shapes.join(sizes, "layer").where((F.col("numel") > svd.DIRECT) & (F.col("numel") % F.col("rows") == 0)).select("layer", "rows")
    svd.compress(deltas, large, rank).write.mode("overwrite").parquet(f"{folder}/factors")
    deltas.join(F.broadcast(large.select("layer")), "layer", "left_anti").write.mode("overwrite").parquet(f"{folder}/direct")
    direct = spark.read.parquet(f"{folder}/direct").count()
    s = svd.summary(spark.read.parquet(f"{folder}/factors"), rank).first()
    whole, packed = (s.original_bytes or 0) + 2 * direct, (s.compressed_bytes or 0) + 2 * direct
    return write_manifest(spark, folder, type="svd_delta", base_id=base_id, derived_id=derived_id, rank=rank, num_layers=sizes.count(), original_bytes=whole, compressed_bytes=packed, compression_ratio=whole / max(packed, 1), avg_error=s.avg_error, max_error=s.max_error)


def reconstruct_model_svd(base: DataFrame, folder: str) -> DataFrame:
    """Base plus U * V, else plus the direct difference, else as it is."""
    spark = base.sparkSession
    delta = svd.product(spark.read.parquet(f"{folder}/factors")).unionByName(spark.read.parquet(f"{folder}/direct"))
    return base.join(delta, ["layer", "idx"], "left").select("layer", "idx", (F.col("value") + F.coalesce("delta", F.lit(0).cast("float"))).cast("float").alias("value"))


def reconstruct(base: DataFrame, folder: str, base_id: str | None = None, strict: bool = False) -> DataFrame:
    """The same for a base in block form: the blocks of the rebuilt model."""
    from deltaforge.model import to_long

    size = base.agg(F.max(F.size("values"))).first()[0] or 1
    check_base(base, read_manifest(base.sparkSession, folder), base_id, strict)
    return to_blocks(reconstruct_model_svd(to_long(base), folder), size)
