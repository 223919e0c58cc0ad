"""Tensors as tables.

Long form ``(layer, idx, value)`` is the logical form: every operator has a plain relational meaning there. Block form
``(layer, block_id, start, values array<float>)`` is the physical one: a model of 7e9 parameters is about 1e5 blocks, so
joins shuffle blocks and never elements, and a layer of any size spreads over tasks by its blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK = 65_536


def to_blocks(tensors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Long to block form; ``idx`` must be dense within a layer. Blocks are built by partial aggregation, each bounded in size."""
    rows = tensors.withColumn("block_id", F.floor(F.col("idx") / size))
    made = rows.groupBy("layer", "block_id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("rows"))
    return made.select("layer", "block_id", (F.col("block_id") * size).alias("start"), F.transform("rows", lambda r: r["value"]).alias("values"))


def to_long(blocks: DataFrame) -> DataFrame:
    return blocks.select("layer", "start", F.posexplode("values").alias("pos", "value")).select("layer", (F.col("start") + F.col("pos")).alias("idx"), "value")


def dense(tensors: DataFrame, size: int = 100_000) -> DataFrame:
    """Number the elements of each layer from 0 by ``idx``, in two passes, so that no layer is sorted in one task."""
    from pyspark.sql import Window

    cut = tensors.withColumn("part", F.floor(F.col("idx") / size))
    ahead = cut.groupBy("layer", "part").count().withColumn("ahead", F.sum("count").over(Window.partitionBy("layer").orderBy("part")) - F.col("count"))
    place = F.row_number().over(Window.partitionBy("layer", "part").orderBy("idx")) - 1
    return cut.withColumn("place", place).join(ahead.select("layer", "part", "ahead"), ["layer", "part"]).select("layer", (F.col("ahead") + F.col("place")).alias("idx"), "value")


def layer_meta(tensors: DataFrame) -> DataFrame:
    """Elements by layer, and the layers' order by name. Layers are few: the result is the size of a model's listing."""
    from pyspark.sql import Window

    sizes = tensors.groupBy("layer").agg(F.count("*").alias("numel"))
    return sizes.withColumn("ord", F.row_number().over(Window.orderBy("layer")) - 1)


def filter_layers(tensors: DataFrame, names: list[str]) -> DataFrame:
    """Only the named layers; the filter reaches the Parquet scan."""
    return tensors.where(F.col("layer").isin(names))
