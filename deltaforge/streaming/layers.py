"""Differences that arrive as files are applied to a base as they come.

The stream is a file source of encoded blocks. Each micro-batch is a stateless join with the base by block, so nothing
is kept between batches; ``maxFilesPerTrigger`` bounds what is in flight, as a bounded buffer would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaforge.plans.artifact import ENCODED, apply_blocks

CHUNKS = "layer string, idx long, q byte, scale float"


def stream_chunks(spark: SparkSession, folder: str, files: int = 8, schema: str = CHUNKS) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def apply_stream(base: DataFrame, chunks: DataFrame, out: str, checkpoint: str):
    """Apply 8-bit chunks in long form to the base and write what changes; ends when all files there are done."""
    applied = chunks.join(base, ["layer", "idx"]).select("layer", "idx", (F.col("value") + F.col("q").cast("float") * F.col("scale")).cast("float").alias("value"))
    return applied.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def apply_block_stream(base: DataFrame, folder: str, out: str, checkpoint: str, files: int = 8):
    """The same for encoded blocks of any method, batch by batch."""

    def one(batch: DataFrame, number: int) -> None:
        touched = base.join(batch.select("layer", "block_id"), ["layer", "block_id"], "left_semi")
        apply_blocks(touched, batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_chunks(base.sparkSession, folder, files, ENCODED).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query) -> dict[str, float]:
    """Rows, batches, milliseconds and rows a second of a stream that has ended."""
    seen = [p for p in query.recentProgress if p["numInputRows"]]
    rows, ms = sum(p["numInputRows"] for p in seen), sum(p["durationMs"].get("triggerExecution", 0) for p in seen)
    return {"rows": rows, "batches": len(seen), "ms": ms, "rows_per_second": rows * 1000 / max(ms, 1)}
