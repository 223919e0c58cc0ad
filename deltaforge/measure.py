"""Timings of the engine on its own data."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaforge.operators import codec

#: Model sizes, in billions of parameters, to which a measured rate is carried on.
SIZES = (1, 7, 13, 70)


@dataclass
class Timing:
    what: str
    elements: int
    seconds: float

    @property
    def per_second(self) -> float:
        return self.elements / max(self.seconds, 1e-9)


@dataclass
class Comparison:
    """The same work done in two ways."""

    one: Timing
    other: Timing

    @property
    def speedup(self) -> float:
        return self.one.seconds / max(self.other.seconds, 1e-9)


@dataclass
class StreamResult:
    """What a stream of layers has done."""

    layers: int
    elements: int
    seconds: float

    @property
    def megabytes_per_second(self) -> float:
        """At two bytes an element."""
        return 2 * self.elements / max(self.seconds, 1e-9) / 1e6


@dataclass
class Rebuilt:
    """A model's reconstruction: where it lies, how long it took, or why it failed."""

    success: bool
    seconds: float
    path: str | None = None
    layers: int = 0
    error: str | None = None


def timed(what: str, df: DataFrame, elements: int, times: int = 1) -> Timing:
    """The median time of running a plan whole, without keeping its result."""
    seen = []
    for _ in range(times):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        seen.append(time.perf_counter() - began)
    return Timing(what, elements, sorted(seen)[len(seen) // 2])


def int8_apply(spark: SparkSession, n: int = 1_000_000, times: int = 3) -> Timing:
    """Applying 8-bit codes to n elements."""
    rows = spark.range(n).select(F.lit("l").alias("layer"), F.col("id").alias("idx"), F.sin("id").cast("float").alias("value"))
    codes = spark.range(n).select(F.lit("l").alias("layer"), F.col("id").alias("idx"), (F.col("id") % 255 - 127).cast("tinyint").alias("q"), F.lit(0.1).cast("float").alias("scale"))
    return timed("int8 apply", codec.apply_int8(rows, codes), n, times)


def extrapolated(timing: Timing) -> dict[int, float]:
    """Seconds by model size at the measured rate."""
    return {b: b * 1e9 / timing.per_second for b in SIZES}


def long_or_blocks(spark: SparkSession, n: int = 1_000_000, block: int = 65_536) -> Comparison:
    """Differences of n elements in long and in block form."""
    from deltaforge.operators.diff import block_differences, difference

    long = spark.range(n).select(F.lit("l").alias("layer"), F.col("id").alias("idx"), F.sin("id").cast("float").alias("value"))
    made = spark.range(-(-n // block)).select(F.lit("l").alias("layer"), F.col("id").alias("block_id"), (F.col("id") * block).alias("start"), F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: i.cast("float")).alias("values"))
    return Comparison(timed("long", difference(long, long), n), timed("blocks", block_differences(made, made), n))


def parallel_speedup(spark: SparkSession, n: int = 1_000_000, parts: int | None = None) -> Comparison:
    """Encoding n elements in one partition and in many."""
    parts = parts or spark.sparkContext.defaultParallelism
    scales = spark.createDataFrame([("l", 0.01)], "layer string, scale float")
    rows = lambda k: spark.range(0, n, 1, k).select(F.lit("l").alias("layer"), F.col("id").alias("idx"), F.sin("id").cast("float").alias("delta"))
    one, many = (timed(what, codec.int8_encode(rows(k), scales), n) for what, k in (("one partition", 1), (f"{parts} partitions", parts)))
    return Comparison(one, many)


def stream_benchmark(spark: SparkSession, layers: int = 4, elements: int = 65_536, files: int = 1) -> tuple[StreamResult, Comparison]:
    """Applying ``layers`` layers of one block each as they arrive, ``files`` files a batch, and all in one batch plan."""
    from deltaforge.plans.artifact import ENCODED, apply_blocks
    from deltaforge.session import written
    from deltaforge.streaming.layers import apply_block_stream

    block = lambda name, x: F.transform(F.sequence(F.lit(0), F.lit(elements - 1)), lambda i: x).alias(name)
    rows = spark.range(0, layers, 1, layers).select(F.concat(F.lit("layer"), "id").alias("layer"), F.lit(0).cast("long").alias("block_id"), F.lit(0).cast("long").alias("start"))
    base = written(rows.select("*", block("values", F.lit(0).cast("float"))), "stream-base")
    full = rows.select("*", F.lit(elements).cast("long").alias("n"), F.lit("full").alias("method"), F.lit(None).cast("array<int>").alias("positions"), block("values", F.lit(0.001).cast("float")), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("scale"))
    encoded = written(full.select(*[c.split(" ")[0] for c in ENCODED.split(", ")]), "stream-in")
    folder = encoded.inputFiles()[0].rsplit("/", 1)[0]
    whole = timed("one batch", apply_blocks(base, encoded), layers * elements)
    began = time.perf_counter()
    apply_block_stream(base, folder, f"{folder}-out", f"{folder}-state", files).awaitTermination()
    seconds = time.perf_counter() - began
    return StreamResult(layers, layers * elements, seconds), Comparison(Timing("stream", layers * elements, seconds), whole)


def rebuilt(spark: SparkSession, base: str, folder: str, out: str) -> Rebuilt:
    """Rebuild a model and say how it went."""
    from deltaforge.cache import rebuild
    from deltaforge.sources.tensors import load_tensors

    began = time.perf_counter()
    try:
        rebuild(load_tensors(spark, base), folder).write.mode("overwrite").parquet(out)
        layers = spark.read.parquet(out).select("layer").distinct().count()
        return Rebuilt(True, time.perf_counter() - began, out, layers)
    except Exception as e:
        return Rebuilt(False, time.perf_counter() - began, error=str(e).splitlines()[0])
