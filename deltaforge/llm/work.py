"""Scratch tables in the shared folder of the cluster, and small Spark helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import time
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from deltaforge.session import reachable, shared_dir

#: Rows and bytes of the batches that go to Python workers, where the session has Spark's defaults: rows are whole texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def settle(spark: SparkSession) -> None:
    """Keep batches of texts small, but for a session that has set its own sizes; let workers import the package."""
    reachable(spark)
    for key, (default, own) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)


#: Folders of scratch tables that are still there.
_roots: set[str] = set()


def roots() -> set[str]:
    """Folders of scratch tables that are still there."""
    return set(_roots)


def clean(folders: set[str] | None = None) -> None:
    """Delete scratch folders, by default all of them: what results that aren't saved yet read from is lost.

    Runs by itself when Python ends.
    """
    if (gateway := SparkContext._gateway) is None:
        return
    conf = gateway.jvm.org.apache.hadoop.conf.Configuration() if SparkContext._active_spark_context is None else SparkContext._active_spark_context._jsc.hadoopConfiguration()
    for root in _roots & (_roots if folders is None else folders):
        where = gateway.jvm.org.apache.hadoop.fs.Path(root)
        where.getFileSystem(conf).delete(where, True)
        _roots.discard(root)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        clean()


atexit.register(_at_exit)


class Scratch:
    """Tables written under one fresh folder. A written table cuts lineage: a lost executor costs no recomputation.

    The folder goes when Python ends, or by ``clean``.
    """

    def __init__(self, spark: SparkSession, name: str):
        settle(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _roots.add(self.root)
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of what was written."""
        path, schema = self.path(name), df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def free(self) -> None:
        """Let Spark delete the shuffle files of plans that are done with.

        It does so when their objects are collected: first Python's, whose release reaches the JVM a moment later, then
        the JVM's own.
        """
        for _ in range(2):
            gc.collect()
            time.sleep(0.3)
            self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table that nothing reads any more."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "-" in folder and self.root.rsplit("/", 1)[1] in folder:
                where = jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
