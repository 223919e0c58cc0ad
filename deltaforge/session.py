"""Spark settings that the engine relies on, and facts about the engine."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("deltaforge").config(map=CONF | conf)
    return reachable((builder.master(master) if master else builder).getOrCreate())


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, if its folder isn't on their path already.

    That serves a local master and clusters with a shared file system; elsewhere give the package with ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in (environment.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if root not in [*paths, *os.environ.get("PYTHONPATH", "").split(os.pathsep)]:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="deltaforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a fresh folder in the shared one, and read from there: rows that are read twice are the same twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def engine_info(spark: SparkSession) -> dict[str, str]:
    """What runs here: versions and the settings that decide how."""
    sc = spark.sparkContext
    return {"spark": spark.version, "python": sc.pythonVer, "master": sc.master, "parallelism": str(sc.defaultParallelism)} | {k: spark.conf.get(k) for k in CONF}
