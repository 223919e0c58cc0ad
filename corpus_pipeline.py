"""A corpus pipeline of five stages over ``documents``: quality, common lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaforge.llm.decontaminate import decontaminate
from deltaforge.llm.jaccard import jaccard_components
from deltaforge.llm.lines import dedup_lines
from deltaforge.llm.packing import packed_documents
from deltaforge.llm.quality import select_documents
from deltaforge.llm.work import Scratch, clean, roots

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Distinct sources from which a line is boilerplate.
MIN_SITES = 10
#: Dropped documents up to which their table is broadcast; 16 MB. Beyond it is joined by shuffle.
BROADCAST_IDS = 1_000_000


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier selects; those likely toxic or of low quality go.

    Rows that repeat are judged each, alike; a null text as an empty one. Without labels all stay.
    """
    return select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources hold stay in their first document only; no document goes, and n_chars follows the text.

    A null text stays null; a row without id keeps no such line; rows that repeat the first document keep it as well.
    """
    found = dedup_lines(docs, min_sites=MIN_SITES)
    return found.select("doc_id", "text", "lang", "source", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by 5-word shingles at 0.8: a row of the smallest id.

    Rows that repeat an id are documents each. Rows without id, and texts without words, link with nothing and stay.
    """
    scratch = Scratch(spark, "near")
    found = scratch.write(jaccard_components(docs, n=5, percent=80, detail=True).where("class_id is not null"), "classes")
    # rows of the smallest id: more than one where an id is repeated
    heads = found.where("doc_id = component_id").groupBy("class_id").agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash")).where("n > 1")
    heads = scratch.write(heads.select("class_id", F.col("text_hash").alias("head")), "heads")
    gone, repeated = found.where("doc_id <> component_id"), heads.count()
    if repeated:
        own = found.where("doc_id = component_id").join(_few(heads), "class_id")
        gone = gone.select("doc_id", "text_hash").unionByName(own.where("text_hash <> head").select("doc_id", "text_hash"))
    gone = scratch.write(gone.select("doc_id", "text_hash").distinct(), "gone")
    kept = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash")).join(_few(gone), ["doc_id", "text_hash"], "left_anti")
    if repeated:
        again = scratch.write(own.where("text_hash = head").select("doc_id", "text_hash").distinct(), "again")
        kept = kept.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(kept.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]))
    return kept.select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of the benchmark, or a whole item of fewer words.

    Rows that repeat an id are judged each; a row without id goes like others, one without words stays.
    """
    marked = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    found = decontaminate(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10, id_col="row")
    gone = Scratch(spark, "benchmark").write(found.where("n_hit > 0").select("row").distinct(), "gone")
    return marked.join(_few(gone), "row", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token pieces and where they stand in sequences of at most 2048; a null or empty text is one piece."""
    return packed_documents(docs, capacity=2048, end_id=0)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("best-fit packing", packing)]
#: Training, tokens and packing have no SQL form; the tests hold small fixtures against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before kept. Scratch tables of a stage go when it is written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = roots()
        made = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        clean(roots() - before)
        if k:
            scratch.drop(docs)
        docs = made
    return docs
