"""A dataset as ordered references into another, and the rows that are new.

Datasets are tables with a position ``pos`` (dense, from 0, within a split) and an ``id``. Row order in files is no
contract, so positions are always explicit; ``number`` gives them without sorting everything in one task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from deltaforge.session import written

#: Positions that are numbered in one task.
CHUNK = 1_000_000


def number(rows: DataFrame, order: list[str], splits: list[str] | None = None, one_task: int = 10_000_000) -> DataFrame:
    """Add ``pos``: a window over each split while tables are small, else range partitions with counts before them.

    In the second form rows are dealt into ranges of ``order``; each range is numbered by itself and gets the number of
    rows before it, of which the driver sees one a partition.
    """
    splits = splits or []
    if rows.count() <= one_task:
        return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*splits).orderBy(*order)).cast("long") - 1)
    dealt = rows.repartitionByRange(*splits, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "numbered")  # ranges are drawn by sampling, so they must be the same for both uses
    sizes = dealt.groupBy("_part", *splits).agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_ahead", F.sum("_n").over(Window.partitionBy(*splits).orderBy("_part")) - F.col("_n")).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part", *splits).orderBy(*order)).cast("long") - 1
    return dealt.withColumn("_place", place).join(F.broadcast(ahead), ["_part", *splits]).withColumn("pos", F.col("_place") + F.col("_ahead")).drop("_part", "_place", "_ahead")


def base_index(base: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """Where each id stands in the base; of repeated ids the last counts."""
    return base.groupBy(*(splits or []), "id").agg(F.max("pos").alias("base_index"))


def _matched(base: DataFrame, derived: DataFrame, splits: list[str], match: str) -> DataFrame:
    if "id" not in base.columns or "id" not in derived.columns:  # without ids everything is new
        plain = derived if "id" in derived.columns else derived.withColumn("id", F.lit(None).cast("long"))
        return plain.withColumn("base_index", F.lit(None).cast("long")).withColumn("modified", F.lit(False))
    index = base_index(base, splits).withColumn("known", F.lit(True)).alias("i")
    same = reduce(lambda a, b: a & b, [F.col(f"v.{c}").eqNullSafe(F.col(f"i.{c}")) for c in [*splits, "id"]])
    found = derived.alias("v").join(index, same, "left").select("v.*", "i.base_index")
    if match == "id":
        return found.withColumn("modified", F.lit(False))
    if match != "content":
        raise ValueError(match)
    payload = sorted(set(derived.columns) - {"pos", *splits})
    mark = lambda df: F.sha2(F.to_json(F.struct(*payload)), 256)
    there = base.select(*[F.col(c).alias(f"_{c}") for c in splits], F.col("pos").alias("_pos"), mark(base).alias("_mark"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in splits], F.col("base_index") == F.col("_pos"))
    both = found.withColumn("_own", mark(found)).join(there, on, "left")
    edited = F.col("base_index").isNotNull() & (F.col("_own") != F.col("_mark"))
    return both.withColumn("modified", edited).withColumn("base_index", F.when(~edited, F.col("base_index"))).select(*found.columns, "modified")


def references(base: DataFrame, derived: DataFrame, splits: list[str] | None = None, match: str = "id") -> DataFrame:
    """For each row of the derived dataset either its place in the base or its place among the new rows.

    :param match: ``id`` looks at ids alone, so an edited row comes back as it was in the base; ``content`` also compares
        the rows and stores edited ones as new (``modified``).
    :returns: all columns of ``derived`` with type, base_index, new_index and modified. Null ids match each other.
    """
    splits = splits or []
    found = _matched(base, derived, splits, match).withColumn("type", F.when(F.col("base_index").isNotNull(), "reference").otherwise("new"))
    found = found.withColumn("_chunk", F.floor(F.col("pos") / CHUNK))
    # new rows are counted by chunk of positions, then within each
    counts = found.groupBy(*splits, "_chunk").agg(F.count_if(F.col("type") == "new").alias("_k"))
    ahead = counts.select(*splits, "_chunk", (F.sum("_k").over(Window.partitionBy(*splits).orderBy("_chunk")) - F.col("_k")).alias("_ahead"))
    on = reduce(lambda a, b: a & b, [F.col(f"f.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*splits, "_chunk"]])
    w = Window.partitionBy(*[f"f.{c}" for c in splits], "f._chunk").orderBy("f.pos").rowsBetween(Window.unboundedPreceding, 0)
    new = F.col("f.type") == "new"
    index = F.when(new, F.col("a._ahead") + F.sum(new.cast("long")).over(w) - 1)
    return found.alias("f").join(ahead.alias("a"), on).select(*[f"f.`{c}`" for c in found.columns if c != "_chunk"], index.alias("new_index"))


def new_rows(refs: DataFrame, splits: list[str] | None = None) -> DataFrame:
    return refs.where("type = 'new'").drop("pos", "type", "base_index", "modified")


def split_summary(refs: DataFrame, split: str) -> DataFrame:
    """Rows by split, and the files that would hold them: none of new rows if there are none."""
    new = F.count_if(F.col("type") == "new")
    named = lambda kind: F.concat(split, F.lit(f"_{kind}.json"))
    return refs.groupBy(split).agg(F.count("*").alias("num_samples"), new.alias("num_new"), F.count_if(F.col("type") == "reference").alias("num_referenced"), F.first(named("refs")).alias("refs_file"), F.first(F.when(F.lit(True), named("new"))).alias("new_samples_file")).withColumn("new_samples_file", F.when(F.col("num_new") > 0, F.col("new_samples_file")))


def json_bytes(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("long")), F.lit(0)).alias("bytes"))


def size_stats(base: DataFrame, refs: DataFrame, payload: list[str]) -> DataFrame:
    """Bytes of both datasets and of the delta as JSON, and the share saved in percent, at least 0."""
    b = json_bytes(base, payload).withColumnRenamed("bytes", "base_bytes")
    d = json_bytes(refs, payload).withColumnRenamed("bytes", "derivative_bytes")
    n = json_bytes(refs.where("type = 'new'"), payload).withColumnRenamed("bytes", "new_bytes")
    r = json_bytes(refs, ["type", "base_index", "new_index"]).withColumnRenamed("bytes", "ref_bytes")
    full = b.crossJoin(d).crossJoin(n).crossJoin(r)  # one row each
    delta = F.col("new_bytes") + F.col("ref_bytes")
    saved = F.greatest(F.lit(0.0), (F.col("derivative_bytes") - delta) / F.greatest(F.col("derivative_bytes"), F.lit(1)).cast("double") * 100)
    return full.select("base_bytes", "derivative_bytes", delta.alias("delta_bytes"), saved.alias("savings_percent"))


def estimate(base: DataFrame, derived: DataFrame, sample: int = 1000, payload: list[str] | None = None) -> DataFrame:
    """What a delta would save, by the first rows of both: each shared row counts a thousandth of a MB, each new one the mean size."""
    payload = payload or [c for c in derived.columns if c != "pos"]
    b, d = base.orderBy("pos").limit(sample), derived.orderBy("pos").limit(sample)
    ids = b.select("id").distinct().withColumn("known", F.lit(1)).alias("b")
    hit = d.alias("d").join(ids, F.col("d.id").eqNullSafe(F.col("b.id")), "left").select("d.*", "known")
    size = F.octet_length(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})).cast("long")
    got = hit.agg(F.count("known").alias("shared"), F.count_if(F.col("known").isNull()).alias("new"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n"))
    mb = F.col("bytes") / 1048576.0
    delta = F.lit(0.001) * F.col("shared") + F.col("new") * mb / F.greatest("n", F.lit(1))
    return got.select("shared", "new", F.lit(0).cast("long").alias("modified"), mb.alias("derivative_mb"), delta.alias("delta_mb"), (F.try_divide(mb - delta, mb) * 100).alias("savings_percent"))


_SLICE = re.compile(r"(?P<split>[^\[\]]+)(\[(?P<first>-?\d+%?)?:(?P<last>-?\d+%?)?\])?")


def part(rows: DataFrame, spec: str, split: str | None = None) -> DataFrame:
    """Rows of a split by position: ``train``, ``train[:100]``, ``train[10%:20%]``, ``train[-50:]``; percents are rounded to rows.

    :param split: the column that names the split; without one the whole table is the split.
    """
    found = _SLICE.fullmatch(spec)
    if not found:
        raise ValueError(f"no slice: {spec}")
    rows = rows if split is None else rows.where(F.col(split) == found["split"])
    if not found["first"] and not found["last"]:
        return rows
    n = rows.count()

    def place(text: str | None, default: int) -> int:
        if not text:
            return default
        at = round(n * int(text[:-1]) / 100) if text.endswith("%") else int(text)
        return min(n, max(0, at + n if at < 0 else at))

    return rows.where((F.col("pos") >= place(found["first"], 0)) & (F.col("pos") < place(found["last"], n)))


def reconstruct(base: DataFrame, refs: DataFrame, new: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """The derived dataset from references and new rows, with its positions; a split that the base lacks has new rows only."""
    splits = splits or []
    payload = [c for c in new.columns if c not in ("new_index", *splits)]
    slim = refs.select(*splits, "pos", "type", "base_index", "new_index")
    old = base.select(*splits, F.col("pos").alias("base_index"), F.struct(*payload).alias("old"))
    add = new.select(*splits, "new_index", F.struct(*payload).alias("add"))
    both = slim.join(old, [*splits, "base_index"], "left").join(add, [*splits, "new_index"], "left")
    row = F.when(F.col("type") == "reference", F.col("old")).otherwise(F.col("add"))
    return both.select(*splits, "pos", row.alias("r")).select(*splits, "pos", *[F.col(f"r.{c}").alias(c) for c in payload])
