"""Line dedup: lines that many sites hold are kept in the first document only.

The distinct sites of a line are counted by HyperLogLog sketches, one per line hash, that merge in partial
aggregation, so a line that a third of all rows hold moves one sketch per task. Lines whose estimate is near the
threshold get an exact distinct count.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaforge.llm.work import Scratch

LG_K = 12
#: Share of the threshold on either side within which an estimate isn't trusted; the sketch's standard error is 1.6 %.
MARGIN = 0.1
#: Boilerplate lines up to which their table is broadcast, 24 bytes each; beyond it they are joined.
BROADCAST_LINES = 200_000


def common_lines(docs: DataFrame, min_sites: int, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Hashes of the lines that at least ``min_sites`` distinct sites hold, with the first document and place of each.

    Rows (h long, doc, place int, n long), n the places that hold the line. A null site is a site of its own; empty lines and null ids don't count.
    """
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), _key(F.col(site_col)).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("place", "line")).where("line <> ''").withColumn("h", F.xxhash64("line")).drop("line")
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n"))
    lo, hi = min_sites * (1 - MARGIN), min_sites * (1 + MARGIN)
    guess = sketched.where(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= int(lo)).select("h", "first", "sites", "n")
    guess = Scratch(docs.sparkSession, "lines").write(guess, "guess")
    sure, near = guess.where(F.col("sites") > hi), guess.where(F.col("sites") <= hi)
    exact = lines.join(near.select("h"), "h", "left_semi").groupBy("h", "site").count().groupBy("h").count().where(F.col("count") >= min_sites)
    return sure.select("h", "first.*", "n").unionByName(near.join(exact, "h", "left_semi").select("h", "first.*", "n"))


def _key(c):
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Take lines that at least ``min_sites`` sites hold out of all documents but the first (the smallest id) to hold them.

    :returns: all columns of ``docs`` with the text that stays, and n_lines long, n_removed long. Lines end at a newline;
        empty lines stay. The first document keeps the line at its first place, so do rows that repeat it. A null text
        stays null and has no lines; a row without id keeps no line that is common. Columns of the same names
        (``n_lines``, ``n_removed``) are replaced.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*names)
    found = Scratch(spark, "lines").write(common_lines(docs, min_sites, id_col, text_col, site_col), "common")
    if (n := found.count()) > broadcast_lines:
        return _joined(docs, found, broadcast_lines, id_col, text_col)
    table = spark.sparkContext.broadcast({r.h: (r.doc, r.place) for r in found.collect()} if n else {})

    def run(batches):
        from xxhash import xxh64_intdigest

        common = {h % (1 << 64): first for h, first in table.value.items()}
        for batch in batches:
            ids, texts, counts, gone = batch.column(id_col).to_pylist(), [], [], []
            for doc, text in zip(ids, batch.column(text_col).to_pylist(), strict=True):
                if text is None:
                    texts.append(None)
                    counts.append(0)
                    gone.append(0)
                    continue
                lines = text.split("\n")
                kept = [line for place, line in enumerate(lines) if not line or (first := common.get(xxh64_intdigest(line.encode(), 42))) is None or first == (doc, place)]
                texts.append(text if len(kept) == len(lines) else "\n".join(kept))
                counts.append(len(lines))
                gone.append(len(lines) - len(kept))
            at = batch.schema.names.index(text_col)
            out = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*batch.schema.names, "n_lines", "n_removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, n_lines long, n_removed long")


def _joined(docs: DataFrame, found: DataFrame, broadcast_lines: int, id_col: str, text_col: str) -> DataFrame:
    """The same with only the most frequent lines in a broadcast; the places of the others are found by a join.

    So a line that a third of all rows hold isn't joined on. Places come back to their rows by id and text hash.
    """
    cut = found.orderBy(F.desc("n")).limit(broadcast_lines).agg(F.min("n")).first()[0]
    hot = found.where(F.col("n") > (cut if cut is not None else 1 << 62)).drop("n")  # fewer than ``broadcast_lines``
    cold = found.join(F.broadcast(hot.select("h")), "h", "left_anti").drop("n")
    keyed = docs.withColumn("_k", F.struct(_key(F.col(id_col)).alias("a"), F.xxhash64(text_col).alias("b"), F.xxhash64(F.lit(1), text_col).alias("c")))
    places = keyed.select("_k", F.col(id_col).alias("_d"), F.posexplode(F.split(text_col, "\n")).alias("_p", "_l")).where("_l <> ''").select("_k", "_d", "_p", F.xxhash64("_l").alias("h"))
    met = places.join(F.broadcast(hot), "h").unionByName(places.join(F.broadcast(hot.select("h")), "h", "left_anti").join(cold, "h"))
    gone = met.where(~F.coalesce((F.col("_d") == F.col("doc")) & (F.col("_p") == F.col("place")), F.lit(False))).groupBy("_k").agg(F.collect_set("_p").alias("_gone"))
    lines = F.coalesce(F.split(text_col, "\n"), F.array().cast("array<string>"))
    back = keyed.join(gone, "_k", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    kept = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains("_gone", k)), "\n")
    text = F.when(F.size("_gone") == 0, F.col(text_col)).otherwise(kept).alias(text_col)
    return back.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns], F.size(lines).cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_removed"))
