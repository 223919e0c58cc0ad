"""Benchmark decontamination: a prefix-filtered set join of document windows with benchmark windows.

Each benchmark item is cut into windows of so many consecutive words (a shorter item is one window), and each window
into short shingles. Shingles are ordered by how rare they are in the documents. A window that must hold ``percent`` of
its shingles can miss only so many, so one of its rarest few, its prefix, must be in the document: only those are
joined. A match of a prefix shingle fixes where the window would begin there; it must lie within the document (length
bound) and begin at the shingle's own place before it (positional bound). What is left is verified word by word.

The benchmark side is broadcast in blocks of at most ``BLOCK_CHARS`` characters, the documents are read once for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaforge.llm.hashing import ALNUM, ngrams, steady, words
from deltaforge.llm.work import Scratch

#: Characters of benchmark text that are broadcast at once, as windows of 64-bit words.
BLOCK_CHARS = 4_000_000
SHINGLE = 3
_BITS = 22


class Windows:
    """The windows of a block of items, and the shingles under which they are sought."""

    def __init__(self, items: list[tuple[str, str]], size: int, least: int, percent: int):
        column, found = pa.array([t for _, t in items], pa.string()), {}
        self.names, self.percent = [n for n, _ in items], percent
        for lo, hi, h, offs in words(column, ALNUM):
            for k in range(hi - lo):
                own = h[offs[k] : offs[k + 1]]
                if len(own) < max(1, min(least, size)):
                    continue
                n = min(size, len(own))
                for a in range(len(own) - n + 1):
                    found.setdefault(own[a : a + n].tobytes(), set()).add(lo + k)
        keys = list(found)
        self.length = np.array([len(k) // 8 for k in keys], np.int64)
        self.words = np.zeros((len(keys), size), np.uint64)
        for k, key in enumerate(keys):
            self.words[k, : self.length[k]] = np.frombuffer(key, np.uint64)
        self.items = [sorted(found[k]) for k in keys]
        self.starts = np.cumsum([0, *map(len, self.items)])
        self.item = np.array([i for x in self.items for i in x], np.int64)

    def shingles(self) -> dict[int, np.ndarray]:
        """By shingle length all shingles of the windows, of which the rarity is asked for."""
        out: dict[int, list] = {}
        for w, n in zip(self.words, self.length, strict=True):
            s = int(min(SHINGLE, n))
            out.setdefault(s, []).append(ngrams(w[:n], s))
        return {s: np.unique(np.concatenate(x)) for s, x in out.items()}

    def index(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's prefix by the counts of its shingles."""
        rows: dict[int, list[tuple[int, int, int]]] = {}
        for k, (w, n) in enumerate(zip(self.words, self.length, strict=True)):
            s = int(min(SHINGLE, n))
            own = ngrams(w[:n], s)
            m = len(own)
            prefix = m - max(1, -(-self.percent * m // 100)) + 1
            order = sorted(range(m), key=lambda j: (counts.get((s, int(own[j])), 0), int(own[j]), j))
            for j in order[:prefix]:
                rows.setdefault(s, []).append((int(own[j]), k, j))
        self.tables = {}
        for s, found in rows.items():
            found.sort()
            keys = np.array([r[0] for r in found], np.uint64)
            self.tables[s] = (keys, np.array([r[1] for r in found], np.int64), np.array([r[2] for r in found], np.int64), _bits(keys))

    def hits(self, h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur in some documents' words, and the words where they begin."""
        out_w, out_a = [], []
        for s, (keys, window, place, bits) in self.tables.items():
            at, lo, hi = _matches(ngrams(h, s), keys, bits)
            n = hi - lo
            pos = np.repeat(at, n)
            row = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            w, start = window[row], pos - place[row]
            doc = np.searchsorted(offs, pos, "right") - 1
            ok = (start >= offs[doc]) & (start + self.length[w] <= offs[doc + 1])
            w, start = w[ok], start[ok]
            if self.percent >= 100:
                for j in range(self.words.shape[1]):
                    if not len(w):
                        break
                    ok = (j >= self.length[w]) | (h[np.minimum(start + j, len(h) - 1)] == self.words[w, j])
                    w, start = w[ok], start[ok]
            elif len(w):
                m = self.length[w] - np.minimum(SHINGLE, self.length[w]) + 1
                same = np.zeros(len(w), np.int64)
                for j in range(self.words.shape[1]):
                    equal = j < m
                    for i in range(s):
                        k = np.minimum(j + i, self.words.shape[1] - 1)
                        equal &= h[np.minimum(start + j + i, len(h) - 1)] == self.words[w, k]
                    same += equal
                ok = 100 * same >= self.percent * m
                w, start = w[ok], start[ok]
            out_w.append(w)
            out_a.append(start)
        return (np.concatenate(out_w), np.concatenate(out_a)) if out_w else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bits(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return bits


def _matches(g: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in g of known keys, and the run of each key."""
    at = np.flatnonzero(bits[(g & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
    ok = hi > lo
    return at[ok], lo[ok], hi[ok]


def _counts(docs: DataFrame, shared) -> dict[tuple[int, int], int]:
    """How often the documents hold each shingle of the windows: one row a shingle reaches the driver."""

    def run(batches):
        known = {s: (keys, _bits(keys), np.zeros(len(keys), np.int64)) for s, keys in shared.value.items()}
        for batch in batches:
            for _, _, h, _ in words(batch.column("text"), ALNUM):
                for s, (keys, bits, total) in known.items():
                    _, lo, _ = _matches(ngrams(h, s), keys, bits)
                    total += np.bincount(lo, minlength=len(keys))
        for s, (_, _, total) in known.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at), pa.array(total[at])], names=["s", "k", "n"])

    rows = docs.select("text").mapInArrow(steady(run), "s long, k long, n long").groupBy("s", "k").agg(F.sum("n").alias("n")).collect()
    return {(s, int(shared.value[s][k])): n for s, k, n in rows}


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, min_item_words: int = 1, percent: int = 100, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Find where documents hold windows of benchmark items.

    Words are runs of ASCII letters, digits and non-ASCII characters, ASCII lower-cased.

    :param size: words a window; an item of fewer is one window.
    :param min_item_words: items of fewer words are left out.
    :param percent: a window occurs if so many of its 3-word shingles stand in their places; 100 means all its words.
    :returns: one row per input row: ``id_col``, n_words long, n_hit long (words inside an occurring window), items
        array<string> (sorted, of the items with occurring windows) and spans array<struct<start, end>> (their words, merged).
        A null or wordless text has no words and no hits; null items likewise. Rows that repeat are reported each; other
        columns are ignored; empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    kind = docs.schema[id_col].dataType.simpleString()
    state = "n_words long, items array<string>, spans array<struct<start:bigint,`end`:bigint>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    scratch = Scratch(spark, "decontaminate")
    for b in range(blocks):
        windows = Windows([tuple(r) for r in items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).distinct().collect()], size, min_item_words, percent)
        windows.index(_counts(read, spark.sparkContext.broadcast(windows.shingles())))
        shared = spark.sparkContext.broadcast(windows)

        def mark(batches, shared=shared, later=b > 0, last=b == blocks - 1):
            known = shared.value
            for batch in batches:
                for lo, hi, h, offs in words(batch.column("text"), ALNUM):
                    n = hi - lo
                    w, a = known.hits(h, offs)
                    doc = np.searchsorted(offs, a, "right") - 1
                    cover = np.zeros(len(h) + 1, np.int64)
                    np.add.at(cover, a, 1)
                    np.add.at(cover, a + known.length[w], -1)
                    inside = np.concatenate(([False], np.cumsum(cover) > 0, [False]))
                    count = known.starts[w + 1] - known.starts[w]
                    row = np.repeat(known.starts[w] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                    pairs = np.unique(np.repeat(doc, count) * len(known.names) + known.item[row]) if len(w) else np.zeros(0, np.int64)
                    names: list[list[str]] = [[] for _ in range(n)]
                    for p in pairs.tolist():
                        names[p // len(known.names)].append(known.names[p % len(known.names)])
                    spans: list[list[list[int]]] = [[] for _ in range(n)]
                    for k in np.unique(doc).tolist():
                        own = np.flatnonzero(np.diff(np.concatenate(([False], inside[1 + offs[k] : 1 + offs[k + 1]], [False])).astype(np.int8)))
                        spans[k] = own.reshape(-1, 2).tolist()
                    part = batch.slice(lo, n)
                    if later:
                        names = [[*set(x) | set(y)] for x, y in zip(names, part.column("items").to_pylist(), strict=True)]
                        spans = [_merge(x + [[s["start"], s["end"]] for s in y]) for x, y in zip(spans, part.column("spans").to_pylist(), strict=True)]
                    out = [part.column("id"), *([] if last else [part.column("text")]), pa.array(np.diff(offs)), pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span)]
                    yield pa.RecordBatch.from_arrays(out, names=["id", *([] if last else ["text"]), "n_words", "items", "spans"])

        found = (read if b == 0 else found).mapInArrow(steady(mark), f"id {kind}, " + ("" if b == blocks - 1 else "text string, ") + state)
        if b < blocks - 1:
            found = scratch.write(found, "marked")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), "items", "spans")
