"""Removal of repeated byte strings by a depth-limited, sampled suffix sort.

Suffixes are ordered only as deep as the threshold, by passes of most significant digits. As only strings of ``length``
bytes matter, it is enough to sort the suffixes at anchors: in every window of ``length`` bytes the 24-byte string with
the smallest hash, which equal windows choose alike. The passes are

1. digit of 24 bytes: anchors that stand in one document only are done. Where all windows of an anchor, taken as one
   string, also stand around it in a smaller document, all of them are repeats; only one document goes on for each
   distinct surrounding. Few strings of 24 bytes come twice by chance (of 16 bytes many do in gigabytes of text, and the
   share grows with the text).
2. digit of 37 bytes: every window holds the 13 bytes before or the 13 after its anchor; halves whose 37 bytes stand in
   one document only are done.
3. the whole window: halves are dealt by their 37 bytes, and the windows of each are held against each other by their
   ``length`` bytes where they lie. Equal groups are exactly the repeated windows.

A key that very many halves have, as those at the edges of a common line do, isn't dealt by: each task finds its repeats
among its own windows first, and only the windows of the smallest document go on to meet those of other tasks.

Surroundings and digits are compared by 64-bit hashes, windows by 128 bits in all. Shuffle files of a pass are let go
before the next pass writes its own, so disk holds one pass at a time; of large tables the second pass takes a part of
the documents at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from deltaforge.llm.hashing import RAW_CODES, mix, pieces, powers, steady, text_buffer
from deltaforge.llm.work import Scratch, partitions

DIGIT = 24
_BITS = np.uint64(20)
_LOW = np.uint64((1 << 20) - 1)
PIECE = 1 << 18


def _digit(length: int) -> int:
    """Bytes of an anchor; those of short windows leave a choice of places."""
    return min(DIGIT, 2 * length // 3)


class Anchors:
    """The anchors of texts that lie side by side: of each the first and last start of the windows that choose it."""

    def __init__(self, d: np.ndarray, starts: np.ndarray, length: int):
        n = len(d)
        self.length, self.doc = length, np.zeros(0, np.int64)
        digit = _digit(length)
        pw, self.inv = powers(n)
        self.total = np.empty(n + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(RAW_CODES[d] * pw[:n], out=self.total[1:])
        self.at = self.lo = self.hi = self.doc
        self.hash = np.zeros(0, np.uint64)
        if n < length:
            return
        m = n - digit + 1
        h = mix((self.total[digit:] - self.total[:-digit]) * self.inv[:m])
        x, span, width = (h & ~_LOW) | np.arange(m, dtype=np.uint64), 1, length - digit + 1
        while 2 * span <= width:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        if width > span:
            x = np.minimum(x[: len(x) - (width - span)], x[width - span :])
        pos = (x & _LOW).astype(np.int64)
        ok = np.zeros(len(pos) + 1, bool)  # windows within one text
        mark = np.zeros(len(pos) + 1, np.int64)
        a, b = starts[:-1], np.maximum(starts[1:] - length + 1, starts[:-1])
        np.add.at(mark, np.minimum(a, len(pos)), 1)
        np.add.at(mark, np.minimum(b, len(pos)), -1)
        ok[: len(pos)] = np.cumsum(mark[:-1]) > 0
        ok = ok[: len(pos)]
        new = ok.copy()
        new[1:] &= (pos[1:] != pos[:-1]) | ~ok[:-1]
        end = ok.copy()
        end[:-1] &= (pos[1:] != pos[:-1]) | ~ok[1:]
        self.lo, self.hi = np.flatnonzero(new), np.flatnonzero(end)
        self.at = pos[self.lo]
        self.hash = mix(h[self.at])  # again, as the smallest hashes of their windows aren't spread evenly
        self.doc = np.searchsorted(starts, self.lo, "right") - 1

    def strings(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from a to b."""
        return mix((self.total[b] - self.total[a]) * self.inv[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def around(self) -> np.ndarray:
        """Hashes of all windows of each anchor as one string, and of the anchor's place in it."""
        return mix(self.strings(self.lo, self.hi + self.length) + (self.at - self.lo).astype(np.uint64))


def anchors(column: pa.Array, length: int):
    """By run of rows: (first row, base of the bytes, bytes, starts, anchors); a long text comes in parts that overlap."""
    data, offs = text_buffer(column)
    for lo, hi in pieces(offs, PIECE):
        base, end = int(offs[lo]), int(offs[hi])
        if end - base <= 2 * PIECE - length:
            yield lo, 0, data[base:end], offs[lo : hi + 1] - base, Anchors(data[base:end], offs[lo : hi + 1] - base, length)
            continue
        for a in range(base, end - length + 1, PIECE):
            d = data[a : min(end, a + PIECE + length - 1)]
            yield lo, a - base, d, np.array([0, len(d)]), Anchors(d, np.array([0, len(d)]), length)


#: Anchors that a task sorts at once, and that a partition of the first pass should get.
SORTED = 1_000_000
#: Windows that a task holds against each other at once: of hot keys, and of others at least.
SETTLED = 1 << 17
#: Bytes of text that the second pass takes at a time, in ROUNDS turns at most.
ROUND = 1 << 31
ROUNDS = 8


def _packed(a: np.ndarray, r: np.ndarray, d: np.ndarray) -> tuple[int, int, bytes]:
    """Anchors, surroundings and documents: (smallest document, bytes of a document's distance from it, all three)."""
    least = d.min()
    far = d.view(np.uint64) - least.view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or far.max() < np.uint64(1 << (8 * w)))
    return int(least), width, a.astype(np.uint32).tobytes() + r.tobytes() + far.astype(f"u{width}").tobytes()


def _unpacked(blob: bytes, n: int, anchored: bool, least: int, width: int) -> list[np.ndarray]:
    at = 4 * n if anchored else 0
    d = np.frombuffer(blob, f"u{width}", n, at + 8 * n).astype(np.uint64) + np.int64(least).view(np.uint64)
    columns = [np.frombuffer(blob, np.int64, n, at), d.view(np.int64)]
    return [np.frombuffer(blob, np.uint32, n).astype(np.int64), *columns] if anchored else columns


def _pairs(a: np.ndarray, r: np.ndarray, d: np.ndarray):
    """Sort by anchor, surroundings and document; by row the smallest document of its surroundings."""
    order = np.lexsort((d, r, a))
    a, r, d = a[order], r[order], d[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (r[1:] != r[:-1]))) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return a, r, d, new, d[first][np.cumsum(new) - 1] if len(a) else d


def _first_digits(length: int, bits: int):
    """Anchors, sorted and packed by the leading bits of their hash: (part, kind, n, least, width, blob).

    Kind 0 has anchors (the 32 bits after those of the part: more that are equal by chance are only open for longer),
    surroundings and documents. Documents that share surroundings with a smaller document of the same task are settled
    here; kind 1 passes them on, dealt evenly, so what a third of all documents hold loads no part.
    """
    schema = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("least", pa.int64()), ("width", pa.int32()), ("blob", pa.binary())])

    def flush(held, turn):
        a, r, d, new, least = _pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))
        rows = []
        later = np.flatnonzero(d > least)
        for k in range(0, len(later), 1 << 16):
            own = later[k : k + (1 << 16)]
            rows.append(((turn + (k >> 16) * 40_503) % (1 << bits), 1, len(own), *_packed(a[:0], r[own], d[own])))
        a, r, d = a[new], r[new], d[new]
        ends = np.searchsorted(a >> 32, np.arange((1 << bits) + 1))
        a &= (1 << 32) - 1
        rows += [(k, 0, int(q - p), *_packed(a[p:q], r[p:q], d[p:q])) for k, (p, q) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if q > p]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        held, n, turn = [], 0, TaskContext.get().partitionId()  # tasks begin at parts of their own
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, _, _, x in anchors(batch.column(1), length):
                if len(x.at):
                    held.append(((x.hash >> np.uint64(32 - bits)).view(np.int64), x.around().view(np.int64), ids[lo + x.doc]))
                    n += len(x.at)
                if n >= SORTED:
                    yield flush(held, turn)
                    held, n, turn = [], 0, turn + 7919
        if n:
            yield flush(held, turn)

    return run, "part long, kind int, n int, least long, width int, blob binary"


def _flags():
    """Surroundings of a part's anchors that aren't done: (doc, key, kind), kind 1 repeats for sure, kind 2 open."""
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("kind", pa.int32())])

    def made(doc, key, kind):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array(np.full(len(doc), kind, np.int32))], schema=schema)

    def run(batches):
        held = []
        for batch in batches:
            for part, kind, n, least, width, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "n", "least", "width", "blob")), strict=True):
                if kind:
                    key, doc = _unpacked(blob, n, False, least, width)
                    yield made(doc, key, 1)
                else:
                    a, r, d = _unpacked(blob, n, True, least, width)
                    held.append((a | (part << 32), r, d))
        if held:
            a, r, d, new, least = _pairs(*(np.concatenate(c) for c in zip(*held, strict=True)))
            del held
            anchor = np.concatenate(([True], a[1:] != a[:-1]))
            group, first = np.cumsum(anchor) - 1, np.flatnonzero(anchor)
            differ = (np.maximum.reduceat(least, first) > np.minimum.reduceat(least, first))[group]
            sure = d > least
            yield made(d[sure], r[sure], 1)
            yield made(d[new & differ], r[new & differ], 2)

    return run, "doc long, key long, kind int"


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, as maximal runs."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    return a[first], b[np.append(first[1:] - 1, len(b) - 1)]


def _gathered(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """The bytes from each a to b, as a column."""
    size = b - a
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
    data = d[np.repeat(a - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _second_digits(length: int):
    """From texts with their flagged surroundings: spans that are repeats for sure, and halves of open windows.

    Rows (doc, row, key, at, size, z): key null for a span of ``size`` bytes from ``at``, else the middle of a half and
    in z the bytes of its windows.
    """
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("z", pa.binary())])
    digit = _digit(length)
    half = (length - digit) // 2

    def told(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Keys made unlike in unlike rows."""
        return keys.view(np.uint64) + (doc.astype(np.uint64) + np.uint64(1)) * _ODD

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            flags = {}
            for kind in ("sure", "open"):
                column = batch.column(kind)
                flags[kind] = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
            for lo, base, d, starts, x in anchors(batch.column("text"), length):
                if not len(x.at):
                    continue
                n, key, hit = len(starts) - 1, told(x.around().view(np.int64), x.doc), {}
                for kind, (flat, ends) in flags.items():
                    own = np.repeat(np.arange(n), np.diff(ends[lo : lo + n + 1]))
                    hit[kind] = np.isin(key, told(flat[ends[lo] : ends[lo + n]], own))
                doc, a, b = x.doc[hit["sure"]], x.lo[hit["sure"]], x.hi[hit["sure"]] + length
                if len(a):
                    first = np.flatnonzero(np.concatenate(([True], (a[1:] > b[:-1]) | (doc[1:] != doc[:-1]))))
                    last, doc = np.append(first[1:] - 1, len(b) - 1), doc[first]
                    nulls = pa.nulls(len(first), pa.int64()), pa.nulls(len(first), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo + doc]), pa.array(rows[lo + doc]), nulls[0], pa.array(a[first] - starts[doc] + base), pa.array(b[last] - a[first]), nulls[1]], schema=schema)
                doc, at, p, q = (c[hit["open"]] for c in (x.doc, x.at, x.lo, x.hi))
                cut = at - half  # windows that start before it hold the bytes before the anchor, the others those after
                for left, s, e in ((True, p, np.minimum(q, cut - 1)), (False, np.maximum(p, cut), q)):
                    ok = s <= e
                    if ok.any():
                        s, e, u, k = s[ok], e[ok], at[ok], doc[ok]
                        sign = x.strings(cut[ok], u + digit) ^ np.uint64(1) if left else x.strings(u, u + length - half)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo + k]), pa.array(rows[lo + k]), pa.array(sign.view(np.int64)), pa.array(s - starts[k] + base), pa.array(e - s + length), _gathered(d, s, e + length)], schema=schema)

    return run, "doc long, row long, key long, at long, size long, z binary"


#: Bits of the filter of keys that more than one document has, which goes to all tasks: 2 MB, however many keys there are.
FILTER_BITS = 1 << 24


#: A key is hot if it has more than HOT halves, and more than one in HOT_KEYS of all that share keys: there are fewer hot
#: keys than that, whose table, 8 bytes each, goes to all tasks.
HOT = 200
HOT_KEYS = 1000


def _shared(halves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Halves whose key stands in more than one document, and some others that pass a filter of fixed size: those of most
    keys, and those of hot keys."""
    spark = halves.sparkSession
    found = halves.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("key", "n")
    found = scratch.write(found, "keys")
    most = max(HOT, (found.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    hot = scratch.write(found.where(F.col("n") > most).select("key"), "hot")
    place = f"pmod(key, {FILTER_BITS})"
    words = found.selectExpr(f"shiftright({place}, 6) AS k", f"shiftleft(1L, cast({place} % 64 AS int)) AS bit").groupBy("k").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for k, v in words.toLocalIterator():
        bits[k] = v
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        known = shared.value
        for batch in batches:
            at = batch.column("key").to_numpy() & (FILTER_BITS - 1)
            yield batch.filter(pa.array((known[at >> 6] >> (at & 63)) & 1 == 1))

    often = None
    if not hot.isEmpty():
        often = halves.join(F.broadcast(hot), "key", "left_semi")
        halves = halves.join(F.broadcast(hot), "key", "left_anti")
    return halves.mapInArrow(run, halves.schema), often


def _settled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows that a smaller document of the same batch has are marked as repeats, and dealt evenly from here on."""
    key, window, doc, at = (batch.column(c).to_numpy() for c in ("key", "window", "doc", "at"))
    order = np.lexsort((doc, window, key))
    k, w, d = key[order], window[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (w[1:] != w[:-1]))))
    sure = np.empty(len(d), bool)
    sure[order] = d > np.repeat(d[first], np.diff(np.append(first, len(d))))
    columns = pa.array(np.where(sure, doc, key)), pa.array(np.where(sure, at, window)), *batch.columns[2:5], pa.array(sure)
    return pa.RecordBatch.from_arrays(list(columns), schema=batch.schema)


def _windows(batch: pa.RecordBatch, length: int):
    """The windows of halves, by run of rows: (row of the batch, hash, place)."""
    data, offs = text_buffer(batch.column("z"))
    place = batch.column("at").to_numpy()
    for lo, hi in pieces(offs, PIECE):
        d, starts = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        pw, inv = powers(len(d))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(RAW_CODES[d] * pw[: len(d)])))
        n = np.diff(starts) - length + 1
        row = np.repeat(np.arange(hi - lo), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = starts[row] + step
        yield lo + row, mix((total[s + length] - total[s]) * inv[s]).view(np.int64), place[lo + row] + step


def _hot_windows(length: int):
    """The windows of halves of hot keys; as many at once as are settled together are held against each other."""
    schema = pa.schema([("key", pa.int64()), ("window", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("sure", pa.bool_())])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for row, h, at in _windows(batch, length):
                take = pa.array(row)
                held.append(pa.RecordBatch.from_arrays([batch.column("key").take(take), pa.array(h), batch.column("doc").take(take), batch.column("row").take(take), pa.array(at), pa.array(np.zeros(len(at), bool))], schema=schema))
                n += len(at)
                if n >= SETTLED:
                    yield _settled(pa.concat_batches(held))
                    held, n = [], 0
        if n:
            yield _settled(pa.concat_batches(held))

    return run, "key long, window long, doc long, row long, at long, sure boolean"


def _matched(length: int):
    """From halves sorted by key: the repeated windows of each, as spans."""
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])

    def spans(batch):
        key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
        row, w, at = (np.concatenate(c) for c in zip(*_windows(batch, length), strict=True))
        k, d = key[row], doc[row]
        order = np.lexsort((d, w, k))
        k, w, d = k[order], w[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (w[1:] != w[:-1]))))
        sure = np.empty(len(d), bool)
        sure[order] = d > np.repeat(d[first], np.diff(np.append(first, len(d))))
        row, at = row[sure], at[sure]  # in the order of rows and places
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + length)
        first = np.flatnonzero(new)
        if len(first):
            take, size = pa.array(row[first]), at[np.append(first[1:] - 1, len(at) - 1)] + length - at[first]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("row").take(take), pa.array(at[first]), pa.array(size)], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.column("z").nbytes  # a window has a byte of its own at least
            if n < SETTLED * 8 or held[0].column("key")[0] == batch.column("key")[-1]:
                continue
            whole = pa.concat_batches(held)
            key = whole.column("key").to_numpy()
            end = int(np.flatnonzero(key != key[-1])[-1]) + 1  # the last key may go on
            yield from spans(whole.slice(0, end))
            held = [whole.slice(end)]
            n = held[0].column("z").nbytes
        if held:
            yield from spans(pa.concat_batches(held))

    return run, "doc long, row long, at long, size long"


def repeated_spans(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes of documents inside ``length``-byte strings that also start in a document of a smaller id.

    :returns: (id long, row long, spans array<struct<start, size>>): one row for each document with such bytes; ``row``
        is ``xxhash64`` of its text, for rows that repeat an id. Spans may touch or overlap. Rows without id are left out
        and nothing is a repeat of them; a null or shorter text has no windows; rows of one id aren't repeats of another.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    read = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(partitions(spark), 2 * size // (length - _digit(length) + 2) // SORTED)
    bits = min(20, int(4 * parts - 1).bit_length())
    run, fields = _first_digits(length, bits)
    dealt = read.mapInArrow(steady(run), fields).repartition(parts, "part")
    run, fields = _flags()
    flagged = scratch.write(dealt.mapInArrow(steady(run), fields), "flagged")
    del dealt
    scratch.free()

    of = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("key")))
    run, fields = _second_digits(length)
    rounds, halves = min(ROUNDS, 1 + size // ROUND), None
    for k in range(rounds):
        turn = F.expr(f"pmod(xxhash64(id), {rounds}) = {k}")
        flags = flagged.withColumnRenamed("doc", "id").where(turn).groupBy("id").agg(of(1).alias("sure"), of(2).alias("open"))
        texts = read.where(turn).withColumn("row", F.xxhash64("text"))
        found = scratch.write(texts.join(flags, "id").select("id", "row", "text", "sure", "open").mapInArrow(steady(run), fields), "halves")
        halves = found if halves is None else halves.unionAll(found)
        del flags, texts, found
        scratch.free()
    scratch.drop(flagged)
    del flagged

    few, often = _shared(halves.where("key is not null").select("key", "doc", "row", "at", "z"), scratch)
    scratch.free()
    run, fields = _matched(length)
    spans = halves.where("key is null").select("doc", "row", "at", "size")
    spans = spans.unionAll(few.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(steady(run), fields))
    if often is not None:
        run, fields = _hot_windows(length)
        windows = often.mapInArrow(steady(run), fields).repartition(parts, "sure", "key", "window")
        windows = windows.withColumn("first", F.min("doc").over(Window.partitionBy("sure", "key", "window"))).where("sure OR doc > first")
        spans = spans.unionAll(windows.select("doc", "row", "at", F.lit(length).cast("long").alias("size")))
        del windows
    both = scratch.write(spans, "spans")
    scratch.drop(halves)
    del halves, few, often, spans
    scratch.free()
    return both.groupBy(F.col("doc").alias("id"), "row").agg(F.collect_list(F.struct(F.col("at").alias("start"), "size")).alias("spans"))


def drop_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut repeated bytes out of every document.

    :returns: one row per input row: ``id_col``, n_bytes long, n_removed long, n_spans long (maximal runs) and kept
        binary (what stays; not always whole characters). A null text counts as empty.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, length, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            out = [[], [], [], []]
            lists = batch.column("spans")
            flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
            starts, sizes = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            for k in range(batch.num_rows):
                own = data[offs[k] : offs[k + 1]]
                a = starts[ends[k] : ends[k + 1]]
                a, b = _merged(a, a + sizes[ends[k] : ends[k + 1]])
                parts, at = [], 0
                for s, e in zip(a.tolist(), b.tolist(), strict=True):
                    parts.append(own[at:s].tobytes())
                    at = e
                kept = b"".join([*parts, own[at:].tobytes()])
                for c, v in zip(out, (len(own), len(own) - len(kept), len(a), kept), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(c, f.type) for c, f in zip(out, schema, strict=True))], names=[id_col, *schema.names])

    joined = rows.join(spans, ["id", "row"], "left").select("own", "text", "spans")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
