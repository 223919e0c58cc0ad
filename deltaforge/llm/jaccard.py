"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Sets up to a boundary x are light: each gives every subset that could be its whole intersection with a partner (the
sizes are fixed by its own size and the threshold), and two light sets that link share such a subset. Larger sets are
heavy: they are put into inverted lists under their rarest shingles, as many as the threshold needs for two linked
sets to meet in a list; light sets within reach of a heavy one stand in those lists too. The boundary is the size up
to which enumerating costs less than the lists, by the histogram of sizes over all documents.

Lists aren't expanded into pairs. A node is a set, whichever documents have it, so equal sets are one from the start. In
the first rounds every node is compared with one other of its lists, and what links is joined into components; then only
pairs that share a list and lie in different components remain, and all of those are compared. So no link between different components is lost, while a
group of n copies costs about n comparisons.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from deltaforge.llm.graph import components
from deltaforge.llm.hashing import ALNUM, NON_SPACE, ORDERED, mix, ngrams, steady, words
from deltaforge.llm.work import Scratch

#: Shingles counted together before those of fewer than LOCAL are forgotten; a shingle of more than twice LOCAL * chunks documents is surely found.
CHUNK = 1_000_000
LOCAL = 6
#: Rows of the two broadcast tables of common words and shingles, 16 bytes each.
COMMON_WORDS = 65_536
COMMON_SHINGLES = 400_000
#: Sizes that are weighed for the light side.
LIGHT_MAX = 20
#: Rounds in which each node meets one other of its lists, before all remaining pairs are compared.
STAR_ROUNDS = 2
WORDS = {"non_space": NON_SPACE, "alnum": ALNUM}


def _least(size: int, percent: int) -> int:
    """The smallest intersection with which a set of this size can link with any other."""
    return -(-percent * size // 100)


def _subsets(size: int, percent: int) -> int:
    return sum(comb(size, c) for c in range(max(1, _least(size, percent)), size + 1))


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The size x up to which sets are light.

    A light set of s shingles costs as many keys as it has possible intersections. In the lists it costs a key for
    each shingle of its prefix, and as these sets are made of a few common words, a comparison with a share of the
    sets in its range of sizes: as large as that of one place of s.
    """
    best, x, gain = 0, 0, 0.0
    for s in range(1, LIGHT_MAX + 1):
        n = histogram.get(s, 0)
        near = sum(k for t, k in histogram.items() if percent * s <= 100 * t and percent * t <= 100 * s)
        prefix = s - _least(s, percent) + 1
        gain += n * (prefix * (1 + near / s / s / 64) - _subsets(s, percent))
        if gain >= best and (n or gain > best):
            best, x = gain, s
    return x


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; all words as one shingle if there are fewer."""
    return np.unique(ngrams(h, n if len(h) >= n else max(1, len(h)))) if len(h) else h


def _node(s: np.ndarray) -> int:
    """The name of a set: 64 bits of its digest."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def parities(s: np.ndarray) -> np.ndarray:
    """About a bit a shingle: whether an even or odd number of shingles fall on it.

    Two sets differ in at least as many shingles as their parities in bits; half as many bits are the halves' XOR.
    """
    m = 1 << max(6, int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _first_pass(n: int, kind: str, id_col: str, text_col: str):
    """Per document its set's name and size; per chunk the common words and shingles."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bits", pa.list_(pa.int64())), ("text_hash", pa.int64())])

    def common(kind_of: int, chunk: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(chunk), return_counts=True)
        keys, counts = keys[counts >= LOCAL], counts[counts >= LOCAL]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind_of, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.list_(pa.int64())), pa.nulls(len(keys), pa.int64())], schema=schema)

    def run(batches):
        kept, held = ([], []), 0
        for batch in batches:
            ids, sizes, sets, bits = batch.column(id_col), [], [], []
            for lo, hi, h, offs in words(batch.column(text_col), WORDS[kind]):
                for k in range(hi - lo):
                    s = shingles(h[offs[k] : offs[k + 1]], n)
                    sizes.append(len(s))
                    sets.append(_node(s) if len(s) else None)
                    bits.append(parities(s) if len(s) else None)
                    kept[1].append(s)
                    held += len(s)
                kept[0].append(h)
                if held >= CHUNK:
                    yield common(1, kept[0])
                    yield common(2, kept[1])
                    kept, held = ([], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sizes), np.int32)), ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), pa.array(bits, pa.list_(pa.int64())), batch.column("text_hash")], schema=schema)
        if held:
            yield common(1, kept[0])
            yield common(2, kept[1])

    return run, "kind int, key long, n long, node long, bits array<bigint>, text_hash long"


#: In place of a rank, the mark of a subset's key.
SUBSET = 127


class Rarity:
    """A total order of shingles, rarest first: known common ones last, then by how common their words are, then by hash."""

    def __init__(self, word_keys, word_ranks, shingle_keys, shingle_ranks):
        self.tables = (word_keys, word_ranks), (shingle_keys, shingle_ranks)

    def _rank(self, which: int, keys: np.ndarray) -> np.ndarray:
        known, ranks = self.tables[which]
        if not len(known):
            return np.zeros(len(keys), np.uint8)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, ranks[at], 0)

    def first(self, h: np.ndarray, n: int, count) -> np.ndarray:
        """The rarest ``count(size)`` shingles of a text's words, as places in the order: 7 bits of rank, 55 of hash."""
        m = n if len(h) >= n else max(1, len(h))
        s, place = np.unique(ngrams(h, m), return_index=True)
        by_word = self._rank(0, h).astype(np.uint64)
        by_words = by_word[place].copy()
        for j in range(1, m):
            by_words += by_word[place + j]
        rank = np.maximum(self._rank(1, s).astype(np.uint64) << np.uint64(3), np.minimum(by_words, np.uint64(255)))
        k = count(len(s))
        order = (np.minimum(rank >> np.uint64(1), np.uint64(SUBSET - 1)) << np.uint64(55)) | (s >> np.uint64(9))
        return np.partition(order, k - 1)[:k] if k < len(order) else order


def _log_ranks(counted: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` most frequent keys of ``counted(key, n)``, sorted, and the rounded-down logarithms of their counts."""
    table = counted.orderBy(F.desc("n"), "key").limit(top).toArrow()
    keys, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    at = np.argsort(keys)
    return keys[at], np.clip(np.log2(np.maximum(n[at], 1)), 1, 31).astype(np.uint8)


#: Sets of a task that are remembered, so that their copies aren't listed again.
SEEN = 200_000


def _lists(n: int, percent: int, kind: str, x: int, rarity):
    """The keys under which sets are listed: subsets of light sets, rarest shingles of the others and of light sets near x.

    A set gets one negative key besides, -1 - the last of its prefix.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32())])
    near = _least(x + 1, percent)

    def keys_of(h, s, order):
        if len(s) > x or len(s) >= near:
            rarest = order.first(h, n, lambda size: size - _least(size, percent) + 1).view(np.int64)
            yield rarest
            yield -1 - rarest.max(keepdims=True)
        if len(s) <= x:
            for c in range(max(1, _least(len(s), percent)), len(s) + 1):
                places = np.array(list(combinations(range(len(s)), c)))
                key = mix((s[places] * ORDERED[:c]).sum(axis=1, dtype=np.uint64) + np.uint64(c << 32))
                yield ((key >> np.uint64(9)) | np.uint64(SUBSET << 55)).view(np.int64)

    def run(batches):
        order, seen = Rarity(*rarity.value), set()
        for batch in batches:
            for lo, hi, h, offs in words(batch.column(0), WORDS[kind]):
                keys, nodes, sizes, n_keys = [], [], [], []
                for k in range(hi - lo):
                    own = h[offs[k] : offs[k + 1]]
                    if not len(own):
                        continue
                    s = shingles(own, n)
                    if (node := _node(s)) in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(node)
                    found = list(keys_of(own, s, order))
                    keys += found
                    nodes.append(node)
                    sizes.append(len(s))
                    n_keys.append(sum(map(len, found)))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(nodes, np.int64), n_keys)), pa.array(np.repeat(np.array(sizes, np.int32), n_keys))], schema=schema)

    return run, "key long, node long, size int"


#: Bits of the filter of wanted ids that goes to all tasks: half a megabyte, however many ids there are.
FILTER_BITS = 1 << 22


def _texts(read: DataFrame, wanted: DataFrame, n: int, kind: str) -> DataFrame:
    """One text, compressed, of each set that a document of the wanted ids has: (node, z).

    A filter of fixed size keeps most other texts out of the shuffle; the join that follows keeps out the rest.
    """
    spark = read.sparkSession
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = wanted.select(place.alias("at")).selectExpr("shiftright(at, 6) AS k", "shiftleft(1L, cast(at % 64 AS int)) AS bit").groupBy("k").agg(F.bit_or("bit")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[[r[0] for r in rows]] = [r[1] for r in rows]
    shared = spark.sparkContext.broadcast(bits)
    schema = pa.schema([("node", pa.int64()), ("z", pa.binary())])

    def run(batches):
        import zstandard

        squeeze, seen = zstandard.ZstdCompressor(level=1).compress, set()
        for batch in batches:
            at = batch.column("at").to_numpy()
            part = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)).column("text")
            for lo, hi, h, offs in words(part, WORDS[kind]):
                nodes, texts = [], []
                for k in range(hi - lo):
                    s = shingles(h[offs[k] : offs[k + 1]], n)
                    if len(s) and (node := _node(s)) not in seen:
                        if len(seen) < SEEN:
                            seen.add(node)
                        nodes.append(node)
                        texts.append(squeeze(part[lo + k].as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(texts, pa.binary())], schema=schema)

    return read.select("text", place.alias("at")).mapInArrow(steady(run), "node long, z binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, marks: DataFrame, read: DataFrame, n: int, percent: int, kind: str, scratch: Scratch) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets link: parities first, then the sets themselves."""
    for side in "ab":
        pairs = pairs.join(marks.select(*[F.col(c).alias(to) for c, to in (("node", side), ("size", f"n{side}"), ("id", f"i{side}"), ("bits", f"p{side}"))]), side)

    def halved(c: str, other: str):
        half = (F.size(c) / 2).cast("int")
        return F.when(F.size(c) > F.size(other), F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))

    apart = F.aggregate(F.zip_with(halved("pa", "pb"), halved("pb", "pa"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    pairs = pairs.where((F.abs(F.log2(F.size("pa")) - F.log2(F.size("pb"))) > 1.5) | ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))).select("a", "b", "ia", "ib")
    pairs = scratch.write(pairs, "close")
    wanted = pairs.select(F.col("ia").alias("id")).unionByName(pairs.select(F.col("ib").alias("id")))
    texts = scratch.write(_texts(read, wanted, n, kind), "texts")
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(side), F.col("z").alias(f"z{side}")), side)

    def run(batches):
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        last, known = None, None

        def made(z):
            (_, _, h, _), *_ = words(pa.array([expand(z)], pa.binary()), WORDS[kind])
            return shingles(h, n)

        for batch in batches:
            yes = []
            for one, two in zip(batch.column("za").to_pylist(), batch.column("zb").to_pylist(), strict=True):
                if one != last:
                    last, known = one, made(one)
                other = made(two)
                both = len(np.intersect1d(known, other, assume_unique=True))
                yes.append(100 * both >= percent * (len(known) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes))

    found = scratch.write(pairs.select("a", "b", "za", "zb").mapInArrow(steady(run), "a long, b long"), "found")
    scratch.drop(texts)
    return found


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, kind: str = "non_space", id_col: str = "doc_id", text_col: str = "text", detail: bool = False) -> DataFrame:
    """Classes of documents linked by the Jaccard similarity of their word n-gram sets.

    :param n: words a shingle; a text of fewer words is one shingle; a null or wordless text has none and links with nothing.
    :param percent: two documents link when 100 * |A & B| >= percent * |A | B|.
    :param kind: ``non_space`` or ``alnum`` words, ASCII letters lower-cased.
    :param detail: add ``class_id long``, which tells classes apart even where rows repeat an id (null without shingles or
        id), and ``text_hash long``, the ``xxhash64`` of the row's text.
    :returns: one row per input row: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id that can be reached.
        Rows that repeat an id are documents each, linked by their texts, not by the id. A row without id has no
        component, and nothing links by it. A very long text is compared whole. Ids are 64-bit integers. Other columns
        are ignored; an empty table gives an empty result.

    Shingles are compared by 64-bit hashes, and equal sets found by 64 bits of a digest of them.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    first, schema = _first_pass(n, kind, "id", "text")
    facts = scratch.write(read.mapInArrow(steady(first), schema), "facts")
    docs_ = facts.where("kind = 0").select(F.col("key").alias("id"), F.col("n").alias("n_shingles"), "node", "bits", "text_hash")
    nodes = docs_.where("node is not null and id is not null")

    tables = []
    for kind_of, top in ((1, COMMON_WORDS), (2, COMMON_SHINGLES)):
        counted = facts.where(F.col("kind") == kind_of).groupBy("key").agg(F.sum("n").alias("n"))
        tables += _log_ranks(counted, top)
    rarity = spark.sparkContext.broadcast(tables)
    histogram = {r[0]: r[1] for r in docs_.where(F.col("n_shingles").between(1, 2 * LIGHT_MAX)).groupBy("n_shingles").count().collect()}
    x = boundary(histogram, percent)

    listing, schema = _lists(n, percent, kind, x, rarity)
    by_key = read.where("id is not null").select("text").mapInArrow(steady(listing), schema)
    w = Window.partitionBy("key")
    ends = lambda df, c: df.withColumn("lo", F.min(c).over(w)).withColumn("hi", F.max(c).over(w))
    lists = scratch.write(ends(by_key, "node").where("lo <> hi OR key < 0").select("key", "node", "size").distinct(), "lists")
    # of its prefix, a set shares ``common`` shingles with other prefixes; ``last`` is the end of its prefix in the order
    shares = lists.groupBy("node", "size").agg(F.count_if((F.col("key") >= 0) & (F.col("key") < SUBSET << 55)).alias("common"), F.max(F.when(F.col("key") < 0, -1 - F.col("key"))).alias("last"), F.count_if(F.col("key") >= 0).alias("keys")).where("keys > 0")
    size = F.col("size")
    most = F.col("common") + size - (size - F.ceil(percent * size / 100) + 1)
    shares = scratch.write(shares.select("node", "size", F.coalesce("last", F.lit(-1)).alias("last"), F.when(F.col("last").isNull(), size).otherwise(F.least(most, size)).alias("most"), "keys"), "shares")
    named = lists.where("key >= 0").select("key", "node").join(shares, "node")
    marks = nodes.join(shares.select("node"), "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"), F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))
    marks = scratch.write(marks, "marks")

    links = None
    comp = None

    def near(p: str, q: str):
        """Bounds for two sets that share a key. The prefix that ends first holds all that both share of it, so at most
        ``most`` shingles of that set can be shared. (A set without prefix, at -1, has no such bound but its size.)"""
        a, b = F.col(f"{p}size"), F.col(f"{q}size")
        bound = F.when(F.col(f"{p}last") <= F.col(f"{q}last"), F.col(f"{p}most")).otherwise(F.col(f"{q}most"))
        return (100 * a >= percent * b) & (100 * b >= percent * a) & ((100 + percent) * bound >= percent * (a + b))

    for k in range(STAR_ROUNDS + 1):
        now = named.withColumn("comp", F.col("node")) if comp is None else named.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        now = ends(now, "comp").where("lo <> hi").drop("lo", "hi")
        if k < STAR_ROUNDS:
            # each node meets one node of another component: first the one in most lists, as the text that others were
            # copied from would be, then the first in an order that changes by the round
            first = -F.col("keys") if k == 0 else F.xxhash64(F.lit(k), "comp")
            place = F.struct(first.alias("first"), "comp", "node", "size", "last", "most")
            ahead = now.withColumn("c", F.min(place).over(w)).where((F.col("c.comp") != F.col("comp")) & near("", "c."))
            pairs = ahead.groupBy(F.col("node").alias("p")).agg(F.min("c").alias("c")).select(F.least("p", "c.node").alias("a"), F.greatest("p", "c.node").alias("b")).distinct()
        else:
            now = scratch.write(now, "open")
            one, two = now.alias("one"), now.alias("two")
            pairs = one.join(two, (F.col("one.key") == F.col("two.key")) & (F.col("one.node") < F.col("two.node")) & (F.col("one.comp") != F.col("two.comp")) & near("one.", "two."))
            pairs = pairs.select(F.col("one.node").alias("a"), F.col("two.node").alias("b")).distinct()
        pairs = scratch.write(pairs, "pairs")
        if pairs.isEmpty():  # no head of a list is near another node of it; other pairs of the list may be
            continue
        found = _verified(pairs, marks, read, n, percent, kind, scratch)
        if found.isEmpty():
            continue
        links = found if links is None else scratch.write(links.unionByName(found), "links")
        comp = scratch.write(components(links, scratch), "comp")
    # a component is named by the smallest id of its sets' documents
    least = nodes.groupBy("node").agg(F.min("id").alias("least"))
    if comp is None:
        least = least.withColumn("class_id", F.col("node"))
    else:
        linked = least.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        named = linked.groupBy("comp").agg(F.min("least").alias("least"))
        least = linked.select("node", "comp").join(named, "comp").select("node", "least", F.col("comp").alias("class_id"))
    found = docs_.join(least, "node", "left")
    own = lambda c: F.when(F.col("id").isNotNull(), c)
    more = [own(F.col("class_id")).alias("class_id"), "text_hash"] if detail else []
    return found.select(F.col("id").alias(id_col), "n_shingles", own(F.coalesce("least", "id")).alias("component_id"), *more)
