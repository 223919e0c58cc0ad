"""Masked pseudo-likelihood by a bidirectional window network.

A network sees the two words on either side of a hidden one and predicts it by a binary tree over the words, a Huffman
tree of their counts: each frequent word is a leaf of its own, the others share leaves with words about as frequent, in
which a word has its share of the counts. A document's score is the sum over its words of the logarithm of their
conditional probability given both sides.

Words are counted exactly over all documents. The counts of the most frequent ones go to all tasks; those of the rest,
however many there are, meet their words in a join. The training, in numpy, covers all documents too: they are dealt
into shards of bounded size by a hash, so that there are as many more shards as the corpus is larger. The first shard
trains a network from the start that gives every word its share of the counts; all others go on from that network, side
by side, and their weights are averaged. (Networks that start apart don't average well: 0.24 nats a word worse.)
"""

from __future__ import annotations

import copy
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from deltaforge.llm.hashing import ALNUM, steady, words
from deltaforge.llm.work import Scratch

#: Words that are leaves and have embeddings of their own.
FREQUENT = 8192
#: Embeddings that the other words share.
SHARED = 4096
#: Words, at most, whose counts go to all tasks; the counts of the rest are joined.
KNOWN = 1 << 18
#: Steps of the histogram of counts to a doubling.
STEPS = 8
#: Word positions counted together before they go to Spark.
CHUNK = 1 << 21
SIDES = (-2, -1, 1, 2)
WIDTH = 16
HIDDEN = 16
#: Words a shard, about, and word positions that a task holds while it trains.
SHARD_WORDS = 2_000_000
HELD = 1 << 19
#: Neighbouring positions that are trained on together, and such runs in a batch, drawn from all that are held.
RUN = 64
RUNS = 32
#: Depth of the tree down to which a batch's nodes are one matrix.
NEAR = 4
RATE = 0.2
SEED = 5
#: Positions that are scored together.
SCORED = 8192


def tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Huffman tree: by leaf the length of its path; by depth and leaf twice the inner node plus the turn there; by node the log odds of turning.

    Inner nodes are numbered from the root down.
    """
    n = len(weights)
    heap = [(int(w), k) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    below, odds = [], []
    for node in range(n, 2 * n - 1):
        (v, a), (w, b) = heapq.heappop(heap), heapq.heappop(heap)
        below.append((a, b))
        odds.append(np.log(w / v))
        heapq.heappush(heap, (v + w, node))
    paths, number, level = [()] * n, [], [(2 * n - 2, ())] if n > 1 else []
    while level:
        deeper = []
        for node, path in level:
            for turn, child in enumerate(below[node - n]):
                if child < n:
                    paths[child] = (*path, (len(number), turn))
                else:
                    deeper.append((child, (*path, (len(number), turn))))
            number.append(node - n)
        level = deeper
    length = np.array([len(x) for x in paths])
    steps = np.zeros((length.max(), n), np.uint16)
    for leaf, path in enumerate(paths):
        for depth, (node, turn) in enumerate(path):
            steps[depth, leaf] = 2 * node + turn
    return length, steps, np.array([odds[k] for k in number] or [0], np.float32)


@dataclass
class Vocabulary:
    """What the counts of words over all documents say."""

    known: np.ndarray  # sorted hashes of words
    leaf: np.ndarray  # by known word, and that of all others as last
    embedding: np.ndarray  # by known word; -1 for those that share one, and as last
    share: np.ndarray  # by known word: log P(word | its leaf); for the others as last that of a word of one occurrence
    frequent: int
    length: np.ndarray  # the tree
    steps: np.ndarray
    odds: np.ndarray
    least: int  # count from which a word is known
    total: int  # words of all documents

    @staticmethod
    def of(counted: DataFrame) -> Vocabulary:
        """From ``counted(word, n)``; at most ``KNOWN`` rows reach the driver, and a histogram of the logarithms of n."""
        steps = counted.groupBy(F.floor(F.log2("n") * STEPS).alias("step")).agg(F.min("n").alias("least"), F.count("*").alias("words"), F.sum("n").alias("n")).collect()
        taken, least, rest = 0, 1 << 62, 0
        for r in sorted(steps, key=lambda r: -r.step):
            if rest or taken + r.words > KNOWN:
                rest += r.n
            else:
                taken, least = taken + r.words, r.least
        top = counted.where(F.col("n") >= least).toArrow()
        word, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
        at = np.argsort(word)
        word, n = word[at], n[at]
        rank = np.empty(len(n), np.int64)
        rank[np.lexsort((word, -n))] = np.arange(len(n))
        own = rank < FREQUENT
        # the other known words by the doublings of their counts, then those that aren't known
        group = np.log2(np.maximum(n, 1)).astype(np.int64)
        _, band = np.unique(group[~own], return_inverse=True)
        leaf = rank.copy()
        leaf[~own] = own.sum() + band
        size = np.bincount(leaf, weights=n, minlength=1).astype(np.int64)
        if rest or not len(n):
            size = np.append(size[: leaf.max(initial=-1) + 1], max(rest, 1))
        last = len(size) - 1
        share = np.append(np.log(n / size[leaf]), -np.log(size[last])).astype(np.float32)
        return Vocabulary(word, np.append(leaf, last), np.append(np.where(own, rank, -1), -1), share, int(own.sum()), *tree(size), least, sum(r.n for r in steps))

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where words stand in ``known``; its length for others."""
        if not len(self.known):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at, len(self.known))

    def embeddings(self, h: np.ndarray, places: np.ndarray) -> np.ndarray:
        found = self.embedding[places]
        return np.where(found < 0, self.frequent + (h % np.uint64(SHARED)).astype(np.int64), found)

    @property
    def edge(self) -> int:
        """The embedding of the edge of a text, the last."""
        return self.frequent + SHARED

    def stream(self, h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts that lie side by side as one run of embeddings and leaves, with two edges (leaf -1) ahead of each text.

        Also the places of the words, in ``known`` and in the run.
        """
        places = self.places(h)
        n = len(offs) - 1
        at = np.arange(len(h)) + 2 * np.repeat(np.arange(1, n + 1), np.diff(offs))
        ids, leaf = np.full(len(h) + 2 * n, self.edge, np.uint16), np.full(len(h) + 2 * n, -1, np.int16)
        ids[at], leaf[at] = self.embeddings(h, places), self.leaf[places]
        return ids, leaf, np.stack([places, at])

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """An order of leaves by falling length of their paths, -1 left out; in it, by depth, twice the inner node plus the turn there."""
        order = np.flatnonzero(leaf >= 0)
        order = order[np.argsort(self.short[leaf[order]], kind="stable")]
        leaf = leaf[order]
        ends = np.searchsorted(self.short[leaf], 255 - np.arange(self.length[leaf[0]] if len(leaf) else 0))
        return order, [self.steps[depth].take(leaf[:end]) for depth, end in enumerate(ends)]

    @property
    def short(self) -> np.ndarray:
        """255 less the length of each leaf's path."""
        if not hasattr(self, "_short"):
            self._short = (255 - self.length).astype(np.uint8)
        return self._short


@dataclass
class Network:
    e: np.ndarray
    w1: np.ndarray  # by width; the hidden units of the four sides one after the other
    b1: np.ndarray
    w2: np.ndarray  # by inner node of the tree
    b2: np.ndarray

    @staticmethod
    def start(v: Vocabulary, seed: int = SEED) -> Network:
        """A network that gives each word its share of the counts, whatever its sides."""
        rng = np.random.default_rng(seed)
        draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        return Network(draw(v.edge + 1, WIDTH, by=0.1), draw(WIDTH, len(SIDES) * HIDDEN, by=0.2), np.zeros(HIDDEN, np.float32), np.zeros((len(v.odds), HIDDEN), np.float32), v.odds.copy())

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.e, self.w1, self.b1, self.w2, self.b2)])

    @staticmethod
    def of(flat: np.ndarray, v: Vocabulary) -> Network:
        out, at = [], 0
        for like in (lambda n: (n.e, n.w1, n.b1, n.w2, n.b2))(Network.start(v)):
            out.append(flat[at : at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
        return Network(*out)

    def hidden(self, parts: np.ndarray) -> np.ndarray:
        """Hidden units of all positions of runs but two at either end; ``parts`` has what each position gives to each side."""
        n = parts.shape[1] - 4
        h = self.b1 + parts[:, :n, 0]
        for k in range(1, len(SIDES)):
            h += parts[:, 2 + SIDES[k] : 2 + SIDES[k] + n, k]
        return np.tanh(h, out=h)

    def log_probabilities(self, v: Vocabulary, ids: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """log P(leaf | both sides) by position of a run; 0 at edges."""
        if not hasattr(self, "_parts"):
            self._parts = self.e @ self.w1
        ids, out = np.concatenate((ids, [v.edge, v.edge])), np.zeros(len(leaf), np.float32)
        for a in range(0, len(leaf) - 2, SCORED):
            own = ids[a : a + SCORED + 4]
            h = self.hidden(self._parts.take(own, axis=0).reshape(1, len(own), len(SIDES), HIDDEN))[0]
            order, steps = v.paths(leaf[a + 2 : a + SCORED + 2])
            h, total = h.take(order, axis=0), np.zeros(len(order), np.float32)
            for step in steps:
                n, node = len(step), step >> 1
                z = np.einsum("ij,ij->i", self.w2.take(node, axis=0), h[:n]) + self.b2.take(node)
                z *= 1 - 2 * (step & 1).astype(np.float32)
                total[:n] -= np.log(1 + np.exp(-np.abs(z))) + np.maximum(z, 0)  # the logistic function of -z
            out[a + 2 + order] = total
        return out


class Training:
    """Gradient descent on a network, each parameter at a rate that falls with the squares of its own steps."""

    def __init__(self, net: Network, v: Vocabulary, rate: float = RATE, seed: int = SEED):
        self.net, self.v, self.rate, self.rng = net, v, rate, np.random.default_rng(seed)
        start = lambda x, rows: np.full(len(x) if rows else x.shape, 1e-4, np.float32)
        self.sq_w1, self.sq_b1, self.sq_b2 = (start(x, False) for x in (net.w1, net.b1, net.b2))
        self.sq_e, self.sq_w2 = start(net.e, True), start(net.w2, True)

    def learn(self, ids: np.ndarray, leaf: np.ndarray) -> None:
        """One pass over a run: stretches of ``RUN`` positions in an order fixed by the seed, ``RUNS`` a batch."""
        n = -(-max(0, len(leaf) - 2) // RUN)
        rest = n * RUN + 4 - len(leaf)
        ids, leaf = np.concatenate((ids, np.full(rest, self.v.edge, ids.dtype))), np.concatenate((leaf, np.full(rest, -1, leaf.dtype)))
        order = self.rng.permutation(n) * RUN
        for a in range(0, n, RUNS):
            at = order[a : a + RUNS, None] + np.arange(RUN + 4)
            self.step(ids[at], leaf[at[:, 2:-2]].ravel())

    def step(self, ids: np.ndarray, leaf: np.ndarray) -> None:
        net, rate, runs = self.net, np.float32(self.rate), len(ids)
        order, steps = self.v.paths(leaf)
        if not steps:
            return
        x = net.e.take(ids.ravel(), axis=0)
        h = net.hidden((x @ net.w1).reshape(runs, RUN + 4, len(SIDES), HIDDEN)).reshape(-1, HIDDEN).take(order, axis=0)
        ends = np.cumsum([0, *map(len, steps)])
        row, step = np.concatenate([np.arange(len(s)) for s in steps]), np.concatenate(steps)
        node, n = step >> 1, len(order)
        own, seen = net.w2.take(node, axis=0), h.take(row, axis=0)
        z = np.einsum("ij,ij->i", own, seen) + net.b2.take(node)
        d = ((1 / (1 + np.exp(-z)) - (step & 1)) / n).astype(np.float32)
        own *= d[:, None]
        dh = own[:n]
        for i, j in zip(ends[1:-1], ends[2:], strict=True):
            dh[: j - i] += own[i:j]
        dh *= 1 - h * h
        # nodes near the root as a matrix, those farther down by runs
        m = ends[min(NEAR, len(steps))]
        near = np.zeros((n, min(1 << NEAR, len(net.b2))), np.float32)
        near[row[:m], node[:m]] = d[:m]
        self._nodes(slice(near.shape[1]), near.T @ h, near.sum(axis=0))
        if m < len(node):
            by = m + np.argsort(node[m:], kind="stable")
            at, first = _runs(node[by])
            far, own_d = seen.take(by, axis=0), d.take(by)
            far *= own_d[:, None]
            self._nodes(at, np.add.reduceat(far, first, axis=0), np.add.reduceat(own_d, first))
        back, sides = np.zeros((runs * RUN, HIDDEN), np.float32), np.zeros((runs, RUN + 4, len(SIDES), HIDDEN), np.float32)
        back[order] = dh
        back = back.reshape(runs, RUN, HIDDEN)
        for k, side in enumerate(SIDES):
            sides[:, 2 + side : 2 + side + RUN, k] = back
        sides = sides.reshape(-1, len(SIDES) * HIDDEN)
        dx = sides @ net.w1.T
        for p, sq, to in ((net.w1, self.sq_w1, x.T @ sides), (net.b1, self.sq_b1, dh.sum(axis=0))):
            sq += to * to
            p -= rate * to / np.sqrt(sq)
        flat = ids.ravel()
        by = np.argsort(flat, kind="stable")
        at, first = _runs(flat[by])
        _descend(net.e, self.sq_e, at, np.add.reduceat(dx.take(by, axis=0), first, axis=0), rate)

    def _nodes(self, at, d2: np.ndarray, db: np.ndarray) -> None:
        _descend(self.net.w2, self.sq_w2, at, d2, self.rate)
        self.sq_b2[at] += db * db
        self.net.b2[at] -= np.float32(self.rate) * db / np.sqrt(self.sq_b2[at])


def _descend(rows: np.ndarray, squares: np.ndarray, at, by: np.ndarray, rate: float) -> None:
    """A step of some rows of a table, each at a rate that falls with the mean squares of its own steps."""
    squares[at] += np.einsum("ij,ij->i", by, by) / np.float32(by.shape[1])
    rows[at] -= by * (np.float32(rate) / np.sqrt(squares[at]))[:, None]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array, and where each begins."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[start], start


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each word stands in all documents: (word, n), words by their hashes."""

    def counted(chunk: list[np.ndarray]):
        word, n = np.unique(np.concatenate(chunk), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    def run(batches):
        chunk, held = [], 0
        for batch in batches:
            for _, _, h, _ in words(batch.column(0), ALNUM):
                chunk.append(h)
                held += len(h)
                if held >= CHUNK:
                    yield counted(chunk)
                    chunk, held = [], 0
        if held:
            yield counted(chunk)

    return docs.select(text_col).mapInArrow(steady(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, vocabulary: Vocabulary, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, rate: float = RATE) -> Network:
    """The average of the networks that the shards train, all from that of the first.

    A shard is read in the order of a hash, a bounded part of it at a time, so a lost task trains the same network again.
    """
    spark = docs.sparkSession
    part = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    shards = max(1, -(-vocabulary.total // shard_words))
    known = spark.sparkContext.broadcast(vocabulary)

    def trained(rows: DataFrame, start: Network | None) -> DataFrame:
        begun = spark.sparkContext.broadcast(start)

        def run(batches):
            v = known.value
            work, held, n = Training(copy.deepcopy(begun.value) or Network.start(v), v, rate), [], 0
            for batch in batches:
                for _, _, h, offs in words(batch.column(1), ALNUM):
                    held.append(v.stream(h, offs)[:2])
                    n += len(h)
                    if sum(len(x) for x, _ in held) >= HELD:  # a very long text is held whole
                        work.learn(*map(np.concatenate, zip(*held, strict=True)))
                        held = []
            if held:
                work.learn(*map(np.concatenate, zip(*held, strict=True)))
            if n:  # a shard without words has no say in the average
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([1], pa.int64()), pa.array([work.net.flat().tobytes()], pa.binary())], names=["shard", "n", "w"])

        return scratch.write(rows.sortWithinPartitions("h").mapInArrow(steady(run), "shard long, n long, w binary"), "networks")

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for w in table.sort_by([("shard", "ascending")]).column("w"):
            total = total + np.frombuffer(w.as_py(), np.float32).astype(np.float64)
        n = sum(table.column("n").to_pylist())
        return pa.table({"shard": pa.array([table.column("up")[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "w": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    own = F.pmod("h", F.lit(shards)) == 0
    first = trained(part.where(own).repartition(1), None).collect()
    start = Network.of(np.frombuffer(first[0].w, np.float32), vocabulary) if first else None
    if shards == 1:
        return start or Network.start(vocabulary)
    made = trained(part.where(~own).repartition(shards - 1, "h"), start)
    while made.count() > 16:  # sums of sixteen, until the driver gets sixteen at most
        made = scratch.write(made.withColumn("up", F.floor(F.col("shard") / 16)).groupBy("up").applyInArrow(add, "shard long, n long, w binary"), "networks")
    rows = sorted(made.collect(), key=lambda r: r.shard)
    if not rows:
        return start or Network.start(vocabulary)
    return Network.of(sum(np.frombuffer(r.w, np.float32).astype(np.float64) for r in rows) / sum(r.n for r in rows), vocabulary)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS, rate: float = RATE) -> DataFrame:
    """Score every document: ``id_col``, n_tokens long, log_likelihood double (the sum) and per_token double (the mean).

    A null or wordless text has no tokens, the sum 0 and no mean; a very long text is scored whole. Rows that repeat are
    scored each, alike; a null id stays null; other columns are ignored; an empty table gives no rows.

    :param shard_words: words a shard of the training, about.
    :param rate: of the descent; at 0 each word has its share of the counts, whatever its sides.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    counted = scratch.write(token_counts(docs, text_col), "counted")
    vocabulary = Vocabulary.of(counted)
    shared = spark.sparkContext.broadcast((vocabulary, train(docs, vocabulary, scratch, id_col, text_col, shard_words, rate)))

    def run(batches):
        v, net = shared.value
        for batch in batches:
            for lo, hi, h, offs in words(batch.column(2), ALNUM):
                ids, leaf, (at, place) = v.stream(h, offs)
                p = net.log_probabilities(v, ids, leaf)[place].astype(np.float64) + v.share[at]
                total = np.concatenate(([0.0], np.cumsum(p)))
                other = at == len(v.known)
                ends = np.concatenate(([0], np.cumsum(other)))[offs]
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[other].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(total[offs[1:]] - total[offs[:-1]]), rest], names=["row", "id", "n", "s", "rest"])

    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col))
    scored = scratch.write(read.mapInArrow(steady(run), f"row long, id {docs.schema[id_col].dataType.simpleString()}, n long, s double, rest array<bigint>"), "scored")
    # a word that isn't known was scored as one that occurs once; what it occurs more often is added
    more = scored.select("row", F.explode("rest").alias("word")).join(counted.where(F.col("n").between(2, vocabulary.least - 1)), "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    out = scored.join(more, "row", "left").withColumn("s", F.round(F.col("s") + F.coalesce("more", F.lit(0.0)), 4))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("s").alias("log_likelihood"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("per_token"))
