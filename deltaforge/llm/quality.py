"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade > j) = sigmoid(score - threshold j): one weight vector, shared by all thresholds, over hashed words, beginnings of
longer words, token endings and shares of unusual tokens, with thresholds kept in order. A document's score gives its
expected grade and the probability of the upper grades, by which documents are selected.

The model is fitted in numpy on a bounded sample of labelled rows; all rows of the table are scored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaforge.llm.hashing import ALNUM, CODES, NON_SPACE, RAW_CODES, mix, pieces, powers, steady, text_buffer
from deltaforge.llm.work import settle

BUCKETS = 1 << 18
#: Labelled rows that the fit uses at most.
SAMPLE = 8_000
#: A feature of fewer fitted rows has no weight.
MIN_ROWS = 8
EPOCHS = 30
RATE = 0.1
DECAY = 1e-3
#: Weights shrink by so much of a rate a step, and stay 0 where that is more than the step: most features say nothing.
SHRINK = 4e-4
SEED = 7
#: Weight of a rating of a rare grade, at most.
HEAVIEST = 1
#: Share of the sample that isn't fitted but sets the bar, and share of its best grade that the bar lets pass.
HELD_OUT = 0.3
KEEP_SHARE = 0.995


#: Bytes of the beginnings of words that are features of longer words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Steps of shares; a share has the features of all steps that it reaches.
STEPS = np.array([0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8])
#: Tokens from which shares of tokens say something.
FEW = 10


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts that lie side by side: hashes, by text the first, (feature, token) pairs as two rows, and marks by token.

    Marks: equal to the token before, ending in two marks, without letters or digits, in capitals.
    """
    base = int(offs[0])
    d = data[base : int(offs[-1])]
    n = len(d)
    starts = offs - base
    w = NON_SPACE[d]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    pw, inv = powers(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(CODES[d] * pw[:n])))
    raw = np.concatenate((np.zeros(1, np.uint64), np.cumsum(RAW_CODES[d] * pw[:n])))

    def part(t, a, b, kind):
        return (mix((t[b] - t[a]) * inv[a] + np.uint64(kind * 0x9E3779B9)) % np.uint64(BUCKETS)).astype(np.int64)

    h = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
    every = np.arange(len(s))
    found = [(part(total, s, e, 1), every), (part(raw, np.maximum(e - 2, s), e, 4), every)]
    for k in BEGINNINGS:
        longer = np.flatnonzero(e - s > k)
        found.append((part(total, s[longer], s[longer] + k, 10 + k), longer))
    upper = np.concatenate(([0], np.cumsum((d >= 65) & (d <= 90))))
    letter = np.concatenate(([0], np.cumsum(ALNUM[d])))
    place = np.searchsorted(s, starts)
    again = np.zeros(len(s), bool)
    again[1:] = h[1:] == h[:-1]
    again[place[:-1][place[:-1] < len(s)]] = False
    size = e - s
    marks = np.stack([again, (size > 1) & (letter[e] - letter[np.maximum(e - 2, s)] == 0), letter[e] == letter[s], (size > 1) & (upper[e] - upper[s] > 1) & (upper[e] - upper[s] == letter[e] - letter[s])])
    return h, place, np.stack([np.concatenate(c) for c in zip(*found, strict=True)]), marks


def _shares(n: int, most: int, distinct: int, marks: np.ndarray) -> np.ndarray:
    """Features of the text as a whole: shares of its tokens, in steps. A text of few tokens has none."""
    if n < FEW:
        return np.array([int(mix(np.array([99], np.uint64))[0] % np.uint64(BUCKETS))])
    shares = np.array([most, distinct, *marks]) / n
    kind, step = np.nonzero(shares[:, None] >= STEPS[None, :])
    return (mix((100 + 16 * kind + step).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


#: Bytes of text that are taken at once; each needs about two hundred bytes meanwhile.
PIECE = 1 << 17
#: Bytes from which a text is taken in parts, and bytes of a part.
LONG, PART = 1 << 20, 1 << 19


def features(column: pa.Array):
    """By row its distinct features. Whole texts; a null or empty text has one feature, that of few tokens."""
    data, offs = text_buffer(column)
    for lo, hi in pieces(offs, PIECE):
        if hi - lo == 1 and offs[hi] - offs[lo] > LONG:
            found, counts, marks, first = [], Counter(), 0, int(offs[lo])
            while first < offs[hi]:
                end = min(first + PART, int(offs[hi]))
                while end < offs[hi] and NON_SPACE[data[end]]:
                    end += 1
                h, _, pairs, own = _tokens(data, np.array([first, end]))
                found.append(np.unique(pairs[0]))
                words, n = np.unique(h, return_counts=True)
                counts.update(dict(zip(words.tolist(), n.tolist(), strict=True)))
                marks, first = marks + own.sum(axis=1), end
            yield np.union1d(np.unique(np.concatenate(found)), _shares(counts.total(), max(counts.values(), default=0), len(counts), marks))
            continue
        h, first, pairs, marks = _tokens(data, offs[lo : hi + 1])
        text = np.searchsorted(first, pairs[1], "right") - 1
        by_text = np.unique(text * BUCKETS + pairs[0])
        ends = np.searchsorted(by_text, np.arange(hi - lo + 1) * BUCKETS)
        total = np.concatenate((np.zeros((len(marks), 1), np.int64), np.cumsum(marks, axis=1)), axis=1)
        for k in range(hi - lo):
            a, b = first[k], first[k + 1]
            n = np.unique(h[a:b], return_counts=True)[1]
            yield np.union1d(by_text[ends[k] : ends[k + 1]] % BUCKETS, _shares(int(b - a), int(n.max(initial=0)), len(n), total[:, b] - total[:, a]))


@dataclass
class Ordinal:
    """Weights by feature, the thresholds between grades in rising order, and the tail probability that is asked of a document."""

    weights: np.ndarray
    thresholds: np.ndarray
    bar: float = 0.5

    def score(self, row: np.ndarray) -> float:
        own = self.weights[row]
        return float(own.sum(dtype=np.float64)) / scale(int(np.count_nonzero(own)))

    def scores(self, rows) -> np.ndarray:
        return np.array([self.score(r) for r in rows], np.float64)

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) by row and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def scale(n: int) -> float:
    """Features count by presence, a little less each in a long text."""
    return max(1.0, n / 300) ** 0.25


def fit_and_set_bar(rows: list[np.ndarray], grades: np.ndarray, levels: int) -> Ordinal:
    """Fit on most of the sample; the rest sets the bar: the highest, up to 0.5, that ``KEEP_SHARE`` of its best grade pass."""
    held = np.random.default_rng(SEED).random(len(rows)) < HELD_OUT
    model = fit([r for r, h in zip(rows, held, strict=True) if not h], grades[~held], levels)
    good = model.tail(model.scores([rows[k] for k in np.flatnonzero(held & (grades == levels - 1))]))[:, -1]
    if len(good):
        model.bar = float(min(0.5, np.quantile(good, 1 - KEEP_SHARE)))
    return model


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, shrink: float = SHRINK, seed: int = SEED) -> Ordinal:
    """Maximise the cumulative-link likelihood by AdaGrad over small batches, in an order fixed by ``seed``.

    Grades weigh alike however many rows they have, but for rare ones, whose rows weigh ``HEAVIEST`` at most.
    """
    seen = np.bincount(np.concatenate([np.zeros(0, np.int64), *rows]), minlength=BUCKETS) >= min(MIN_ROWS, max(2, len(rows) // 100))
    rows = [r[seen[r]] for r in rows]
    w, g2 = np.zeros(BUCKETS, np.float32), np.full(BUCKETS, 1e-2, np.float32)
    theta = np.linspace(-1, 1, levels - 1)
    t2 = np.full(levels - 1, 1.0)
    if not rows:
        return Ordinal(w, theta)
    share = np.bincount(grades, minlength=levels) / len(grades)
    weigh = np.minimum(1 / np.maximum(share[grades] * levels, 1e-9), HEAVIEST)
    rng = np.random.default_rng(seed)
    above = (grades[:, None] > np.arange(levels - 1)[None, :]).astype(np.float64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            batch = order[a : a + 64]
            n = np.array([len(rows[k]) for k in batch])
            flat = np.concatenate([rows[k] for k in batch])
            factor = 1 / np.array([scale(x) for x in n])
            ends = np.concatenate(([0], np.cumsum(n)))
            sums = np.concatenate(([0.0], np.cumsum(w[flat], dtype=np.float64)))
            score = (sums[ends[1:]] - sums[ends[:-1]]) * factor
            p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -40, 40)))
            error = (above[batch] - p) * weigh[batch][:, None]
            grad = np.repeat(error.sum(axis=1) * factor, n)
            at, back = np.unique(flat, return_inverse=True)
            step = np.bincount(back, weights=grad) / len(batch) - decay * w[at]
            g2[at] += step * step
            pace = rate / np.sqrt(g2[at])
            moved = w[at] + pace * step
            w[at] = np.sign(moved) * np.maximum(0, np.abs(moved) - pace * shrink)
            down = -error.mean(axis=0)
            t2 += down * down
            theta = np.maximum.accumulate(theta + rate * down / np.sqrt(t2))
    return Ordinal(w, theta)


def train(docs: DataFrame, ratings: DataFrame, levels: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fit on at most ``sample`` rated documents, as many of each grade as there are up to an equal share, by a hash of the id.

    ``ratings`` has ``id_col`` and grade (0 to levels - 1; others and nulls are left out). Without any rated row the model
    knows nothing and its bar is 0.
    """
    spark = docs.sparkSession
    settle(spark)
    rated = ratings.where(F.col(id_col).isNotNull() & F.col("grade").between(0, levels - 1)).groupBy(id_col).agg(F.min("grade").alias("grade"))
    chosen = []
    for g in range(levels):
        chosen += [(r[0], g) for r in rated.where(F.col("grade") == g).orderBy(F.xxhash64(id_col, F.lit(1)), id_col).select(id_col).limit(sample // levels).collect()]
    if not chosen:
        return Ordinal(np.zeros(BUCKETS, np.float32), np.linspace(-1, 1, levels - 1), 0.0)
    kind = docs.schema[id_col].dataType.simpleString()
    few = F.broadcast(spark.createDataFrame(chosen, f"`{id_col}` {kind}, grade int"))  # at most ``sample`` rows

    def run(batches):
        for batch in batches:
            for k, f in enumerate(features(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), pa.array([f.astype(np.int32).tobytes()], pa.binary())], names=["id", "grade", "f"])

    # of documents that repeat an id, one is fitted: the text of least hash
    first = docs.select(id_col, text_col).join(few, id_col).groupBy(id_col, "grade").agg(F.min_by(text_col, F.xxhash64(text_col)).alias(text_col))
    rows = first.select(F.col(id_col).alias("id"), text_col, "grade").mapInArrow(run, f"id {kind}, grade int, f binary")
    found = sorted(((r.id, r.grade, np.frombuffer(r.f, np.int32)) for r in rows.toLocalIterator()), key=lambda r: (r[0], len(r[2]), r[2].tobytes()))
    return fit_and_set_bar([r[2] for r in found], np.array([r[1] for r in found], np.int64), levels)


def score_documents(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and expected_grade double and tail_probability double (of the highest grade) for every row.

    A null or empty text is scored by its shape alone. Columns of the same names are replaced.
    """
    names = [c for c in docs.columns if c not in ("expected_grade", "tail_probability")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            score = known.scores(features(batch.column(text_col)))
            tail = known.tail(score) if len(score) else np.zeros((0, len(known.thresholds)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail.sum(axis=1)), pa.array(tail[:, -1])], names=[*batch.schema.names, "expected_grade", "tail_probability"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(steady(run), f"{fields}, expected_grade double, tail_probability double")


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades of (doc_id, quality, toxic) rows: 0 toxic, 1 of low quality, 2 good; null where both labels are."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def select_documents(docs: DataFrame, labels: DataFrame, least: float | None = None, sample: int = SAMPLE) -> DataFrame:
    """Documents whose probability of the highest of three grades is at least ``least``, by default the model's bar, with their scores.

    The scale is toxic < of low quality < good: weights learned for the first step, away from insults, and for the second,
    away from noise, add up in one score, and on rated documents that aren't fitted the three grades lie in that order.
    Rows that repeat are judged each, alike; a row without id or text is judged as well, a null text as an empty one; very
    long texts are judged whole; equal scores are treated alike. An empty table gives no rows; without ratings all pass.
    """
    model = train(docs, grades_of(labels), 3, sample)
    return score_documents(docs, model).where(F.col("tail_probability") >= (model.bar if least is None else least))
