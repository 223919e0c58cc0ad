"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are ordered by length and cut into buckets. With a lower bound of a query's k-th score, each bucket has a
local cosine threshold: what a vector as long as its longest must reach. Over 1 the bucket is skipped; where it is high,
the query's largest coordinates bound where a vector's own may lie and most fall away (coordinate pruning); where it is
low, the bucket is cut at the length below which no vector can reach the bound (length pruning). What is left gets its
exact integer product. Bounds start from the longest vectors of all and rise from bucket to bucket.

Queries are taken in blocks of bounded size, each against all rows; a block's results are written before the next block
is read, so the driver holds one block. Integers are exact at any size: where products may pass 64 bits they are Python's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from deltaforge.llm.work import Scratch, partitions

BUCKET = 1024
BLOCK = 4096
SEEDS = 1024
#: Cosine threshold from which coordinates prune better than lengths, and the coordinates that are looked at.
STEEP = 0.6
FOCUS = 3
#: Bytes of a score beyond 64 bits, as a number over 0 that sorts like the score; integers of up to 1024 bits a component.
WIDE = 260
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def length(x: np.ndarray) -> float:
    """The norm of a vector; the largest number if it is beyond that."""
    top = float(np.abs(x).max(initial=0))
    if top < 1e150:
        return float(np.sqrt(np.sum(x**2)))
    with np.errstate(over="ignore"):
        return min(float(top * np.sqrt(np.sum((x / top) ** 2))), np.finfo(np.float64).max)


def _integers(scale: int):
    """Rows with an id and a whole finite vector, as whole numbers in double precision, with length and norm."""
    schema = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("v", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                part = batch.slice(at, BUCKET)
                part = part.filter(pc.and_(part.column("id").is_valid(), part.column("v").is_valid()))
                v = part.column("v")
                flat, offs = v.flatten(), np.concatenate(([0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
                x = np.floor(scale * flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
                bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
                ok = bad[offs[1:]] == bad[offs[:-1]]
                rows = [x[a:b] for a, b, good in zip(offs[:-1], offs[1:], ok, strict=True) if good]
                ids = part.column("id").filter(pa.array(ok))
                norms = [length(r) for r in rows]
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in rows], pa.int32()), pa.array(norms, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], schema=schema)

    return run, "id long, dim int, norm double, v array<double>"


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of whole numbers: in floating point where every sum is below 2 ** 53, else as 64 bits or as Python's integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2.0**53:
        return (q @ c.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).astype(object) @ whole(c).astype(object).T


def joined(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Scores side by side; as Python's integers if either are."""
    return np.concatenate([s, t]) if s.dtype == t.dtype else np.concatenate([s.astype(object), t.astype(object)])


class Best:
    """The k best candidates so far of each query, and the score a further one must reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.s, self.i = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n = n

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        if not len(q):
            return
        q, s, i = np.concatenate([self.q, q]), joined(self.s, s), np.concatenate([self.i, i])
        falling = np.unique(-s, return_inverse=True)[1] if s.dtype == object else ~s
        order = np.lexsort((i, falling, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - first[q]
        full = rank == self.k - 1
        if s.dtype == object:
            self.floor = self.floor.astype(object)
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])
        keep = rank < self.k
        self.q, self.s, self.i = q[keep], s[keep], i[keep]


def search_bucket(best: Best, qid: np.ndarray, q: np.ndarray, qnorm: np.ndarray, cid: np.ndarray, c: np.ndarray, cnorm: np.ndarray) -> None:
    """Add a bucket's candidates, given by falling norm."""
    bound = np.array([max(-1e300, min(float(x), 1e300)) if abs(x) < 1 << 1000 else (1e300 if x > 0 else -1e300) for x in best.floor.tolist()])
    with np.errstate(over="ignore"):
        reach = qnorm * cnorm[0] if len(cnorm) else qnorm
    sound = reach < 1e300  # beyond it nothing is pruned
    reach = np.where(sound, reach, 1e300)
    slack = 1e-9 * (np.abs(bound) + reach + 1)
    alive = (bound <= reach + slack) | ~sound
    cosine = np.where(sound & (reach > 0), (bound - slack) / np.where(reach > 0, reach, 1), -1.0)
    steep = alive & (cosine >= STEEP)
    for k in np.flatnonzero(steep):
        unit = q[k] / qnorm[k]
        t = min(1.0, cosine[k])
        at = np.arange(len(cnorm))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            x = np.divide(c[at, f], cnorm[at], out=np.zeros(len(at)), where=cnorm[at] > 0)
            spread = np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - t * t))) + 1e-9
            # a vector shorter than the longest needs a larger cosine, so the bucket's threshold holds for all
            at = at[(x >= unit[f] * t - spread) if unit[f] > 0 else (x <= unit[f] * t + spread)]
        if len(at):
            s = products(q[k : k + 1], c[at])[0]
            ok = (s >= best.floor[k]) & (cid[at] != qid[k])
            best.add(np.full(ok.sum(), k), s[ok], cid[at][ok])
    flat = np.flatnonzero(alive & ~steep)
    if len(flat):
        # the shortest vector that can still reach the least demanding query's bound
        need = np.where((bound[flat] > 0) & sound[flat], (bound[flat] - slack[flat]) / np.maximum(qnorm[flat], 1e-300), 0.0)
        cut = int(np.searchsorted(-cnorm, -need.min() * (1 - 1e-9), "right"))
        if cut:
            s = products(q[flat], c[:cut])
            a, b = np.nonzero((s >= best.floor[flat][:, None]) & (cid[None, :cut] != qid[flat][:, None]))
            best.add(flat[a], s[a, b], cid[b])


def _scored(q: np.ndarray, i: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """Results as rows: scores beyond 64 bits are held to them, and given whole in a form that sorts like them."""
    wide = [None] * len(s)
    if s.dtype == object:
        wide = [(x + (1 << 8 * WIDE - 1)).to_bytes(WIDE) if not LEAST < x < MOST else None for x in s]
        s = np.array([max(LEAST, min(x, MOST)) for x in s], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(s), pa.array(wide, pa.binary())], names=["query_id", "vec_id", "score", "wide"])


def _block(k: int, shared):
    def run(batches):
        queries = shared.value
        state = {dim: Best(len(ids), k, floor) for dim, (ids, _, _, floor) in queries.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in queries:
                    continue
                part = batch.filter(pa.array(dims == dim))
                ids, norms = part.column("id").to_numpy(), part.column("norm").to_numpy()
                vectors = part.column("v").flatten().to_numpy().reshape(len(ids), int(dim))
                order = np.argsort(-norms, kind="stable")
                qid, q, qnorm, _ = queries[int(dim)]
                for at in range(0, len(order), BUCKET):
                    own = order[at : at + BUCKET]
                    search_bucket(state[int(dim)], qid, q, qnorm, ids[own], vectors[own], norms[own])
        for dim, best in state.items():
            yield _scored(queries[dim][0][best.q], best.i, best.s)

    return run, "query_id long, vec_id long, score long, wide binary"


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query row with all rows but those of its own id.

    :param is_query: condition on ``vectors`` that picks the queries.
    :returns: query_id long, rank int (from 1), vec_id long, score long; ties go to the smaller id, all candidates if fewer.
        Components are ``floor(scale * x)`` in double. Rows without id, and vectors that are null or hold null or
        non-finite components, take no part. Scores beyond 64 bits rank by their whole value and are given as the nearest
        64-bit number. Only vectors of the same length have a product. Rows that repeat an id are candidates each; of
        queries that repeat one, the shortest and then least vector asks. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    make, fields = _integers(scale)
    whole = rows.select("id", "v").mapInArrow(make, fields)
    ordered = scratch.write(whole.repartitionByRange(partitions(spark), F.col("dim"), F.desc("norm"), F.col("id")).sortWithinPartitions(F.col("dim"), F.desc("norm"), "id"), "ordered")
    asked = rows.where("asks").select("id", "v").mapInArrow(make, fields)
    seeds = {}
    for r in ordered.orderBy(F.desc("norm"), "id").limit(SEEDS).collect():
        seeds.setdefault(r.dim, []).append((r.id, r.v))
    # rows of a query that is repeated go to one block; a block's rows lie together in the table
    blocks = max(1, -(-rows.where("asks").count() // BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    asked = scratch.write(asked.repartitionByRange(min(blocks, partitions(spark)), "block", "id").sortWithinPartitions("block") if blocks > 1 else asked, "asked")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "vec_id")
    found = None
    for b in range(blocks):
        by_dim: dict[int, list] = {}
        last = None
        for r in asked.where(F.col("block") == b).orderBy("id", "dim", "v").collect():
            if r.id != last:
                by_dim.setdefault(r.dim, []).append(r)
            last = r.id
        queries = {}
        for dim, rows_ in by_dim.items():
            ids, q = np.array([r.id for r in rows_]), np.array([r.v for r in rows_], np.float64).reshape(len(rows_), dim)
            floor = np.full(len(rows_), LEAST, np.int64)
            if dim in seeds:
                sid, sv = np.array([i for i, _ in seeds[dim]]), np.array([v for _, v in seeds[dim]], np.float64).reshape(len(seeds[dim]), dim)
                best = Best(len(ids), k, floor)
                s = products(q, sv)
                x, y = np.nonzero(sid[None, :] != ids[:, None])
                best.add(x, s[x, y], sid[y])
                floor = best.floor
            queries[dim] = ids, q, np.array([r.norm for r in rows_]), floor
        shared = spark.sparkContext.broadcast(queries)
        search, out = _block(k, shared)
        part = ordered.mapInArrow(search, out).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            part = scratch.write(part, "found")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found
