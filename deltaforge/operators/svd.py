"""Low-rank encodings of layer differences, one matrix a group, in half precision.

A tensor is a matrix of its first dimension by all others; one dimension is a row. Singular values are folded into the
first factor. A layer of few dimensions or elements is stored as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DIRECT = 1000
#: Elements above which a matrix is sketched by random projections rather than decomposed whole; the errors that come with the factors are measured in either case.
SKETCH = 4_000_000
FACTORS = "layer string, m long, n long, k long, u array<float>, v array<float>, mean_error double, max_error double, relative_error double"


def factors(d: np.ndarray, rank: int, sketch: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """(U * S, V) in half precision, of the largest ``rank`` singular values."""
    k = max(1, min(rank, *d.shape))
    if d.size > sketch and min(d.shape) > 4 * k:
        rng = np.random.default_rng(0)
        q, _ = np.linalg.qr(d @ rng.standard_normal((d.shape[1], k + 8)))
        for _ in range(2):
            q, _ = np.linalg.qr(d @ (d.T @ q))
        u, s, v = np.linalg.svd(q.T @ d, full_matrices=False)
        u = q @ u
    else:
        u, s, v = np.linalg.svd(d, full_matrices=False)
    return (u[:, :k] * s[:k]).astype(np.float16), v[:k].astype(np.float16)


def compress(deltas: DataFrame, shapes: DataFrame, rank: int = 16, sketch: int = SKETCH) -> DataFrame:
    """Factors and errors of each layer of more than ``DIRECT`` elements and at least two dimensions.

    :param deltas: (layer, idx, delta) with ``idx`` dense within a layer.
    :param shapes: (layer, rows): the first dimension of each layer that is a matrix.
    :param sketch: elements above which the factors are those of a sketch, near the best but not the best of their rank.
    """
    large = deltas.join(F.broadcast(shapes), "layer")

    def one(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("idx").to_numpy())
        x = table.column("delta").to_numpy()[order].astype(np.float64)
        m = int(table.column("rows")[0].as_py())
        d = x.reshape(m, -1)
        u, v = factors(d, rank, sketch)
        e = np.abs(d - u.astype(np.float64) @ v.astype(np.float64))
        out = {"layer": [table.column("layer")[0].as_py()], "m": [m], "n": [d.shape[1]], "k": [v.shape[0]], "u": [u.astype(np.float32).ravel()], "v": [v.astype(np.float32).ravel()], "mean_error": [float(e.mean())], "max_error": [float(e.max())], "relative_error": [float(e.mean() / (np.abs(d).mean() + 1e-8))]}
        return pa.table({k: pa.array(c, pa.list_(pa.float32()) if k in "uv" else None) for k, c in out.items()})

    return large.groupBy("layer").applyInArrow(one, FACTORS)


#: Rows of a matrix that are multiplied at once.
ROWS = 1024


def product(encoded: DataFrame) -> DataFrame:
    """U * V of every layer, by blocks of its rows: (layer, idx, delta). A block meets its layer's V, never single elements."""
    first = F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / ROWS))).alias("_", "part")
    blocks = encoded.select("layer", "n", "k", "u", first).select("layer", "n", "k", "part", F.slice("u", (F.col("part") * ROWS * F.col("k") + 1).cast("int"), (F.lit(ROWS) * F.col("k")).cast("int")).alias("u"))
    blocks = blocks.repartition("layer", "part").join(encoded.select("layer", "v"), "layer")
    schema = pa.schema([("layer", pa.string()), ("start", pa.int64()), ("values", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                layer, n, rank, part = (batch.column(c)[k].as_py() for c in ("layer", "n", "k", "part"))
                u, v = (batch.column(c)[k].values.to_numpy().astype(np.float64) for c in "uv")
                x = (u.reshape(-1, rank) @ v.reshape(rank, n)).astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([layer]), pa.array([part * ROWS * n]), pa.array([x], pa.list_(pa.float32()))], schema=schema)

    made = blocks.mapInArrow(run, "layer string, start long, values array<float>")
    return made.select("layer", "start", F.posexplode("values").alias("p", "delta")).select("layer", (F.col("start") + F.col("p")).alias("idx"), "delta")


def summary(encoded: DataFrame, rank: int) -> DataFrame:
    """The manifest's figures: the mean of the layers' mean errors and the largest of all."""
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    size = F.sum(2 * k * (m + n))
    return encoded.agg(F.lit(rank).alias("rank"), F.count("*").alias("num_layers"), F.sum(2 * m * n).alias("original_bytes"), size.alias("compressed_bytes"), (F.sum(2 * m * n) / size).alias("ratio"), F.avg("mean_error").alias("avg_error"), F.max("max_error").alias("max_error"))
