"""Artifacts: a model or dataset stored as a difference, with a manifest.

A model artifact holds ``encoded`` (Parquet, one directory a method, a row a block), ``layers`` (Parquet, a row a layer)
and ``manifest.json``. A dataset artifact holds ``refs``, ``new`` and ``manifest.json``. Elements are never shuffled:
base and fine-tune meet by block, and all that is gathered is a row a layer.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaforge.operators import choose, codec, dataset as ds
from deltaforge.operators.diff import EPS, block_differences, block_stats

VERSION = "1.0"
#: Known fields of manifests; others are dropped on reading.
FIELDS = ("version", "type", "base_id", "derived_id", "base_hash", "created_at", "num_layers", "total_params", "changed_params", "original_bytes", "compressed_bytes", "compression_ratio", "threshold", "rank", "avg_error", "max_error", "layers", "splits")
ENCODED = "layer string, block_id long, start long, n long, method string, positions array<int>, values array<float>, codes binary, scale float"
_ENCODED = pa.schema([("layer", pa.string()), ("block_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("method", pa.string()), ("positions", pa.list_(pa.int32())), ("values", pa.list_(pa.float32())), ("codes", pa.binary()), ("scale", pa.float32())])


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of text, in any store that Spark writes to; replaced whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_manifest(spark: SparkSession, folder: str) -> dict:
    found = json.loads(read_text(spark, f"{folder}/manifest.json"))
    return {k: v for k, v in found.items() if k in FIELDS}


def write_manifest(spark: SparkSession, folder: str, **fields) -> dict:
    made = {"version": VERSION, "created_at": datetime.now(UTC).isoformat()} | {k: v for k, v in fields.items() if k in FIELDS}
    write_text(spark, f"{folder}/manifest.json", json.dumps(made, indent=1))
    return made


def model_hash(blocks: DataFrame) -> str:
    """16 hex digits over every element of every layer, whatever the order of rows: an edit anywhere changes them."""
    each = blocks.select("layer", "block_id", F.xxhash64("layer", "block_id", "values").alias("h"))
    row = each.agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x"), F.count("*").alias("n")).first()
    import hashlib

    return hashlib.sha256(f"{row.s}:{row.x}:{row.n}".encode()).hexdigest()[:16]


def layer_table(deltas: DataFrame, mode: str = "smart", threshold: float = EPS) -> DataFrame:
    """Statistics, method and threshold by layer; for hybrid with ``mode`` ``median`` the layer's median size."""
    stats = block_stats(deltas, threshold)
    counted = deltas.select("layer", F.aggregate("delta", F.lit(0).cast("long"), lambda n, x: n + ((F.abs(x) >= F.lit(threshold).cast("float")) & ~F.isnan(x)).cast("long")).alias("k")).groupBy("layer").agg(F.sum("k").alias("nonzero"))
    return stats.join(counted, "layer").withColumn("method", choose.method("basic" if mode == "basic" else "smart")).withColumn("threshold", F.lit(threshold))


def _rounded(held: np.ndarray) -> bytes:
    """Codes, halves away from zero."""
    return (np.sign(held) * np.floor(np.abs(held) + np.float32(0.5))).astype(np.int8).tobytes()


def encode_blocks(deltas: DataFrame, layers: DataFrame) -> DataFrame:
    """Encode each block by its layer's method, in Arrow batches."""

    def run(batches):
        for batch in batches:
            flat, ends = _flat(batch.column("delta"))
            rows, columns = [], [batch.column(c).to_pylist() for c in ("layer", "block_id", "start", "method", "threshold", "max_abs")]
            for k, (layer, block, start, method, threshold, max_abs) in enumerate(zip(*columns, strict=True)):
                d = flat[ends[k] : ends[k + 1]]
                positions = values = codes = scale = None
                size = np.nan_to_num(np.abs(d), nan=0.0)
                n = len(d)
                if method in (choose.SCATTER, "hybrid"):
                    keep = (size >= np.float32(threshold)) if method == choose.SCATTER else (size > np.float32(threshold))
                    positions = np.flatnonzero(keep).astype(np.int32)
                    values = d[positions]
                    d, size = np.where(keep, np.float32(0), d), np.where(keep, 0, size)
                if method == "full":
                    values = d
                if method == "int8" or (method == "hybrid" and size.any()):
                    top = np.float32(max_abs if method == "int8" else size.max())
                    scale = np.float32(1) if top < np.float32(codec.TINY) else np.float32(top / np.float32(codec.TOP))
                    codes = _rounded(np.clip((np.nan_to_num(d) / scale).astype(np.float32), -codec.TOP, codec.TOP))
                rows.append((layer, block, start, n, method, positions, values, codes, scale))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ENCODED, strict=True)] if rows else [pa.array([], f.type) for f in _ENCODED], schema=_ENCODED)

    named = deltas.join(F.broadcast(layers.select("layer", "method", "threshold", "max_abs")), "layer").where("method <> 'zero'")
    return named.select("layer", "block_id", "start", "delta", "method", "threshold", "max_abs").mapInArrow(run, ENCODED)


def _flat(column: pa.Array, kind=np.float32) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists, and where each list's begin; null lists are empty."""
    ends = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False), ends


def _differences(encoded: pa.StructArray):
    """By row the difference that it holds as an array; None for a null row."""
    n, method, codes, scale = (encoded.field(c).to_pylist() for c in ("n", "method", "codes", "scale"))
    (places, at), (values, to) = _flat(encoded.field("positions"), np.int64), _flat(encoded.field("values"))
    for k, there in enumerate(encoded.is_valid().to_pylist()):
        if not there:
            yield None
            continue
        d = np.zeros(n[k], np.float32) if codes[k] is None else np.frombuffer(codes[k], np.int8).astype(np.float32) * np.float32(scale[k])
        if method[k] == "full":
            d = values[to[k] : to[k + 1]]
        elif at[k + 1] > at[k]:
            d[places[at[k] : at[k + 1]]] = values[to[k] : to[k + 1]]
        yield d


def apply_blocks(base: DataFrame, encoded: DataFrame, half: bool = False) -> DataFrame:
    """Base blocks plus the differences of those that have one; layers that only the artifact knows are skipped.

    :param half: round what changes to half precision, as a model kept so would be.
    """
    columns = ["n", "method", "positions", "values", "codes", "scale"]
    delta = encoded.select("layer", "block_id", F.struct(*columns).alias("e"))
    joined = base.join(delta, ["layer", "block_id"], "left").select("layer", "block_id", "start", "values", "e")

    def run(batches):
        for batch in batches:
            flat, ends = _flat(batch.column("values"))
            out = flat.copy()
            for k, d in enumerate(_differences(batch.column("e"))):
                if d is None:
                    continue
                a, b = ends[k], ends[k + 1]
                if len(d) != b - a:
                    raise ValueError(f"a block of {b - a} values, a difference of {len(d)}")
                out[a:b] += d
                if half:
                    out[a:b] = out[a:b].astype(np.float16)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))], names=["layer", "block_id", "start", "values"])

    return joined.mapInArrow(run, "layer string, block_id long, start long, values array<float>")


def compress_model(base: DataFrame, other: DataFrame, folder: str, base_id: str = "base", derived_id: str = "derived", mode: str = "smart", threshold: float = EPS, profile: str = "standard", report=None, shapes: tuple[DataFrame, DataFrame] | None = None) -> dict:
    """Store ``other`` as its difference from ``base``, both in block form, and return the manifest.

    :param mode: ``smart``, ``basic``, or ``full`` to store differences whole, without loss.
    :param report: called with (what, share done).
    :param shapes: tables (layer, shape) of both models; layers of unlike shape are left out, as are those of unlike size.
    """
    spark, say = base.sparkSession, report or (lambda what, share: None)
    say("differences", 0.0)
    deltas = block_differences(base, other, shapes=shapes).select("layer", "block_id", "start", "delta").persist()
    try:
        layers = layer_table(deltas, "smart" if mode == "full" else mode, threshold)
        if mode == "full":
            layers = layers.withColumn("method", F.when(F.col("max_abs") == 0, "zero").otherwise("full"))
        n, k, m = F.col("numel"), F.col("nonzero"), F.col("method")
        layers = layers.withColumn("layer_type", choose.layer_type(F.col("layer"))).withColumn("original_bytes", 2 * n).withColumn("compressed_bytes", codec.packed_bytes(m, n, k, n, profile)).withColumn("changed", codec.changed(m, n, k))
        layers.write.mode("overwrite").parquet(f"{folder}/layers")
        layers = spark.read.parquet(f"{folder}/layers")
        say("encoding", 0.4)
        encode_blocks(deltas, layers).write.mode("overwrite").option("compression", "zstd").partitionBy("method").parquet(f"{folder}/encoded")
    finally:
        deltas.unpersist()
    say("manifest", 0.9)
    total = layers.agg(F.count("*").alias("num_layers"), *[F.coalesce(F.sum(c), F.lit(0)).alias(to) for c, to in (("numel", "total_params"), ("changed", "changed_params"), ("original_bytes", "original_bytes"), ("compressed_bytes", "compressed_bytes"))]).first().asDict()
    listing = [r.asDict() for r in layers.orderBy("layer").select("layer", "layer_type", "method", "numel", "nonzero", "max_abs", "l2_norm", "sparsity", "compressed_bytes").toLocalIterator()]
    made = write_manifest(spark, folder, type="model_delta", base_id=base_id, derived_id=derived_id, base_hash=model_hash(base), threshold=threshold, compression_ratio=total["original_bytes"] / max(total["compressed_bytes"], 1), layers=listing, **total)
    say("done", 1.0)
    return made


def encoded_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The encoded rows of an artifact; none if all its layers are unchanged."""
    if not exists(spark, f"{folder}/encoded"):
        raise FileNotFoundError(f"{folder}/encoded: the artifact isn't whole")
    return spark.read.schema(ENCODED).parquet(f"{folder}/encoded")


def check_base(base: DataFrame, manifest: dict, base_id: str | None = None, strict: bool = False) -> None:
    """Warn of a base of another name or content than the artifact was made from; refuse it if ``strict``."""
    import warnings

    wrong = []
    if base_id and base_id != manifest.get("base_id"):
        wrong.append(f"made from {manifest.get('base_id')}, not {base_id}")
    if manifest.get("base_hash") and manifest["base_hash"] != model_hash(base):
        wrong.append("the base has changed")
    if wrong and strict:
        raise ValueError("; ".join(wrong))
    for w in wrong:
        warnings.warn(w, stacklevel=3)


def reconstruct_model(base: DataFrame, folder: str, base_id: str | None = None, strict: bool = False, check: bool = True, half: bool = False) -> DataFrame:
    """Rebuild a model in block form. A base of another name or content is refused if ``strict``, else warned of.

    :param check: read the base's content for that; without it only names are compared.
    :param half: round what changes to half precision.
    """
    spark = base.sparkSession
    manifest = read_manifest(spark, folder)
    check_base(base, manifest if check or strict else manifest | {"base_hash": None}, base_id, strict)
    encoded = encoded_blocks(spark, folder)
    lost = [x["layer"] for x in manifest.get("layers", []) if x["method"] != "zero"]
    held = {r.layer for r in encoded.select("layer").distinct().toLocalIterator()}
    if missing := sorted(set(lost) - held):
        raise FileNotFoundError(f"no payload for {missing[:5]}")
    return apply_blocks(base, encoded, half)


def compress_adapter(adapter: str, folder: str, spark: SparkSession, base_id: str = "base", derived_id: str = "adapter", base: DataFrame | None = None) -> dict:
    """Package an adapter's files as they are; with ``base`` its hash goes into the manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(adapter)
    root = adapter.rstrip("/")
    files.select(F.regexp_replace("path", f"^.*?{root.split(':')[-1]}/?", "").alias("name"), "length", "content").write.mode("overwrite").parquet(f"{folder}/adapter")
    size = spark.read.parquet(f"{folder}/adapter").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return write_manifest(spark, folder, type="adapter", base_id=base_id, derived_id=derived_id, compressed_bytes=size, base_hash=None if base is None else model_hash(base))


#: Fixed values of adapters: the settings' file, the names that factors of a layer end in, and what their names begin with.
ADAPTER_SETTINGS = "adapter_config.json"
ADAPTER_PARTS = {".lora_A.weight": "a", ".lora_B.weight": "b"}
ADAPTER_PREFIX = "base_model.model."


def adapter_factors(spark: SparkSession, folder: str) -> DataFrame:
    """An adapter's low-rank factors by layer: (layer, m, n, k, scale, a array<float> of k by n, b array<float> of m by k).

    Factors come from the packaged ``safetensors`` files, the scale lora_alpha / r from their settings.
    """
    files = spark.read.parquet(f"{folder}/adapter")
    settings = files.where(F.col("name").endswith(ADAPTER_SETTINGS)).first()
    if settings is None:
        raise FileNotFoundError(f"{folder}/adapter holds no {ADAPTER_SETTINGS}")
    found = json.loads(bytes(settings.content))
    scale = float(found["lora_alpha"]) / float(found["r"])
    schema = pa.schema([("layer", pa.string()), ("part", pa.string()), ("rows", pa.int64()), ("columns", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches):
        from deltaforge.sources.tensors import tensors_of

        for batch in batches:
            for content in batch.column(0).to_pylist():
                for name, x in tensors_of(content):
                    for end, part in ADAPTER_PARTS.items():
                        if name.endswith(end):
                            layer = name.removeprefix(ADAPTER_PREFIX).removesuffix(end) + ".weight"
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([layer], [part], [x.shape[0]], [x.shape[1]], [x.ravel()]), schema, strict=True)], schema=schema)

    parts = files.where(F.col("name").endswith(".safetensors")).select("content").mapInArrow(run, "layer string, part string, rows long, columns long, x array<float>")
    of = lambda p, *names: parts.where(F.col("part") == p).select("layer", *names)
    a = of("a", F.col("columns").alias("n"), F.col("rows").alias("k"), F.col("x").alias("a"))
    b = of("b", F.col("rows").alias("m"), F.col("x").alias("b"))
    return a.join(b, "layer").withColumn("scale", F.lit(scale))


def merge_adapter(base: DataFrame, factors: DataFrame) -> DataFrame:
    """Base blocks with ``scale * B * A`` added to the layers that ``factors`` names; a factor of no known layer is skipped.

    Each block meets its layer's two factors and multiplies only the rows that it covers.
    """
    joined = base.join(F.broadcast(factors) if factors.count() <= FEW_LAYERS else factors, "layer", "left").select("layer", "block_id", "start", "values", "m", "n", "k", "a", "b", "scale")

    def run(batches):
        for batch in batches:
            flat, ends = _flat(batch.column("values"))
            out = flat.copy()
            starts, n, k, scale = (batch.column(c).to_pylist() for c in ("start", "n", "k", "scale"))
            for r in range(batch.num_rows):
                if n[r] is None:
                    continue
                first, size = starts[r], int(ends[r + 1] - ends[r])
                lo, hi = first // n[r], -(-(first + size) // n[r])
                b = batch.column("b")[r].values.to_numpy().reshape(-1, k[r])[lo:hi]
                a = batch.column("a")[r].values.to_numpy().reshape(k[r], n[r])
                d = (b.astype(np.float64) @ a.astype(np.float64) * scale[r]).ravel()[first - lo * n[r] :][:size]
                if len(d) != size:
                    raise ValueError(f"{batch.column('layer')[r].as_py()}: the adapter's factors are of another shape")
                out[ends[r] : ends[r + 1]] += d.astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))], names=["layer", "block_id", "start", "values"])

    return joined.mapInArrow(run, "layer string, block_id long, start long, values array<float>")


#: Layers up to which an adapter's factors are broadcast; those of a layer are a few rows of the whole matrix.
FEW_LAYERS = 64


def reconstruct_adapter(base: DataFrame, folder: str, base_id: str | None = None, strict: bool = False) -> DataFrame:
    """The base with an artifact's adapter merged into it, in block form."""
    check_base(base, read_manifest(base.sparkSession, folder), base_id, strict)
    return merge_adapter(base, adapter_factors(base.sparkSession, folder))


def compress_dataset(base: DataFrame, derived: DataFrame, folder: str, splits: list[str] | None = None, match: str = "id", base_id: str = "base", derived_id: str = "derived") -> dict:
    """Store a dataset (with ``pos``) as references into another and new rows, on a fresh set of files."""
    spark, splits = base.sparkSession, splits or []
    refs = ds.references(base, derived, splits, match).persist()
    try:
        payload = [c for c in derived.columns if c not in ("pos", *splits)]
        refs.select(*splits, "pos", "type", "base_index", "new_index").write.mode("overwrite").parquet(f"{folder}/refs")
        ds.new_rows(refs, splits).write.mode("overwrite").parquet(f"{folder}/new")
        size = ds.size_stats(base, refs, payload).first().asDict()
        by = refs.groupBy(*splits).agg(F.count("*").alias("num_samples"), F.count_if(F.col("type") == "new").alias("num_new"), F.count_if(F.col("type") == "reference").alias("num_referenced"), F.count_if(F.col("modified")).alias("num_modified"))
        listing = {"/".join(str(r[c]) for c in splits) or "all": {k: r[k] for k in ("num_samples", "num_new", "num_referenced", "num_modified")} for r in by.collect()}
    finally:
        refs.unpersist()
    return write_manifest(spark, folder, type="dataset_delta", base_id=base_id, derived_id=derived_id, splits=listing, original_bytes=size["derivative_bytes"], compressed_bytes=size["delta_bytes"], compression_ratio=size["derivative_bytes"] / max(size["delta_bytes"], 1)) | {"savings_percent": size["savings_percent"]}


def reconstruct_dataset(base: DataFrame, folder: str, splits: list[str] | None = None) -> DataFrame:
    spark = base.sparkSession
    return ds.reconstruct(base, spark.read.parquet(f"{folder}/refs"), spark.read.parquet(f"{folder}/new"), splits)

