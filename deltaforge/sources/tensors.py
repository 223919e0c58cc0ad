"""A Spark data source for the public ``safetensors`` format, and a keyed store of blocks.

A file is an 8-byte little-endian header length, a JSON header (name to dtype, shape and byte range) and the bytes. Only
headers are read to plan: a partition is a range of one tensor's bytes, so a layer of any size spreads over tasks, all
shards of a folder are read, and a filter on layers skips their bytes.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from deltaforge.model import BLOCK

SCHEMA = "layer string, block_id long, start long, values array<float>"
#: Fixed values of the format: numpy types by name. bfloat16 is widened by its bits.
DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def shards(path: str) -> list[str]:
    """The files of a path: itself, or all of its folder."""
    from pyarrow import fs

    where, name = _filesystem(path)
    if where.get_file_info(name).type == fs.FileType.Directory:
        return sorted(f.path for f in where.get_file_info(fs.FileSelector(name)) if f.path.endswith(".safetensors"))
    return [name]


def read_header(where, name: str) -> tuple[dict, int]:
    with where.open_input_file(name) as f:
        size = struct.unpack("<Q", f.read_at(8, 0))[0]
        return json.loads(f.read_at(size, 8)), 8 + size


class _Range(InputPartition):
    def __init__(self, file: str, layer: str, dtype: str, offset: int, first: int, last: int):
        super().__init__(0)
        self.file, self.layer, self.dtype, self.offset, self.first, self.last = file, layer, dtype, offset, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, block: int, blocks_a_task: int):
        self.path, self.block, self.blocks_a_task, self.layers = path, block, blocks_a_task, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("layer",):
                self.layers = {f.value}
            elif isinstance(f, In) and f.attribute == ("layer",):
                self.layers = set(f.value)
            yield f  # Spark filters too: this only skips bytes

    def partitions(self):
        where, _ = _filesystem(self.path)
        out, step = [], self.block * self.blocks_a_task
        for file in shards(self.path):
            header, data = read_header(where, file)
            for layer, t in header.items():
                if layer == "__metadata__" or (self.layers is not None and layer not in self.layers):
                    continue
                width = np.dtype(DTYPES[t["dtype"]]).itemsize
                a, b = t["data_offsets"]
                n = (b - a) // width
                out += [_Range(file, layer, t["dtype"], data + a, k, min(n, k + step)) for k in range(0, n, step)]
        return out

    def read(self, partition):
        where, _ = _filesystem(self.path)
        kind = np.dtype(DTYPES[partition.dtype])
        with where.open_input_file(partition.file) as f:
            for k in range(partition.first, partition.last, self.block):
                n = min(self.block, partition.last - k)
                x = np.frombuffer(f.read_at(n * kind.itemsize, partition.offset + k * kind.itemsize), kind)
                x = (x.astype(np.uint32) << 16).view(np.float32) if partition.dtype == "BF16" else x.astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([partition.layer]), pa.array([k // self.block]), pa.array([k]), pa.array([x], pa.list_(pa.float32()))], names=["layer", "block_id", "start", "values"])


class SafetensorsSource(DataSource):
    """``spark.read.format("safetensors").load(path)``: the block form of a file's or folder's tensors."""

    @classmethod
    def name(cls):
        return "safetensors"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("block", BLOCK)), int(self.options.get("blocks_a_task", 64)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SafetensorsSource)


def layer_names(path: str) -> list[tuple[str, str, list[int]]]:
    """(name, dtype, shape) of every tensor, from the headers alone."""
    where, _ = _filesystem(path)
    return [(n, t["dtype"], t["shape"]) for f in shards(path) for n, t in read_header(where, f)[0].items() if n != "__metadata__"]


def load_layer(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name not in {n for n, *_ in layer_names(path)}:
        raise KeyError(name)
    return spark.read.format("safetensors").load(path).where(F.col("layer") == name)


def tensors_of(content: bytes):
    """(name, float array) of every tensor of a small file at hand."""
    size = struct.unpack("<Q", content[:8])[0]
    for name, t in json.loads(content[8 : 8 + size]).items():
        if name != "__metadata__":
            a, b = t["data_offsets"]
            x = np.frombuffer(content[8 + size + a : 8 + size + b], DTYPES[t["dtype"]])
            x = (x.astype(np.uint32) << 16).view(np.float32) if t["dtype"] == "BF16" else x.astype(np.float32)
            yield name, x.reshape(t["shape"])


def shapes(spark: SparkSession, path: str) -> DataFrame | None:
    """(layer, shape array<bigint>) of a model: from ``safetensors`` headers, or as ``save_tensors`` has kept them; None if not known."""
    from deltaforge.plans.artifact import exists

    if path.endswith(".safetensors") or (not path.endswith(".parquet") and shards(path)):
        return spark.createDataFrame([(n, s) for n, _, s in layer_names(path)], "layer string, shape array<bigint>")
    return spark.read.parquet(f"{path}/_shapes") if exists(spark, f"{path}/_shapes") else None


def save_tensors(blocks: DataFrame, path: str, shapes: DataFrame | None = None) -> None:
    """Blocks as Parquet, with the layers' shapes beside them, in a folder that readers of the blocks pass over."""
    blocks.write.mode("overwrite").parquet(path)
    if shapes is not None:
        shapes.select("layer", F.col("shape").cast("array<bigint>").alias("shape")).write.mode("overwrite").parquet(f"{path}/_shapes")


def write_safetensors(tensors: dict[str, np.ndarray], path: str) -> None:
    """Write arrays that are at hand, such as test inputs, as one file."""
    header, at, parts = {}, 0, []
    names = {np.dtype(v): k for k, v in DTYPES.items() if k != "BF16"}
    for name, x in tensors.items():
        b = np.ascontiguousarray(x).tobytes()
        header[name] = {"dtype": names[x.dtype], "shape": list(x.shape), "data_offsets": [at, at + len(b)]}
        at += len(b)
        parts.append(b)
    head = json.dumps(header).encode()
    where, name = _filesystem(path)
    with where.open_output_stream(name, compression=None) as f:
        f.write(struct.pack("<Q", len(head)) + head + b"".join(parts))


def load_tensors(spark: SparkSession, path: str) -> DataFrame:
    """Block form of a path: ``safetensors`` files, or Parquet in block or long form."""
    if path.endswith(".safetensors") or (not path.endswith(".parquet") and shards(path)):
        register(spark)
        return spark.read.format("safetensors").load(path)
    found = spark.read.parquet(path)
    if "values" in found.columns:
        return found
    from deltaforge.model import to_blocks

    return to_blocks(found)


class BlockStore:
    """Differences by layer in Parquet; a read of one layer prunes to its files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, blocks: DataFrame) -> None:
        blocks.write.mode("append").option("compression", "zstd").partitionBy("layer").parquet(f"{self.folder}/blocks")

    def load(self, layer: str) -> DataFrame:
        found = self.spark.read.parquet(f"{self.folder}/blocks").where(F.col("layer") == layer)
        if found.isEmpty():
            raise KeyError(layer)
        return found

    def save_metadata(self, metadata: dict) -> None:
        from deltaforge.plans.artifact import write_text

        write_text(self.spark, f"{self.folder}/metadata.json", json.dumps(metadata))

    def load_metadata(self) -> dict:
        from deltaforge.plans.artifact import read_text

        return json.loads(read_text(self.spark, f"{self.folder}/metadata.json"))

    def total_mb(self) -> float:
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder).select("length")
        return (found.agg(F.sum("length")).first()[0] or 0) / 2**20
