"""Functions for SQL that have no built-in form: half precision and byte compression, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType, StructField, StructType

#: Levels of the byte codec: fast, usual, small.
LEVELS = {"fast": 1, "default": 3, "max": 19}


@F.pandas_udf(ArrayType(FloatType()))
def round_half(values: pd.Series) -> pd.Series:
    """Each value as it is after a trip through half precision."""
    return values.map(lambda v: None if v is None else np.asarray(v, np.float32).astype(np.float16).astype(np.float32))


def zstd_compress(level: int = 3):
    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level).compress
        return data.map(lambda b: None if b is None else pack(bytes(b)))

    return run


@F.pandas_udf(BinaryType())
def zstd_decompress(data: pd.Series) -> pd.Series:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    return data.map(lambda b: None if b is None else unpack.decompressobj().decompress(bytes(b)))


INT8 = StructType([StructField("codes", BinaryType()), StructField("scale", FloatType())])


@F.pandas_udf(INT8)
def int8_quantize(values: pd.Series) -> pd.DataFrame:
    """Codes and scale of each array, as the relational form has them."""
    codes, scales = [], []
    for v in values:
        x = np.nan_to_num(np.asarray(v, np.float32))
        top = np.float32(np.abs(x).max(initial=0))
        scale = np.float32(1) if top < np.float32(1e-10) else np.float32(top / np.float32(127))
        held = np.clip((x / scale).astype(np.float32), -127, 127)
        codes.append((np.sign(held) * np.floor(np.abs(held) + np.float32(0.5))).astype(np.int8).tobytes())
        scales.append(scale)
    return pd.DataFrame({"codes": codes, "scale": scales})


@F.pandas_udf(ArrayType(FloatType()))
def int8_dequantize(codes: pd.Series, scale: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else np.frombuffer(bytes(c), np.int8).astype(np.float32) * np.float32(s) for c, s in zip(codes, scale, strict=True)])


@F.pandas_udf(ArrayType(FloatType()))
def int8_apply_half(base: pd.Series, codes: pd.Series, scale: pd.Series) -> pd.Series:
    """Base plus codes times scale, added in single precision and rounded to half; null where base or codes are."""
    out = [None if b is None or c is None else (_halved(b) + np.frombuffer(bytes(c), np.int8).astype(np.float32) * np.float32(s)).astype(np.float16).astype(np.float32) for b, c, s in zip(base, codes, scale, strict=True)]
    return pd.Series(out)


@F.pandas_udf(ArrayType(FloatType()))
def scatter_apply_half(base: pd.Series, places: pd.Series, values: pd.Series) -> pd.Series:
    """Base with values added one after another in their places, each sum rounded to half; places beyond the base are ignored."""
    out = []
    for b, at, x in zip(base, places, values, strict=True):
        if b is None:
            out.append(None)
            continue
        y = _halved(b)
        at, x = np.asarray([] if at is None else at, np.int64), np.asarray([] if x is None else x, np.float32)
        ok = (at >= 0) & (at < len(y))
        at, x = at[ok], x[ok]
        while len(at):  # the first of each place, then those that are left
            _, first = np.unique(at, return_index=True)
            y[at[first]] = (y[at[first]] + x[first]).astype(np.float16)
            at, x = np.delete(at, first), np.delete(x, first)
        out.append(y)
    return pd.Series(out)


def _halved(values) -> np.ndarray:
    return np.asarray(values, np.float32).astype(np.float16).astype(np.float32)


@F.pandas_udf(StringType())
def tensor_hash(name: pd.Series, values: pd.Series) -> pd.Series:
    """SHA-256 of a block's little-endian bytes under its name."""
    import hashlib

    return pd.Series([hashlib.sha256(n.encode() + np.asarray(v, "<f4").tobytes()).hexdigest() for n, v in zip(name, values, strict=True)])


@F.udtf(returnType="layer string, idx bigint, value float")
class Reconstruct:
    """``reconstruct(TABLE(...))``: the elements of rebuilt blocks, from rows (layer, start, values, codes, scale) of a base with its 8-bit difference.

    A row whose codes are null is given as it is.
    """

    def eval(self, row):
        x = np.asarray(row["values"], np.float32)
        if row["codes"] is not None:
            x = x + np.frombuffer(bytes(row["codes"]), np.int8).astype(np.float32) * np.float32(row["scale"])
        for k, v in enumerate(x.tolist()):
            yield row["layer"], row["start"] + k, v


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL, and the built-in ``layer_type`` rule under its own name."""
    from deltaforge.operators.choose import NAME_PARTS

    named = {"round_half": round_half, "zstd_compress": zstd_compress(), "zstd_decompress": zstd_decompress, "int8_quantize": int8_quantize, "int8_dequantize": int8_dequantize, "int8_apply_half": int8_apply_half, "scatter_apply_half": scatter_apply_half, "tensor_hash": tensor_hash}
    for name, f in named.items():
        spark.udf.register(name, f)
    spark.udtf.register("reconstruct", Reconstruct)
    cases = " ".join(f"WHEN {' OR '.join(f"contains(lower(name), '{p}')" for p in parts)} THEN '{kind}'" for kind, parts in NAME_PARTS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION layer_type(name STRING) RETURNS STRING RETURN CASE {cases} ELSE 'unknown' END")
