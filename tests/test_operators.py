"""Codecs on small literals, and properties of what is decoded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaforge import model
from deltaforge.operators import choose, codec, diff, svd


def tensor(spark, values, layer="l", name="delta"):
    return spark.createDataFrame([(layer, i, float(v)) for i, v in enumerate(values)], f"layer string, idx long, {name} float")


def by_idx(df, column):
    return [r[column] for r in df.orderBy("idx").collect()]


def test_nonzero_literal(spark):
    found = codec.nonzero_encode(tensor(spark, [0, 1.5, 0, 2.3, 0, -1.2]))
    assert [r.idx for r in found.orderBy("idx").collect()] == [1, 3, 5]


def test_nonzero_periodic(spark):
    rows = spark.range(100_000).select(F.lit("l").alias("layer"), F.col("id").alias("idx"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("float").alias("delta"))
    assert codec.nonzero_encode(rows).count() == 9_999


def test_nan_is_neither_kept_nor_small(spark):
    rows = spark.createDataFrame([("l", 0, float("nan")), ("l", 1, 1.0), ("l", 2, 0.0)], "layer string, idx long, delta float")
    assert by_idx(codec.nonzero_encode(rows), "idx") == [1]
    s = diff.layer_stats(rows).first()
    assert s.sparsity == pytest.approx(1 / 3) and s.nonzero == 1
    assert by_idx(codec.int8_encode(rows, codec.int8_scales(rows)), "q") == [0, 127, 0]


def test_scatter_literal(spark):
    encoded = spark.createDataFrame([("l", 0, 1.0), ("l", 5, 2.0), ("l", 10, 3.0)], "layer string, idx long, value float")
    places = spark.range(15).select(F.lit("l").alias("layer"), F.col("id").alias("idx"))
    assert by_idx(codec.scatter_decode(encoded, places), "delta") == [1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 3, 0, 0, 0, 0]


def test_int8_apply_literal(spark):
    base = tensor(spark, [1, 2, 3, 4, 5], name="value")
    codes = spark.createDataFrame([("l", i, q, 0.1) for i, q in enumerate([10, -10, 5, -5, 0])], "layer string, idx long, q byte, scale float")
    assert np.allclose(by_idx(codec.apply_int8(base, codes), "value"), [2, 1, 3.5, 3.5, 5])


def test_int8_rounds_half_away(spark):
    d = tensor(spark, [127, 2.5, -2.5, 0.5])
    assert by_idx(codec.int8_encode(d, codec.int8_scales(d)), "q") == [127, 3, -3, 1]


@pytest.mark.parametrize("seed", range(3))
def test_codecs_keep_their_bounds(spark, seed):
    x = np.random.default_rng(seed).standard_normal(500).astype(np.float32)
    x[np.abs(x) < 1] = 0
    d = tensor(spark, x)
    assert np.array_equal(np.array(by_idx(codec.scatter_decode(codec.nonzero_encode(d), d), "delta"), np.float32), x)
    scales = codec.int8_scales(d)
    back = np.array(by_idx(codec.int8_decode(codec.int8_encode(d, scales)), "delta"))
    assert np.abs(back - x).max() <= scales.first().scale / 2 + 1e-6
    exact, codes = codec.hybrid_encode(d, 1.5)
    assert np.abs(np.array(by_idx(codec.hybrid_decode(exact, codes, d), "delta")) - x).max() <= 1.5 / 127 / 2 + 1e-6


def test_all_zero_hybrid_has_no_codes(spark):
    exact, codes = codec.hybrid_encode(tensor(spark, [0, 0, 3]), 1.0)
    assert exact.count() == 1 and codes.count() == 0


def test_missing_layers(spark):
    a, b = tensor(spark, [1, 2], "a", "value"), tensor(spark, [1, 3], "b", "value")
    both = a.unionByName(b)
    assert diff.difference(both, a).select("layer").distinct().count() == 1
    with pytest.raises(KeyError):
        diff.difference(both, a, "error")
    short = tensor(spark, [1], "a", "value")
    assert diff.difference(a, short).count() == 0


@pytest.mark.parametrize(("name", "kind"), [("x.q_proj.w", "attention"), ("FC1", "feedforward"), ("wte", "embedding"), ("ln_f", "normalization"), ("lm_head", "output"), ("gate", "unknown")])
def test_layer_types(spark, name, kind):
    assert spark.range(1).select(choose.layer_type(F.lit(name)).alias("k")).first().k == kind


def test_blocks_and_long_form_agree(spark):
    x = tensor(spark, np.arange(1000), name="value")
    blocks = model.to_blocks(x, 64)
    assert blocks.count() == 16
    assert [r.value for r in model.to_long(blocks).orderBy("idx").collect()] == list(range(1000))


def test_svd_error_falls_with_rank():
    d = np.random.default_rng(0).standard_normal((40, 30))
    errors = [np.abs(d - u.astype(float) @ v.astype(float)).mean() for u, v in (svd.factors(d, k) for k in (1, 4, 16, 30))]
    assert errors == sorted(errors, reverse=True) and errors[-1] < 5e-3


def test_svd_of_a_sketched_matrix():
    rng = np.random.default_rng(1)
    d = rng.standard_normal((2500, 4)) @ rng.standard_normal((4, 2000))
    u, v = svd.factors(d, 4)
    assert np.abs(d - u.astype(float) @ v.astype(float)).mean() < 0.02


def test_sizes(spark):
    row = spark.range(1).select(codec.packed_bytes(F.lit("int8"), F.lit(100), F.lit(7)).alias("a"), codec.packed_bytes(F.lit(choose.SCATTER), F.lit(100), F.lit(7)).alias("b"), codec.packed_bytes(F.lit("int8"), F.lit(100), F.lit(7), profile="streaming").alias("c"), choose.size_ratio(F.lit(10), F.lit(0)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (104, 42, 100, float("inf"))


def test_plans_join_without_products(spark, sf):
    from deltaforge.queries import queries

    for name in ("delta_elements", "int8_quantize", "dataset_refs"):
        plan = queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
