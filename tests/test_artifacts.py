"""Artifacts, sources, datasets, families, caches, streams and the command line, end to end on small data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaforge import cache, cli, fixtures, functions as fn, model
from deltaforge.operators import choose, dataset as ds, family
from deltaforge.plans import artifact, lossy
from deltaforge.sources import tensors
from tests.conftest import rows


@pytest.fixture(scope="module")
def models(spark, sf):
    return [model.to_blocks(model.dense(t), 512).cache() for t in (fixtures.base_model(spark, sf), fixtures.fine_tune(spark, sf))]


@pytest.mark.parametrize(("mode", "bound"), [("full", 1e-6), ("smart", 0.01), ("basic", 0.01)])
def test_model_round_trip(spark, models, tmp_path, mode, bound):
    base, other = models
    made = artifact.compress_model(base, other, str(tmp_path), mode=mode)
    assert made["num_layers"] == 10 and artifact.read_manifest(spark, str(tmp_path))["total_params"] == made["total_params"]
    back = model.to_long(artifact.reconstruct_model(base, str(tmp_path), strict=True)).join(model.to_long(other).withColumnRenamed("value", "v"), ["layer", "idx"])
    assert back.count() == made["total_params"]
    assert back.agg(F.max(F.abs(F.col("value") - F.col("v")))).first()[0] <= bound


def test_a_changed_base_is_refused(spark, models, tmp_path):
    base, other = models
    artifact.compress_model(base, other, str(tmp_path))
    with pytest.raises(ValueError):
        artifact.reconstruct_model(other, str(tmp_path), strict=True)
    with pytest.warns(UserWarning):
        artifact.reconstruct_model(base, str(tmp_path), base_id="another")


def test_lost_payload_is_an_error(spark, models, tmp_path):
    import shutil

    base, other = models
    artifact.compress_model(base, other, str(tmp_path))
    shutil.rmtree(tmp_path / "encoded" / f"method={choose.SCATTER}")
    with pytest.raises(FileNotFoundError):
        artifact.reconstruct_model(base, str(tmp_path))


def test_svd_artifact(spark, sf, tmp_path):
    base, other = (model.dense(t) for t in (fixtures.base_model(spark, sf), fixtures.fine_tune(spark, sf)))
    shapes = base.groupBy("layer").agg((F.count("*") / 64).cast("long").alias("rows")).where("layer <> 'model.rotary.scale'")
    made = lossy.compress_model_svd(base, other, shapes, str(tmp_path), rank=64)
    back = lossy.reconstruct_model_svd(base, str(tmp_path)).join(other.withColumnRenamed("value", "v"), ["layer", "idx"])
    assert made["rank"] == 64 and back.agg(F.max(F.abs(F.col("value") - F.col("v")))).first()[0] < 0.01


def test_safetensors(spark, tmp_path):
    rng = np.random.default_rng(0)
    shards = [{"a.w": rng.standard_normal((30, 10)).astype(np.float32)}, {"b.w": rng.standard_normal(500).astype(np.float16), "c": np.arange(5, dtype=np.int32)}]
    for k, part in enumerate(shards):
        tensors.write_safetensors(part, str(tmp_path / f"{k}.safetensors"))
    tensors.register(spark)
    found = model.to_long(spark.read.format("safetensors").option("block", 64).load(str(tmp_path)))
    for part in shards:
        for name, x in part.items():
            got = [r.value for r in found.where(F.col("layer") == name).orderBy("idx").collect()]
            assert np.allclose(got, x.ravel().astype(np.float32))
    assert sorted(n for n, *_ in tensors.layer_names(str(tmp_path))) == ["a.w", "b.w", "c"]
    with pytest.raises(KeyError):
        tensors.load_layer(spark, str(tmp_path), "none")


def test_block_store(spark, models, tmp_path):
    store = tensors.BlockStore(spark, str(tmp_path))
    store.save(models[0])
    store.save_metadata({"x": 1})
    assert store.load("lm_head.weight").count() > 0 and store.load_metadata() == {"x": 1} and store.total_mb() > 0
    with pytest.raises(KeyError):
        store.load("none")


def test_dataset_round_trip(spark, sf, tmp_path):
    base, derived = (ds.number(t, ["id"]) for t in (fixtures.base_dataset(spark, sf), fixtures.derived_dataset(spark, sf)))
    for match, same in (("id", False), ("content", True)):
        made = artifact.compress_dataset(base, derived, str(tmp_path / match), match=match)
        back = artifact.reconstruct_dataset(base, str(tmp_path / match))
        assert (rows(back) == rows(derived.select("pos", "id", "text"))) is same
        assert made["savings_percent"] > 0


def test_dataset_without_ids_or_split(spark):
    base = spark.createDataFrame([("a", 0, 1, "x")], "split string, pos long, id long, t string")
    derived = spark.createDataFrame([("a", 0, 1, "x"), ("b", 0, 1, "x")], "split string, pos long, id long, t string")
    found = {r.split: r.type for r in ds.references(base, derived, ["split"]).collect()}
    assert found == {"a": "reference", "b": "new"}
    plain = ds.references(base.drop("id"), derived.drop("id"), ["split"])
    assert {r.type for r in plain.collect()} == {"new"}


def test_numbering_in_ranges(spark):
    table = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 3).alias("s"))
    a, b = ds.number(table, ["k"], ["s"]), ds.number(table, ["k"], ["s"], one_task=0)
    assert rows(a.select("k", "s", "pos")) == rows(b.select("k", "s", "pos"))


def test_family(spark):
    edges = spark.createDataFrame([("m1", "base", 0)], "model_id string, parent_id string, seq long")
    edges = family.add_model(family.add_model(edges, "m2"), "m3")
    assert rows(family.depths(edges)) == [(0, "m1"), (1, "m2"), (2, "m3")]
    assert family.chains(edges, ["m3"]).first().chain == ["base", "m1", "m2", "m3"]
    assert family.savings(edges).first().savings_percent == pytest.approx(46.6667, abs=1e-3)
    with pytest.raises(ValueError):
        family.add_model(edges, "m3")


def test_nearest_parent(spark):
    own = spark.createDataFrame([("l", 0, 1.0), ("l", 1, 1.0)], "layer string, idx long, value float")
    others = spark.createDataFrame([("a", "l", 0, 5.0), ("a", "l", 1, 1.0), ("b", "l", 0, 1.5), ("b", "l", 1, 1.0)], "model_id string, layer string, idx long, value float")
    assert family.nearest_parent(others, own).first().parent == "b"


def test_functions(spark):
    fn.register(spark)
    row = spark.sql("SELECT layer_type('x.mlp') AS t, round_half(array(CAST(1.0001 AS FLOAT), NULL)) AS h, zstd_decompress(zstd_compress(CAST('abcabc' AS BINARY))) AS z").first()
    assert row.t == "feedforward" and row.h[0] == 1.0 and bytes(row.z) == b"abcabc"
    back = spark.sql("SELECT int8_dequantize(q.codes, q.scale) AS d FROM (SELECT int8_quantize(array(CAST(127 AS FLOAT), CAST(-2.5 AS FLOAT))) AS q)").first()
    assert back.d == [127.0, -3.0]


def test_delta_cache(spark, models, tmp_path):
    base, other = models
    base.write.parquet(str(tmp_path / "base.parquet"))
    artifact.compress_model(base, other, str(tmp_path / "delta"))
    c = cache.DeltaCache(spark, str(tmp_path / "cache"))
    where = (str(tmp_path / "base.parquet"), str(tmp_path / "delta"))
    assert c.reconstructed_path(*where) is None
    path = c.get_or_reconstruct(*where)
    assert c.get_or_reconstruct(*where) == path and c.job_status(c.key(*where)) == "completed"
    again = cache.DeltaCache(spark, str(tmp_path / "cache"))
    assert again.is_reconstructed(*where) and again.stats()["hits"] >= 1
    assert cache.load(spark, where[1], where[0], cache=again).count() == base.count()
    with pytest.raises(Exception):
        c.get_or_reconstruct(where[0], str(tmp_path / "none"))


def test_model_cache(spark, models, tmp_path):
    for k in "ab":
        models[0].write.parquet(str(tmp_path / f"{k}.parquet"))
    c = cache.BaseModelCache(spark, max_gb=1e-9)
    c.get(str(tmp_path / "a.parquet"))
    c.get(str(tmp_path / "a.parquet"))
    c.get(str(tmp_path / "b.parquet"))
    assert c.stats()["models"] == [str(tmp_path / "b.parquet")] and (c.hits, c.misses) == (1, 2)
    c.clear()


def test_block_stream(spark, models, tmp_path):
    from deltaforge.streaming.layers import apply_block_stream, progress

    base, other = models
    artifact.compress_model(base, other, str(tmp_path / "delta"), mode="full")
    artifact.encoded_blocks(spark, str(tmp_path / "delta")).repartition(3).write.parquet(str(tmp_path / "in"))
    q = apply_block_stream(base, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), 1)
    q.awaitTermination()
    got = model.to_long(spark.read.parquet(str(tmp_path / "out"))).join(model.to_long(other).withColumnRenamed("value", "v"), ["layer", "idx"])
    assert got.count() > 0 and got.agg(F.max(F.abs(F.col("value") - F.col("v")))).first()[0] < 1e-6
    assert progress(q)["batches"] == 3


def test_command_line(spark, models, sf, tmp_path, capsys):
    for name, m in zip(("base", "ft"), models, strict=True):
        m.write.parquet(str(tmp_path / f"{name}.parquet"))
    p = {k: str(tmp_path / k) for k in ("base.parquet", "ft.parquet", "delta", "out", "none")}
    assert cli.main(["compress", p["base.parquet"], p["ft.parquet"], p["delta"]]) == 0
    assert cli.main(["reconstruct", p["base.parquet"], p["delta"], p["out"]]) == 0
    assert cli.main(["info", p["delta"]]) == 0 and "model_delta" in capsys.readouterr().out
    assert cli.main(["info", p["none"]]) == 1
    fixtures.base_dataset(spark, sf).write.parquet(str(tmp_path / "b.parquet"))
    fixtures.derived_dataset(spark, sf).write.parquet(str(tmp_path / "d.parquet"))
    b, d = str(tmp_path / "b.parquet"), str(tmp_path / "d.parquet")
    assert cli.main(["dataset-compress", b, d, p["delta"] + "2"]) == 0
    assert cli.main(["dataset-reconstruct", b, p["delta"] + "2", p["out"] + "2"]) == 0
    capsys.readouterr()
    assert cli.main(["dataset-estimate", b, d]) == 0 and "savings_percent" in json.loads(capsys.readouterr().out)
    assert cli.main(["help"]) == 0


def test_adapter(spark, tmp_path):
    (tmp_path / "ad").mkdir()
    (tmp_path / "ad" / "a.bin").write_bytes(b"xyz")
    made = artifact.compress_adapter(str(tmp_path / "ad"), str(tmp_path / "out"), spark)
    assert made["compressed_bytes"] == 3 and spark.read.parquet(str(tmp_path / "out" / "adapter")).first().name == "a.bin"


def test_int8_quality_of_spread_layers(spark, sf):
    from deltaforge.plans.validate import int8_quality

    found = int8_quality(fixtures.base_model(spark, sf), fixtures.fine_tune(spark, sf), 3, 100).collect()
    assert len(found) == 3 and all(r.ratio > 1.9 and r.max_error < 0.02 for r in found)


def test_parallel_speedup(spark):
    from deltaforge.measure import parallel_speedup

    assert parallel_speedup(spark, 1000, 2).speedup > 0


def test_layers_of_unlike_size_are_left_out_whole(spark, tmp_path):
    """16 and 12 elements in blocks of 8: neither half a layer in the artifact nor a mix in what is rebuilt."""
    of = lambda n, x: [("a", k, float(x)) for k in range(n)] + [("b", k, float(x)) for k in range(9)]
    base, other = (model.to_blocks(spark.createDataFrame(of(n, x), "layer string, idx long, value float"), 8) for n, x in ((16, 1), (12, 2)))
    made = artifact.compress_model(base, other, str(tmp_path / "d"))
    assert [(x["layer"], x["numel"]) for x in made["layers"]] == [("b", 9)]
    back = {(r.layer, r.idx): r.value for r in model.to_long(artifact.reconstruct_model(base, str(tmp_path / "d"), strict=True)).collect()}
    assert back == {("a", k): 1.0 for k in range(16)} | {("b", k): pytest.approx(2.0, abs=0.01) for k in range(9)}
    unlike = [spark.createDataFrame([("a", s), ("b", [9])], "layer string, shape array<bigint>") for s in ([4, 4], [2, 8])]
    made = artifact.compress_model(base, base, str(tmp_path / "e"), shapes=tuple(unlike))
    assert [x["layer"] for x in made["layers"]] == ["b"]
    with pytest.raises(Exception, match="blocks of unlike size"):
        artifact.compress_model(base, model.to_blocks(model.to_long(base), 16), str(tmp_path / "f"))


def test_a_changed_base_is_warned_of(spark, models, tmp_path):
    base, other = models
    artifact.compress_model(base, other, str(tmp_path))
    with pytest.warns(UserWarning, match="changed"):
        artifact.reconstruct_model(other, str(tmp_path))


def test_a_changed_base_is_rebuilt_again(spark, models, tmp_path):
    base, other = models
    where = (str(tmp_path / "base.parquet"), str(tmp_path / "delta"))
    base.write.parquet(where[0])
    artifact.compress_model(base, other, where[1])
    c = cache.DeltaCache(spark, str(tmp_path / "cache"))
    first = c.get_or_reconstruct(*where)
    other.write.mode("overwrite").parquet(where[0])
    with pytest.warns(UserWarning, match="changed"):
        again = artifact.reconstruct_model(spark.read.parquet(where[0]), where[1])
    second = c.get_or_reconstruct(*where)
    assert first != second
    total = lambda df: model.to_long(df).agg(F.sum("value")).first()[0]
    assert total(spark.read.parquet(second)) == pytest.approx(total(again)) != pytest.approx(total(spark.read.parquet(first)))


def test_what_was_used_last_stays():
    entries = [("a", 3.0, 10.0), ("b", 3.0, 5.0), ("c", 3.0, 7.0), ("d", 3.0, 7.0)]
    assert cache.outlived(entries, 12) == [] and cache.outlived(entries, 6) == ["b", "d"] and cache.outlived(entries, 0) == ["b", "d", "c", "a"]


def test_a_hit_counts_as_use(spark, models, tmp_path):
    base, other = models
    base.write.parquet(str(tmp_path / "base.parquet"))
    for name, mode in (("x", "smart"), ("y", "full")):
        artifact.compress_model(base, other, str(tmp_path / name), mode=mode)
    c = cache.get_global_cache(spark, str(tmp_path / "cache"))
    assert cache.get_global_cache(spark) is c
    b, x, y = (str(tmp_path / n) for n in ("base.parquet", "x", "y"))
    c.get_or_reconstruct(b, x)
    c.get_or_reconstruct(b, y)
    c.get_or_reconstruct(b, x)
    used = {k: e["used"] for k, e in c.index["entries"].items()}
    assert used[c.key(b, x)] > used[c.key(b, y)]


@pytest.fixture
def adapter(tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((4, 50)).astype(np.float32), rng.standard_normal((30, 4)).astype(np.float32)
    folder = tmp_path / "ad"
    folder.mkdir()
    tensors.write_safetensors({"base_model.model.x.q_proj.lora_A.weight": a, "base_model.model.x.q_proj.lora_B.weight": b}, str(folder / "adapter_model.safetensors"))
    (folder / "adapter_config.json").write_text(json.dumps({"r": 4, "lora_alpha": 8}))
    return str(folder), 2 * b.astype(np.float64) @ a


@pytest.mark.parametrize("block", [64, 1500])
def test_adapter_merge(spark, adapter, tmp_path, block):
    folder, delta = adapter
    w = np.arange(1500, dtype=np.float32).reshape(30, 50) / 100
    tensors.write_safetensors({"x.q_proj.weight": w, "x.other": np.ones(7, np.float32)}, str(tmp_path / "base.safetensors"))
    tensors.register(spark)
    base = spark.read.format("safetensors").option("block", block).load(str(tmp_path / "base.safetensors"))
    artifact.compress_adapter(folder, str(tmp_path / "out"), spark, base=base)
    for merged in (artifact.reconstruct_adapter(base, str(tmp_path / "out"), strict=block != 64 and True), cache.load(spark, str(tmp_path / "out"), str(tmp_path / "base.safetensors"))):
        got = {(r.layer, r.idx): r.value for r in model.to_long(merged).collect()}
        assert np.allclose([got["x.q_proj.weight", k] for k in range(1500)], (w + delta).ravel(), atol=1e-4)
        assert [got["x.other", k] for k in range(7)] == [1.0] * 7


def test_load_serves_every_type(spark, sf, models, tmp_path):
    base, other = (model.dense(t) for t in (fixtures.base_model(spark, sf), fixtures.fine_tune(spark, sf)))
    shapes = base.groupBy("layer").agg(F.array((F.count("*") / 64).cast("long"), F.lit(64).cast("long")).alias("shape"))
    where = str(tmp_path / "base.parquet")
    tensors.save_tensors(models[0], where, shapes)
    assert tensors.shapes(spark, where).count() == 10 and tensors.load_tensors(spark, where).count() == models[0].count()
    lossy.compress_model_svd(base, other, shapes.select("layer", F.col("shape")[0].alias("rows")), str(tmp_path / "svd"), 64, where)
    artifact.compress_model(models[0], models[1], str(tmp_path / "delta"), where)
    for name in ("svd", "delta"):
        both = model.to_long(cache.load(spark, str(tmp_path / name))).join(other.withColumnRenamed("value", "v"), ["layer", "idx"])
        assert both.agg(F.max(F.abs(F.col("value") - F.col("v"))), F.count("*")).first()[0] < 0.02
    data, derived = (ds.number(t, ["id"]) for t in (fixtures.base_dataset(spark, sf), fixtures.derived_dataset(spark, sf)))
    data.write.parquet(str(tmp_path / "data"))
    artifact.compress_dataset(data, derived, str(tmp_path / "ds"), match="content", base_id=str(tmp_path / "data"))
    assert rows(cache.load(spark, str(tmp_path / "ds"))) == rows(derived.select("pos", "id", "text"))


def test_lossy_command_line_factors_parquet(spark, sf, models, tmp_path):
    shapes = fixtures.base_model(spark, sf).groupBy("layer").agg(F.array((F.count("*") / 64).cast("long"), F.lit(64).cast("long")).alias("shape"))
    for name, m in zip(("base", "ft"), models, strict=True):
        tensors.save_tensors(m, str(tmp_path / f"{name}.parquet"), shapes)
    p = [str(tmp_path / k) for k in ("base.parquet", "ft.parquet", "delta", "out")]
    assert cli.main(["compress-lossy", *p[:3], "--rank", "8"]) == 0
    assert spark.read.parquet(f"{p[2]}/factors").count() == 10
    assert cli.main(["reconstruct-lossy", p[0], p[2], p[3]]) == 0 and spark.read.parquet(p[3]).count() > 0
    models[0].write.parquet(str(tmp_path / "bare.parquet"))
    assert cli.main(["compress-lossy", str(tmp_path / "bare.parquet"), p[1], p[2] + "2"]) == 1


def test_half_precision(spark):
    fn.register(spark)
    row = spark.sql("SELECT int8_apply_half(array(1F, 2F), X'0AF6', 0.1F) AS a, scatter_apply_half(array(1F, 2048F, 3F), array(1, 1, 9, 2), array(0.4F, 1.0F, 5F, 0.0001F)) AS b, tensor_hash('x', array(1F)) AS h").first()
    assert row.a == [2.0, 1.0] and row.b == [1.0, 2048.0, 3.0] and len(row.h) == 64
    got = spark.sql("SELECT * FROM reconstruct(TABLE(SELECT 'l' AS layer, 4L AS start, array(1F, 2F) AS values, X'0AF6' AS codes, 0.1F AS scale UNION ALL SELECT 'm', 0L, array(7F), NULL, NULL))")
    assert [(r.layer, r.idx, round(r.value, 5)) for r in got.orderBy("layer", "idx").collect()] == [("l", 4, 2.0), ("l", 5, 1.0), ("m", 0, 7.0)]


def test_slices(spark):
    table = spark.range(10).select(F.col("id").alias("pos"), F.when(F.col("id") < 100, "train").alias("split"))
    got = lambda spec: [r.pos for r in ds.part(table, spec, "split").orderBy("pos").collect()]
    assert got("train") == list(range(10)) and got("train[:3]") == [0, 1, 2] and got("train[-2:]") == [8, 9] and got("train[20%:50%]") == [2, 3, 4] and got("test[:5]") == []
    with pytest.raises(ValueError):
        ds.part(table, "train[1")


def test_references_count_new_rows_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(ds, "CHUNK", 7)
    base = spark.range(100).select(F.col("id").alias("pos"), (2 * F.col("id")).alias("id"))
    derived = spark.range(100).select(F.col("id").alias("pos"), F.col("id").alias("id"), F.when(F.col("id") % 2 == 0, "a").alias("split"))
    found = {r.id: r.new_index for r in ds.references(base, derived).collect()}
    assert found == {k: (None if k % 2 == 0 else k // 2) for k in range(100)}
    by = ds.references(base.withColumn("split", F.lit("a")), derived, ["split"])
    assert {r.id: r.new_index for r in by.collect() if r.split is None} == {k: k // 2 for k in range(1, 100, 2)}
    plan = ds.references(base, derived)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # the counts, a row a chunk


def test_no_layer_is_sorted_for_its_quantiles(spark):
    from deltaforge.operators import diff

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal(997).astype(np.float32), np.zeros(50, np.float32), np.full(31, 0.5, np.float32)])
    d = spark.createDataFrame([("l", k, float(v)) for k, v in enumerate(x)] + [("one", 0, 2.0), ("none", 0, 0.0), ("none", 1, 0.0)], "layer string, idx long, delta float")
    found = {r.layer: r for r in diff.distribution(d).collect()}
    a = np.abs(x.astype(np.float64))
    for name, p in (("q25", 0.25), ("q75", 0.75), ("q95", 0.95), ("q99", 0.99)):
        assert found["l"][name] == pytest.approx(np.quantile(a, p), abs=1e-12)
    assert found["l"].median == np.sort(a)[int(np.ceil(0.5 * len(a))) - 1] and found["one"].q99 == 2.0 and found["none"].q25 == 0.0
    assert "percentile" not in diff.distribution(d)._jdf.queryExecution().toString()


def test_low_rank_product_in_blocks(spark, monkeypatch):
    from deltaforge.operators import svd

    monkeypatch.setattr(svd, "ROWS", 3)
    rng = np.random.default_rng(0)
    u, v = rng.standard_normal((10, 4)).astype(np.float32), rng.standard_normal((4, 7)).astype(np.float32)
    enc = spark.createDataFrame([("l", 10, 7, 4, u.ravel().tolist(), v.ravel().tolist())], "layer string, m long, n long, k long, u array<float>, v array<float>")
    got = [r.delta for r in svd.product(enc).orderBy("idx").collect()]
    assert np.allclose(got, (u @ v).ravel(), atol=1e-5)
