"""Archives, chat, search, quality, language model and the pipeline: round trips, plain versions and held-out figures."""

import hashlib
import json
import math
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltaforge.llm import chat, lm, quality, topk, warc
from deltaforge.llm.hashing import ALNUM, words
from deltaforge.llm.work import Scratch
from tests.llm.data import SCHEMA, WORDS, documents, sentence, table

PAGES = "page_id long, url string, html string, payload binary"


def pages():
    big = "<html>" + "ü" * 200 + "</html>"
    rows = [(k, f"http://h/{k} ä\n", "<p>" + sentence(random.Random(k), 30) + "</p>\r\n\r\nWARC/1.1", None) for k in range(40)]
    rows += [(100 + k, None, big, None) for k in range(5)] + [(50, "u", None, None), (51, "", "", None), (52, "u", "short", None), (53, "u", "short", None), (None, "u", big, None), (None, "v", big, None)]
    return [*rows, (104, None, big, None), (60, "u", "x" * 600_000, None)]


def test_archives(spark, tmp_path):
    table_ = spark.createDataFrame(pages(), PAGES).repartition(3)
    index = warc.write_archives(table_, f"file://{tmp_path}/out")
    found = warc.read_archives(index).collect()
    assert sorted(map(str, ((r.page_id, r.digest) for r in found))) == sorted(str((i, hashlib.sha256((h or "").encode()).hexdigest())) for i, _, h, _ in pages())
    texts = {i: (h or "").encode() for i, _, h, _ in pages()}
    for r in found:
        if 100 < (r.page_id or 0):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 100, None)
        else:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == texts[r.page_id]
    one = warc.fetch(index.where("page_id = 7")).first()
    assert bytes(one.payload) == texts[7] and "\n" not in one.url
    files = list((tmp_path / "out").iterdir())
    assert len(files) == index.select("path").distinct().count()
    import zstandard

    for f in files:  # any reader of Zstandard frames can read a bundle
        with zstandard.ZstdDecompressor().stream_reader(f.open("rb"), read_across_frames=True) as s:
            assert len(list(warc.parse(s.read()))) == index.where(F.col("path").endswith(f.name)).count()


def test_resolved_records_of_repeated_ids(spark):
    """A revisit stands for the payload of its digest, also where the page it refers to has another one besides."""
    x, y, z = ("<p>" + c * 200 for c in "xyz")
    rows = [(3, "u", x, None), (3, "u", y, None), (5, "u", y, None), (6, "u", x, None), (3, "u", z, None), (9, "u", z + "!", None), (9, "u", z + "!", None), (7, "u", None, None)]
    found = warc.resolved(warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES)))).collect()
    want = [(i, len(h or ""), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if i in (5, 6) else "response", 3 if i in (5, 6) else None) for i, _, h, _ in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_small_bundles_and_frames(spark, tmp_path, monkeypatch):
    b = warc._Bundle(f"file://{tmp_path}")
    monkeypatch.setattr(warc, "FRAME_BYTES", 1000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3000)
    for k in range(50):
        b.add(k, warc.record(k, "u", os.urandom(300), None))
    b.close()
    assert len({r[1] for r in b.ready}) > 1 and len({(r[1], r[2]) for r in b.ready}) > 10


def test_archives_of_nothing(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).collect() == []


MESSAGES = "tree string, node long, parent long, role string, text string, score double, t string"


def plain_paths(rows, n):
    """By walking up from every leaf."""
    trees = {}
    for tree, node, parent, role, text, score, _ in rows:
        trees.setdefault(tree, {})[node] = (parent, role, text, score or 0.0)
    out = []
    for tree, nodes in trees.items():
        leaves = set(nodes) - {p for p, *_ in nodes.values() if p in nodes}
        found = []
        for leaf in leaves:
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][0]
            if len(path) <= len(nodes):
                found.append((-sum(nodes[x][3] for x in path), leaf, [(nodes[x][1], nodes[x][2]) for x in reversed(path)]))
        for k, (score, _, path) in enumerate(sorted(found)[:n]):
            out.append((tree, k + 1, -score, path))
    return sorted(out, key=str)


def messages():
    rng = random.Random(2)
    rows = []
    for tree in ("a", "b", None):
        for k in range(40):
            rows.append((tree, k, rng.randrange(k) if k > 2 else None, rng.choice(["user", "assistant", None, "<x>"]), rng.choice(["hi", None, "", "</turn>\n<turn:user>\n&lt;", "\\### é"]), rng.choice([0.5, 1.0, None]), "x"))
    rows += [("chain", k, k - 1 if k else None, "user", str(k), 1.0, "x") for k in range(50)]
    rows += [("lost", 1, 99, "user", "orphan", 1.0, "x"), ("loop", 1, 2, "user", "a", 1.0, "x"), ("loop", 2, 1, "user", "b", 1.0, "x"), ("loop", 3, 2, "user", "c", 1.0, "x")]
    return rows


@pytest.mark.parametrize("n", [1, 3])
def test_paths(spark, n):
    found = chat.best_paths(spark.createDataFrame(messages(), MESSAGES).repartition(3), n).collect()
    got = sorted(((r.tree, r.path, r.score, [(m.role, m.text) for m in r.turns]) for r in found), key=str)
    assert got == plain_paths(messages(), n)


def test_formatting_is_reversible(spark):
    made = chat.best_paths(spark.createDataFrame(messages(), MESSAGES), 5).select("turns", chat.format_turns(F.col("turns")).alias("f"))
    for r in made.select("turns", "f", chat.read_turns(F.col("f")).alias("back")).collect():
        assert [(m.role or "", m.text or "") for m in r.turns] == [(m.role, m.text) for m in r.back]
        assert [m.loss for m in r.back] == [m.role == "assistant" for m in r.turns]


def test_chat_plan_is_native(spark):
    plan = chat.format_conversations(spark.createDataFrame(messages(), MESSAGES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_chat_of_nothing(spark):
    assert chat.format_conversations(spark.createDataFrame([], MESSAGES)).collect() == []
    same = spark.createDataFrame([(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    assert {r.tree: len(r.turns) for r in chat.best_paths(chat.linear_messages(same)).collect()} == {1: 3, None: 1}


VECTORS = "vec_id long, embedding array<double>, label int, score int"


def plain_top(rows, k):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(1024 * x) for x in v)]
    out = []
    asks = {i: v for i, v in sorted(ok, key=lambda r: (r[0], len(r[1]), r[1]), reverse=True) if i % 10 == 0}
    for q, v in asks.items():
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("block", "bucket", "seeds"), [(4096, 1024, 1024), (3, 7, 5)])
def test_top_k(spark, monkeypatch, block, bucket, seeds):
    for name, v in (("BLOCK", block), ("BUCKET", bucket), ("SEEDS", seeds)):
        monkeypatch.setattr(topk, name, v)
    rng = np.random.default_rng(3)
    rows = [(k, (rng.standard_normal(8) * rng.gamma(0.5)).tolist(), 0, 0) for k in range(300)]
    rows += [(300 + k, rows[10][1], 0, 0) for k in range(30)]  # ties
    rows += [(400, [0.0] * 8, 0, 0), (401, None, 0, 0), (402, [1.0, None] * 4, 0, 0), (403, [float("nan")] * 8, 0, 0), (410, [float("inf")] * 8, 0, 0), (420, [1.0, 2.0], 0, 0), (421, [3.0, 1.0], 0, 0), (430, [], 0, 0), (None, [1.0] * 8, 0, 0), (440, [1e7] * 8, 0, 0), (441, [-1e7] * 8, 0, 0)]
    rows += [(450, [5e12] + [0.0] * 7, 0, 0), (451, [3e38] * 8, 0, 0), (452, [3e38] * 7 + [2.9e38], 0, 0), (460, [-3e38, 1.0] * 4, 0, 0), (461, [1e250] * 8, 0, 0), (470, [1e307, 1e300] * 4, 0, 0), (20, rows[20][1], 0, 0), (30, rows[31][1], 0, 0), (33, rows[31][1], 0, 0)]
    found = topk.exact_top_k(spark.createDataFrame(rows, VECTORS).repartition(4), F.col("vec_id") % 10 == 0, 10).collect()
    held = lambda x: max(-(1 << 63), min(x, (1 << 63) - 1))
    assert sorted(map(tuple, found)) == [(*r[:3], held(r[3])) for r in plain_top(rows, 10)]


def test_top_k_of_nothing(spark):
    assert topk.exact_top_k(spark.createDataFrame([], VECTORS), F.lit(True)).collect() == []


def rated(n=600, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 150))]
        grade = k % 3
        if grade == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scumbag"]))
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        out.append((k, " ".join(words), grade))
    return out


def test_grades_of_held_out_documents(spark):
    rows = rated(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, _, g in rows[:1000]], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.select_documents(docs, labels).collect()}
    held = rows[1000:]
    assert sum(g == 2 and i not in kept for i, _, g in held) <= 0.03 * len(held)
    assert sum(g != 2 and i in kept for i, _, g in held) <= 0.05 * len(held)
    model = quality.train(docs, quality.grades_of(labels), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    scored = quality.score_documents(docs, model).collect()
    grades = [np.mean([r.expected_grade for r in scored if rows[r.doc_id][2] == g]) for g in range(3)]
    assert grades == sorted(grades)
    again = quality.train(docs.repartition(7), quality.grades_of(labels), 3)
    assert np.array_equal(model.weights, again.weights)


def test_held_out_ratings(spark, sf):
    """Fitted on 60 % of the ratings: of the others nearly all good documents pass, and few toxic ones or of low quality."""
    sf = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) < 6)
    kept = {r.doc_id for r in quality.select_documents(docs, fitted).select("doc_id").collect()}
    rest = quality.grades_of(labels.join(fitted, "doc_id", "left_anti")).collect()
    share = [np.mean([r.doc_id in kept for r in rest if r.grade == g]) for g in range(3)]
    assert share[0] <= 0.04 and share[1] <= 0.08 and share[2] >= 0.985, share
    scored = quality.score_documents(docs.join(labels, "doc_id"), quality.train(docs, quality.grades_of(fitted), 3))
    mean = {r.g: r.m for r in scored.groupBy(F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality")).alias("g")).agg(F.avg("expected_grade").alias("m")).collect()}
    assert mean[0] < mean[1] < mean[2]


def test_documents_that_repeat_an_id_are_fitted_once(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other text")], "doc_id long, text string")
    few = quality.train(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int"), 2)
    again = quality.train(docs.where("doc_id = 2 or text = 'text 3'").repartition(3), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int"), 2)
    assert few.weights.shape == again.weights.shape


def test_quality_of_messy_rows(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(0, 1, 0), (1, None, None), (None, 1, 1), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, quality.grades_of(labels), 3)
    assert quality.score_documents(docs, model).count() == docs.count()
    none = quality.train(docs, quality.grades_of(labels.limit(0)), 3)
    assert none.bar == 0 and quality.score_documents(docs, none).where("tail_probability is null").count() == 0
    assert quality.score_documents(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_features_of_a_long_text_are_those_of_its_parts(monkeypatch):
    rng = random.Random(0)
    text = sentence(rng, 400_000) + " ! ! ! %%% END"
    (parts,) = quality.features(pa.array([text]))
    monkeypatch.setattr(quality, "LONG", 1 << 40)
    (whole,) = quality.features(pa.array([text]))
    assert len(text) > 2 << 20 and np.array_equal(parts, whole)


def test_language_model(spark):
    rng = random.Random(1)
    follow = {w: rng.sample(WORDS, 2) for w in WORDS}

    def chain(n):
        out = [rng.choice(WORDS)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    texts = [chain(80) for _ in range(400)]
    held = [chain(80) for _ in range(30)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k, t in enumerate(held):
        rows += [(1000 + k, " ".join(t)), (2000 + k, " ".join(rng.sample(t, len(t))))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (2_000_000, 5_000):  # one shard, and several that are averaged
        found = {r.doc_id: r.per_token for r in lm.pseudo_likelihood(docs, shard_words=size).collect()}
        better = sum(found[1000 + k] > found[2000 + k] for k in range(len(held)))
        assert better >= 0.9 * len(held)
        again = {r.doc_id: r.per_token for r in lm.pseudo_likelihood(docs.repartition(5), shard_words=size).collect()}
        assert max(abs(found[k] - again[k]) for k in found) < 1e-3


def test_language_model_beats_shares_on_held_out_documents(spark, sf):
    """On texts that it isn't trained on, a word's sides tell 0.4 nats more than its share of the counts."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    vocabulary = lm.Vocabulary.of(lm.token_counts(docs))
    net = lm.train(docs.where("doc_id % 20 <> 0"), vocabulary, Scratch(spark, "lm"))
    held = pa.array([r.text for r in docs.where("doc_id % 20 = 0").collect()])
    gain = []
    for _, _, h, offs in words(held, ALNUM):
        ids, leaf, (_, at) = vocabulary.stream(h, offs)
        gain.append((net.log_probabilities(vocabulary, ids, leaf) - lm.Network.start(vocabulary).log_probabilities(vocabulary, ids, leaf))[at])
    assert np.concatenate(gain).mean() > 0.4


def test_language_model_trains_on_every_document(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, sentence(rng, 30)) for k in range(5)], "doc_id long, text string")
    vocabulary = lm.Vocabulary.of(lm.token_counts(docs))
    nets = [lm.train(docs.where(F.col("doc_id") != k), vocabulary, Scratch(spark, "lm")).flat() for k in (-1, *range(5))]
    assert all(not np.array_equal(nets[0], n) for n in nets[1:])  # each document left out makes a difference


@pytest.mark.parametrize(("known", "frequent"), [(1 << 18, 8192), (300, 50), (0, 0)])
def test_words_are_counted_exactly(spark, monkeypatch, known, frequent):
    """Without training a score is that of the exact shares of all words, however few of their counts go to all tasks."""
    monkeypatch.setattr(lm, "KNOWN", known)
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rng = random.Random(8)
    texts = [" ".join(f"w{int(rng.paretovariate(0.5)) % 100_000}" for _ in range(60)) for _ in range(200)] + ["", None]
    n = Counter(w for t in texts for w in (t or "").split())
    assert len(n) > 800 and max(n.values()) > 1000
    docs = spark.createDataFrame([(k % 190, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in lm.pseudo_likelihood(docs, rate=0.0).collect())
    want = sorted((k % 190, len((t or "").split()), sum(math.log(n[w] / n.total()) for w in (t or "").split())) for k, t in enumerate(texts))
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert max(abs(f[2] - w[2]) for f, w in zip(found, want, strict=True)) < 0.01


def test_probabilities_of_all_words_add_up_to_one():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 1000, 700)
    v = lm.Vocabulary(*[np.zeros(0)] * 4, 700, *lm.tree(size), 1, 1)
    work = lm.Training(lm.Network.start(v), v)
    ids, leaf = rng.integers(0, 40, 100_000).astype(np.uint16), rng.integers(0, 700, 100_000).astype(np.int16)
    leaf[2:][ids[1:-1] == 3] = 5  # what a side tells
    work.learn(ids, leaf)
    for side, most in ((3, True), (4, False)):
        ids, leaf = np.full(5 * 700, 9, np.uint16), np.full(5 * 700, -1, np.int16)
        ids[1::5], leaf[2::5] = side, np.arange(700)
        p = np.exp(work.net.log_probabilities(v, ids, leaf)[2::5].astype(float))
        assert abs(p.sum() - 1) < 1e-4 and (p[5] > 0.5) == most


def test_training_misses_no_position():
    """What is left over of a run is trained on as well."""
    v = lm.Vocabulary(*[np.zeros(0)] * 4, 8, *lm.tree(np.arange(1, 9)), 1, 1)
    for n in (1, 3, lm.RUN - 1, lm.RUN, lm.RUN + 1, 3 * lm.RUN + 5):
        seen = []
        work = lm.Training(lm.Network.start(v), v)
        work.step = lambda ids, leaf, seen=seen: seen.extend(leaf[leaf >= 0])
        work.learn(np.zeros(n + 2, np.uint16), np.concatenate(([-1, -1], np.arange(n) % 8)).astype(np.int16))
        assert sorted(seen) == sorted(np.arange(n) % 8)


def test_language_model_of_messy_rows(spark):
    docs = table(spark)
    found = lm.pseudo_likelihood(docs).collect()
    assert len(found) == docs.count()
    assert {(r.log_likelihood, r.per_token) for r in found if r.n_tokens == 0} == {(0.0, None)}
    assert lm.pseudo_likelihood(spark.createDataFrame([], SCHEMA)).collect() == []


def test_language_model_of_a_very_long_text(spark):
    """A text of megabytes counts word for word: at rate 0 its score is the sum of its words' shares."""
    rng = random.Random(3)
    text = sentence(rng, 700_000)
    rows = [(1, text), (2, "ba ko ti")]
    n = Counter(w for _, t in rows for w in t.split())
    found = {r.doc_id: (r.n_tokens, r.log_likelihood) for r in lm.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string"), rate=0.0).collect()}
    want = sum(math.log(n[w] / n.total()) for w in text.split())
    assert len(text) > 2 << 20 and found[1][0] == 700_000 and abs(found[1][1] - want) < 1e-4 * abs(want)


def test_scratch_folders_are_deleted(spark):
    from deltaforge.llm import work

    before = work.roots()
    scratch = Scratch(spark, "kept")
    scratch.write(spark.range(3), "t")
    assert os.path.isdir(scratch.root.removeprefix("file://")) and work.roots() - before == {scratch.root}
    work.clean({scratch.root})
    assert not os.path.exists(scratch.root.removeprefix("file://")) and work.roots() == before


def messy_corpus(spark, tmp_path):
    """Tables for the pipeline with nulls, empty texts, repeated ids and rows; a folder."""
    rows = [(i, t, lang, source, n) for i, t, lang, source, n, *_ in documents()] + [(500, None, None, None, None), (500, "a line", "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, documents()[2][1]), (None, "x"), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_stages_on_messy_rows(spark, tmp_path):
    """Nulls in all columns, empty texts, repeated ids and rows: every stage keeps what it has no reason to drop."""
    import corpus_pipeline as p

    d = messy_corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    all_ = Counter((r.doc_id, r.text) for r in docs.collect())
    found = {name: stage(spark, docs, d) for name, stage in p.STAGES}
    assert p.quality(spark, docs, d).columns == list(p.COLUMNS)
    near, lines_, bench = (Counter((r.doc_id, r.text) for r in found[n].collect()) for n in ("n-gram jaccard join", "line dedup", "benchmark decontamination"))
    assert not near - all_ and {k: v for k, v in all_.items() if k[0] is None} == {k: v for k, v in near.items() if k[0] is None}
    assert all(near[k] == v for k, v in all_.items() if not (k[1] or "").split())
    assert sum(lines_.values()) == sum(all_.values()) and Counter(i for i, _ in lines_.elements()) == Counter(i for i, _ in all_.elements())
    hit = {i for (i, t), n in all_.items() if t and documents()[2][1] in t}
    assert set(all_) - set(bench) == {(i, t) for i, t in all_ if i in hit and i is not None}
    pieces = found["best-fit packing"].collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(i for i, _ in all_.elements())


@pytest.mark.parametrize("extra", ["", ", n_shingles long, component_id long, text_hash long, h long, items string, part long, sequence_id long"])
def test_pipeline_stages_on_no_rows_and_clashing_columns(spark, tmp_path, extra):
    import corpus_pipeline as p

    d = messy_corpus(spark, tmp_path)
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, "some text here", "en", "s", 3), (2, "other text", "en", "t", 3)]):
        docs = spark.createDataFrame([(*r, *([None] * extra.count(" long")), *(["x"] if extra else [])) for r in rows], fields + extra.replace("items string, ", "").replace(", h long", ", h long") + (", items string" if extra else ""))
        for name, stage in p.STAGES:
            out = stage(spark, docs, d)
            assert out.count() == len(rows) or name == "quality classifier", name
            assert name == "best-fit packing" or out.columns == list(p.COLUMNS)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from deltaforge.llm.jaccard import jaccard_components
    from tests.llm.test_documents import pack_checks, plain_hits

    rng = random.Random(9)
    rows, labels = [], []
    for i, t, g in rated(300):
        rows.append((i, t, "en", f"src{i % 12}", len(t)))
        labels.append((i, int(g != 1), int(g == 0)))
    clean = [sentence(rng, 60) for _ in range(80)]
    item = sentence(rng, 25)
    rows += [(1000 + k, t + "\nOne line for all sites.", "en", f"src{k % 12}", len(t) + 24) for k, t in enumerate(clean)]
    rows += [(2000 + k, clean[k] + " more", "en", "src1", 0) for k in range(10)] + [(3000, clean[20] + " tail " + item, "en", "src1", 0), (3001, "", "en", "src1", 0)]
    rows += [(4000 + k, " ".join(["scumbag", "idiot", sentence(rng, 40)]), "en", "src2", 0) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "benchmark decontamination", "best-fit packing"]
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
            kept.append({r.doc_id: r.text for r in docs.collect()})
    ids = [set(k) for k in kept]
    assert not ids[0] & set(range(4000, 4010)) and len(set(range(1000, 1080)) - ids[0]) <= 2
    assert ids[1] == ids[0] and sum("One line" in t for t in kept[1].values()) <= 1
    before = spark.createDataFrame(list(kept[1].items()), "doc_id long, text string")
    assert ids[2] == {r.doc_id for r in jaccard_components(before, 5, 80).collect() if r.component_id == r.doc_id} and not ids[2] & set(range(2000, 2010))
    hits = {i for (i, _, n, _), _ in plain_hits(list(kept[2].items()), [("1", item), ("2", "a b")], 10).items() if n}
    assert hits == {3000} and ids[3] == ids[2] - hits
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == ids[3]
    pack_checks(pieces, None, 2048)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_nothing_else_imports_the_subpackage(tmp_path):
    """Without the subpackage's folder and the pipeline the entry point still serves all other queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, check=True).stdout
    names = json.loads(said.strip().splitlines()[-1])
    assert "layer_manifest" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_sql_of_the_queries(spark, sf):
    import duckdb

    from deltaforge.llm import queries as q
    from tests.test_entry import TABLES, same

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in q.oracle_sql():
        same(spark, c, sf, name)


def test_messy_documents_are_messy():
    assert {None} <= {r[1] for r in documents()} and len({r[0] for r in documents()}) < len(documents())
