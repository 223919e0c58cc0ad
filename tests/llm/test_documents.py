"""Operators on documents against plain versions, on messy rows and on none."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deltaforge.llm import packing
from deltaforge.llm.decontaminate import decontaminate
from deltaforge.llm.hashing import NON_SPACE, words
from deltaforge.llm.jaccard import Rarity, boundary, jaccard_components
from deltaforge.llm.lines import dedup_lines
from deltaforge.llm.packing import packed_documents
from deltaforge.llm.repeats import drop_repeats
from deltaforge.llm.work import Scratch
from tests.llm.data import SCHEMA, documents, sentence, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n):
    w = SPACE.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def classes(rows, n, percent):
    """Smallest id that can be reached, by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def row_classes(rows, n, percent):
    """(id, size, component) of every row, where each row is a document of its own."""
    own = classes([(k, t) for k, (_, t) in enumerate(rows)], n, percent)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[own[k]] = min(least.get(own[k], i), i)
    return sorted((i, len(shingles(t, n)), least[own[k]]) for k, (i, t) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard(spark, docs, n, percent):
    found = [tuple(r) for r in jaccard_components(docs, n, percent).collect()]
    rows = [(i, t) for i, t, *_ in documents()]
    assert sorted(r for r in found if r[0] is not None) == row_classes([r for r in rows if r[0] is not None], n, percent)
    assert [r[2] for r in found if r[0] is None] == [None, None]


def test_jaccard_of_very_long_texts(spark):
    """Texts of megabytes are compared whole: an edit at the end counts."""
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 100_000, 300_000)]
    half = base[:150_000] + [f"v{x}" for x in rng.integers(0, 100_000, 150_000)]
    rows = [(3, " ".join(base)), (4, " ".join([*base, "end"])), (5, " ".join(half)), (6, " ".join(base[:280_000])), (7, " ".join(half[1:]))]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert {k: v[1] for k, v in found.items()} == {3: 3, 4: 3, 5: 5, 6: 3, 7: 5}
    assert found[3][0] == len({tuple(base[k : k + 5]) for k in range(len(base) - 4)})


def test_jaccard_of_small_sets(spark):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(1, 18)))) for k in range(150)]
    rows += [(200 + k, rows[k][1] + " tail") for k in range(60)]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80)
    assert {r.doc_id: r.component_id for r in found.collect()} == classes(rows, 1, 80)


def test_jaccard_of_copies_without_their_original(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(w if j != 5 * k + 1 else f"e{k}" for j, w in enumerate(base))) for k in range(1, 19)]
    for rows_ in (rows, [*rows, (99, " ".join(base))]):
        found = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows_, "doc_id long, text string"), 4, 85).collect()}
        assert found == classes(rows_, 4, 85)
    assert set(found.values()) == {1}


def _hidden(n, percent):
    """Texts c, p and q, parts of c, where all that p and q list is also listed by c, too large to link with either."""
    for seed in range(1000):
        c = [f"s{seed}x{k}" for k in range(60)]
        rarest = []
        for words_ in (c, c[:24], c[:25]):
            ((_, _, h, _),) = words(pa.array([" ".join(words_)]), NON_SPACE)
            rarest.append(set(Rarity([], [], [], []).first(h, n, lambda size: size - -(-percent * size // 100) + 1).tolist()))
        if rarest[1] & rarest[2] <= rarest[0]:
            yield [" ".join(x) for x in (c, c[:24], c[:25])]


@pytest.mark.parametrize("ids", [(1, 2, 3), (3, 1, 2)])
def test_jaccard_where_no_head_of_a_list_is_near(spark, ids):
    for texts, _ in zip(_hidden(4, 85), range(2)):
        rows = list(zip(ids, texts))
        found = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
        assert found == classes(rows, 4, 85) and len(set(found.values())) == 2


@pytest.mark.parametrize("parts", [1, 3])
def test_jaccard_of_an_id_with_two_texts(spark, parts):
    """Rows of one id are documents each: all copies of either text keep their links."""
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(7, one), (7, two), (9, one), (10, one + " end"), (8, two), (5, two + " end"), (7, one)]
    found = [tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts), 4, 85).collect()]
    assert sorted(found) == row_classes(rows, 4, 85)
    assert {(i, c) for i, _, c in found} == {(7, 7), (7, 5), (9, 7), (10, 7), (8, 5), (5, 5)}


@pytest.mark.parametrize("many", [10_000, 0])
def test_components(spark, monkeypatch, many):
    from deltaforge.llm import graph

    monkeypatch.setattr(graph, "MANY", many)
    rng = np.random.default_rng(2)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [tuple(x) for x in rng.integers(200, 260, (40, 2)).tolist()] + [(9, 9)]
    up = {i: i for x in links for i in x if x[0] != x[1]}
    for _ in up:
        for a, b in links:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    found = graph.components(spark.createDataFrame(links, "a long, b long"), packing.Scratch(spark, "c")).collect()
    assert {r.id: r.comp for r in found} == up and len(found) == len(up)
    assert graph.components(spark.createDataFrame([], "a long, b long"), packing.Scratch(spark, "c")).collect() == []


def test_jaccard_of_nothing(empty):
    assert jaccard_components(empty).collect() == []


def test_boundary_grows_with_small_sets():
    assert boundary({}, 85) <= boundary({5: 10_000, 6: 10_000}, 85) <= 20


def pack_checks(found, rows, capacity):
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def fewest_at_least(items, room):
    """A lower bound on the bins: pieces over half of one share none, and what is left of theirs holds only so much of the rest."""
    best = 0
    for k in {0, *(x for x in items if 2 * x <= room)}:
        alone = sum(x > room - k for x in items)
        half = [x for x in items if room - k >= x and 2 * x > room]
        rest = sum(x for x in items if 2 * x <= room and x >= k)
        best = max(best, alone + len(half) + max(0, -(-(rest - (len(half) * room - sum(half))) // room)))
    return best


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in documents():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        import zlib

        for k, a in enumerate(range(0, len(ids), 256)):
            own = np.array(ids[a : a + 256], "<u4")
            want[(i, k, a, len(own), zlib.crc32(own.tobytes()))] += 1
    found = packed_documents(docs, capacity=256).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    assert pack_checks(found, None, 256) == fewest_at_least([r.length for r in found], 256)


def test_packing_nothing(empty):
    assert packed_documents(empty).collect() == []


def test_bin_completion_is_optimal_on_small_cases():
    rng = np.random.default_rng(0)

    def fewest(items, room):
        """All ways of putting items into bins."""
        best = [len(items)]

        def walk(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[k] <= room:
                    walk(k + 1, [*bins[:j], bins[j] + items[k], *bins[j + 1 :]])
            walk(k + 1, [*bins, items[k]])

        walk(0, [])
        return best[0]

    for _ in range(30):
        items = sorted(rng.integers(1, 20, 9).tolist(), reverse=True)
        plan = packing.patterns(dict(Counter(items)), 20)
        assert sum(n for _, n in plan) == fewest(items, 20)
        assert Counter(x for p, n in plan for x in p * n) == Counter(items)
    assert packing.dominated((3, 3), (6,)) and not packing.dominated((6,), (3, 3))


def triplets(n, capacity, seed=0):
    """Lengths of 3 * n pieces that fill n sequences exactly, each between a quarter and half of one."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < 3 * n:
        a, b = rng.integers(capacity // 4 + 1, capacity // 2, 2).tolist()
        if capacity // 4 < capacity - a - b < capacity // 2:
            out += [a, b, capacity - a - b]
    return Counter(out)


@pytest.mark.parametrize("times", [1, 10, 100])
def test_packing_where_best_fit_is_not_optimal(times):
    """Exact triplets: the search finds the optimum, whatever the number of pieces."""
    for seed in range(3):
        hist = {x: times * n for x, n in triplets(10, 200, seed).items()}
        assert sum(n for _, n in packing.best_fit(hist, 200)) > 10 * times
        plan = packing.patterns(hist, 200)
        assert sum(n for _, n in plan) == 10 * times
        used = Counter()
        for p, n in plan:
            used.update({x: k * n for x, k in Counter(p).items()})
        assert used == hist


def test_packing_search_improves_on_best_fit():
    """30 triplets of 2048: the search stays within 4 % of the optimum, best fit at 13 %."""
    for times in (1, 100):
        hist = {x: times * n for x, n in triplets(30, 2048).items()}
        fit, found = (sum(n for _, n in plan) for plan in (packing.best_fit(hist, 2048), packing.patterns(hist, 2048)))
        print(times, fit, found)
        assert fit >= 33 * times and found <= 31 * times


def test_lower_bound_counts_large_pieces():
    assert packing.lower_bound({11: 5}, 20) == 5 and packing.lower_bound({11: 5, 9: 7}, 20) == 6 and packing.lower_bound({5: 9}, 20) == 3 and packing.lower_bound({}, 20) == 0


def test_pack_numbers_pieces_by_itself(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(x)) for k, x in enumerate(rng.integers(1, 40, 3000))] + [(9999, 7)] * 500
    pieces = spark.createDataFrame(rows, "doc_id long, length long").repartition(5)
    found = packing.pack(pieces, packing.Scratch(spark, "p"), 64).collect()
    assert Counter((r.doc_id, r.length) for r in found) == Counter(rows)
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == -(-sum(x for _, x in rows) // 64)


def test_large_histograms_pack_near_the_bound():
    rng = np.random.default_rng(1)
    hist = dict(Counter(np.minimum(2048, rng.gamma(1.2, 500, 50_000).astype(int) + 1).tolist()))
    plan = packing.patterns(hist, 2048)
    bound = -(-sum(k * n for k, n in hist.items()) // 2048)
    assert sum(n for _, n in plan) <= 1.002 * bound + 1
    used = Counter()
    for p, n in plan:
        assert sum(p) <= 2048
        for x in p:
            used[x] += n
    assert used == hist


def long_text(n, seed=7):
    """A text of megabytes: prose, lines without a space, marks."""
    rng = np.random.default_rng(seed)
    made = [f"word{x}" if x % 50 else "it's 1.5 % — ÇA" for x in rng.integers(0, 3000, n)]
    return " ".join(made[: n // 2]) + "\n" + "x" * 300_000 + "\n" + " ".join(made[n // 2 :])


def test_packing_of_a_very_long_text(spark):
    """Cut in parts for the lookup of words, the ids are those of the whole text."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain = long_text(300_000).replace("it's 1.5 % — ÇA", "some 1.5 % ÇA").replace("x" * 300_000, "x" * 20_000)
    rows = [(1, plain), (2, long_text(5_000).replace("x" * 300_000, "y")), (3, "short")]
    found = packed_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = set()
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want |= {(i, k, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))}
    assert len(plain) > 2_000_000 and {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in found} == want
    pack_checks(found, None, 2048)


def test_decontamination_of_a_very_long_text(spark):
    text = long_text(400_000)
    words_ = ALNUM.findall(text.translate(LOWER))
    bench = [("end", " ".join(words_[-12:])), ("middle", " ".join(words_[200_000:200_030])), ("none", " ".join(words_[100:110][::-1]))]
    found = decontaminate(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"), spark.createDataFrame(bench, "item_id string, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == plain_hits([(1, text), (2, "short")], bench, 10)


def plain_lines(rows, least):
    sites, first = defaultdict(set), {}
    for i, t, _, source, *_ in rows:
        if t is None or i is None:
            continue
        for place, line in enumerate(t.split("\n")):
            if line:
                sites[line].add(source)
                first[line] = min(first.get(line, (i, place)), (i, place))
    out = []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for k, x in enumerate(lines) if not x or len(sites[x]) < least or first[x] == (i, k)]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("broadcast_lines", [200_000, 3, 0])
@pytest.mark.parametrize("least", [2, 5])
def test_lines(docs, least, broadcast_lines):
    found = dedup_lines(docs, least, broadcast_lines=broadcast_lines)
    assert found.columns == [*(c for c in docs.columns if c != "n_removed"), "n_lines", "n_removed"]
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.collect()) == plain_lines(documents(), least)


def test_lines_of_nothing(empty):
    assert dedup_lines(empty).collect() == []


def items():
    rows = documents()
    cut = lambda k, a, b: " ".join((rows[k][1] or "").split()[a:b])
    return [("10", cut(2, 0, 14)), ("9", cut(60, 5, 60)), ("a", "one"), ("b", "A b, c!"), ("c", None), ("d", "?!"), ("e", "words that nobody wrote " * 4), ("9", cut(61, 0, 12)), (None, "one")]


def plain_hits(rows, bench, size, least=1):
    windows = defaultdict(set)
    for i, t in bench:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        if i is not None and len(w) >= min(least, size) and n:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t, *_ in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, seen = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    seen |= found
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), tuple(sorted(seen))))
    return Counter(out)


@pytest.mark.parametrize(("size", "least", "chars"), [(10, 1, 4_000_000), (10, 4, 4_000_000), (3, 1, 100)])
def test_decontamination(spark, docs, monkeypatch, size, least, chars):
    monkeypatch.setattr("deltaforge.llm.decontaminate.BLOCK_CHARS", chars)
    bench = spark.createDataFrame(items(), "item_id string, text string")
    found = decontaminate(docs, bench, size, least).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == plain_hits(documents(), items(), size, least)
    assert all(r.n_hit == sum(s.end - s.start for s in r.spans) for r in found)


def test_part_of_a_window_is_enough(spark):
    text = " ".join(f"w{k}" for k in range(30))
    bench = spark.createDataFrame([("i", " ".join("other" if k == 9 else f"w{k}" for k in range(10)))], "item_id string, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [decontaminate(docs, bench, 10, percent=p).first().n_hit for p in (100, 80)] == [0, 10]


def test_decontamination_of_nothing(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate(empty, bench).collect() == []
    assert {r.n_hit for r in decontaminate(docs, bench).collect()} == {0}


def plain_repeats(rows, length):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - length + 1):
                first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if i is not None and first.get(b[k : k + length], i) < i:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("length", "piece", "hot"), [(50, 1 << 19, 5000), (24, 1 << 19, 5000), (50, 600, 5000), (50, 1 << 19, 2), (24, 1 << 19, 0)])
def test_repeats(docs, monkeypatch, length, piece, hot):
    monkeypatch.setattr("deltaforge.llm.repeats.PIECE", piece)
    monkeypatch.setattr("deltaforge.llm.repeats.HOT", hot)
    found = drop_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert Counter(tuple(r) for r in found) == plain_repeats(documents(), length)


def test_repeats_of_hot_lines(spark, monkeypatch):
    """A line in most documents, between texts of their own: its edges are keys of all of them."""
    monkeypatch.setattr("deltaforge.llm.repeats.HOT", 20)
    rng = random.Random(4)
    line = "All rights are reserved by the owners of this site, see the notice."
    rows = [(k, sentence(rng, 12) + (f" {line} " if k % 3 else " ") + sentence(rng, 12)) for k in range(150)]
    found = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert Counter(tuple(r) for r in found) == plain_repeats(rows, 50)
    assert sum(r.n_removed > 0 for r in found) == 99


def test_repeats_in_rounds(spark, docs, monkeypatch):
    """Documents taken in turns, keys that go on from batch to batch."""
    monkeypatch.setattr("deltaforge.llm.repeats.ROUND", 20_000)
    monkeypatch.setattr("deltaforge.llm.repeats.SETTLED", 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        found = drop_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    finally:
        spark.conf.set(key, before)
    assert Counter(tuple(r) for r in found) == plain_repeats(documents(), 50)


def shuffled(spark):
    """Bytes that stages have written to the shuffle so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_repeats_keep_disk_low(spark, monkeypatch):
    """What only short strings have in common is not written; windows of near copies aren't shuffled each."""
    written = {}

    def write(self, df, name, own=Scratch.write):
        out = own(self, df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr("deltaforge.llm.repeats.Scratch.write", write)
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("ab") for _ in range(2000))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_removed for r in drop_repeats(df).collect()) == 0
    assert written["halves"] < 1500  # 21,578 with anchors of 16 bytes

    rows = [(k, "".join(rng.choice("abcdefgh") for _ in range(4000))) for k in range(40)]
    for k in range(40, 200):
        t = list(rows[k % 40][1])
        for j in range(rng.randrange(150), 4000, 150):
            t[j] = "-"
        rows.append((k, "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = shuffled(spark)
    found = drop_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    size = shuffled(spark) - before
    assert Counter(tuple(r) for r in found) == plain_repeats(rows, 50)
    assert size < 8_000_000  # 10,138,935 when each window was shuffled


def test_repeats_of_nothing(empty):
    assert drop_repeats(empty).collect() == []
