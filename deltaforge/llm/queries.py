"""The query of each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word shingle sets are linked at a Jaccard similarity of 0.85."""
    from deltaforge.llm.jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


#: Texts with ASCII letters in lower case.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.n + y.n - k)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised, cut and packed into sequences of at most 2048 tokens."""
    from deltaforge.llm.packing import packed_documents

    return packed_documents(_table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on at least 10 sites stay in their first document only."""
    from deltaforge.llm.lines import dedup_lines

    found = dedup_lines(_table(spark, sf_dir, "documents"), min_sites=10)
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, source, u.line AS line, u.place AS place
  FROM (SELECT doc_id, source, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents), LATERAL (SELECT z[1] AS line, z[2] AS place) AS u
), common AS (
  SELECT line, min(doc_id * 1000000 + place) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.doc_id, l.place, l.line, c.line IS NOT NULL AND l.doc_id * 1000000 + l.place <> c.first AS gone
  FROM lines l LEFT JOIN common c ON l.line = c.line
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS BIGINT) AS kept_chars,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to seekable bundles and read back from them; each revisit is resolved to the response it names."""
    from deltaforge.llm.warc import read_archives, resolved, write_archives

    return resolved(read_archives(write_archives(_table(spark, sf_dir, "pages"), least=100)))


OP4_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND d.n >= 100
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects out of all documents, with their expected grade (0 toxic, 1 of low quality, 2 good)."""
    from deltaforge.llm.quality import select_documents

    found = select_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items."""
    from deltaforge.llm.decontaminate import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM bw), gs AS (SELECT DISTINCT m, g FROM bw), dx AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw CROSS JOIN lens)
), hits AS (
  SELECT doc_id, dx.m, i, dx.g FROM dx JOIN gs ON dx.m = gs.m AND dx.g = gs.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits JOIN bw ON hits.m = bw.m AND hits.g = bw.g) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without what 50-byte strings repeat from documents of smaller ids."""
    from deltaforge.llm.repeats import drop_repeats

    found = drop_repeats(_table(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits, in stretches of 1024 bytes that overlap.
OP7_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents
), c AS (
  SELECT doc_id, substr(x, 2048 * k + 1, 2146) AS x, 1024 * k AS base FROM (SELECT doc_id, x, unnest(range(n // 1024 + 1)) AS k FROM h)
), w AS (
  SELECT doc_id, base + i AS i, md5(substr(x, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, x, base, unnest(range(least(1024, strlen(x) // 2 - 49))) AS i FROM c)
), f AS (
  SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)
), r AS (
  SELECT doc_id, i, coalesce(i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, true) AS new FROM w JOIN f USING (g) WHERE first < doc_id
), j AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM j UNION ALL SELECT h.doc_id, coalesce(max(j.b), 0), h.n FROM h LEFT JOIN j ON h.doc_id = j.doc_id GROUP BY h.doc_id, h.n
), t AS (
  SELECT kept.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS x FROM kept JOIN h ON kept.doc_id = h.doc_id GROUP BY kept.doc_id
), k AS (
  SELECT doc_id, count(*) AS spans, sum(b - a) AS gone FROM j GROUP BY doc_id
)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(t.x)) AS kept_sha256
FROM h JOIN t ON h.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = h.doc_id
"""


#: The contract's own conversation: two texts that hold control strings of common templates.
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and number -7, formatted and read back."""
    from deltaforge.llm.chat import format_conversations, linear_messages, read_turns

    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    made = format_conversations(linear_messages(rows.unionByName(extra)))
    back = made.select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"))
    trained = F.array_join(F.transform(F.filter("turns", lambda m: m["loss"]), lambda m: m["text"]), "")
    every = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'
), e AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS n,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS m FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + m + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every row whose vec_id is divisible by 100."""
    from deltaforge.llm.topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of all documents."""
    from deltaforge.llm.lm import pseudo_likelihood

    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_ngram_jaccard, op2_best_fit_packing, op3_line_dedup, op4_warc, op5_quality_classifier, op6_decontamination, op7_suffix_dedup, op8_chat_formatting, op9_exact_top_k, op10_lm_scoring)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_warc": OP4_SQL, "op6_decontamination": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op8_chat_formatting": OP8_SQL, "op9_exact_top_k": OP9_SQL}
