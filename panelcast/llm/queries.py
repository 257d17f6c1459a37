"""The text operators as queries over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import panelcast
from panelcast.llm import (
    analogs, bpe, chat, common, lines, mix, negatives, passages, quality, secrets, simhash, sliced, spelling, warc,
)
from panelcast.operators.storage import checkpoint_dir

# The driver of these queries may run where executors have no copy of the package.
panelcast.ship_by_value()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            CHECKS[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits texts for it."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@_query("op1_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.span_text("base_spans"), 256).alias("base_sha256"), secrets.span_text("spans").alias("spans"),
    )


@_query("op2_warc_bundles", """
WITH p AS (
  SELECT page_id, STRLEN(COALESCE(html, ''))::BIGINT AS payload_bytes, SHA1(COALESCE(html, '')) AS digest,
         MAX(page_id) OVER (PARTITION BY COALESCE(html, '')) AS top
  FROM pages
), five AS (
  SELECT page_id, g, ('0x' || SUBSTR(digest, 5 * g + 1, 5))::BIGINT AS v FROM p, RANGE(8) AS r(g)
), letters AS (
  SELECT page_id, STRING_AGG(SUBSTR('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (15 - 5 * k)) & 31)::INT + 1, 1), '' ORDER BY g, k) AS payload_digest
  FROM five, RANGE(4) AS q(k) GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p JOIN letters USING (page_id)
""")
def warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/bundles-{uuid.uuid4().hex}"
    warc.write_bundles(_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_bundles(spark, folder, payloads=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@_query("op3_shared_passages")
def shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(_table(spark, sf_dir, "documents"))


@_query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    encoded = bpe.encode_text(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return bpe.decode_ids(encoded, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op5_nearest_vectors", """
WITH e AS (
  SELECT vec_id, v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE LEN(v) > 0 AND LEN(LIST_FILTER(v, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0 AND LEN(LIST_FILTER(v, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, LIST_INNER_PRODUCT(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND LEN(q.v) = LEN(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs
) WHERE place <= 20
""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(
        F.lit("embeddings").alias("entity"), F.col("vec_id").alias("pos"), F.col("embedding").alias("features")
    )
    return analogs.nearest_histories(rows, rows.where(F.col("pos") % 20 == 0), k=20).select(
        F.col("pos").alias("query_id"), "rank", F.col("near_pos").alias("vec_id"), "score"
    )


@_query("op6_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.saved(_table(spark, sf_dir, "documents").select(
        F.col("source").alias("entity"), F.col("doc_id").alias("pos"),
        mix.word_count("text").alias("size"),
    ), "sizes")
    mixed, targets = mix.mix_entities(rows)
    taken = mixed.groupBy(*mix.ELEMENT).agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    each = common.null_safe_join(mix.elements(rows), taken, mix.ELEMENT)
    return common.null_safe_join(each, targets, ["entity"], "inner").select(
        F.col("pos").alias("doc_id"), "size", F.col("entity_size").cast("long").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
    )


@_query("op7_line_dedup", """
WITH l AS (
  SELECT doc_id, UNNEST(STRING_SPLIT(COALESCE(text, ''), CHR(10))) AS line,
         UNNEST(RANGE(LEN(STRING_SPLIT(COALESCE(text, ''), CHR(10))))) AS nth FROM documents
), k AS (
  SELECT *, TRANSLATE(REGEXP_REPLACE(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, MAX(doc_id) AS keeper FROM k WHERE LENGTH(key) >= 20 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 3
)
SELECT doc_id, COUNT(*)::BIGINT AS n_lines, COUNT(*) FILTER (keeper <> doc_id)::BIGINT AS n_dropped,
       SHA256(COALESCE(STRING_AGG(line, CHR(10) ORDER BY nth) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@_query("op8_quality_rules", """
WITH d AS (SELECT doc_id, source, COALESCE(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, UNNEST(ws) AS word, UNNEST(RANGE(LEN(ws))) AS nth
  FROM (SELECT doc_id, REGEXP_EXTRACT_ALL(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)
), n AS (SELECT doc_id, COUNT(*) AS n_words, SUM(LENGTH(word)) AS word_chars FROM w GROUP BY doc_id),
windows AS (
  SELECT doc_id, nth, LEAD(word, 4) OVER o AS fifth,
         CONCAT_WS(' ', word, LEAD(word, 1) OVER o, LEAD(word, 2) OVER o, LEAD(word, 3) OVER o, LEAD(word, 4) OVER o) AS five
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY nth)
), twice AS (
  SELECT doc_id, nth, COUNT(*) OVER (PARTITION BY doc_id, five) AS times FROM windows WHERE fifth IS NOT NULL
), repeated AS (
  SELECT doc_id, COUNT(DISTINCT nth + k) AS n_repeat_words FROM twice, RANGE(5) AS r(k) WHERE times > 1 GROUP BY doc_id
), l AS (
  SELECT doc_id, source, text, UNNEST(ls) AS line, UNNEST(RANGE(LEN(ls))) AS nth
  FROM (SELECT doc_id, source, text, STRING_SPLIT(text, CHR(10)) AS ls FROM d)
), worded AS (
  SELECT *, REGEXP_EXTRACT_ALL(line, '[^\\x20\\x09-\\x0D]+') AS ws FROM l WHERE REGEXP_MATCHES(line, '[^\\x20\\x09-\\x0D]')
), dup AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
keyed AS (
  SELECT doc_id, source, text, TRANSLATE(ARRAY_TO_STRING(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key,
         LEN(ws) AS words FROM worded
), held AS (SELECT source, key, COUNT(DISTINCT text) AS docs, MIN(doc_id) AS first FROM keyed GROUP BY ALL),
common AS (SELECT * FROM held WHERE docs > 100), removed AS (
  SELECT k.doc_id, SUM(k.words) AS gone FROM keyed k JOIN common c ON k.key = c.key AND k.source IS NOT DISTINCT FROM c.source
  WHERE k.doc_id > c.first GROUP BY k.doc_id
), m AS (
  SELECT d.doc_id, COALESCE(n_words, 0)::BIGINT AS n_words, COALESCE(word_chars, 0)::BIGINT AS word_chars,
         LENGTH(REGEXP_REPLACE(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         COALESCE(n_dup_lines, 0)::BIGINT AS n_dup_lines, COALESCE(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         COALESCE(gone, 0)::BIGINT AS gone
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN removed USING (doc_id)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (gone = 0 OR (n_words - gone >= 10 AND n_words - gone >= 0.3 * n_words)) AS kept FROM b
""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(_table(spark, sf_dir, "documents"))
    return judged.select(F.col("doc").alias("doc_id"), *quality.MEASURES, "base_failed", "kept")


@_query("op9_chat_format", """
WITH t AS (
  SELECT conv_id, turn, role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, CASE role WHEN 'system' THEN CHR(10) || '<</SYS>>' || CHR(10) WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>'
           ELSE ' [/ROLE]' END AS closing,
         CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 10 + 8 WHEN 'assistant' THEN 6 + 4 ELSE 7 + LENGTH(role) + 8 + 8 END AS marks
  FROM t
), sized AS (
  SELECT *, marks + LENGTH(text) + CASE WHEN CONTAINS(text, closing) THEN
    LEN(REGEXP_EXTRACT_ALL(text, '<<SYS>>|<</SYS>>|<s>|</s>|\\[/?INST\\]|\\[OUT\\]|\\[/?ROLE\\]|\\[TEXT\\]')) ELSE 0 END AS chars
  FROM marked
)
SELECT conv_id, COUNT(*)::BIGINT AS n_turns, SHA256(STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn)) AS turns_sha256,
       COALESCE(SUM(LENGTH(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       SHA256(STRING_AGG(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       SUM(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_conversations(chat.format_turns(turns))


@_query("op10_simhash")
def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


_INTEGERS_SQL = """e AS (
  SELECT vec_id, label, LIST_TRANSFORM(CAST(embedding AS DOUBLE[]), lambda x: FLOOR(256 * x)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND LEN(LIST_FILTER(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT ISFINITE(x))) = 0
)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(
        F.lit("embeddings").alias("entity"), F.col("vec_id").alias("pos"), F.col("embedding").alias("features"), "label"
    )


@_query("op11_exact_top", f"""
WITH {_INTEGERS_SQL}, pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(LIST_INNER_PRODUCT(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND LEN(q.v) = LEN(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs
) WHERE place <= 5
""")
def exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return sliced.exact_top_histories(rows, rows.where(F.col("pos") % 50 == 0), k=5, scale=256).select(
        F.col("pos").alias("query_id"), "rank", F.col("near_pos").alias("vec_id"), "score"
    )


@_query("op12_hard_negatives", f"""
WITH {_INTEGERS_SQL}, r AS (
  SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM e WHERE label IS NOT NULL
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(LIST_INNER_PRODUCT(a.v, c.v) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id AND LEN(a.v) = LEN(c.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(ROW_NUMBER() OVER o AS INTEGER) AS rank, n.vec_id AS negative_id, positive_score,
       n.score AS negative_score
FROM p JOIN pairs n USING (anchor_id)
WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
WINDOW o AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY ROW_NUMBER() OVER o <= 10
""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("pos") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _vectors(spark, sf_dir).withColumn("label", moved)
    found = negatives.hard_negatives(rows, rows.where(F.col("pos") % 100 == 0), label="label")
    return found.select(
        F.col("pos").alias("anchor_id"), F.col("positive_pos").alias("positive_id"), "rank",
        F.col("negative_pos").alias("negative_id"), "positive_score", "negative_score",
    )


@_query("op13_spelling_variants", """
WITH RECURSIVE codes AS (
  SELECT LIST(LIST_REDUCE(LIST_PREPEND(b, RANGE(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS code
  FROM RANGE(256) AS r(b)
), runs AS (
  SELECT doc_id, TRANSLATE(UNNEST(REGEXP_EXTRACT_ALL(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (SELECT doc_id, run, COUNT(*) AS times FROM runs GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, times, LIST_TRANSFORM(RANGE(1, LEN(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT) AS b
  FROM (SELECT *, HEX(ENCODE(doc_id || ':' || run)) AS h FROM counted)
), hashed AS (
  SELECT run, times, xor(LIST_REDUCE(LIST_PREPEND(4294967295, b), lambda c, x: xor(c >> 8, code[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM bytes, codes
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % LENGTH(run)] || run[h % LENGTH(run) + 2:] ELSE run END AS word, times FROM hashed
), v AS (SELECT word, SUM(times)::BIGINT AS n FROM words WHERE LENGTH(word) >= 5 GROUP BY word HAVING SUM(times) >= 3),
cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM v, RANGE(1, LENGTH(word) + 1) AS r(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, cuts.word, cuts.n FROM v JOIN cuts ON v.word = cuts.rest
  UNION SELECT cuts.word, v.word, v.n FROM v JOIN cuts ON v.word = cuts.rest
), best AS (
  SELECT word, COUNT(*) AS n_near, MAX(other_n) AS top, FIRST(other ORDER BY other_n DESC, other) AS other FROM near GROUP BY word
), f AS (
  SELECT v.word, v.n, COALESCE(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * v.n THEN other END AS form,
         CASE WHEN top >= 2 * v.n THEN top END AS form_n
  FROM v LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT steps.word, f.word, f.form FROM steps JOIN f ON steps.next = f.word
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN steps USING (word) WHERE next IS NULL
""")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(_table(spark, sf_dir, "documents"), misprint=97)
    return spelling.group_spellings(words)
