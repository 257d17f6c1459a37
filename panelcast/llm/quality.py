"""Quality rules with cross-document line frequency.

Each document is measured by itself. Then hashes of its normalised lines are counted over the documents of
its host: lines that too many of them hold are removed, and documents that this depletes are rejected.

The forecasting project has no texts, so the operators are general: any table with a document, a host and a
text column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import free_names, limit_batches, null_safe_join, saved, small_batches, text_bytes

# Fixed values of the single-document rules.
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUED = bytes(range(0x80, 0xC0))


def _repeated_words(ids: np.ndarray) -> int:
    """Words inside windows that occur at least twice."""
    windows = len(ids) - WINDOW + 1
    if windows < 2:
        return 0
    with np.errstate(over="ignore"):
        mixed = np.zeros(windows, np.uint64)
        for i in range(WINDOW):
            mixed = (mixed ^ ids[i : i + windows]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed)
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(windows, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def _line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words).lower()) - 2**63


def measure_text(text: bytes) -> tuple[list[int], dict[int, int]]:
    """The measures of one text, and the words under each of its normalised lines' hashes."""
    words: list[bytes] = []
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    again = 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        words += own
        again += line in seen
        seen.add(line)
        key = _line_hash(own)
        lines[key] = lines.get(key, 0) + len(own)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.uint64, len(words))
    chars = sum(map(len, words)) - (len(text) - len(text.translate(None, _CONTINUED)))
    return [len(words), chars, len(text.translate(None, _NOT_SYMBOLS)), again, _repeated_words(ids)], lines


def measure_documents(df: DataFrame, doc: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """(doc, host, ``text_hash``, the measures, ``lines``: hash and words of each distinct line)."""
    limit_batches(df.sparkSession)
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("host", T.StringType()), T.StructField("text_hash", T.LongType()),
        *[T.StructField(m, T.LongType()) for m in MEASURES],
        T.StructField("lines", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.IntegerType())),
    ])

    def run(batches):
        for batch in small_batches(batches, 1024):
            measures, hashes, words, ends = [], [], [], [0]
            for body in text_bytes(batch.column(3)):
                values, lines = measure_text(body)
                measures.append(values)
                hashes += lines.keys()
                words += lines.values()
                ends.append(len(hashes))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    *[pa.array(c, pa.int64()) for c in zip(*measures, strict=True)],
                    pa.ListArray.from_arrays(offsets, pa.array(hashes, pa.int64())),
                    pa.ListArray.from_arrays(offsets, pa.array(words, pa.int32())),
                ],
                names=[f.name for f in schema.fields],
            )

    body = F.col(f"`{text}`")
    return df.select(
        F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{host}`").cast("string").alias("host"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("text_hash"), body.alias("text"),
    ).mapInArrow(run, schema)


def judge_documents(
    df: DataFrame, doc: str = "doc_id", host: str = "source", text: str = "text",
    max_docs: int = 100, left_share: float = 0.3, min_words: int = MIN_WORDS,
) -> DataFrame:
    """One row per row of ``df``: (doc, host, text_hash, the measures, ``base_failed``,
    ``removed_words``, ``removed_lines``: hashes of the lines it loses, null for none, ``kept``).

    General: the forecasting project has no texts. A line (words joined by single spaces, A-Z lower-cased) is above its host's limit if more than
    ``max_docs`` of the host's documents hold it, however large the host is. Byte-identical texts count as
    one document, so copies alone do not make a line boilerplate. Lines above the limit are removed from all
    documents of the host but the smallest that holds them. A document is rejected if it fails the
    single-document rules, or if removal leaves fewer than ``min_words`` words or less than ``left_share``
    of its words.

    Null hosts are one host; a null document id is below all others; null and empty texts have no words and
    fail; repeated rows are judged alike; other columns are ignored; an empty table stays empty.
    Counts cover all documents; a common line is counted and matched in parts (partial aggregation,
    skew join), never gathered.
    """
    measured = saved(measure_documents(df, doc, host, text), "measures")
    no_doc = F.lit(-(2**63))
    lines = measured.select(
        F.coalesce("doc", no_doc).alias("doc"), "host", "text_hash", F.explode(F.arrays_zip("lines", "words")).alias("_l")
    ).select("doc", "host", "text_hash", F.col("_l.lines").alias("line"), F.col("_l.words").alias("words"))
    holders = (
        lines.groupBy("host", "line", "text_hash").agg(F.min("doc").alias("first"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"))
        .where(F.col("docs") > max_docs)
    )
    removed = (
        null_safe_join(lines, holders.select("host", "line", "first"), ["host", "line"], "inner")
        .where("doc > first")
        .groupBy("doc", "host", "text_hash", "line").agg(F.max("words").alias("words"))
        .groupBy("doc", "host", "text_hash").agg(
            F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines")
        )
    )
    rows = measured.select(F.coalesce("doc", no_doc).alias("_doc"), "doc", "host", "text_hash", *MEASURES)
    judged = null_safe_join(
        rows, removed.withColumnRenamed("doc", "_doc"), ["_doc", "host", "text_hash"]
    ).withColumns({
        "removed_words": F.coalesce("removed_words", F.lit(0)),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    left = F.col("n_words") - F.col("removed_words")
    stays = (F.col("removed_words") == 0) | ((left >= min_words) & (left >= F.lit(left_share) * F.col("n_words")))
    return judged.drop("_doc").withColumn("kept", ~F.col("base_failed") & stays)


def without_lines(text: str, lines: set[int]) -> str:
    """``text`` without the lines whose normalised form has one of these hashes."""
    return b"\n".join(
        line for line in text.encode().split(b"\n") if not (own := line.split()) or _line_hash(own) not in lines
    ).decode()


def keep_good_documents(df: DataFrame, doc: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows of ``df`` that `judge_documents` keeps, their text without the lines above the limit.

    Lines that stay are unchanged, joined by newlines; all other columns pass through.
    """
    judged = judge_documents(df, doc, host, text, **limits)
    changed = judged.where(~F.col("kept") | F.col("removed_lines").isNotNull()).groupBy("doc", "host", "text_hash").agg(
        F.bool_and("kept").alias("_kept"), F.first("removed_lines").alias("_gone")
    )
    marks = ["_judged_doc", "_judged_host", "_judged_hash"]
    keyed = free_names(df, [*marks, "_kept", "_gone"], [doc, host, text]).withColumns({
        marks[0]: F.col(f"`{doc}`").cast("long"), marks[1]: F.col(f"`{host}`").cast("string"),
        marks[2]: F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
    })
    met = null_safe_join(keyed, changed.withColumnsRenamed(dict(zip(("doc", "host", "text_hash"), marks))), marks)
    good = met.where(F.coalesce("_kept", F.lit(True))).drop(*marks, "_kept")
    place = good.columns.index(text)

    def clean(batches):
        for batch in small_batches(batches, 1024):
            gone = batch.column(batch.num_columns - 1)
            columns = batch.columns[:-1]
            if gone.null_count < len(gone):
                columns[place] = pa.array([
                    without_lines(t, set(lines)) if lines else t for t, lines in zip(columns[place].to_pylist(), gone.to_pylist(), strict=True)
                ], columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    ordered = good.select(*[F.col(f"`{c}`") for c in good.columns if c != "_gone"], "_gone")
    return ordered.mapInArrow(clean, T.StructType([f for f in ordered.schema.fields if f.name != "_gone"]))
