"""Line deduplication through sharded minimal perfect hashes.

Hashes of all distinct lines are spread over shards. A shard's index is a minimal perfect hash with a short
fingerprint and a document count per line, and the document that keeps the line where it is repeated.
Documents are dealt into buckets; a bucket asks each shard once per distinct line, so a line that
a third of all documents hold costs one question per bucket, and lines are never joined to each other. What a bucket
asks about is what the shard is built from, so both happen in the shard's task.

The forecasting project has no texts made of lines, so the operator is general.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import mph
from panelcast.llm.common import SPACES, arrow_rows, free_names, limit_batches, pieces, saved, small_batches, text_bytes

BUCKET_BYTES = 4_000_000
SHARD_BYTES = 64_000_000
NO_DOC = -(2**63)

_STRIP = SPACES.encode()
LINES_TYPE = "bucket int, shard int, high binary, low binary, docs binary, largest binary"
INDEX_TYPE = (
    "shard int, lines long, levels array<long>, bits binary, fingerprints binary, counts binary, keepers binary"
)
ANSWERS_TYPE = "bucket int, high binary, low binary, keeper binary"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """Per line: its hash, or None where it is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(_STRIP).lower()
        # Continuation bytes begin no code point; the decoding is only needed where bytes alone do not tell.
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode(errors="replace")) < min_chars)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in columns sorted alike."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def bucket_lines(bucketed: DataFrame, shards: int, doc: str, text: str, min_chars: int) -> DataFrame:
    """Per (bucket, shard): its distinct lines, each with the number of documents and the largest one."""

    limit_batches(bucketed.sparkSession)
    def run(batches):
        digests, docs, buckets = [], [], []
        for batch in small_batches(batches):
            for bucket, of, body in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True
            ):
                found = set(line_keys(body, min_chars)) - {None}
                digests.extend(found)
                docs.append(np.full(len(found), NO_DOC if of is None else of, np.int64))
                buckets.append(np.full(len(found), bucket, np.int32))
        if not digests:
            return
        high, low = _halves(digests)
        docs, buckets = np.concatenate(docs), np.concatenate(buckets)
        shard = (high % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((docs, low, high, shard, buckets))
        high, low, docs, shard, buckets = (c[order] for c in (high, low, docs, shard, buckets))
        once = _starts(high, low, docs, shard, buckets)
        high, low, docs, shard, buckets = (c[once] for c in (high, low, docs, shard, buckets))
        first = _starts(high, low, shard, buckets)
        ends = np.append(first[1:], len(high))
        count, largest = (ends - first).astype("<u4"), docs[ends - 1]
        high, low, shard, buckets = (c[first] for c in (high, low, shard, buckets))
        runs = _starts(shard, buckets)
        for a, b in zip(runs, np.append(runs[1:], len(shard)), strict=True):
            row = (int(buckets[a]), int(shard[a]), *(c[a:b].tobytes() for c in (high, low, count, largest)))
            yield arrow_rows([row], LINES_TYPE)

    return bucketed.select("_bucket", F.col(f"`{doc}`").cast("long"), F.col(f"`{text}`")).mapInArrow(run, LINES_TYPE)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _counts_kind(min_docs: int) -> np.dtype:
    """Counts saturate; they only need to tell whether a line is in ``min_docs`` documents."""
    return np.dtype(np.uint16 if min_docs <= 65_535 else np.uint32)


def _shard_arrays(table: pa.Table, min_docs: int) -> tuple:
    """A row of the index: the perfect hash over the distinct lines of a shard and the arrays it points into."""
    high, low = _joined(table["high"], np.uint64), _joined(table["low"], np.uint64)
    docs, largest = _joined(table["docs"], "<u4"), _joined(table["largest"], np.int64)
    order = np.lexsort((low, high))
    high, low, docs, largest = (c[order] for c in (high, low, docs, largest))
    first = _starts(high, low)
    count, keeper = np.add.reduceat(docs.astype(np.int64), first), np.maximum.reduceat(largest, first)
    high, low = high[first], low[first]
    levels, bits = mph.build(high, low)
    number = mph.Lookup(levels, bits).number(high, low)
    kind = _counts_kind(min_docs)
    fingerprints, counts, keepers = np.zeros(len(high), np.uint32), np.zeros(len(high), kind), np.zeros(len(high), np.int64)
    fingerprints[number] = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    counts[number] = np.minimum(count, np.iinfo(kind).max)
    keepers[number] = keeper
    return (
        table["shard"][0].as_py(), len(high), levels, bits, fingerprints.tobytes(), counts.tobytes(),
        keepers[counts >= min_docs].tobytes(),
    )


def line_index(lines: DataFrame, min_docs: int) -> DataFrame:
    """One row per shard: the perfect hash over all its distinct lines, a fingerprint and a document count per line, and
    the keeping document of every line whose count reaches ``min_docs``, in the order of the counts."""

    def build(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([arrow_rows([_shard_arrays(table, min_docs)], INDEX_TYPE)])

    return lines.groupBy("shard").applyInArrow(build, INDEX_TYPE)


def answer_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Per bucket and shard: the bucket's repeated lines and the document that keeps each of them.

    A shard's task holds both its arrays and the lines that buckets ask about, which are those it was built from, so
    line hashes are shuffled once. A line is repeated if its fingerprint is at its number and the count there says so.
    """

    def probe(table: pa.Table) -> pa.Table:
        own = dict(zip((f.split()[0] for f in INDEX_TYPE.split(", ")), _shard_arrays(table, min_docs), strict=True))
        lookup = mph.Lookup(own["levels"], own["bits"])
        prints, keepers = np.frombuffer(own["fingerprints"], np.uint32), np.frombuffer(own["keepers"], np.int64)
        often = np.frombuffer(own["counts"], _counts_kind(min_docs)) >= min_docs
        rank = np.cumsum(often) - 1
        out = []
        for bucket, high, low in zip(table["bucket"].to_pylist(), table["high"].to_pylist(), table["low"].to_pylist(), strict=True):
            high, low = np.frombuffer(high, np.uint64), np.frombuffer(low, np.uint64)
            number = lookup.number(high, low)
            hit = (number >= 0) & (prints[number] == (low & np.uint64(0xFFFFFFFF)).astype(np.uint32)) & often[number]
            if hit.any():
                out.append((bucket, high[hit].tobytes(), low[hit].tobytes(), keepers[rank[number[hit]]].tobytes()))
        return pa.Table.from_batches([arrow_rows(out, ANSWERS_TYPE)])

    return lines.groupBy("shard").applyInArrow(probe, ANSWERS_TYPE)


def dedup_lines(
    df: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3,
    kept: str = "kept_text",
) -> DataFrame:
    """Add ``kept``, the text without repeated lines, ``n_lines`` and ``n_dropped``.

    General: the forecasting project has no texts made of lines. Lines end at a newline. A line's key is the line stripped of ASCII white space with A-Z lower-cased;
    keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their
    lines except in the largest document that holds them, which keeps all of its own. Null and empty
    texts are one empty line. A null ``doc`` is one document, below all others; rows that repeat a
    document are cleaned alike and count once. Columns named like the new ones are replaced; an empty
    table stays empty. Lines are told apart by 128 bits of hash. Rows of one document meet in one task, so
    ids should be nearly unique.
    """
    kept_df = free_names(df, [kept, "n_lines", "n_dropped", "_bucket"], [doc, text])
    total = kept_df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    buckets, shards = pieces(total, BUCKET_BYTES), pieces(total, SHARD_BYTES)
    bucketed = kept_df.withColumn(
        "_bucket", F.pmod(F.xxhash64(F.col(f"`{doc}`").cast("long")), F.lit(buckets)).cast("int")
    )
    dealt = bucketed.select("_bucket", doc, text).repartition(buckets, "_bucket")
    answers = answer_lines(saved(bucket_lines(dealt, shards, doc, text, min_chars), "lines"), min_docs)
    schema = T.StructType([
        *kept_df.schema.fields, T.StructField(kept, T.StringType()),
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
    ])

    def drop(docs: pa.Table, told: pa.Table) -> pa.Table:
        high, low = _joined(told["high"], np.uint64), _joined(told["low"], np.uint64)
        keys = np.stack([high, low], axis=1).astype(">u8").tobytes()
        keeper = dict(zip((keys[i : i + 16] for i in range(0, len(keys), 16)), _joined(told["keeper"], np.int64).tolist(), strict=True))
        texts, totals, dropped = [], [], []
        for of, body in zip(
            docs[doc].to_pylist(), text_bytes(docs[text].combine_chunks()), strict=True
        ):
            of, lines = NO_DOC if of is None else of, body.split(b"\n")
            stay = [
                line for line, key in zip(lines, line_keys(body, min_chars), strict=True)
                if key is None or keeper.get(key, of) == of
            ]
            texts.append(b"\n".join(stay))
            totals.append(len(lines))
            dropped.append(len(lines) - len(stay))
        out = docs.drop_columns(["_bucket"])
        text_column = pc.cast(pa.array(texts, pa.binary()), pa.string())
        return (
            out.append_column(kept, text_column).append_column("n_lines", pa.array(totals, pa.int64()))
            .append_column("n_dropped", pa.array(dropped, pa.int64()))
        )

    return bucketed.groupBy("_bucket").cogroup(answers.groupBy("bucket")).applyInArrow(drop, schema)
