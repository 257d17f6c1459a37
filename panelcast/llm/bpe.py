"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one last token with which its encoding can end: the token
whose predecessor is the last token of the shorter prefix and which BPE would leave next to it. Storing
that token per prefix gives the encoding of every prefix at once. Appending continues the table; after
an edit only the positions near it are computed again.

The forecasting project has no texts to tokenise, so these operators are general: any table with a
text column. Token ids are kept as packed little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from panelcast.llm.common import free_names, limit_batches, small_batches

CACHE_PIECES = 400_000
CACHE_CHARS = 32
KNOWN_PAIRS = 400_000
HEAD = 6
KNOWN_HEADS = 200_000


@dataclass
class Merges:
    """Token bytes by rank, and for each token the two tokens that BPE joins last to make it; ``reached`` are
    the tokens that merges lead to.

    ``lengths`` holds, by the last three bytes (or all, of shorter tokens), how long tokens that end so are.
    """

    ranks: dict[bytes, int]
    tokens: list[bytes]
    left: list[int]
    right: list[int]
    lengths: dict[bytes, tuple[int, ...]]
    longest: int
    packed: list[bytes]
    reached: dict[bytes, int]
    known: dict[int, bool] = field(default_factory=dict)
    # Packed ids of pieces seen lately, in two generations: a full young one takes the place of the old.
    young: dict[str, bytes] = field(default_factory=dict)
    old: dict[str, bytes] = field(default_factory=dict)
    heads: dict[bytes, list[int]] = field(default_factory=dict)

    def adjoin(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes leaves them as these two tokens.

        Undoes the later of the two tokens' merges at the border, again and again. If the parts that
        face each other would have been joined before the merge just undone, the border breaks.
        """
        ranks, tokens, left, right = self.ranks, self.tokens, self.left, self.right
        limit = len(tokens)
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < limit:
                return False
            if a > b:
                # The merge that made ``a`` comes later. At equal rank the left one is done first.
                limit, inner = a, right[a]
                if inner != a:
                    a = inner
                    continue
                limit, inner = b + 1, left[b]
                if inner == b:
                    return True
                b = inner
            else:
                limit, inner = b + 1, left[b]
                if inner != b:
                    b = inner
                    continue
                limit, inner = a, right[a]
                if inner == a:
                    return True
                a = inner

    def fill(self, piece: bytes, last: list[int], upto: int) -> None:
        """Append to ``last`` the last token of every further prefix of ``piece``, up to ``upto`` bytes.

        Of the tokens that end a prefix only one fits behind the shorter prefix's last token.
        """
        ranks, lengths, known = self.reached.get, self.lengths.get, self.known
        for end in range(len(last), upto + 1):
            ways = end > 2 and lengths(piece[end - 3 : end]) or end > 1 and lengths(piece[end - 2 : end]) or (1,)
            for length in ways:
                start = end - length
                if start < 0:
                    continue
                token = ranks(piece[start:end])
                if token is None:
                    continue
                if start:
                    pair = last[start] << 32 | token
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) > KNOWN_PAIRS:
                            known.clear()
                        fits = known[pair] = self.adjoin(last[start], token)
                    if not fits:
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the ranks lack a single byte")


class PrefixTable:
    """``last[i]`` is the last token of the encoding of the first ``i`` bytes of ``piece``."""

    def __init__(self, merges: Merges, piece: bytes = b""):
        """Pieces that begin alike share the table of their first bytes."""
        self.merges, self.piece = merges, piece
        head = merges.heads.get(piece[:HEAD])
        if head is None:
            head = [-1]
            merges.fill(piece, head, min(HEAD, len(piece)))
            if len(merges.heads) >= KNOWN_HEADS:
                merges.heads.clear()
            merges.heads[piece[:HEAD]] = head
        self.last = head.copy()
        merges.fill(piece, self.last, len(piece))

    def append(self, more: bytes) -> None:
        """Exact: the table of the longer piece, without touching what is there."""
        self.piece += more
        self.merges.fill(self.piece, self.last, len(self.piece))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start:stop``; returns how many prefixes were computed again.

        A prefix's token depends on the bytes and tokens at most one token length before it. Once that
        many in a row are as before, all later ones are too.
        """
        old_piece, old, shift = self.piece, self.last, len(new) - (stop - start)
        self.piece = old_piece[:start] + new + old_piece[stop:]
        self.last, same, done = old[: start + 1], 0, 0
        for end in range(start + 1, len(self.piece) + 1):
            self.merges.fill(self.piece, self.last, end)
            done += 1
            settled = end - start - len(new)
            same = same + 1 if settled > 0 and self.last[end] == old[end - shift] else 0
            if same >= self.merges.longest:
                self.last.extend(old[end - shift + 1 :])
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes (all by default), read backwards from the last token."""
        end = len(self.piece) if end is None else end
        out = []
        while end:
            out.append(self.last[end])
            end -= len(self.merges.tokens[self.last[end]])
        return out[::-1]


def _merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """Tables of a rank file (lines of base64 token and rank). Their size depends on the vocabulary alone."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return merges_of(ranks)


def merges_of(ranks: dict[bytes, int]) -> Merges:
    """``left`` is the token itself for a single byte and -1 where no merge reaches the token."""
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    left, right = list(range(len(tokens))), list(range(len(tokens)))
    ends: dict[bytes, set[int]] = {}
    for token, rank in ranks.items():
        ends.setdefault(token[-3:], set()).add(len(token))
        if len(token) > 1:
            parts = _merge_by_rank(token, ranks, rank)
            left[rank], right[rank] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
    lengths = {}
    for tail, found in ends.items():
        shorter = {len(tail[i:]) for i in range(1, len(tail)) if tail[i:] in ranks}
        lengths[tail] = tuple(sorted(found | shorter, reverse=True))
    reached = {token: rank for token, rank in ranks.items() if left[rank] >= 0}
    packed = [rank.to_bytes(4, "little") for rank in range(len(tokens))]
    return Merges(ranks, tokens, left, right, lengths, max(map(len, ranks)), packed, reached)


class Encoder:
    """Encodes texts piece by piece. Short pieces seen lately are kept with the tables, so tasks that a
    worker runs one after another share them."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.split = merges, regex.compile(pattern)

    def piece(self, piece: bytes) -> list[int]:
        """A piece that is itself a token stays whole, even one that no merge reaches."""
        whole = self.merges.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self.merges, piece).ids()

    def packed(self, piece: str) -> bytes:
        merges = self.merges
        found = merges.young.get(piece) or merges.old.get(piece)
        if found is None:
            found = b"".join(map(merges.packed.__getitem__, self.piece(piece.encode())))
        if len(piece) <= CACHE_CHARS:
            if len(merges.young) >= CACHE_PIECES:
                merges.old, merges.young = merges.young, {}
            merges.young[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        young, packed = self.merges.young.get, self.packed
        found, seen = [], self.merges.young
        for piece in self.split.findall(text):
            found.append(young(piece) or packed(piece))
            if seen is not self.merges.young:
                seen, young = self.merges.young, self.merges.young.get
        return b"".join(found)

    def append(self, text: str, ids: bytes, suffix: str) -> bytes:
        """Encoding of ``text + suffix`` from that of ``text``. No match of the pattern looks back, so
        only the last match of ``text`` can change."""
        start, last = 0, ""
        for match in self.split.finditer(text):
            start, last = match.start(), match.group()
        kept = len(ids) - len(self.packed(last)) if last else 0
        fresh = self.split.findall(text[start:] + suffix)
        if not last or not fresh or not fresh[0].startswith(last):
            return ids[:kept] + b"".join(map(self.packed, fresh))
        table = PrefixTable(self.merges, last.encode())
        table.append(fresh[0].encode()[len(table.piece) :])
        whole = self.merges.ranks.get(table.piece)
        first = np.array([whole] if whole is not None else table.ids(), "<u4").tobytes()
        return ids[:kept] + first + b"".join(map(self.packed, fresh[1:]))


def _sent(spark: SparkSession, path: str) -> Broadcast:
    """The tables for all tasks, as built-in types: a broadcast cannot carry classes by value."""
    merges = load_merges(path)
    names = ("ranks", "tokens", "left", "right", "lengths", "longest", "packed", "reached")
    return spark.sparkContext.broadcast({name: getattr(merges, name) for name in names})


def _opened(sent: Broadcast) -> Merges:
    """The tables of a worker, made once and kept with their caches for its later tasks."""
    fields = sent.value
    if "made" not in fields:
        fields["made"] = Merges(**fields)
    return fields["made"]


def _add_binary(df: DataFrame, name: str, make) -> DataFrame:
    limit_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        one = make()
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(one(batch), pa.binary())], names=[*batch.schema.names, name]
            )

    return df.mapInArrow(run, schema)


def encode_text(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the packed token ids of the whole ``text``, special tokens read as ordinary text.

    General: the forecasting project has no texts. Every match of ``pattern`` is encoded by itself. Null and empty texts give no ids; repeated rows are
    encoded alike; an ``ids`` column that is already there is replaced. Rows keep their partitions, and
    nothing is shuffled. The tables are built once on the driver and sent along with the tasks: their
    size is that of the vocabulary, whatever the input.
    """
    tables = _sent(df.sparkSession, path)

    def make():
        encoder = Encoder(_opened(tables), pattern)
        return lambda batch: [encoder.encode(t) if t else b"" for t in batch.column(text).to_pylist()]

    return _add_binary(free_names(df, [ids], [text]), ids, make)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``, the bytes of the packed ``ids``; null ids give empty bytes."""
    tables = df.sparkSession.sparkContext.broadcast(load_merges(path).tokens)

    def make():
        token = tables.value.__getitem__
        return lambda batch: [
            b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(ids).to_pylist()
        ]

    return _add_binary(free_names(df, [decoded], [ids]), decoded, make)


def append_text(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", suffix: str = "suffix",
    appended: str = "appended_ids",
) -> DataFrame:
    """Add the packed ids of ``text`` followed by ``suffix``, made from those of ``text``.

    Only the last match of the pattern is encoded again, and of it only the appended bytes.
    """
    tables = _sent(df.sparkSession, path)

    def make():
        encoder = Encoder(_opened(tables), pattern)
        return lambda batch: [
            encoder.append(t or "", i or b"", s or "")
            for t, i, s in zip(*(batch.column(c).to_pylist() for c in (text, ids, suffix)), strict=True)
        ]

    return _add_binary(free_names(df, [appended], [text, ids, suffix]), appended, make)


__all__ = [
    "Encoder", "Merges", "PrefixTable", "append_text", "decode_ids", "encode_text", "load_merges", "merges_of",
]
