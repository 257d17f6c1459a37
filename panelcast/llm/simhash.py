"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Fingerprints are put into shards so that any two within the radius share one: of r + k blocks of bits at most
r can differ, so some k agree, and every choice of k blocks is a shard key. Each shard builds a BK-tree
(children keyed by their distance to the parent) that travels with the shard and is searched along the
edges within the radius only. Shards give spanning links, never all pairs. A crowded shard is split by further
bits, and what is crowded still is dealt into parts that meet in pairs, so no tree grows with a family of texts.

The forecasting project has no texts, so the operators are general.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import free_names, limit_batches, null_safe_join, pieces, saved, small_batches, text_bytes

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD_SIZE = 48
#: Values of a shard before it is split, and values that a search task is meant to get.
PART_NODES = 2048
TASK_VALUES = 100_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)],
        np.uint64, len(starts),
    )
    by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 1500:
        counts = np.unpackbits(by_byte, axis=1).sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(
    df: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, same: str | None = None
) -> DataFrame:
    """(doc, fingerprint, same): 64 bits as a long, and a long column carried along (null without a name).
    Null and empty texts have fingerprint zero."""

    limit_batches(df.sparkSession)
    def run(batches):
        for batch in small_batches(batches):
            found = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc", "fingerprint", "same"]
            )

    carried = F.col(f"`{same}`") if same else F.lit(None).cast("long")
    return df.select(
        F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"), carried.alias("same")
    ).mapInArrow(run, "doc long, fingerprint long, same long")


class BkTree:
    """Distinct fingerprints, and which of them hang together within the radius.

    A subtree whose members all hang together is closed to a query that already hangs together with
    them: it has nothing to add. So a crowd of near copies costs a walk down the tree each, not a
    comparison of all with all.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.kids: list[dict[int, int]] = []
        self.mixed: list[bool] = []
        self.up: list[int] = []

    def _root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, value: int) -> None:
        me, radius, values, kids = len(self.values), self.radius, self.values, self.kids
        values.append(value)
        kids.append({})
        self.mixed.append(False)
        self.up.append(me)
        if me == 0:
            return
        stack, visited = [0], []
        while stack:
            node = stack.pop()
            if not self.mixed[node] and self._root(node) == self._root(me):
                continue
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                a, b = self._root(node), self._root(me)
                if a != b:
                    self.up[max(a, b)] = min(a, b)
            if self.mixed[node]:
                visited.append(node)
            own = kids[node]
            if own:
                for edge in range(distance - radius, distance + radius + 1):
                    kid = own.get(edge)
                    if kid is not None:
                        stack.append(kid)
        mine = self._root(me)
        for node in reversed(visited):
            if self._root(node) == mine:
                self.mixed[node] = any(self.mixed[k] or self._root(k) != mine for k in kids[node].values())
        node = 0
        while True:
            if self._root(node) != mine:
                self.mixed[node] = True
            distance = (values[node] ^ value).bit_count()
            below = kids[node].get(distance)
            if below is None:
                kids[node][distance] = me
                return
            node = below

    def links(self) -> list[tuple[int, int]]:
        """A star per group: each member with the group's first."""
        return [(self.values[i], self.values[self._root(i)]) for i in range(len(self.values)) if self._root(i) != i]


def shard_masks(count: int, radius: int, shard_size: int = SHARD_SIZE) -> list[int]:
    """Bit masks of the shard keys: the fewest blocks with which random fingerprints make small shards."""
    for extra in range(1, 5):
        blocks = radius + extra
        edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
        spans = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(c) for c in combinations(spans, extra)]
        if count <= shard_size << min(m.bit_count() for m in masks):
            break
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks over the bits that ``mask`` leaves: values within the radius agree on one of them."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    blocks = radius + 2
    edges = [round(i * len(free) / blocks) for i in range(blocks + 1)]
    spans = [sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(spans, 2)]


def shards(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE, most: int | None = None) -> DataFrame:
    """(shard, fingerprint): any two ``fingerprint`` values within the radius share a shard, which holds a few times ``most``
    values at the very most, ``2 * most`` on average.

    A shard with more than ``most`` values is sharded again by the bits that its key leaves open. One that is still
    larger is dealt into parts by a hash, and every pair of parts is a shard.
    """
    most = PART_NODES if most is None else most
    masks = shard_masks(distinct.count(), radius, shard_size)
    signed = lambda own: F.array(*[F.lit(_signed(m)) for m in own])
    keyed = distinct.select("fingerprint", F.posexplode(signed(masks)).alias("mask", "_bits")).select(
        "fingerprint", "mask", F.struct("mask", F.col("fingerprint").bitwiseAND(F.col("_bits")).alias("key")).alias("first")
    )
    crowded = lambda df, key: saved(
        df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most), "crowded"
    )
    none = F.lit(0).cast("long")
    whole = F.struct(F.lit(-1).alias("mask"), none.alias("key"))
    no_parts = F.struct(F.lit(0).alias("one"), F.lit(0).alias("other"))
    large = crowded(keyed, "first")
    if large.isEmpty():
        return keyed.select(F.struct("first", whole.alias("second"), no_parts.alias("parts")).alias("shard"), "fingerprint")
    met = keyed.join(large, "first", "left")
    plain = met.where(F.col("size").isNull()).select("first", whole.alias("second"), "fingerprint", no_parts.alias("parts"))
    finer = F.array(*[signed(finer_masks(m, radius)) for m in masks])
    again = met.where(F.col("size").isNotNull()).select(
        "first", "fingerprint", F.posexplode(F.element_at(finer, F.col("mask") + 1)).alias("sub", "_bits")
    ).select("first", F.struct(F.col("sub").alias("mask"), F.col("fingerprint").bitwiseAND(F.col("_bits")).alias("key")).alias("second"), "fingerprint")
    both = again.withColumn("both", F.struct("first", "second"))
    sized = both.join(crowded(both, "both"), "both", "left")
    parts = F.coalesce(F.ceil(F.col("size") / most), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fingerprint"), parts).cast("int")
    pairs = F.when(parts == 1, F.array(no_parts)).otherwise(F.transform(
        F.filter(F.sequence(F.lit(0), parts - 1), lambda p: p != own),
        lambda p: F.struct(F.least(p, own).alias("one"), F.greatest(p, own).alias("other")),
    ))
    dealt = sized.select("first", "second", "fingerprint", F.explode(pairs).alias("parts"))
    return plain.unionByName(dealt).select(F.struct("first", "second", "parts").alias("shard"), "fingerprint")


def links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(a, b): links that join all distinct ``fingerprint`` values within ``radius``, transitively."""
    rows = distinct.count()
    tasks = pieces(rows * len(shard_masks(rows, radius, shard_size)), TASK_VALUES, least=32)
    sharded = shards(distinct, radius, shard_size).select(
        "fingerprint", F.col("shard.first.mask").alias("mask"), F.col("shard.first.key").alias("key"),
        F.struct("shard.second", "shard.parts").alias("rest"),
    ).repartition(tasks, "mask", "key", "rest").sortWithinPartitions("mask", "key", "rest", "fingerprint").select(
        "fingerprint", "mask", "key", F.xxhash64("rest").alias("rest")
    )

    def search(batches):
        now, members, out = None, [], []

        def close():
            if len(members) > 1:
                tree = BkTree(radius)
                for m in members:
                    tree.add(m)
                out.extend(tree.links())

        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64).tolist()
            for key, value in zip(zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True), values, strict=True):
                if key != now:
                    close()
                    now, members = key, []
                members.append(value)
            if len(out) > 10_000:
                yield _pairs(out)
                out.clear()
        close()
        if out:
            yield _pairs(out)

    return sharded.mapInArrow(search, "a long, b long").distinct()


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = np.array(rows, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(columns[:, 0].copy()), pa.array(columns[:, 1].copy())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of ``edges`` (a, b) with the smallest node it is connected to.

    Alternates large and small stars until nothing changes: a logarithmic number of rounds, each a
    few aggregations. Every round is written, so a lost executor does not bring back earlier ones.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a")
        now = saved(
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct(),
            "edges",
        )


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """Add ``label``, the same within a component, and ``component_id`` to rows (doc, fingerprint)."""
    nodes = saved(rows.groupBy("fingerprint").agg(F.min("doc").alias("first")), "nodes")
    labels = components(links(nodes.select("fingerprint"), radius))
    placed = nodes.join(labels, nodes["fingerprint"] == labels["node"], "left").select(
        "fingerprint", "first", F.coalesce("label", "fingerprint").alias("label")
    )
    smallest = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(placed.join(smallest, "label").drop("first"), "fingerprint")


def near_duplicates(
    df: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per row of ``df``: (doc, ``fingerprint`` as 16 hex digits, ``component_id``).

    General: the forecasting project has no texts. A-Z is lower-cased, words are what lies between ASCII white space, shingles have ``shingle`` words
    (all words, if fewer). Fingerprints at most ``radius`` bits apart are linked; ``component_id`` is the
    smallest document reached over links. Equal fingerprints are one node, so copies cost nothing.

    Null and empty texts have fingerprint zero and are linked like any other. Null document ids get a
    component but never name one (null if there is no other); repeated rows are returned as often as they
    come; other columns are ignored; an empty table stays empty.
    """
    rows = saved(fingerprints(df, doc, text, shingle), "fingerprints")
    return _labelled(rows, radius).select(
        "doc", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    df: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row of ``df`` per component of `near_duplicates`: that of its smallest document.

    If that document comes in several rows of the component, one of them stays. A component without a
    document id keeps one row.
    """
    marks = ["_near_doc", "_near_text"]
    keyed = free_names(df, marks, [doc, text]).withColumns({
        marks[0]: F.col(f"`{doc}`").cast("long"), marks[1]: F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    })
    rows = saved(fingerprints(keyed, doc, text, shingle, marks[1]), "fingerprints")
    chosen = (
        _labelled(rows, radius).where(F.col("doc").eqNullSafe(F.col("component_id")))
        .groupBy("label").agg(F.min(F.struct("doc", "same")).alias("_kept")).select("_kept.*").toDF(*marks)
    )
    return null_safe_join(keyed, saved(chosen, "kept"), marks, "left_semi").dropDuplicates(marks).drop(*marks)
