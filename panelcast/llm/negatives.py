"""Hard negatives among the weeks of a panel, from tiles of exact inner products.

Rows are weeks of series with a feature vector (columns entity, pos, features) and a class, such as whether
the week's cases exceed the outbreak threshold of its series. For an anchor week the nearest weeks of its class are its positives; a
week of another class whose inner product lies in a window below that of a positive is a hard negative: it
looks like the anchor, but not so much that its class is in doubt.

Products of anchors and candidates are made in tiles of int64 by Strassen's recursion. Every tile offers its
best to heaps of bounded size, and the heaps of all tasks merge by ranking.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import pieces, saved
from panelcast.llm.sliced import LEAST_TASKS, MOST_PLACES, check_range, matrix, once_per_key, quantised_histories

BLOCK_CELLS = 1 << 19
TILE = 1024
ANCHOR_ROWS = 256
LEAF = 16


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices by seven half-size products per step; odd sizes are padded with zeros.

    Integer additions are exact (modulo 2^64, where they cancel), so the product is, if it fits a long.
    """
    (m, n), p = a.shape, b.shape[1]
    if min(m, n, p) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, n % 2)))
    b = np.pad(b, ((0, n % 2), (0, p % 2)))
    i, j, k = (m + 1) // 2, (n + 1) // 2, (p + 1) // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    both = strassen(a11 + a22, b11 + b22, leaf)
    lower = strassen(a21 + a22, b11, leaf)
    right = strassen(a11, b12 - b22, leaf)
    left = strassen(a22, b21 - b11, leaf)
    upper = strassen(a11 + a12, b22, leaf)
    down = strassen(a21 - a11, b11 + b12, leaf)
    across = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), np.int64)
    out[:i, :k] = both + left - upper + across
    out[:i, k:] = right + upper
    out[i:, :k] = lower + left
    out[i:, k:] = both - lower + right + down
    return out[:m, :p]


class BestHeap:
    """The ``k`` best of all (score, row) offered: larger scores first, then smaller rows."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def offer(self, scores: np.ndarray, rows: np.ndarray) -> None:
        """``rows`` ascending. At most ``k`` of one offer enter the heap."""
        if len(self.heap) == self.k:
            better = scores > self.heap[0][0]
            scores, rows = scores[better], rows[better]
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            above = np.flatnonzero(scores > edge)
            chosen = np.concatenate([above, np.flatnonzero(scores == edge)[: self.k - len(above)]])
            scores, rows = scores[chosen], rows[chosen]
        for entry in zip(scores.tolist(), (-rows).tolist()):
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)

    def entries(self) -> list[tuple[int, int]]:
        return [(score, -row) for score, row in sorted(self.heap, reverse=True)]


def _tiles(batches, handle, schema):
    """Stream rows sorted by (cut, block, width, class, asks): gather the candidates of a group, then give every lot of anchors
    and all candidates to ``handle(anchors, candidates)``, which returns rows."""
    names = [f.name for f in schema.fields]
    group, lots, ready, waiting = None, [], None, []
    types: list = []

    def run(anchors: pa.Table):
        nonlocal ready
        if not lots and ready is None:
            return []
        if ready is None:
            ready = pa.concat_tables(lots).sort_by([("entity", "ascending"), ("pos", "ascending")])
            lots.clear()
        return handle(anchors, ready)

    def emit(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        kinds = {n: table.schema.field(n).type for n in table.schema.names}
        types = [kinds["entity"] if n.endswith("entity") else kinds["pos"] if n.endswith("pos") else pa.int64() for n in names]
        keys = list(zip(*[table[c].to_pylist() for c in ("cut", "block", "width", "part", "asks")], strict=True))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        for start, stop in zip(starts, starts[1:]):
            *now, asks = keys[start]
            if now != group:
                if waiting:
                    yield emit(run(pa.concat_tables(waiting)))
                group, ready = now, None
                lots.clear(), waiting.clear()
            rows = table.slice(start, stop - start)
            if not asks:
                lots.append(rows)
                continue
            waiting.append(rows)
            if sum(map(len, waiting)) >= ANCHOR_ROWS:
                anchors = pa.concat_tables(waiting)
                waiting.clear()
                for at in range(0, len(anchors), ANCHOR_ROWS):
                    yield emit(run(anchors.slice(at, ANCHOR_ROWS)))
    if waiting:
        yield emit(run(pa.concat_tables(waiting)))


def _products(anchors: pa.Table, candidates: pa.Table):
    """(first row, tile) for every tile of the products of the anchors and candidates of one group."""
    width = anchors["width"][0].as_py()
    left, right = matrix(anchors["q"], width), matrix(candidates["q"], width)
    check_range(left, right)
    for start in range(0, len(right), TILE):
        yield start, strassen(left, np.ascontiguousarray(right[start : start + TILE].T))


def _keys(table: pa.Table) -> list[tuple]:
    return list(zip(table["entity"].to_pylist(), table["pos"].to_pylist(), strict=True))


def hard_negatives(
    histories: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, entity: str = "entity", order: str = "pos", features: str = "features", label: str = "outbreak",
) -> DataFrame:
    """(entity, pos, positive_entity, positive_pos, ``rank`` from 1, negative_entity, negative_pos, positive_score,
    negative_score): for each anchor and each of its positives the first ``negatives`` rows of another class with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    An anchor's positives are its first ``positives`` other rows of the same class. A score is the integer inner product
    of components floor(scale * x); higher scores come first, ties by smaller (entity, pos), null keys last.
    Fewer rows are all taken; a positive without a negative has no row. Rows with a null class or a vector that is
    null or holds null or non-finite components take no part; vectors meet only those of the same width, empty
    ones score 0. Rows with the anchor's own key are neither positive nor negative. Repeated rows count
    separately, but a positive that is repeated is listed once, with its largest score; a repeated anchor key is asked
    once, with its smallest (class, vector). Empty tables give no rows, other columns are not looked at.
    Products that might exceed a long raise.

    Positives are sought among rows of the anchor's class only; a class is dealt into as many parts as its size
    needs, so one class may hold any share of the rows. Tasks hold bounded blocks of candidates and read anchors in lots.
    """
    kind = F.col(f"`{label}`").cast("string").alias("part")
    named = lambda df: quantised_histories(df, scale, entity, order, features, kind).where(F.col("part").isNotNull())
    rows = saved(named(histories).withColumn("width", F.size("q")), "candidates")
    asked = saved(once_per_key(named(anchors), "part", "q").withColumn("width", F.size("q")), "anchors")
    near = saved(_positives(rows, asked, positives), "positives")
    return _negatives(rows, asked, near, negatives, low, high)


def _meet(candidates: DataFrame, asking: DataFrame, groups: int, handle, schema: T.StructType) -> DataFrame:
    """Candidates and anchors with the same (cut, block, width, part) through ``handle``, in ``groups`` partitions at most."""
    parts = min(max(groups, 1), MOST_PLACES)
    shift = F.pmod(F.xxhash64("width", "part"), F.lit(parts))
    place = F.pmod(shift + F.col("cut").cast("long") * LEAST_TASKS + F.col("block"), F.lit(parts)).cast("int")
    met = candidates.withColumn("asks", F.lit(False)).unionByName(asking.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    placed = met.repartitionById(parts, place).sortWithinPartitions("cut", "block", "width", "part", "asks")
    return placed.mapInArrow(lambda batches: _tiles(batches, handle, schema), schema)


def _positives(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(entity, pos, positive_entity, positive_pos, positive_score): the first ``k`` rows of the anchor's class."""
    cells = F.sum(F.col("width") + 1)
    sizes = rows.groupBy("width", "part").agg(F.ceil(cells / BLOCK_CELLS).cast("int").alias("cuts"))
    sizes = saved(sizes.where(F.col("cuts") > 1), "classes")
    cuts = F.coalesce("cuts", F.lit(1))
    numbered = rows.join(sizes, ["width", "part"], "left").select(
        *rows.columns, F.pmod(F.xxhash64("entity", "pos", "q"), cuts).cast("int").alias("cut"), F.lit(0).alias("block")
    )
    asking = asked.join(sizes, ["width", "part"], "left").select(
        *asked.columns, F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"), F.lit(0).alias("block")
    )
    keys = rows.schema
    schema = T.StructType([
        keys["entity"], keys["pos"], T.StructField("positive_entity", keys["entity"].dataType),
        T.StructField("positive_pos", keys["pos"].dataType), T.StructField("positive_score", T.LongType()),
    ])

    def handle(anchors: pa.Table, candidates: pa.Table) -> list[tuple]:
        own, names = _keys(anchors), _keys(candidates)
        at: dict = {}
        for i, name in enumerate(names):
            at.setdefault(name, []).append(i)
        heaps = [BestHeap(k) for _ in own]
        for start, tile in _products(anchors, candidates):
            here = np.arange(start, start + tile.shape[1])
            for key, heap, scores in zip(own, heaps, tile, strict=True):
                free = np.ones(len(here), bool)
                free[[i - start for i in at.get(key, []) if start <= i < start + len(here)]] = False
                heap.offer(scores[free], here[free])
        return [(*key, *names[row], score) for key, heap in zip(own, heaps, strict=True) for score, row in heap.entries()]

    found = _meet(numbered, asking, pieces(rows.count(), 2048, LEAST_TASKS), handle, schema)
    order = Window.partitionBy("entity", "pos").orderBy(
        F.desc("positive_score"), F.asc_nulls_last("positive_entity"), F.asc_nulls_last("positive_pos")
    )
    first = found.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    return first.groupBy("entity", "pos", "positive_entity", "positive_pos").agg(F.max("positive_score").alias("positive_score"))


def _negatives(rows: DataFrame, asked: DataFrame, near: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Rank the rows of other classes inside the window of every positive."""
    cells, n_asked = rows.agg(F.sum(F.col("width") + 1)).first()[0] or 0, asked.count()
    cuts = pieces(cells, BLOCK_CELLS)
    blocks = min(pieces(n_asked, ANCHOR_ROWS), pieces(LEAST_TASKS, cuts))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("string").alias("part")
    keys = rows.schema
    candidates = rows.select(
        "entity", "pos", "q", "width", none, F.col("part").alias("class"),
        F.pmod(F.xxhash64("entity", "pos", "q"), F.lit(cuts)).cast("int").alias("cut"), numbers(blocks).alias("block"),
    )
    listed = near.groupBy("entity", "pos").agg(
        F.collect_list(F.struct("positive_score", "positive_entity", "positive_pos")).alias("found")
    ).withColumnsRenamed({"entity": "_entity", "pos": "_pos"})
    same = F.col("entity").eqNullSafe(F.col("_entity")) & F.col("pos").eqNullSafe(F.col("_pos"))
    asking = asked.join(listed, same).select(
        "entity", "pos", "q", "width", none, F.col("part").alias("class"), "found",
        numbers(cuts).alias("cut"), F.pmod(F.xxhash64("entity", "pos"), F.lit(blocks)).cast("int").alias("block"),
    )
    schema = T.StructType([
        keys["entity"], keys["pos"], T.StructField("positive_entity", keys["entity"].dataType),
        T.StructField("positive_pos", keys["pos"].dataType), T.StructField("negative_entity", keys["entity"].dataType),
        T.StructField("negative_pos", keys["pos"].dataType), T.StructField("positive_score", T.LongType()),
        T.StructField("negative_score", T.LongType()),
    ])

    def handle(anchors: pa.Table, candidates: pa.Table) -> list[tuple]:
        own, names = _keys(anchors), _keys(candidates)
        codes = {c: i for i, c in enumerate(sorted(set(candidates["class"].to_pylist())))}
        classes = np.array([codes[c] for c in candidates["class"].to_pylist()])
        wanted = anchors["found"].to_pylist()
        heaps = [[BestHeap(k) for _ in found] for found in wanted]
        mine = [codes.get(c, -1) for c in anchors["class"].to_pylist()]
        at: dict = {}
        for i, name in enumerate(names):
            at.setdefault(name, []).append(i)
        for start, tile in _products(anchors, candidates):
            here = np.arange(start, start + tile.shape[1])
            other = classes[start : start + tile.shape[1]]
            for key, found, own_class, own_heaps, scores in zip(own, wanted, mine, heaps, tile, strict=True):
                free = other != own_class
                free[[i - start for i in at.get(key, []) if start <= i < start + len(here)]] = False
                for positive, heap in zip(found, own_heaps, strict=True):
                    value = positive["positive_score"]
                    inside = free & (scores >= -(-low * value // 100)) & (scores <= high * value // 100)
                    heap.offer(scores[inside], here[inside])
        return [
            (*key, p["positive_entity"], p["positive_pos"], *names[row], p["positive_score"], score)
            for key, found, own_heaps in zip(own, wanted, heaps, strict=True)
            for p, heap in zip(found, own_heaps, strict=True) for score, row in heap.entries()
        ]

    found = _meet(candidates, asking, cuts * blocks, handle, schema)
    order = Window.partitionBy("entity", "pos", "positive_entity", "positive_pos").orderBy(
        F.desc("negative_score"), F.asc_nulls_last("negative_entity"), F.asc_nulls_last("negative_pos")
    )
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "entity", "pos", "positive_entity", "positive_pos", "rank", "negative_entity", "negative_pos",
        "positive_score", "negative_score",
    )
