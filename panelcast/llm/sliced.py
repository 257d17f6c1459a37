"""Exact top-k weeks of a panel by a bit-sliced index.

A history is the feature vector of a week of a series (`multiscale_features`, `raw_lag_features`: columns
entity, pos, features). Its components are quantised to integers, and the index keeps for every
attribute and bit the set of weeks that have it, as a bitmap. The integer inner product with a query
is a sum of shifted slices, added for all weeks at once by bitmap arithmetic; the best weeks are read off
the sum from its most significant slice downward, and ties at the boundary go to the first keys.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import pieces, saved

SLICE_CELLS = 1 << 20
LEAST_TASKS = 64
MOST_PLACES = 8192


def quantised(features: str | Column, scale: int) -> Column:
    """Components as floor(scale * x), x in double precision; null for a vector that is null or holds a null or
    non-finite component."""
    values = (F.col(f"`{features}`") if isinstance(features, str) else features).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(values, lambda x: F.floor(F.lit(scale) * x)))


def quantised_histories(
    histories: DataFrame, scale: int, entity: str = "entity", order: str = "pos", features: str = "features",
    *more: Column,
) -> DataFrame:
    """(entity, pos, q, more): rows whose vector takes part, with its quantised components."""
    return histories.select(
        F.col(f"`{entity}`").alias("entity"), F.col(f"`{order}`").alias("pos"), quantised(features, scale).alias("q"), *more
    ).where(F.col("q").isNotNull())


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of equal sizes as an int64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def check_range(left: np.ndarray, right: np.ndarray) -> None:
    """Raise where an inner product might not fit a long."""
    if left.size and right.size:
        tops = [max(abs(int(m.max())), abs(int(m.min()))) for m in (left, right)]
        if tops[0] * tops[1] * left.shape[-1] >= 1 << 63:
            raise OverflowError("inner products of these quantised histories may exceed a long: use a smaller scale")


class BitSlices:
    """Bitmaps of the rows of ``values``: for attribute d the bits of its distance from the column's minimum.

    Planes of one attribute follow each other, lowest bit first. ``pack`` and ``unpack`` are its stored form.
    """

    def __init__(self, rows: int, low: np.ndarray, bits: np.ndarray, planes: np.ndarray):
        self.rows, self.low, self.bits = rows, low, bits
        self.first = np.concatenate([[0], np.cumsum(bits)])
        # Complements behind the planes: a negative weight adds the complement of its attribute.
        self.planes = np.concatenate([planes, ~planes])
        self.exists = _bitmap(np.ones(rows, bool))

    @classmethod
    def of(cls, values: np.ndarray) -> BitSlices:
        low = values.min(axis=0)
        above = (values - low).astype(np.uint64)
        bits = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int64)
        planes = [
            _bitmap((above[:, d] >> np.uint64(j)) & np.uint64(1)) for d in range(values.shape[1]) for j in range(bits[d])
        ]
        words = -(-len(values) // 64)
        return cls(len(values), low, bits, np.array(planes, np.uint64).reshape(-1, words))

    def pack(self) -> bytes:
        return self.planes[: len(self.planes) // 2].tobytes()

    @classmethod
    def unpack(cls, rows: int, low, bits, packed: bytes) -> BitSlices:
        planes = np.frombuffer(packed, np.uint64).reshape(-1, -(-rows // 64))
        return cls(rows, np.asarray(low, np.int64), np.asarray(bits, np.int64), planes)

    def weighted_sum(self, weights: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the inner product of all rows with ``weights``, and the constant to add to it."""
        places: dict[int, list[int]] = defaultdict(list)
        constant, plain = 0, len(self.planes) // 2
        for d in np.flatnonzero(weights):
            weight, first, bits = int(weights[d]), int(self.first[d]), int(self.bits[d])
            constant += weight * int(self.low[d])
            if weight < 0:
                # weight * u = |weight| * (complement of u) - |weight| * (2^bits - 1)
                weight, first = -weight, first + plain
                constant -= weight * ((1 << bits) - 1)
            for shift in range(weight.bit_length()):
                if weight >> shift & 1:
                    for j in range(bits):
                        places[shift + j].append(first + j)
        total, carried, power = [], [], 0
        while carried or any(p >= power for p in places):
            column = np.concatenate([self.planes[places.get(power, [])], *carried])
            column, carried = _add_column(column)
            total.append(column)
            power += 1
        return total, constant

    def top(self, total: list[np.ndarray], barred: list[int], k: int) -> np.ndarray:
        """Rows of the ``k`` largest sums; of equal ones at the boundary the first rows."""
        tied = self.exists.copy()
        for row in barred:
            tied[row // 64] &= ~np.uint64(1 << row % 64)
        better, have = np.zeros_like(tied), 0
        for plane in reversed(total):
            hit = tied & plane
            more = int(np.bitwise_count(hit).sum())
            if have + more > k:
                tied = hit
            else:
                better |= hit
                tied &= ~plane
                have += more
        return np.concatenate([_rows(better), _rows(tied)[: k - have]])


def _bitmap(marks: np.ndarray) -> np.ndarray:
    packed = np.packbits(marks.astype(np.uint8), bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _add_column(column: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Add bitmaps of one power of two: the slice of that power, and the carries into the next one.

    Three bitmaps become a sum and a carry (a full adder), many triples at a time, until one is left.
    """
    carries = []
    while len(column) > 2:
        n = len(column) // 3
        a, b, c = column[:n], column[n : 2 * n], column[2 * n : 3 * n]
        odd = a ^ b
        carries.append((a & b) | (odd & c))
        column = np.concatenate([odd ^ c, column[3 * n :]])
    if len(column) == 2:
        carries.append((column[0] & column[1])[None])
        column = column[:1] ^ column[1:]
    return column[0] if len(column) else np.zeros(column.shape[1], np.uint64), carries


def index_slices(rows: DataFrame, slices: int) -> DataFrame:
    """The bit-sliced index of (entity, pos, q): one row per (width, slice) of about ``SLICE_CELLS`` components, with
    its keys in order, minima and bit numbers per attribute, and all bitmaps."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType([
        T.StructField("width", T.IntegerType()), T.StructField("slice", T.IntegerType()),
        T.StructField("entities", T.ArrayType(kinds["entity"])), T.StructField("positions", T.ArrayType(kinds["pos"])),
        T.StructField("low", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())),
        T.StructField("planes", T.BinaryType()),
    ])
    dealt = rows.select(
        "entity", "pos", "q", F.size("q").alias("width"), F.pmod(F.xxhash64("entity", "pos", "q"), F.lit(slices)).cast("int").alias("slice")
    )

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("entity", "ascending"), ("pos", "ascending")])
        width = table["width"][0].as_py()
        index = BitSlices.of(matrix(table["q"], width))
        values = [
            width, table["slice"][0].as_py(), table["entity"].to_pylist(), table["pos"].to_pylist(),
            index.low.tolist(), index.bits.tolist(), index.pack(),
        ]
        types = [
            pa.int32(), pa.int32(), pa.list_(table["entity"].type), pa.list_(table["pos"].type),
            pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
        ]
        return pa.table([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=[f.name for f in schema.fields])

    return dealt.groupBy("width", "slice").applyInArrow(build, schema)


def once_per_key(rows: DataFrame, *values: str) -> DataFrame:
    """One row per (entity, pos): that with the smallest ``values``."""
    least = rows.groupBy("entity", "pos").agg(F.min(F.struct(*values)).alias("_least"))
    return least.select("entity", "pos", *[F.col(f"_least.{v}").alias(v) for v in values])


def exact_top_histories(
    histories: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, entity: str = "entity", order: str = "pos",
    features: str = "features",
) -> DataFrame:
    """(entity, pos, ``rank`` from 1, ``near_entity``, ``near_pos``, ``score``): for every row of ``queries``
    its ``k`` rows of ``histories`` with the largest integer inner product of components floor(scale * x).

    A row is known by (entity, pos); rows with the query's own key are no candidates, null keys come last in
    ties. Fewer candidates than ``k`` are all returned; ties go to the smaller (entity, pos). Vectors that are null
    or hold null or non-finite components take no part, empty ones score 0, vectors meet only those of the same width.
    Repeated candidates count separately; a repeated query key is asked once, with its smallest vector. Empty
    tables give no rows, other columns are not looked at. Products that might exceed a long raise.

    Every history is in the index and every query asks every slice of it; a task holds one slice and reads
    queries one after another, and returns ``k`` rows for each.
    """
    rows = saved(quantised_histories(histories, scale, entity, order, features), "quantised")
    asked = saved(once_per_key(quantised_histories(queries, scale, entity, order, features), "q"), "asked")
    cells, n_asked = rows.agg(F.sum(F.size("q") + 1)).first()[0] or 0, asked.count()
    slices = pieces(cells, SLICE_CELLS)
    blocks = min(pieces(n_asked, 1), pieces(LEAST_TASKS, slices))
    index = saved(index_slices(rows, slices), "slices")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.withColumn("block", numbers(blocks)).withColumns({
        "entity": F.lit(None).cast(rows.schema["entity"].dataType), "pos": F.lit(None).cast(rows.schema["pos"].dataType),
        "q": F.lit(None).cast("array<bigint>"), "asks": F.lit(False),
    })
    asking = asked.withColumns({
        "width": F.size("q"), "block": F.pmod(F.xxhash64("entity", "pos"), F.lit(blocks)).cast("int"), "asks": F.lit(True)
    }).withColumn("slice", numbers(slices))
    place = F.pmod(F.col("slice") * blocks + F.col("block"), F.lit(min(slices * blocks, MOST_PLACES)))
    met = asking.unionByName(held, allowMissingColumns=True).repartitionById(min(slices * blocks, MOST_PLACES), place.cast("int"))
    met = met.sortWithinPartitions("slice", "block", "width", "asks")
    schema = T.StructType([
        rows.schema["entity"], rows.schema["pos"], T.StructField("near_entity", rows.schema["entity"].dataType),
        T.StructField("near_pos", rows.schema["pos"].dataType), T.StructField("score", T.LongType()),
    ])

    def search(batches):
        group, index, own = None, None, {}
        for batch in batches:
            out: list[tuple] = []
            types = [batch.schema.field(n).type for n in ("entity", "pos")] * 2 + [pa.int64()]
            for row in range(batch.num_rows):
                now = tuple(batch.column(c)[row].as_py() for c in ("width", "slice", "block"))
                if not batch.column("asks")[row].as_py():
                    cell = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
                    group, keys = now, list(zip(cell("entities"), cell("positions"), strict=True))
                    index = BitSlices.unpack(len(keys), cell("low"), cell("bits"), cell("planes"))
                    top = index.low + (1 << index.bits) - 1
                    own = defaultdict(list)
                    for i, key in enumerate(keys):
                        own[key].append(i)
                elif now == group:
                    weights = np.array(batch.column("q")[row].as_py(), np.int64)
                    key = (batch.column("entity")[row].as_py(), batch.column("pos")[row].as_py())
                    check_range(weights, np.stack([index.low, top]))
                    total, constant = index.weighted_sum(weights)
                    for near in index.top(total, own.get(key, []), k):
                        word, bit = near // 64, int(near % 64)
                        score = constant + sum((int(plane[word]) >> bit & 1) << p for p, plane in enumerate(total))
                        out.append((*key, *keys[near], score))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.name for f in schema.fields]
            )

    found = met.mapInArrow(search, schema)
    best = Window.partitionBy("entity", "pos").orderBy(
        F.desc("score"), F.asc_nulls_last("near_entity"), F.asc_nulls_last("near_pos")
    )
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "entity", "pos", "rank", "near_entity", "near_pos", "score"
    )
