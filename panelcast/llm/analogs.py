"""Nearest histories by randomly rotated one-bit codes.

A history is the feature vector of a row of a panel (`multiscale_features`, `raw_lag_features`: columns
entity, pos, features). Weeks of any series with a like past are found by the largest inner product.
Each vector is rotated at random and only the signs are kept, with two numbers: its length and how well
the signs fit it. From these follow an estimate of the inner product and a bound on its error; exact
products are computed only where the bound leaves room among the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import pieces, saved, small_batches

SLICE_ROWS = 8192
QUERY_ROWS = 4096
CHUNK = 256
WIDTH_OF_BOUND = 2.5
_CODE_FIELDS = "width int, code binary, norm double, fit double, vector binary"


def rotation(width: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, width]).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def index_histories(
    histories: DataFrame, entity: str = "entity", order: str = "pos", features: str = "features", seed: int = 0
) -> DataFrame:
    """(entity, pos, width, code, norm, fit, vector): packed signs of the rotated vector, its length, the
    inner product of the unit vector with its signs, and the vector in double precision.

    Vectors that are null, empty or zero, or hold null or non-finite components, are left out.
    """
    rows = histories.select(
        F.col(f"`{entity}`").alias("entity"), F.col(f"`{order}`").alias("pos"),
        F.col(f"`{features}`").cast("array<double>").alias("features"),
    )
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string(_CODE_FIELDS).fields])

    def encode(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in small_batches(batches, 4096):
            kept, out = [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                if not v or any(x is None for x in v):
                    continue
                v = np.array(v)
                norm = float(np.sqrt(v @ v))
                if not np.isfinite(norm) or norm == 0.0:
                    continue
                if len(v) not in turns:
                    turns[len(v)] = rotation(len(v), seed)
                turned = (v / norm) @ turns[len(v)]
                fit = float(np.abs(turned).sum() / np.sqrt(len(v)))
                kept.append(i)
                out.append((len(v), np.packbits(turned > 0).tobytes(), norm, fit, v.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64())),
                    pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.float64()),
                    pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.binary()),
                ],
                names=[f.name for f in schema.fields],
            )

    return rows.mapInArrow(encode, schema)


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added in their order."""
    total = np.zeros(len(x))
    for d in range(x.shape[1] if x.ndim == 2 else 0):
        total += x[:, d] * y[:, d]
    return total


def _best_of(own: np.ndarray, query: np.ndarray, estimate: np.ndarray, bound: np.ndarray, barred: list[int], k: int):
    """The ``k`` best rows of a slice for one query, and those that rounding cannot tell from the last."""
    free = len(own) - len(barred)
    if free <= 0:
        return np.zeros(0, np.int64)
    estimate[barred] = -np.inf
    first = np.argpartition(-estimate, min(k, free) - 1)[: min(k, free)]
    floor = np.einsum("ij,j->i", own[first], query).min()
    rows = np.flatnonzero(estimate + bound >= floor)
    rows = np.union1d(rows, first)
    near = np.einsum("ij,j->i", own[rows], query)
    if len(rows) > k:
        last = np.partition(near, len(near) - k)[len(near) - k]
        rows = rows[near >= last - 1e-9 * max(1.0, abs(last))]
    if len(rows) > 2 * k:  # many equal candidates: rows are in the order that breaks ties
        exact = _products(own[rows], np.broadcast_to(query, (len(rows), len(query))))
        rows = rows[np.argsort(-exact, kind="stable")[:k]]
    return rows


def nearest_histories(
    histories: DataFrame, queries: DataFrame, k: int = 20, entity: str = "entity", order: str = "pos",
    features: str = "features", seed: int = 0,
) -> DataFrame:
    """(entity, pos, ``rank`` from 1, ``near_entity``, ``near_pos``, ``score``): for every row of
    ``queries`` its ``k`` rows of ``histories`` with the largest inner product in double precision.

    A row is known by (entity, pos); rows with the query's own key are no candidates. Fewer candidates
    than ``k`` are all returned; ties go to the smaller (entity, pos). Vectors meet only those of the same
    width. Repeated candidates count separately, a repeated query key is asked once per distinct
    vector. Empty tables give no rows. Every history is indexed and every query looks at every code;
    queries and codes meet in pairs of blocks, each of a bounded number of rows. An estimate is off by more than its
    bound with a small probability only, which is all that recall can lose.
    """
    index = saved(index_histories(histories, entity, order, features, seed), "codes")
    asked = saved(index_histories(queries, entity, order, features, seed).dropDuplicates(["entity", "pos", "vector"]), "asked")
    slices, blocks = pieces(index.count(), SLICE_ROWS), pieces(asked.count(), QUERY_ROWS)
    spread = lambda df, own, own_n, other, other_n: df.withColumn(
        own, F.pmod(F.xxhash64("entity", "pos"), F.lit(own_n))
    ).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_n - 1)).cast("array<bigint>")))
    codes = spread(index, "slice", slices, "block", blocks)
    wanted = spread(asked.drop("code", "fit"), "block", blocks, "slice", slices)
    key = ["width", "slice", "block"]
    kinds = {f.name: f.dataType for f in index.schema.fields}
    schema = T.StructType([
        T.StructField("entity", kinds["entity"]), T.StructField("pos", kinds["pos"]),
        T.StructField("near_entity", kinds["entity"]), T.StructField("near_pos", kinds["pos"]),
        T.StructField("score", T.DoubleType()),
    ])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f.name for f in schema.fields]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, _arrow_types(schema), strict=True)})
        left = left.sort_by([("entity", "ascending"), ("pos", "ascending")])
        width = left["width"][0].as_py()
        own, ask = _vectors(left["vector"], width), _vectors(right["vector"], width)
        signs = np.unpackbits(
            np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(own), -1), axis=1, count=width
        )
        signs = signs.astype(np.float32) * 2 - 1
        norm, fit = left["norm"].to_numpy(), left["fit"].to_numpy()
        scale = (norm / (fit * np.sqrt(width))).astype(np.float32)
        slack = (norm * np.sqrt(np.maximum(0.0, 1 - fit**2)) / fit * WIDTH_OF_BOUND / np.sqrt(max(1, width - 1))).astype(np.float32)
        turned = (ask @ rotation(width, seed)).astype(np.float32)
        lengths = right["norm"].to_numpy()
        barred: dict = {}
        for i, name in enumerate(zip(left["entity"].to_pylist(), left["pos"].to_pylist(), strict=True)):
            barred.setdefault(name, []).append(i)
        keys = list(zip(right["entity"].to_pylist(), right["pos"].to_pylist(), strict=True))
        queries_at, rows = [], []
        for start in range(0, len(ask), CHUNK):
            estimates = (turned[start : start + CHUNK] @ signs.T) * scale
            for i, estimate in enumerate(estimates, start):
                bound = slack * np.float32(lengths[i])
                found = _best_of(own, ask[i], estimate, bound, barred.get(keys[i], []), k)
                queries_at.append(np.full(len(found), i))
                rows.append(found)
        at, near = np.concatenate(queries_at).astype(np.int64), np.concatenate(rows).astype(np.int64)
        scores = _products(ask[at], own[near])
        order = np.lexsort((near, -scores, at))
        at, near, scores = at[order], near[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        at, near, scores = at[place < k], near[place < k], scores[place < k]
        q, r = pa.array(at), pa.array(near)
        return pa.table([
            right["entity"].take(q), right["pos"].take(q), left["entity"].take(r), left["pos"].take(r), pa.array(scores),
        ], names=names)

    found = codes.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(search, schema)
    best = Window.partitionBy("entity", "pos").orderBy(F.col("score").desc(), "near_entity", "near_pos")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "entity", "pos", "rank", "near_entity", "near_pos", "score"
    )


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
