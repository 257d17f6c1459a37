"""Gradient boosting of trees with second-order splits, for absolute error and for counts.

Each round fits a tree to gradients and curvatures of the loss, counted per (node, feature, code) over rows that are
binned once. A part (a series, or all rows) that fits one lot is boosted in one task, all parts side by side; for a larger part every level of
a round is one job: tasks add counts of their rows, and only splits come back. Both ways give the same model: rows
and features are sampled by hashes of row, round and feature.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.forest import (
    _TREES, FittedForest, _arrays, _record_batch, coded_parts, drawn, mixed, walked,
)
from panelcast.operators.screen import CODES, TIE
from panelcast.operators.storage import written

PART_ROWS = 65536
#: Rounds after which the margins of the rows of a large part are written anew.
KEPT_ROUNDS = 25


@dataclass(frozen=True)
class BoostPlan:
    """Settings of boosting; the defaults are fixed values of the published runs.

    ``objective`` is ``absolute`` (leaves are medians of what is left) or ``poisson`` (of counts, through a logarithm).
    ``min_child`` is the least curvature on a side of a split, ``l1`` and ``l2`` are penalties of leaf values.
    """

    objective: str = "absolute"
    rounds: int = 500
    rate: float = 0.03
    depth: int = 3
    min_child: float = 10.0
    row_share: float = 0.85
    feature_share: float = 0.8
    l1: float = 0.1
    l2: float = 10.0
    seed: int = 42

    def __post_init__(self):
        if self.objective not in ("absolute", "poisson"):
            raise ValueError(f"boosting has no objective {self.objective!r}")

    def salt(self, round_: int) -> int:
        return int(mixed(self.seed * 1_000_003 + round_))

    def rows(self, ids: np.ndarray, round_: int) -> np.ndarray:
        return np.flatnonzero(drawn(ids ^ np.uint64(self.salt(round_))) < self.row_share)

    def features(self, width: int, round_: int) -> np.ndarray:
        noise = mixed(np.arange(width, dtype=np.uint64) ^ mixed(self.salt(round_)))
        return np.sort(np.argsort(noise, kind="stable")[: max(1, round(width * self.feature_share))])

    def slopes(self, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss; absolute error counts every row as one."""
        if self.objective == "absolute":
            return np.sign(margin - y), np.ones(len(y))
        mean = np.exp(margin)
        return mean - y, mean

    def base(self, y: np.ndarray) -> float:
        if self.objective == "absolute":
            return float(np.median(y))
        return float(np.log(max(y.mean(), 1e-9)))

    def leaf(self, g, h):
        return -_shrunk(g, self.l1) / (h + self.l2)

    def gain(self, g, h):
        return _shrunk(g, self.l1) ** 2 / (h + self.l2)


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


@dataclass
class BoostTree:
    """A tree under way; ``open`` nodes are split next. ``g`` and ``h`` are sums of slopes per node."""

    features: np.ndarray
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    g: list[float] = field(default_factory=lambda: [0.0])
    h: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])
    depth: int = 0

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        return walked(codes, *(np.array(x) for x in (self.feature, self.cut, self.left, self.right)))

    def counts(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """(2, open nodes, tried features, codes): sums of gradients and curvatures."""
        slots = np.full(len(self.feature), -1)
        slots[self.open] = np.arange(len(self.open))
        slot = slots[self.nodes_of(codes)]
        rows = np.flatnonzero(slot >= 0)
        tried = len(self.features)
        cells = ((slot[rows, None] * tried + np.arange(tried)) * CODES + codes[rows[:, None], self.features]).ravel()
        size = len(self.open) * tried * CODES
        sums = [np.bincount(cells, np.repeat(v[rows], tried), minlength=size) for v in (g, h)]
        return np.stack(sums).reshape(2, len(self.open), tried, CODES)

    def grow(self, counts: np.ndarray, plan: BoostPlan) -> None:
        """Split the open nodes where the penalised loss falls most; the first feature and lowest code win ties."""
        below = counts.cumsum(axis=-1)
        total = below[:, :, :1, -1:]
        g, h = total
        g_left, h_left = below[..., :-1]
        if self.depth == 0:
            self.g[0], self.h[0] = float(g[0, 0, 0]), float(h[0, 0, 0])
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = plan.gain(g_left, h_left) + plan.gain(g - g_left, h - h_left) - plan.gain(g, h)
        gain = np.where((h_left >= plan.min_child) & (h - h_left >= plan.min_child), gain, -np.inf)
        flat, opened = gain.reshape(len(self.open), -1), []
        for i, node in enumerate(self.open):
            top = flat[i].max()
            if not top > TIE * (1.0 + abs(float(g[i, 0, 0]))):
                continue
            f, c = divmod(int(np.argmax(flat[i] >= top - TIE * abs(top))), CODES - 1)
            sides = (float(g_left[i, f, c]), float(h_left[i, f, c]))
            rest = (self.g[node] - sides[0], self.h[node] - sides[1])
            self.feature[node], self.cut[node] = int(self.features[f]), c
            self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
            for side in (sides, rest):
                opened.append(len(self.feature))
                for values, value in zip((self.feature, self.cut, self.left, self.right, self.g, self.h), (-1, -1, -1, -1, *side)):
                    values.append(value)
        self.depth += 1
        self.open = opened if self.depth < plan.depth else []

    def row(self, part: int, number: int, values: np.ndarray) -> tuple:
        return part, number, self.feature, self.cut, self.left, self.right, values.tolist()


def _leaf_values(tree: BoostTree, plan: BoostPlan, medians: Mapping[int, float]) -> np.ndarray:
    """What every node adds to the margin."""
    if plan.objective == "absolute":
        return plan.rate * np.array([medians.get(i, 0.0) for i in range(len(tree.feature))])
    return plan.rate * plan.leaf(np.array(tree.g), np.array(tree.h))


def boost_rows(plan: BoostPlan, codes: np.ndarray, y: np.ndarray, ids: np.ndarray, part: int = 0) -> list[tuple]:
    """All trees of one part as rows; tree -1 is the starting margin."""
    start = plan.base(y)
    margin = np.full(len(y), start)
    out = [(part, -1, [-1], [-1], [-1], [-1], [start])]
    for round_ in range(plan.rounds):
        g, h = plan.slopes(margin, y)
        rows = plan.rows(ids, round_)
        tree = BoostTree(plan.features(codes.shape[1], round_))
        own = codes[rows]
        while tree.open:
            tree.grow(tree.counts(own, g[rows], h[rows]), plan)
        node = tree.nodes_of(codes)
        medians: dict[int, float] = {}
        if plan.objective == "absolute":
            left = (y - margin)[rows]
            medians = {int(k): float(np.median(left[node[rows] == k])) for k in np.unique(node[rows])}
        values = _leaf_values(tree, plan, medians)
        margin = margin + values[node]
        out.append(tree.row(part, round_, values))
    return out


def _boosted_parts(data: DataFrame, plans: Mapping[int, BoostPlan]) -> DataFrame:
    """Parts whose rows meet in one task each."""

    def boost(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        codes, labels, ids = _arrays(table.sort_by("row"))
        return pa.Table.from_batches([_record_batch(boost_rows(plans[part], codes, labels, ids, part), _TREES)])

    return data.repartition(max(1, len(plans)), "part").groupBy("part").applyInArrow(boost, _TREES)


def _boosted_rows(data: DataFrame, part: int, plan: BoostPlan, width: int) -> DataFrame:
    """One part of any size, a job per level of a round (and one for the medians of absolute error)."""
    spark = data.sparkSession
    own = data.where(F.col("part") == part)
    start = F.expr("percentile(label, 0.5)") if plan.objective == "absolute" else F.log(F.greatest(F.avg("label"), F.lit(1e-9)))
    base = float(own.agg(start).first()[0])
    out = [(part, -1, [-1], [-1], [-1], [-1], [base])]
    state = own.withColumn("margin", F.lit(base))
    pending: list[tuple] = []

    def sampled(batch: pa.RecordBatch, round_: int | None, pending: list[tuple]):
        table = pa.Table.from_batches([batch])
        codes, y, ids = _arrays(table)
        margin = table["margin"].to_numpy().copy()
        for row in pending:
            shape = [np.array(x) for x in row[2:6]]
            margin += np.array(row[6])[walked(codes, *shape)]
        rows = np.arange(len(y)) if round_ is None else plan.rows(ids, round_)
        return codes, y, margin, rows

    def count(tree: BoostTree, round_: int, pending: list[tuple]):
        def run(batches):
            total = None
            for batch in batches:
                codes, y, margin, rows = sampled(batch, round_, pending)
                g, h = plan.slopes(margin, y)
                counts = tree.counts(codes[rows], g[rows], h[rows])
                total = counts if total is None else total + counts
            if total is not None:
                yield _record_batch([(0, total.tobytes())], "part int, counts binary")

        def add(table: pa.Table) -> pa.Table:
            counts = sum(np.frombuffer(packed) for packed in table["counts"].to_pylist())
            return pa.Table.from_batches([_record_batch([(0, counts.tobytes())], "part int, counts binary")])

        found = state.mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
        return np.frombuffer(found[0]["counts"]).reshape(2, len(tree.open), -1, CODES)

    def residuals(tree: BoostTree, round_: int, pending: list[tuple]):
        def run(batches):
            for batch in batches:
                codes, y, margin, rows = sampled(batch, round_, pending)
                node = tree.nodes_of(codes[rows])
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array((y - margin)[rows])], names=["node", "rest"])

        middles = state.mapInArrow(run, "node int, rest double").groupBy("node").agg(F.expr("percentile(rest, 0.5)").alias("m"))
        return {r["node"]: r["m"] for r in middles.collect()}

    def moved(pending: list[tuple]):
        def run(batches):
            for batch in batches:
                _, _, margin, _ = sampled(batch, None, pending)
                yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin))

        return written(state.mapInArrow(run, state.schema))

    for round_ in range(plan.rounds):
        tree = BoostTree(plan.features(width, round_))
        while tree.open:
            tree.grow(count(tree, round_, list(pending)), plan)
        medians = residuals(tree, round_, list(pending)) if plan.objective == "absolute" else {}
        pending.append(tree.row(part, round_, _leaf_values(tree, plan, medians)))
        out.append(pending[-1])
        if len(pending) == KEPT_ROUNDS:
            state, pending = moved(list(pending)), []
    return spark.createDataFrame(out, _TREES)


class FittedBoost(FittedForest):
    """Boosted trees of all parts: ``predict`` adds a non-negative ``prediction``, null for a row of no part."""

    def _value(self, total, trees):
        value = F.when(trees > 0, total)
        for i, plan in enumerate(self.plans.values()):
            if plan.objective == "poisson":
                value = F.when((F.col("_part") == i) & (trees > 0), F.exp(total)).otherwise(value)
        return value


def fit_boosts(
    train: DataFrame, columns: Sequence[str], target: str, plan: BoostPlan | Mapping[object, BoostPlan],
    entity: str | None = None, keys: Sequence[str] | None = None,
) -> FittedBoost:
    """Boost over all rows, or with ``entity`` for every series named in ``plan``, all small ones in the same job.

    Values are cut at 31 quantiles of all training rows; missing ones count as larger than all others. Rows without a target take no part.
    ``keys`` tell rows apart for sampling, by default all columns. A part of at most ``PART_ROWS`` rows meets in a
    task; of a larger one tasks see only counts. Medians of a large part's leaves are aggregated over distinct values. A part without rows predicts null.
    """
    plans = {None: plan} if entity is None else dict(plan)
    columns, by_number = list(columns), dict(enumerate(plans.values()))
    edges, data = coded_parts(train, columns, target, entity, list(plans), F.lit(False), keys)
    sizes = {r["part"]: r["count"] for r in data.groupBy("part").count().collect()}
    small = {p: by_number[p] for p, n in sizes.items() if n <= PART_ROWS}
    grown = [_boosted_parts(data.where(F.col("part").isin(list(small))), small)] if small else []
    grown += [_boosted_rows(data, p, by_number[p], len(columns)) for p, n in sizes.items() if n > PART_ROWS]
    trees = train.sparkSession.createDataFrame([], _TREES) if not grown else grown[0]
    for more in grown[1:]:
        trees = trees.unionByName(more)
    return FittedBoost(written(trees), columns, edges, plans, entity)
