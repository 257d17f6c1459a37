"""Forests of regression trees with random thresholds, Poisson splits and sampling by hash.

Rows are binned to small codes once. A tree is grown level by level from counts of (rows, target sum) per
(node, feature, code), so growing needs sums over rows only. A part (a series, or all rows) that fits one lot grows whole trees in tasks,
a few trees each; of a larger part the tasks count lots, the counts of a tree are added, and its splits go back to
the tasks. Both ways give the same trees: samples, features and thresholds come from hashes of row, tree and node.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import expm1_target, log1p_target
from panelcast.operators.screen import BINS, CODES, LOT_ROWS, TIE, _code, _edges, _fixed
from panelcast.operators.storage import written

PART_ROWS = 65536
TREE_GROUPS = 32
LEVEL_CELLS = 1 << 24
SENT_NODES = 4_000_000

_TREES = "part int, tree int, feature array<int>, cut array<int>, left array<int>, right array<int>, value array<double>"
_CHOICES = "part int, tree int, node int, feature int, cut int, n_left double, s_left double"
_SUMS = "row long, total double, trees long"


@dataclass(frozen=True)
class ForestPlan:
    """Settings of a forest; the defaults are fixed values of the published runs.

    ``extra`` draws one threshold per feature and node and uses all rows; otherwise rows are drawn with
    replacement and every threshold is tried. ``criterion`` is ``squared`` or ``poisson`` (deviance). ``log_target``
    fits log(1 + y). ``share`` of the features is tried at a node: by default a third, with random thresholds all.
    """

    trees: int = 500
    min_leaf: int = 5
    max_depth: int = 12
    share: float | None = None
    extra: bool = False
    criterion: str = "squared"
    log_target: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.criterion not in ("squared", "poisson"):
            raise ValueError(f"no criterion {self.criterion!r}")
        if self.criterion == "poisson" and self.log_target:
            raise ValueError("Poisson splits are of counts, not of their logarithms")

    def tried(self, width: int) -> int:
        """Features tried at a node."""
        share = self.share if self.share is not None else 1.0 if self.extra else 1 / 3
        return max(1, round(width * share))


# Odd constants of a 64-bit mixing function.
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(_STEP)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_FIRST)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_SECOND)
    return x ^ (x >> np.uint64(31))


def drawn(x) -> np.ndarray:
    """A number in [0, 1) from a hash."""
    return (mixed(x) >> np.uint64(11)).astype(np.float64) * 2.0**-53


_POISSON_STEPS = np.exp(-1.0) * np.cumsum(1.0 / np.cumprod([1.0, *range(1, 12)]))


def row_weights(ids: np.ndarray, salt: int) -> np.ndarray:
    """How often each row is drawn: Poisson with mean one."""
    return np.searchsorted(_POISSON_STEPS, drawn(ids ^ np.uint64(salt)), side="right").astype(np.float64)


def walked(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The node that each row reaches in a tree."""
    node, moving = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while len(moving):
        moving = moving[feature[node[moving]] >= 0]
        at = node[moving]
        node[moving] = np.where(codes[moving, feature[at]] <= cut[at], left[at], right[at])
    return node


@dataclass
class Tree:
    """A tree under way. ``open`` nodes are split next; for each, its path number and the codes left open per feature."""

    plan: ForestPlan
    number: int
    width: int
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [-1])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    size: list[float] = field(default_factory=lambda: [0.0])
    total: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [1])
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    depth: int = 0

    def __post_init__(self):
        if self.low is None:
            self.low = np.zeros((1, self.width), np.int64)
            self.high = np.full((1, self.width), BINS, np.int64)

    @property
    def salt(self) -> int:
        return int(mixed(self.plan.seed * 1_000_003 + self.number))

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(features, thresholds) tried at every open node; a threshold only counts for ``extra``, -1 where none is left."""
        nodes = mixed(np.array(self.path, np.uint64) ^ np.uint64(self.salt))[:, None]
        noise = mixed(nodes ^ mixed(np.arange(self.width, dtype=np.uint64))[None])
        features = np.sort(np.argsort(noise, axis=1, kind="stable")[:, : self.plan.tried(self.width)], axis=1)
        at = np.arange(len(features))[:, None]
        low, high = self.low[at, features], self.high[at, features]
        cuts = low + np.floor(drawn(noise[at, features] ^ np.uint64(self.plan.seed)) * (high - low)).astype(np.int64)
        return features, np.where(high > low, cuts, -1)

    def nodes_of(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row has reached."""
        return walked(codes, *(np.array(x) for x in (self.feature, self.cut, self.left, self.right)))

    def counts(self, codes: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(2, open nodes, features, codes) rows and sums; for ``extra`` the last axis is (left, all)."""
        features, cuts = self.candidates()
        wide = 2 if self.plan.extra else CODES
        out = np.zeros((2, features.size * wide))
        slots = np.full(len(self.feature), -1)
        slots[self.open] = np.arange(len(self.open))
        for start in range(0, len(codes), LOT_ROWS):
            lot = slice(start, start + LOT_ROWS)
            slot = slots[self.nodes_of(codes[lot])]
            weight = np.ones(len(slot)) if self.plan.extra else row_weights(ids[lot], self.salt)
            rows = np.flatnonzero((slot >= 0) & (weight > 0))
            slot, weight, y = slot[rows], weight[rows], labels[lot][rows]
            code = codes[lot][rows[:, None], features[slot]]
            cell = slot[:, None] * features.shape[1] + np.arange(features.shape[1])
            weights, sums = (np.repeat(v, features.shape[1]) for v in (weight, weight * y))
            if self.plan.extra:
                cells = (cell * 2 + (code > cuts[slot])).ravel()
            else:
                cells = (cell * CODES + code).ravel()
            out[0] += np.bincount(cells, weights, minlength=out.shape[1])
            out[1] += np.bincount(cells, sums, minlength=out.shape[1])
        return out.reshape(2, *features.shape, wide)

    def choose(self, counts: np.ndarray) -> list[tuple]:
        """(node, feature, cut, rows left, sum left) for every open node, feature -1 for a leaf; then its rows and sum."""
        features, cuts = self.candidates()
        below = counts.cumsum(axis=-1)
        n, s = below[..., -1][..., None]
        n_left, s_left = below[..., :-1]
        gain = _gain(n_left, s_left, n, s, self.plan)
        if self.plan.extra:
            gain = np.where(cuts[..., None] >= 0, gain, -np.inf)
        flat = gain.reshape(len(features), -1)
        top = flat.max(axis=1)
        best = np.argmax(flat >= (top - TIE * np.abs(top))[:, None], axis=1)
        out = []
        for i, node in enumerate(self.open):
            f, c = divmod(int(best[i]), gain.shape[-1])
            size, total = float(n[i, 0, 0]), float(s[i, 0, 0])
            if not top[i] > TIE * (1.0 + abs(total)):
                out.append((node, -1, -1, size, total))
                continue
            cut = int(cuts[i, f]) if self.plan.extra else c
            out.append((node, int(features[i, f]), cut, float(n_left[i, f, c]), float(s_left[i, f, c])))
            if node == 0:
                self.size[0], self.total[0] = size, total
        return out

    def extend(self, choices: list[tuple]) -> None:
        """Split the open nodes as chosen and open their sides."""
        places = {node: i for i, node in enumerate(self.open)}
        opened, paths, lows, highs = [], [], [], []
        for node, feature, cut, n_left, s_left in choices:
            if feature < 0:
                if node == 0:
                    self.size[0], self.total[0] = n_left, s_left
                continue
            i, sides = places[node], []
            for right, (n, s) in enumerate(((n_left, s_left), (self.size[node] - n_left, self.total[node] - s_left))):
                child = len(self.feature)
                sides.append(child)
                for values, value in zip((self.feature, self.cut, self.left, self.right, self.size, self.total), (-1, -1, -1, -1, n, s)):
                    values.append(value)
                if n >= 2 * self.plan.min_leaf and self.depth + 1 < self.plan.max_depth:
                    low, high = self.low[i].copy(), self.high[i].copy()
                    if right:
                        low[feature] = max(low[feature], cut + 1)
                    else:
                        high[feature] = min(high[feature], cut)
                    opened.append(child), paths.append(2 * self.path[i] + right), lows.append(low), highs.append(high)
            self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, *sides
        self.open, self.path, self.depth = opened, paths, self.depth + 1
        self.low = np.array(lows, np.int64).reshape(-1, self.width)
        self.high = np.array(highs, np.int64).reshape(-1, self.width)

    def row(self, part: int) -> tuple:
        value = [s / n if n else 0.0 for n, s in zip(self.size, self.total)]
        return part, self.number, self.feature, self.cut, self.left, self.right, value


def _gain(n_left, s_left, n, s, plan: ForestPlan) -> np.ndarray:
    """Fall of squared error or of half the Poisson deviance; -inf for a side below ``min_leaf`` rows or, for
    counts, without any count."""
    n_right, s_right = n - n_left, s - s_left
    fine = (n_left >= plan.min_leaf) & (n_right >= plan.min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        if plan.criterion == "poisson":
            fine &= (s_left > 0) & (s_right > 0)
            gain = s_left * np.log(s_left / n_left) + s_right * np.log(s_right / n_right) - s * np.log(s / n)
        else:
            gain = s_left**2 / n_left + s_right**2 / n_right - s**2 / n
    return np.where(fine, gain, -np.inf)


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = table["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    return codes.astype(np.int64), table["label"].to_numpy(), table["row"].to_numpy().astype(np.int64).view(np.uint64)


def _record_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(),
             "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def _whole_trees(data: DataFrame, plans: Mapping[int, ForestPlan], width: int) -> DataFrame:
    """Trees of parts whose rows meet in one task per group of trees."""
    groups = min(TREE_GROUPS, max((p.trees for p in plans.values()), default=1))
    spread = data.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, group = (k.as_py() for k in key)
        rows, out = _arrays(table.sort_by("row")), []
        for number in range(group, plans[part].trees, groups):
            tree = Tree(plans[part], number, width)
            while tree.open:
                tree.extend(tree.choose(tree.counts(*rows)))
            if tree.size[0]:
                out.append(tree.row(part))
        return pa.Table.from_batches([_record_batch(out, _TREES)])

    return spread.repartition(groups * max(1, len(plans)), "part", "group").groupBy("part", "group").applyInArrow(grow, _TREES)


def _grown_by_level(data: DataFrame, plans: Mapping[int, ForestPlan], width: int) -> DataFrame:
    """Trees of parts of any size: per level and lot of trees one job counts, the driver sees the splits.

    A lot has at most ``LEVEL_CELLS`` counts, which bounds what a task holds.
    """
    spark = data.sparkSession
    trees = {(p, t): Tree(plan, t, width) for p, plan in plans.items() for t in range(plan.trees)}
    while any(tree.open for tree in trees.values()):
        for lot in _lots(trees):
            found: dict[tuple, list] = {}
            for r in _choices(data, lot).collect():
                found.setdefault((r["part"], r["tree"]), []).append(tuple(r)[2:])
            for key, tree in lot.items():
                chosen = sorted(found.get(key, []))
                tree.size[0], tree.total[0] = next(((n, s) for node, f, _, n, s in chosen if node < 0), (tree.size[0], tree.total[0]))
                tree.extend([c for c in chosen if c[0] >= 0])
    rows = [tree.row(part) for (part, _), tree in trees.items() if tree.size[0]]
    return spark.createDataFrame(rows, _TREES)


def _lots(trees: Mapping[tuple, Tree]) -> Iterator[dict]:
    lot, cells = {}, 0
    for key, tree in trees.items():
        if not tree.open:
            continue
        own = len(tree.open) * tree.plan.tried(tree.width) * CODES
        if lot and cells + own > LEVEL_CELLS:
            yield lot
            lot, cells = {}, 0
        lot[key] = tree
        cells += own
    if lot:
        yield lot


def _choices(data: DataFrame, lot: Mapping[tuple, Tree]) -> DataFrame:
    by_part: dict[int, list[Tree]] = {}
    for (part, _), tree in lot.items():
        by_part.setdefault(part, []).append(tree)

    def count(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            parts = table["part"].to_numpy()
            for part in np.unique(parts):
                rows = _arrays(table.filter(pa.array(parts == part)))
                for tree in by_part.get(int(part), []):
                    counts, key = tree.counts(*rows), (int(part), tree.number)
                    held[key] = held[key] + counts if key in held else counts
        for key, counts in held.items():
            yield _record_batch([(*key, counts.tobytes())], "part int, tree int, counts binary")

    def choose(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, number = (k.as_py() for k in key)
        tree = lot[part, number]
        counts = sum(np.frombuffer(packed) for packed in table["counts"].to_pylist())
        wide = 2 if tree.plan.extra else CODES
        chosen = tree.choose(counts.reshape(2, len(tree.open), -1, wide))
        # Node -1 carries rows and sum of the root, which its own choice does not name.
        rows = [(part, number, *c) for c in chosen]
        if tree.open == [0] and chosen[0][1] >= 0:
            rows.append((part, number, -1, -1, -1, tree.size[0], tree.total[0]))
        return pa.Table.from_batches([_record_batch(rows, _CHOICES)])

    counted = data.mapInArrow(count, "part int, tree int, counts binary")
    return counted.groupBy("part", "tree").applyInArrow(choose, _CHOICES)


class FittedForest:
    """Grown trees of all parts: ``predict`` adds a non-negative ``prediction``, null for a row of no part."""

    def __init__(self, trees: DataFrame, columns: Sequence[str], edges: Mapping, plans: Mapping, entity: str | None):
        self.trees, self.columns, self.edges, self.plans, self.entity = trees, list(columns), edges, dict(plans), entity

    def predict(self, df: DataFrame) -> DataFrame:
        """Trees go to the rows in lots of at most ``SENT_NODES`` nodes; sums of a row are added over lots."""
        numbered = written(_coded(df, self.columns, self.edges, self.entity, list(self.plans)).withColumn("_row", F.monotonically_increasing_id()))
        sizes = self.trees.select("part", "tree", F.size("feature").alias("nodes")).collect()
        lots, room = [[]], SENT_NODES
        for r in sorted(sizes):
            if lots[-1] and r["nodes"] > room:
                lots.append([])
                room = SENT_NODES
            lots[-1].append((r["part"], r["tree"]))
            room -= r["nodes"]
        sums = None
        for lot in lots:
            if lot:
                found = self._sums(numbered, lot)
                sums = found if sums is None else sums.unionByName(found)
        if sums is None:
            return df.withColumn("prediction", F.lit(None).cast("double"))
        if len(lots) > 1:
            sums = sums.groupBy("row").agg(F.sum("total").alias("total"), F.sum("trees").alias("trees"))
        met = numbered.join(sums.withColumnRenamed("row", "_row"), "_row", "left")
        value = self._value(F.col("total"), F.col("trees"))
        return met.select(*df.columns, F.when(value.isNotNull(), F.greatest(value, F.lit(0.0))).alias("prediction"))

    def _value(self, total, trees):
        """The mean of all trees, on the scale of the target."""
        mean = F.when(trees > 0, total / trees)
        value = mean
        for i, plan in enumerate(self.plans.values()):
            if plan.log_target:
                value = F.when(F.col("_part") == i, expm1_target(mean)).otherwise(value)
        return value

    def _sums(self, numbered: DataFrame, lot: list[tuple[int, int]]) -> DataFrame:
        first, last = min(lot), max(lot)
        key = F.struct("part", "tree")
        inside = key.between(F.struct(F.lit(first[0]), F.lit(first[1])), F.struct(F.lit(last[0]), F.lit(last[1])))
        by_part: dict[int, list[tuple]] = {}
        for r in self.trees.where(inside).collect():
            by_part.setdefault(r["part"], []).append(tuple(np.array(r[c]) for c in ("feature", "cut", "left", "right", "value")))
        sent = numbered.sparkSession.sparkContext.broadcast(by_part)
        width = len(self.columns)

        def score(batches):
            for batch in batches:
                table = pa.Table.from_batches([batch])
                codes = table["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)
                parts, total, trees = table["part"].to_numpy(zero_copy_only=False), np.zeros(len(table)), np.zeros(len(table), np.int64)
                for part, own in sent.value.items():
                    rows = np.flatnonzero(parts == part)
                    held = codes[rows]
                    for *shape, value in own if len(rows) else []:
                        total[rows] += value[walked(held, *shape)]
                        trees[rows] += 1
                yield pa.RecordBatch.from_arrays([table["row"].combine_chunks(), pa.array(total), pa.array(trees)], names=["row", "total", "trees"])

        narrow = numbered.select(F.col("_row").alias("row"), F.coalesce("_part", F.lit(-1)).alias("part"), F.col("_codes").alias("codes"))
        return narrow.mapInArrow(score, _SUMS)


def _coded(df: DataFrame, columns: Sequence[str], edges: Mapping, entity: str | None, parts: list) -> DataFrame:
    """``df`` with ``_part`` (number of its part, null for none) and ``_codes``."""
    part = F.lit(0) if entity is None else F.coalesce(*[F.when(F.col(entity) == k, F.lit(i)) for i, k in enumerate(parts)])
    codes = F.array(*[_code(F.col(c).cast("double"), edges[f"_edges_{c}"]) for c in columns]).cast("array<byte>")
    return df.withColumns({"_part": part, "_codes": codes})


def coded_parts(train: DataFrame, columns: list[str], target: str, entity: str | None, parts: list, logged, keys) -> tuple[Mapping, DataFrame]:
    """Quantile edges of the columns, and rows as (part, ``row`` hash, label, codes), written."""
    label = F.col(target).cast("double")
    rows = train.where(label.isNotNull() & ~F.isnan(label))
    values = {f"_edges_{c}": F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    edges = _fixed(_edges(rows, values, []))
    data = written(_coded(rows, columns, edges, entity, parts).where(F.col("_part").isNotNull()).select(
        F.col("_part").alias("part"), F.xxhash64(*(keys or train.columns)).alias("row"),
        F.when(logged, log1p_target(target)).otherwise(label).cast("double").alias("label"), F.col("_codes").alias("codes"),
    ))
    return edges, data


def fit_forests(
    train: DataFrame, columns: Sequence[str], target: str, plan: ForestPlan | Mapping[object, ForestPlan],
    entity: str | None = None, keys: Sequence[str] | None = None,
) -> FittedForest:
    """Grow one forest over all rows, or with ``entity`` one per series named in ``plan``, all in the same jobs.

    Values are cut at 31 quantiles of all training rows; missing ones count as larger than all others. Rows without a target take no part.
    ``keys`` tell rows apart for drawing them, by default all columns; equal rows are drawn alike, and a tree that draws no
    row is left out. A tree depends on rows, plan and
    number only, not on partitions. Tasks hold a part of at most ``PART_ROWS`` rows, or counts of a lot of trees. A part without rows
    predicts null.
    """
    plans = {None: plan} if entity is None else dict(plan)
    columns, by_number = list(columns), dict(enumerate(plans.values()))
    logged = F.coalesce(*[F.when(F.col("_part") == i, F.lit(p.log_target)) for i, p in by_number.items()])
    edges, data = coded_parts(train, columns, target, entity, list(plans), logged, keys)
    sizes = {r["part"]: r["count"] for r in data.groupBy("part").count().collect()}
    small = {p: by_number[p] for p, n in sizes.items() if n <= PART_ROWS}
    large = {p: by_number[p] for p, n in sizes.items() if n > PART_ROWS}
    grown = [
        grow(data.where(F.col("part").isin(list(own))), own, len(columns))
        for grow, own in ((_whole_trees, small), (_grown_by_level, large)) if own
    ]
    if not grown:
        grown = [train.sparkSession.createDataFrame([], _TREES)]
    trees = grown[0] if len(grown) == 1 else grown[0].unionByName(grown[1])
    return FittedForest(written(trees), columns, edges, plans, entity)
