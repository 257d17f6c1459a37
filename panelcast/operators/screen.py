"""Choice of history lengths by decision trees, all cells of the grid grown together level by level.

A cell is a (signal, length, fold); its tree sees the last L values of the signal. Values are binned once and
lagged as small codes. Rows stay where they are: a level sends the trees so far to the tasks, every
task counts (rows, target sum) per (fold, node, lag, bin), and the counts are added by node to find its splits.
So depth 5 is five jobs, whatever the number of cells.

Lengths share work: length L uses the first L lags, so the best split of a node for every length is a prefix maximum over
lags. A node belongs to an interval of lengths, and only where a longer history splits it otherwise do they part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.history import raw_lag_arrays
from panelcast.operators.storage import written

BINS = 32
MISSING = BINS
CODES = BINS + 1
LOT_ROWS = 8192
TASK_ROWS = 65536
QUANTILE_ACCURACY = 10_000
#: A split must be better than one on fewer or earlier lags by more than rounding of sums.
TIE = 1e-9

_COUNTED = "part int, signal int, fold int, node int, counts binary"
_SPLITS = "part int, signal int, fold int, node int, n double, s double, lo int, hi int, feature int, bin int, n_left double, s_left double"
_ERRORS = "entity_row string, signal int, length int, total double, rows long"


@dataclass
class Node:
    """A node of the trees of lengths number ``lo`` to ``hi``; ``splits`` are (lo, hi, feature, bin, left, right).

    ``n`` rows sum to ``s``. Lengths without a split have a leaf here. Feature 0 is the level of the series,
    feature j the value j - 1 rows back.
    """

    lo: int
    hi: int
    n: float = 0.0
    s: float = 0.0
    depth: int = 0
    open: bool = True
    splits: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)


Trees = dict[tuple[int, int, int], list[Node]]


@dataclass(frozen=True)
class Grid:
    lengths: tuple[int, ...]
    folds: int
    chronological: bool
    depth: int
    min_leaf: int
    level: bool

    def trains(self, fold_of_row: np.ndarray, fold: int) -> np.ndarray:
        return fold_of_row < fold if self.chronological else fold_of_row != fold


def routed(tree: list[Node], codes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, rows) for every node that the rows reach."""
    stack = [(0, rows)]
    while stack:
        number, here = stack.pop()
        if not len(here):
            continue
        yield number, here
        for _, _, feature, cut, left, right in tree[number].splits:
            less = codes[here, feature] <= cut
            stack += [(left, here[less]), (right, here[~less])]


def bin_counts(codes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """(2, features, codes): rows and label sums per feature and code."""
    width = codes.shape[1]
    out = np.zeros((2, width * CODES))
    offsets = np.arange(width) * CODES
    for start in range(0, len(codes), LOT_ROWS):
        lot = (codes[start : start + LOT_ROWS] + offsets).ravel()
        out[0] += np.bincount(lot, minlength=width * CODES)
        out[1] += np.bincount(lot, weights=np.repeat(labels[start : start + LOT_ROWS], width), minlength=width * CODES)
    return out.reshape(2, width, CODES)


def best_cuts(counts: np.ndarray, min_leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per feature: gain in squared error, bin, rows and sum of the left side of its best cut.

    A cut needs ``min_leaf`` rows on both sides; without one the gain is -inf. The lowest bin wins a tie.
    """
    n, s = counts[0].cumsum(axis=1), counts[1].cumsum(axis=1)
    total_n, total_s = n[:, -1:], s[:, -1:]
    n, s = n[:, :-1], s[:, :-1]
    fine = (n >= min_leaf) & (total_n - n >= min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / n + (total_s - s) ** 2 / (total_n - n) - total_s * total_s / total_n
    gain = np.where(fine, gain, -np.inf)
    top = gain.max(axis=1, keepdims=True)
    cut = np.argmax(gain >= top - TIE * np.abs(top), axis=1)
    at = np.arange(len(cut))
    return gain[at, cut], cut, n[at, cut], s[at, cut]


def interval_splits(counts: np.ndarray, node: Node, grid: Grid) -> list[tuple]:
    """(lo, hi, feature, bin, n_left, s_left) for the lengths of a node, feature -1 where none splits it."""
    gain, cut, n_left, s_left = best_cuts(counts, grid.min_leaf)
    scale = TIE * (1.0 + counts[1][0].sum() ** 2 / max(1.0, counts[0][0].sum()))
    best, feature, out, seen = 0.0, -1, [], 0 if grid.level else 1
    for i in range(node.lo, node.hi + 1):
        while seen <= grid.lengths[i]:
            if gain[seen] > best + scale:
                best, feature = gain[seen], seen
            seen += 1
        if out and out[-1][2] == feature:
            out[-1] = (out[-1][0], i, *out[-1][2:])
        elif feature < 0:
            out.append((i, i, -1, -1, 0.0, 0.0))
        else:
            out.append((i, i, feature, int(cut[feature]), float(n_left[feature]), float(s_left[feature])))
    return out


def _units(batches, names: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Lots of rows of one (part, signal), at most ``TASK_ROWS`` rows and a batch each."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = list(zip(table["part"].to_pylist(), table["signal"].to_pylist(), strict=True))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        for start, stop in zip(starts, starts[1:]):
            yield keys[start], table.slice(start, stop - start).select(names)


def _codes(table: pa.Table, fold: int, lags: np.ndarray) -> np.ndarray:
    """Codes of all features as one matrix; the level of the series is that before ``fold``."""
    levels = table["levels"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    return np.concatenate([levels[:, fold - 1 : fold], lags], axis=1).astype(np.int64)


def _lags(table: pa.Table) -> np.ndarray:
    return table["codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _count_level(data: DataFrame, trees: Trees, grid: Grid) -> DataFrame:
    """Counts of every open node, added over tasks, as the splits of its lengths."""

    def count(batches):
        held: dict[tuple, np.ndarray] = {}
        at = None

        def out():
            rows = [(*key, counts.tobytes()) for key, counts in held.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())],
                names=["part", "signal", "fold", "node", "counts"],
            )

        for unit, table in _units(batches, ["f", "label", "levels", "codes"]):
            if at is not None and unit != at:
                yield out()
            at = unit
            fold_of_row, labels, lags = table["f"].to_numpy(), table["label"].to_numpy(), _lags(table)
            for fold in range(1, grid.folds + 1):
                tree = trees.get((*unit, fold))
                rows = np.flatnonzero(grid.trains(fold_of_row, fold))
                if tree is None or not len(rows):
                    continue
                codes = _codes(table, fold, lags)
                for number, here in routed(tree, codes, rows):
                    node = tree[number]
                    if node.open:
                        width = 1 + grid.lengths[node.hi]
                        counts = bin_counts(codes[here, :width], labels[here])
                        key = (*unit, fold, number)
                        held[key] = held[key] + counts if key in held else counts
        yield out()

    def split(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, signal, fold, number = (k.as_py() for k in key)
        node = trees[part, signal, fold][number]
        counts = np.zeros((2, 1 + grid.lengths[node.hi], CODES))
        for packed in table["counts"].to_pylist():
            counts += np.frombuffer(packed).reshape(counts.shape)
        n, s = counts[0][1].sum(), counts[1][1].sum()
        rows = [(part, signal, fold, number, n, s, *found) for found in interval_splits(counts, node, grid)]
        names = [c.split()[0] for c in _SPLITS.split(", ")]
        types = [pa.int32() if c.split()[1] == "int" else pa.float64() for c in _SPLITS.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    counted = data.mapInArrow(count, _COUNTED)
    return counted.groupBy("part", "signal", "fold", "node").applyInArrow(split, _SPLITS)


def grow(data: DataFrame, trees: Trees, grid: Grid) -> None:
    """Grow ``trees`` in place. The driver sees splits only, whose number is bounded by the grid, not by the rows."""
    for depth in range(grid.depth):
        found = _count_level(data, trees, grid).collect()
        for tree in trees.values():
            for node in tree:
                node.open = False
        for r in sorted(found, key=lambda r: (r["part"], r["signal"], r["fold"], r["node"], r["lo"])):
            tree = trees[r["part"], r["signal"], r["fold"]]
            node = tree[r["node"]]
            node.n, node.s = r["n"], r["s"]
            if r["feature"] < 0:
                continue
            sides = ((r["n_left"], r["s_left"]), (r["n"] - r["n_left"], r["s"] - r["s_left"]))
            node.splits.append((r["lo"], r["hi"], r["feature"], r["bin"], len(tree), len(tree) + 1))
            for n, s in sides:
                able = depth + 1 < grid.depth and n >= 2 * grid.min_leaf
                tree.append(Node(r["lo"], r["hi"], n, s, depth + 1, able))
        if not any(node.open for tree in trees.values() for node in tree):
            break


def _held_errors(data: DataFrame, trees: Trees, grid: Grid) -> DataFrame:
    """Sums of absolute errors of held-out rows per (entity, signal, length)."""

    def measure(batches):
        for (part, signal), table in _units(batches, ["entity_row", "f", "label", "levels", "codes"]):
            fold_of_row, labels, lags = table["f"].to_numpy(), table["label"].to_numpy(), _lags(table)
            names = table["entity_row"].combine_chunks().dictionary_encode()
            owner = names.indices.to_numpy()
            total = np.zeros((len(names.dictionary), len(grid.lengths)))
            rows = np.zeros(total.shape, np.int64)
            for fold in range(1, grid.folds + 1):
                tree = trees.get((part, signal, fold))
                if tree is None or not tree[0].n:
                    continue
                codes = _codes(table, fold, lags)
                held = np.flatnonzero((fold_of_row == fold) & (codes[:, 0] >= 0))
                for number, here in routed(tree, codes, held):
                    node = tree[number]
                    ends = np.ones(node.hi - node.lo + 1, bool)
                    for lo, hi, *_ in node.splits:
                        ends[lo - node.lo : hi - node.lo + 1] = False
                    at = np.flatnonzero(ends) + node.lo
                    if len(at):
                        error = np.abs(labels[here] - node.s / node.n)
                        np.add.at(total, (owner[here][:, None], at), error[:, None])
                        np.add.at(rows, (owner[here][:, None], at), 1)
            e, k = np.nonzero(rows)
            yield pa.RecordBatch.from_arrays([
                names.dictionary.take(pa.array(e)), pa.array(np.full(len(e), signal, np.int32)),
                pa.array(np.array(grid.lengths, np.int32)[k]), pa.array(total[e, k]), pa.array(rows[e, k]),
            ], names=["entity_row", "signal", "length", "total", "rows"])

    return data.mapInArrow(measure, _ERRORS)


def _edges(df: DataFrame, columns: dict[str, str | Column], by: Sequence[str]) -> DataFrame:
    """Distinct values that cut each column into ``BINS`` parts of about equal size."""
    shares = [i / BINS for i in range(1, BINS)]
    cut = lambda c: F.array_sort(F.array_distinct(F.percentile_approx(c, shares, QUANTILE_ACCURACY)))
    return df.groupBy(*by).agg(*[cut(c).alias(name) for name, c in columns.items()])


def _fixed(edges: DataFrame) -> dict[str, Column]:
    """Edges of a single group as constants: at most ``BINS`` - 1 numbers a column."""
    row = edges.first()
    return {c: F.array(*[F.lit(x) for x in row[c] or []]).cast("array<double>") for c in edges.columns}


def _code(value: str | Column, edges: str | Column) -> Column:
    """Number of edges below a value; missing values come after all others."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNull() | F.isnan(value), F.lit(MISSING)).otherwise(F.size(F.filter(edges, lambda e: e < value)))


def window_screen(
    panel: DataFrame,
    entity: str,
    time_order: str,
    target: str,
    signals: Sequence[str],
    lengths: Sequence[int],
    entities: Sequence | None = None,
    folds: int = 10,
    chronological: bool = True,
    depth: int = 5,
    min_leaf: int = 5,
) -> DataFrame:
    """(entity, variable, length, mae): cross-validated error of a decision tree on the last L values.

    Pooled by default: one tree per (signal, length, fold) over the rows of all series, with the series' mean before the
    fold as a further input; its errors are summed per series. With ``entities``, a short declared list, every listed
    series has trees of its own. Chronological mode validates fold k on a tree of the folds before it;
    otherwise folds are drawn by a hash and each is held out once. A cell without a validated row has a null error.

    Trees split at one of 31 quantiles of a signal (of up to 10,000 distinct values exact, beyond within a
    ten-thousandth of the rows) where squared error falls most, with ``min_leaf`` rows on both sides; shorter lags and
    lower values win ties. Missing values count as larger than all others, rows without a target take no part.

    A task holds counts of (folds x nodes x lags x bins) of one signal at a time. The trees that are sent to tasks have
    at most signals x folds x lengths x 2^depth nodes (times the listed series).
    """
    lengths = tuple(sorted(set(lengths)))
    longest = lengths[-1]
    signals = list(signals)
    grid = Grid(lengths, folds, chronological, depth, min_leaf, entities is None)
    own, chosen = (panel, None) if entities is None else (panel.where(F.col(entity).isin(list(entities))), list(entities))

    group = [] if chosen is None else [entity]
    numbers = {s: F.col(s).cast("double") for s in signals}
    edges = _edges(own, {f"_edges_{s}": F.when(~F.isnan(c), c) for s, c in numbers.items()}, group)
    if chosen is None:
        cuts = _fixed(edges)
        coded = own.withColumns({f"_code_{s}": _code(numbers[s], cuts[f"_edges_{s}"]) for s in signals})
    else:
        coded = own.join(edges, group).withColumns({f"_code_{s}": _code(numbers[s], f"_edges_{s}") for s in signals})
    share = F.floor(F.col(time_order) * (folds + 1) / F.col("n"))
    drawn = F.pmod(F.xxhash64(F.lit(7), F.col(entity), F.col(time_order)), F.lit(folds)) + 1
    fold = F.least(share, F.lit(folds)) if chronological else drawn
    lagged = raw_lag_arrays(
        coded.select(entity, time_order, "n", target, *[f"_code_{s}" for s in signals]),
        [entity], time_order, {f"_code_{s}": longest for s in signals},
    )
    label = F.col(target).cast("double")
    ready = written(lagged.where(F.size(f"_code_{signals[0]}_lags") == longest).where(label.isNotNull() & ~F.isnan(label)).select(
        entity, time_order, fold.cast("int").alias("f"), label.alias("label"),
        *[F.reverse(f"_code_{s}_lags").cast("array<byte>").alias(f"_lags_{s}") for s in signals],
    ))
    before = lambda k: F.avg(F.when((F.col("f") < k) if chronological else (F.col("f") != k), F.col("label")))
    levels = written(ready.groupBy(entity).agg(*[before(k).alias(f"l{k}") for k in range(1, folds + 1)]))
    steps = _edges(levels, {f"l{k}": F.col(f"l{k}") for k in range(1, folds + 1)}, [])
    steps = _fixed(steps)
    coded = F.array(*[
        F.when(F.col(f"l{k}").isNull(), F.lit(-1)).otherwise(_code(f"l{k}", steps[f"l{k}"])) for k in range(1, folds + 1)
    ])
    ranked = levels.select(entity, coded.cast("array<byte>").alias("levels"))
    part = F.lit(0)
    if chosen is not None:
        part = F.coalesce(*[F.when(F.col(entity) == e, F.lit(i)) for i, e in enumerate(chosen)])
    each = F.array(*[F.struct(F.lit(i).alias("signal"), F.col(f"_lags_{s}").alias("codes")) for i, s in enumerate(signals)])
    total = ready.count()
    lots = max(1, -(-total // TASK_ROWS))
    spread = ready.join(ranked, entity).select(
        F.col(entity).cast("string").alias("entity_row"), part.alias("part"), "f", "label", "levels",
        F.pmod(F.xxhash64(entity, time_order), F.lit(lots)).alias("_lot"), F.inline(each),
    )
    data = written(spread.repartition(len(signals) * lots, "signal", "_lot").sortWithinPartitions("part", "signal").drop("_lot"))

    trees = {
        (p, s, k): [Node(0, len(lengths) - 1)]
        for p in range(1 if chosen is None else len(chosen)) for s in range(len(signals)) for k in range(1, folds + 1)
    }
    grow(data, trees, grid)
    errors = _held_errors(data, trees, grid).groupBy("entity_row", "signal", "length").agg(
        (F.sum("total") / F.sum("rows")).alias("mae")
    )
    named = F.array(*[F.struct(F.lit(i).alias("signal"), F.lit(s).alias("variable")) for i, s in enumerate(signals)])
    grid_rows = levels.select(entity, F.inline(named)).withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths])))
    met = grid_rows.withColumn("entity_row", F.col(entity).cast("string")).join(errors, ["entity_row", "signal", "length"], "left")
    return met.select(entity, "variable", F.col("length").cast("long").alias("length"), "mae")


def best_window(screen: DataFrame, entity: str) -> DataFrame:
    """Length with the lowest error per (entity, variable); the shorter one wins a tie."""
    order = Window.partitionBy(entity, "variable").orderBy("mae", "length")
    return screen.where(F.col("mae").isNotNull()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
