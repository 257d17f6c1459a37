"""The screen of history lengths against trees grown one cell at a time."""

import math

import numpy as np
import pytest

from conftest import make_panel, to_spark
from panelcast.operators import screen
from panelcast.operators.position import row_position


def edges_of(values):
    x = sorted(v for v in values if not math.isnan(v))
    return sorted({x[max(0, math.ceil(len(x) * i / screen.BINS) - 1)] for i in range(1, screen.BINS)})


def code(value, edges):
    return screen.MISSING if math.isnan(value) else sum(e < value for e in edges)


def grown(rows, depth, min_leaf):
    """A tree over (codes, label) rows as nested tuples."""
    labels = [y for _, y in rows]
    n, s = len(labels), sum(labels)
    best = (1e-9 * (1 + s * s / n), None)
    if depth:
        for feature in range(len(rows[0][0])):
            for cut in range(screen.MISSING):
                left = [y for x, y in rows if x[feature] <= cut]
                if min(len(left), n - len(left)) < min_leaf:
                    continue
                gain = sum(left) ** 2 / len(left) + (s - sum(left)) ** 2 / (n - len(left)) - s * s / n
                if gain > best[0] + 1e-9 * (1 + s * s / n) * (best[1] is not None):
                    best = (gain, (feature, cut))
    if best[1] is None:
        return s / n
    feature, cut = best[1]
    sides = [r for r in rows if r[0][feature] <= cut], [r for r in rows if r[0][feature] > cut]
    return feature, cut, grown(sides[0], depth - 1, min_leaf), grown(sides[1], depth - 1, min_leaf)


def predicted(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def brute(series, lengths, folds, depth, min_leaf, pooled):
    """series: {entity: (values, targets)} of one signal; chronological folds."""
    longest, errors = max(lengths), {}
    groups = [list(series)] if pooled else [[e] for e in series]
    for group in groups:
        edges = edges_of([v for e in group for v in series[e][0]])
        rows = []
        for e in group:
            values, targets = series[e]
            coded = [code(v, edges) for v in values]
            for i in range(longest - 1, len(values)):
                f = min(i * (folds + 1) // len(values), folds)
                rows.append((e, f, coded[i - longest + 1 : i + 1][::-1], targets[i]))
        levels = {
            (e, k): np.mean([y for o, f, _, y in rows if o == e and f < k])
            for e in group for k in range(1, folds + 1) if any(o == e and f < k for o, f, _, _ in rows)
        }
        for k in range(1, folds + 1):
            steps = edges_of([v for (e, j), v in levels.items() if j == k]) if any(j == k for _, j in levels) else []
            for length in lengths:
                def inputs(e, lags):
                    return ([code(levels[e, k], steps)] if pooled else []) + lags[:length]  # noqa: B023

                train = [(inputs(e, lags), y) for e, f, lags, y in rows if f < k]
                held = [(e, inputs(e, lags), y) for e, f, lags, y in rows if f == k and (e, k) in levels]
                if not train:
                    continue
                tree = grown(train, depth, min_leaf)
                for e, x, y in held:
                    errors.setdefault((e, length), []).append(abs(y - predicted(tree, x)))
    return {cell: float(np.mean(e)) for cell, e in errors.items()}


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    out = {}
    for name, n in (("a", 90), ("b", 70)):
        x = rng.integers(0, 60, n).astype(float)
        y = np.round(x / 3 + np.roll(x, 4) + rng.integers(0, 9, n)) + 20 * (name == "b")
        x[[3, 40, 41]] = np.nan
        out[name] = (x.tolist(), y.tolist())
    return out


@pytest.mark.parametrize("entities", [None, ["a", "b"], ["b"]])
@pytest.mark.parametrize("depth", [1, 3])
def test_equals_trees_grown_alone(spark, series, entities, depth):
    rows = [
        (e, i, len(v[0]), None if math.isnan(x) else x, y) for e, v in series.items() for i, (x, y) in enumerate(zip(*v))
    ]
    panel = spark.createDataFrame(rows, "city string, seq long, n long, rain double, cases double").repartition(5)
    got = {
        (r["city"], r["length"]): r["mae"]
        for r in screen.window_screen(panel, "city", "seq", "cases", ["rain"], [3, 5, 9], entities, 3, depth=depth).collect()
    }
    chosen = {e: v for e, v in series.items() if entities is None or e in entities}
    want = brute(chosen, [3, 5, 9], 3, depth, 5, entities is None)
    assert got.keys() == want.keys()
    for cell in want:
        assert got[cell] == pytest.approx(want[cell], rel=1e-9), cell


def test_planted_length_is_chosen(spark):
    rng = np.random.default_rng(1)
    n = 320
    rain, heat = rng.normal(0, 1, n), rng.normal(0, 1, n)
    cases = np.where(np.roll(rain, 9) > 0, 12, 2) + np.where(np.roll(heat, 22) > 0, 0, 0)
    rows = [("a", i, n, float(rain[i]), float(heat[i]), float(cases[i])) for i in range(n)]
    rows += [("b", i, n, float(heat[i]), float(rain[i]), float(cases[i])) for i in range(n)]
    panel = spark.createDataFrame(rows, "city string, seq long, n long, rain double, heat double, cases double")
    lengths = range(3, 52)
    errors = screen.window_screen(panel, "city", "seq", "cases", ["rain", "heat"], lengths, ["a", "b"]).cache()
    assert errors.count() == 2 * 2 * 49
    best = {(r["city"], r["variable"]): r["length"] for r in screen.best_window(errors, "city").collect()}
    assert best["a", "rain"] == 10 and best["b", "heat"] == 10


@pytest.mark.parametrize("chronological", [True, False])
@pytest.mark.parametrize("entities", [None, ["a"]])
def test_screen_covers_the_grid(spark, chronological, entities):
    placed = row_position(to_spark(spark, make_panel({"a": 120, "b": 90})), ["city"], "week_start_date", "day")
    errors = screen.window_screen(
        placed, "city", "seq", "total_cases", ["rain"], [3, 8], entities, folds=3, chronological=chronological
    )
    rows = errors.orderBy("city", "length").collect()
    cities = entities or ["a", "b"]
    assert [(r["city"], r["variable"], r["length"]) for r in rows] == [(c, "rain", n) for c in cities for n in (3, 8)]
    assert all(r["mae"] > 0 for r in rows)
    best = screen.best_window(errors, "city").where("city = 'a'").first()
    assert best["mae"] == min(r["mae"] for r in rows if r["city"] == "a")


def test_jobs_do_not_grow_with_the_grid(spark, monkeypatch):
    levels = []
    plain = screen._count_level
    monkeypatch.setattr(screen, "_count_level", lambda *args: levels.append(1) or plain(*args))
    for series, lengths in (({"a": 90}, [4]), ({"a": 90, "b": 90, "c": 90}, range(3, 30))):
        placed = row_position(to_spark(spark, make_panel(series)), ["city"], "week_start_date", "day")
        levels.clear()
        screen.window_screen(placed, "city", "seq", "total_cases", ["rain"], lengths, folds=2, depth=2).collect()
        assert len(levels) == 2


def test_empty_panel(spark):
    panel = spark.createDataFrame([], "city string, seq long, n long, rain double, cases double")
    assert screen.window_screen(panel, "city", "seq", "cases", ["rain"], [3, 4]).count() == 0
