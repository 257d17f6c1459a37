import numpy as np
import pytest

from panelcast.llm import negatives
from panelcast.operators.evaluate import outbreak_threshold

KIND = "entity string, pos long, features array<double>, outbreak int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(3)


def brute(rows, anchors, n_positive=5, n_negative=10, low=30, high=90, scale=256):
    def good(r):
        return r[2] is not None and None not in r[2] and np.isfinite(r[2]).all() and r[3] is not None

    rows = [(e, p, np.floor(scale * np.array(v)).astype(np.int64), c) for e, p, v, c in filter(good, rows)]
    out = []
    for e, p, v, c in filter(good, anchors):
        v = np.floor(scale * np.array(v)).astype(np.int64)
        rest = sorted(
            ((-int(v @ w), f is None, f, q is None, q, d) for f, q, w, d in rows if (f, q) != (e, p) and len(w) == len(v)),
            key=lambda x: tuple((0,) if y is None else (1, y) for y in x[:5]),
        )
        for s, _, f, _, q, _ in [x for x in rest if x[5] == c][:n_positive]:
            inside = [x for x in rest if x[5] != c and low * -s <= 100 * -x[0] <= high * -s][:n_negative]
            out += [(e, p, f, q, i, g, r, -s, -t) for i, (t, _, g, _, r, _) in enumerate(inside, 1)]
    return out


def key(row):
    return tuple((0,) if x is None else (1, x) for x in row)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.mark.parametrize("shape", [(1, 1, 1), (16, 16, 16), (17, 33, 50), (64, 64, 64), (5, 100, 3), (1, 40, 90), (3, 0, 2)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-1000, 1000, shape[:2]), rng.integers(-1000, 1000, shape[1:])
    for leaf in (1, 4, 16):
        assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_strassen_is_exact_near_the_limit():
    a = np.full((40, 40), 3 * 10**8)
    assert (negatives.strassen(a, a, 2) == 40 * 9 * 10**16).all()


def test_heap_keeps_first_of_equal():
    heap = negatives.BestHeap(3)
    heap.offer(np.array([1, 5, 5, 5, 5]), np.arange(5))
    heap.offer(np.array([5, 6]), np.array([7, 8]))
    assert heap.entries() == [(6, 8), (5, 1), (5, 2)]


@pytest.mark.parametrize("width,cells", [(4, 1 << 19), (64, 5000), (3, 200)])
def test_equals_brute_force(spark, monkeypatch, width, cells):
    monkeypatch.setattr(negatives, "BLOCK_CELLS", cells)
    monkeypatch.setattr(negatives, "TILE", 50)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 7)
    rng = np.random.default_rng(width)
    v = (rng.normal(0, 0.15, (600, width)) + rng.normal(0, 0.15, (4, width))[rng.integers(0, 4, 600)]).round(2)
    rows = [("sj" if i % 2 else "iq", i, x.tolist(), int(rng.integers(0, 3)) * (i % 5 > 1)) for i, x in enumerate(v)]
    df = frame(spark, rows)
    got = rows_of(negatives.hard_negatives(df, df.where("pos % 20 = 0")))
    assert got == sorted(brute(rows, [r for r in rows if r[1] % 20 == 0]), key=key) and got


def test_nulls_ties_repeats_and_empty_tables(spark):
    nan = float("nan")
    rows = [
        ("a", 1, [1.0, 0.0], 0), ("a", 2, [2.0, 0.0], 0), (None, 2, [2.0, 0.0], 0), ("a", 3, [1.0, 1.0], 1), ("a", 4, [1.0, 1.0], 1),
        ("a", 5, [1.0, 1.0], None), ("a", 6, None, 1), ("a", 7, [1.0, None], 1), ("a", 8, [nan, 1.0], 1), ("b", None, [1.0, 1.0], 2),
        ("a", 9, [], 0), ("a", 10, [], 0), ("a", 11, [], 1), ("c", 1, [1.0, 1.0, 1.0], 1),
    ]
    df = frame(spark, rows)
    anchors = [r for r in rows if r[1] in (1, 3, 5, 6, 9)]
    got = rows_of(negatives.hard_negatives(df, df.where("pos in (1, 3, 5, 6, 9)"), negatives=3, high=60))
    assert got == sorted(brute(rows, anchors, n_negative=3, high=60), key=key) and got
    again = df.unionByName(df.where("pos = 4"))
    twice = rows_of(negatives.hard_negatives(again, again.where("pos = 1"), high=60))
    assert [r[6] for r in twice if r[3] == 2 and r[2] == "a"] == [3, 4, 4, None]
    for left, right in ((df.where("false"), df), (df, df.where("false"))):
        assert negatives.hard_negatives(left, right).count() == 0


def test_outbreak_weeks_of_a_panel(spark):
    rng = np.random.default_rng(3)
    weeks = [(city, i, rng.normal(0, 1, 6).round(3).tolist(), int(rng.poisson(9))) for city in ("sj", "iq") for i in range(90)]
    panel = spark.createDataFrame(weeks, "entity string, pos long, features array<double>, target int")
    limit = outbreak_threshold(panel, ["entity"], "target", 0.8)
    name = next(c for c in limit.columns if c != "entity")
    marked = panel.join(limit, "entity").withColumn("outbreak", (panel["target"] > limit[name]).cast("int"))
    rows = [(r["entity"], r["pos"], r["features"], r["outbreak"]) for r in marked.collect()]
    got = rows_of(negatives.hard_negatives(marked, marked.where("pos % 30 = 0")))
    assert got == sorted(brute(rows, [r for r in rows if r[1] % 30 == 0]), key=key) and got
