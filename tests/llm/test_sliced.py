import numpy as np
import pytest

from panelcast.llm import sliced
from panelcast.operators.history import multiscale_features

KIND = "entity string, pos long, features array<double>, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], KIND).repartition(3)


def last(value):
    return (value is None, value)


def brute(rows, asked, k, scale=256):
    def ints(v):
        return np.floor(scale * np.array(v)).astype(np.int64)

    good = [(e, p, ints(v)) for e, p, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = {}
    for e, p, v in asked:
        if v is None or None in v or not np.isfinite(v).all():
            continue
        near = sorted(
            (-int(ints(v) @ w), last(f), last(q)) for f, q, w in good if (f, q) != (e, p) and len(w) == len(v)
        )[:k]
        out[e, p] = [(f[1], q[1], -s) for s, f, q in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("rank").collect():
        own = out.setdefault((r["entity"], r["pos"]), [])
        own.append((r["near_entity"], r["near_pos"], r["score"]))
        assert r["rank"] == len(own)
    return out


@pytest.mark.parametrize("width,cells", [(5, 1 << 20), (64, 6000), (1, 300)])
def test_equals_brute_force(spark, monkeypatch, width, cells):
    monkeypatch.setattr(sliced, "SLICE_CELLS", cells)
    rng = np.random.default_rng(width)
    rows = [("sj" if i % 3 else "iq", i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.2, (700, width)).round(2))]
    df = frame(spark, rows)
    asked = [r for r in rows if r[1] % 50 == 0]
    assert found(sliced.exact_top_histories(df, df.where("pos % 50 = 0"), k=5)) == brute(rows, asked, 5)


def test_sum_of_slices():
    rng = np.random.default_rng(2)
    values = rng.integers(-300, 70, (200, 6))
    values[:, 3] = 9
    index = sliced.BitSlices.of(values)
    again = sliced.BitSlices.unpack(200, index.low.tolist(), index.bits.tolist(), index.pack())
    for weights in (rng.integers(-90, 90, 6), np.zeros(6, np.int64), np.array([0, 0, 0, -5, 0, 0])):
        total, constant = again.weighted_sum(weights)
        sums = [
            constant + sum((int(plane[i // 64]) >> i % 64 & 1) << p for p, plane in enumerate(total)) for i in range(200)
        ]
        assert sums == (values @ weights).tolist()
        top = again.top(total, [4, 5], 10)
        order = sorted((i for i in range(200) if i not in (4, 5)), key=lambda i: (-sums[i], i))[:10]
        assert sorted(top.tolist()) == sorted(order)


def test_ties_odd_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        ("a", 1, [1.0, 0.0]), ("a", 2, [2.0, 0.0]), ("b", 2, [2.0, 0.0]), ("a", 3, [2.0, 0.0]), ("a", 3, [2.0, 0.0]),
        ("a", 4, None), ("a", 5, []), ("b", 5, []), ("a", 6, [0.0, 0.0]), ("a", 7, [1.0, None]), ("a", 8, [nan, 1.0]),
        ("a", 9, [inf, 1.0]), ("c", 1, [1.0, 2.0, 3.0]), (None, 2, [2.0, 0.0]), ("a", None, [2.0, 0.0]), (None, None, [-1.0, 0.0]),
    ]
    df = frame(spark, rows)
    asked = df.where("entity = 'a' and pos in (1, 3, 4, 5, 6)")
    got = found(sliced.exact_top_histories(df, asked, k=20))
    assert got == brute(rows, [r for r in rows if r[0] == "a" and r[1] in (1, 3, 4, 5, 6)], 20)
    assert got["a", 5] == [("b", 5, 0)]
    for left, right in ((df.where("false"), df), (df, df.where("false"))):
        assert sliced.exact_top_histories(left, right).count() == 0


def test_products_beyond_a_long_raise(spark):
    df = frame(spark, [("a", 1, [1e10]), ("a", 2, [-1e10])])
    with pytest.raises(Exception, match="exceed a long"):
        sliced.exact_top_histories(df, df).collect()


def test_like_weeks_of_a_panel(spark):
    rng = np.random.default_rng(0)
    weeks = [
        (city, i, i % 52 + 1, float(np.sin(i / 8) + rng.normal(0, 0.1)), float(np.cos(i / 8)))
        for city, n in (("sj", 160), ("iq", 120)) for i in range(n)
    ]
    panel = spark.createDataFrame(weeks, "city string, pos long, weekofyear int, rain double, heat double")
    placed = panel.selectExpr("*", "0L as first_pos", "CASE city WHEN 'sj' THEN 160L ELSE 120L END as examples")
    histories = multiscale_features(placed, ["city"], ["rain", "heat"], "weekofyear", keep=["city", "pos"])
    rows = [(r["city"], r["pos"], [float(x) for x in r["features"]]) for r in histories.collect()]
    got = found(sliced.exact_top_histories(histories, histories.where("pos = 100"), k=5, entity="city"))
    assert got == brute(rows, [r for r in rows if r[1] == 100], 5)
