import numpy as np
import pytest

from panelcast.llm import analogs
from panelcast.operators.history import multiscale_features

KIND = "entity string, pos long, features array<double>, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], KIND).repartition(3)


def brute(rows, asked, k):
    good = [(e, p, np.array(v)) for e, p, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for e, p, v in asked:
        near = sorted(((-float(v @ w), f, q) for f, q, w in good if (f, q) != (e, p) and len(w) == len(v)))[:k]
        out[e, p] = [(f, q) for _, f, q in near]
    return out


@pytest.mark.parametrize("width", [7, 64])
def test_recall_and_scores(spark, width, monkeypatch):
    monkeypatch.setattr(analogs, "SLICE_ROWS", 500)
    monkeypatch.setattr(analogs, "QUERY_ROWS", 40)
    rng = np.random.default_rng(width)
    v = rng.standard_normal((2000, width)) * rng.uniform(0.5, 2, (2000, 1))
    rows = [("sj" if i % 3 else "iq", i, x.tolist()) for i, x in enumerate(v)]
    df = frame(spark, rows)
    got = {}
    for r in analogs.nearest_histories(df, df.where("pos % 20 = 0"), k=10).collect():
        got.setdefault((r["entity"], r["pos"]), []).append((r["rank"], r["near_entity"], r["near_pos"], r["score"]))
    want = brute(rows, [(e, p, np.array(x)) for e, p, x in rows if p % 20 == 0], 10)
    assert set(got) == set(want)
    hits = sum(len({g[1:3] for g in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for (_, p), near in got.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 11)) and [n[3] for n in near] == sorted((n[3] for n in near), reverse=True)
        for _, _, q, score in near:
            assert score == pytest.approx(float(v[p] @ v[q]), rel=1e-12)


def test_ties_odd_vectors_and_few_candidates(spark):
    rows = [
        ("a", 1, [1.0, 0.0]), ("a", 2, [2.0, 0.0]), ("b", 2, [2.0, 0.0]), ("a", 3, [2.0, 0.0]), ("a", 4, None), ("a", 5, []),
        ("a", 6, [0.0, 0.0]), ("a", 7, [1.0, None]), ("a", 8, [float("nan"), 1.0]), ("a", 9, [float("inf"), 1.0]),
        ("c", 1, [1.0, 2.0, 3.0]), (None, None, [0.5, 0.0]), ("a", 3, [2.0, 0.0]),
    ]
    df = frame(spark, rows)
    got = analogs.nearest_histories(df, df.where("entity = 'a' and pos in (1, 4, 6)"), k=20).orderBy("rank").collect()
    assert [(r["near_entity"], r["near_pos"]) for r in got] == [("a", 2), ("a", 3), ("a", 3), ("b", 2), (None, None)]
    assert analogs.nearest_histories(df.where("false"), df, k=3).count() == 0
    assert analogs.nearest_histories(df, df.where("false"), k=3).count() == 0


def test_many_equal_vectors(spark):
    df = frame(spark, [("a", i, [1.0, 1.0, 0.5]) for i in range(3000)])
    got = analogs.nearest_histories(df, df.where("pos = 5"), k=3).orderBy("rank").collect()
    assert [r["near_pos"] for r in got] == [0, 1, 2]


def test_analog_weeks_of_a_panel(spark):
    rng = np.random.default_rng(0)
    weeks = [
        (city, i, i % 52 + 1, float(np.sin(i / 8) + rng.normal(0, 0.1)), float(np.cos(i / 8)))
        for city, n in (("sj", 160), ("iq", 120)) for i in range(n)
    ]
    panel = spark.createDataFrame(weeks, "entity string, pos long, weekofyear int, rain double, heat double")
    placed = panel.selectExpr("*", "0L as first_pos", "CASE entity WHEN 'sj' THEN 160L ELSE 120L END as examples")
    histories = multiscale_features(placed, ["entity"], ["rain", "heat"], "weekofyear", keep=["entity", "pos"])
    near = analogs.nearest_histories(histories, histories.where("pos = 100"), k=5).collect()
    vectors = {(r["entity"], r["pos"]): np.array(r["features"], float) for r in histories.collect()}
    want = brute([(e, p, v.tolist()) for (e, p), v in vectors.items()], [(c, 100, vectors[c, 100]) for c in ("sj", "iq")], 5)
    assert {(r["entity"], r["near_entity"], r["near_pos"]) for r in near} == {(q[0], *n) for q, found in want.items() for n in found}
