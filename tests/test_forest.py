"""Forests against trees grown in plain loops, and the two ways of growing against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import forest, trees
from panelcast.operators.forest import ForestPlan, Tree, fit_forests

MASK = (1 << 64) - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def share(x):
    return (mix(x) >> 11) * 2.0**-53


def times_drawn(row, salt):
    u, k, p = share(row ^ salt), 0, math.exp(-1)
    total = p
    while u >= total:
        k += 1
        p /= k
        total += p
    return k


def grown(plan, number, codes, labels, ids):
    """One tree as nested tuples, by the definition."""
    salt, width = mix(plan.seed * 1_000_003 + number), len(codes[0])
    weight = [1 if plan.extra else times_drawn(i, salt) for i in ids]

    def score(n, s):
        return s * math.log(s / n) if plan.criterion == "poisson" else s * s / n

    def node(rows, path, depth, low, high):
        n, s = sum(weight[r] for r in rows), sum(weight[r] * labels[r] for r in rows)
        leaf = s / n if n else 0.0
        if (n < 2 * plan.min_leaf and depth) or depth == plan.max_depth or (plan.criterion == "poisson" and s <= 0):
            return leaf
        seed = mix(path ^ salt)
        noise = [mix(seed ^ mix(f)) for f in range(width)]
        tried = sorted(sorted(range(width), key=lambda f: (noise[f], f))[: plan.tried(width)])
        best = (1e-9 * (1 + abs(s)), None)
        for f in tried:
            cuts = range(forest.BINS)
            if plan.extra:
                cuts = [low[f] + math.floor(share(noise[f] ^ plan.seed) * (high[f] - low[f]))] if high[f] > low[f] else []
            for c in cuts:
                nl = sum(weight[r] for r in rows if codes[r][f] <= c)
                sl = sum(weight[r] * labels[r] for r in rows if codes[r][f] <= c)
                if min(nl, n - nl) < plan.min_leaf or (plan.criterion == "poisson" and min(sl, s - sl) <= 0):
                    continue
                gain = score(nl, sl) + score(n - nl, s - sl) - score(n, s)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, c))
        if best[1] is None:
            return leaf
        f, c = best[1]
        left, right = list(high), list(low)
        left[f], right[f] = min(high[f], c), max(low[f], c + 1)
        return (
            f, c, node([r for r in rows if codes[r][f] <= c], 2 * path, depth + 1, low, left),
            node([r for r in rows if codes[r][f] > c], 2 * path + 1, depth + 1, right, high),
        )

    return node(range(len(codes)), 1, 0, [0] * width, [forest.BINS] * width)


def predicted(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


PLANS = [
    ForestPlan(4, 5, 4), ForestPlan(4, 3, 6, share=0.5, extra=True), ForestPlan(4, 5, 5, extra=True, criterion="poisson"),
    ForestPlan(3, 5, 4, share=0.4, extra=True), ForestPlan(3, 5, 4, share=1.0, criterion="poisson", seed=7),
]


@pytest.mark.parametrize("plan", PLANS)
def test_trees_equal_loops(plan):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, forest.CODES, (120, 5))
    labels = rng.poisson(np.exp(codes[:, 0] / 12)).astype(float)
    ids = rng.integers(-(2**62), 2**62, 120)
    for number in range(3):
        tree = Tree(plan, number, 5)
        while tree.open:
            tree.extend(tree.choose(tree.counts(codes, labels, ids.view(np.uint64))))
        want = grown(plan, number, codes.tolist(), labels.tolist(), [int(i) & MASK for i in ids])
        node, value = tree.nodes_of(codes), np.array(tree.row(0)[-1])
        np.testing.assert_allclose(value[node], [predicted(want, x) for x in codes.tolist()], rtol=1e-12)
        assert len(tree.feature) > 3


@pytest.fixture(scope="module")
def weeks(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e, n in (("sj", 220), ("iq", 150), ("xx", 40)):
        a, b, c = rng.normal(0, 1, n), rng.normal(0, 1, n), rng.integers(0, 4, n)
        y = rng.poisson(np.exp(1.5 + a))
        rows += [(e, i, None if i % 17 == 3 else float(a[i]), float(b[i]), int(c[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "city string, pos long, rain double, heat double, kind int, cases int").cache()


def values(df):
    return {(r["city"], r["pos"]): r["prediction"] for r in df.collect()}


PER_CITY = {"sj": ForestPlan(12, max_depth=5, extra=True, criterion="poisson"), "iq": ForestPlan(9, max_depth=4, log_target=True)}


def test_growing_by_level_and_partitions_change_nothing(spark, weeks, monkeypatch):
    columns = ["rain", "heat", "kind"]
    one = values(fit_forests(weeks, columns, "cases", PER_CITY, "city", ["city", "pos"]).predict(weeks))
    again = values(fit_forests(weeks.repartition(7), columns, "cases", PER_CITY, "city", ["city", "pos"]).predict(weeks.repartition(3)))
    known = lambda got: {k: v for k, v in got.items() if v is not None}
    assert known(one) == pytest.approx(known(again), rel=1e-12) and len(one) == len(again) == 410
    monkeypatch.setattr(forest, "PART_ROWS", 200)
    monkeypatch.setattr(forest, "LEVEL_CELLS", 2000)
    monkeypatch.setattr(forest, "SENT_NODES", 60)
    leveled = values(fit_forests(weeks.repartition(5), columns, "cases", PER_CITY, "city", ["city", "pos"]).predict(weeks))
    assert one.keys() == leveled.keys()
    for key, value in one.items():
        assert (value is None) == (key[0] == "xx")
        assert value is None or leveled[key] == pytest.approx(value, rel=1e-12)


def test_forest_is_the_mean_of_its_trees(spark, weeks):
    own = weeks.where("city = 'sj'")
    plan = ForestPlan(6, max_depth=4)
    fitted = fit_forests(own, ["rain", "heat"], "cases", plan, keys=["pos"])
    got = values(fitted.predict(own))
    row_id = {r["pos"]: r["h"] & MASK for r in own.select("pos", F.xxhash64("pos").alias("h")).collect()}
    coded = forest._coded(own, ["rain", "heat"], fitted.edges, None, [None]).collect()
    codes, labels, ids = [list(r["_codes"]) for r in coded], [r["cases"] for r in coded], [row_id[r["pos"]] for r in coded]
    grove = [grown(plan, t, codes, labels, ids) for t in range(6)]
    for r, x in zip(coded, codes):
        assert got["sj", r["pos"]] == pytest.approx(np.mean([predicted(t, x) for t in grove]), rel=1e-9)


def test_random_thresholds_and_counts_learn(weeks):
    own = weeks.where("city = 'sj'")
    base = own.agg(F.avg(F.abs(F.col("cases") - 7))).first()[0]
    for kw in ({"extra": True, "criterion": "poisson"}, {"extra": True}, {"log_target": True}, {}):
        scored = trees.forest_regressor(own, ["rain", "heat", "kind"], "cases", trees=20, keys=["pos"], **kw).predict(own)
        low, error = scored.agg(F.min("prediction"), F.avg(F.abs(F.col("cases") - F.col("prediction")))).first()
        assert low >= 0 and error < 0.7 * base


def test_empty_constant_and_unknown(spark, weeks):
    with pytest.raises(ValueError):
        ForestPlan(criterion="absolute")
    with pytest.raises(ValueError):
        ForestPlan(criterion="poisson", log_target=True)
    nothing = fit_forests(weeks.where("false"), ["rain"], "cases", ForestPlan(3))
    assert {v for v in values(nothing.predict(weeks)).values()} == {None}
    flat = weeks.withColumns({"cases": F.lit(4), "rain": F.lit(1.0)})
    assert set(values(fit_forests(flat, ["rain"], "cases", ForestPlan(3)).predict(flat)).values()) == {4.0}
    zero = weeks.withColumn("cases", F.lit(0))
    assert set(values(fit_forests(zero, ["heat"], "cases", ForestPlan(3, criterion="poisson")).predict(zero)).values()) == {0.0}
