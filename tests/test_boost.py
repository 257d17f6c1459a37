"""Boosting against plain loops, and the two ways of growing against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import boost
from panelcast.operators.boost import BoostPlan, boost_rows, fit_boosts
from panelcast.operators.forest import CODES, walked

MASK = (1 << 64) - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def loops(plan, codes, labels, ids):
    """Margins of all rows after every round, by the definition."""
    width, shrink = len(codes[0]), lambda g: math.copysign(max(abs(g) - plan.l1, 0.0), g)
    absolute = plan.objective == "absolute"
    margin = [float(np.median(labels)) if absolute else math.log(sum(labels) / len(labels))] * len(labels)
    out = [list(margin)]
    for t in range(plan.rounds):
        salt = mix(plan.seed * 1_000_003 + t)
        rows = [r for r in range(len(labels)) if (mix(ids[r] ^ salt) >> 11) * 2.0**-53 < plan.row_share]
        noise = [mix(f ^ mix(salt)) for f in range(width)]
        tried = sorted(sorted(range(width), key=lambda f: noise[f])[: max(1, round(width * plan.feature_share))])
        slope = {r: (float(np.sign(margin[r] - labels[r])), 1.0) if absolute else (math.exp(margin[r]) - labels[r], math.exp(margin[r])) for r in range(len(labels))}

        def sums(own):
            return sum(slope[r][0] for r in own), sum(slope[r][1] for r in own)  # noqa: B023

        def worth(g, h):
            return shrink(g) ** 2 / (h + plan.l2)

        def add(own, everyone, depth):
            g, h = sums(own)
            best = (1e-9 * (1 + abs(g)), None)
            for f in tried if depth < plan.depth else []:  # noqa: B023
                for c in range(CODES - 1):
                    gl, hl = sums([r for r in own if codes[r][f] <= c])
                    if min(hl, h - hl) < plan.min_child:
                        continue
                    gain = worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, c))
            if best[1]:
                f, c = best[1]
                for side in (True, False):
                    add([r for r in own if (codes[r][f] <= c) == side], [r for r in everyone if (codes[r][f] <= c) == side], depth + 1)
                return
            left = [labels[r] - margin[r] for r in own]
            value = float(np.median(left)) if absolute and own else 0.0 if absolute else -shrink(g) / (h + plan.l2)
            for r in everyone:
                moved[r] += plan.rate * value  # noqa: B023

        moved = list(margin)
        add(rows, range(len(labels)), 0)
        margin = moved
        out.append(list(margin))
    return out


PLANS = [
    BoostPlan("absolute", 6, 0.3, 2, 5.0), BoostPlan("poisson", 6, 0.3, 3, 5.0), BoostPlan("poisson", 4, 0.5, 2, 1.0, 1.0, 1.0, 0.0, 0.0, 7),
]


@pytest.mark.parametrize("plan", PLANS)
def test_margins_equal_loops(plan):
    rng = np.random.default_rng(3)
    codes = rng.integers(0, CODES, (200, 5))
    y = rng.poisson(np.exp(codes[:, 0] / 14)).astype(float)
    ids = rng.integers(-(2**62), 2**62, 200)
    margin = np.zeros(200)
    for row, want in zip(boost_rows(plan, codes, y, ids.view(np.uint64)), loops(plan, codes.tolist(), y.tolist(), [int(i) & MASK for i in ids]), strict=True):
        margin = margin + np.array(row[6])[walked(codes, *(np.array(x) for x in row[2:6]))]
        np.testing.assert_allclose(margin, want, rtol=1e-9)


def test_poisson_deviance_falls_every_round():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, CODES, (300, 4))
    y = rng.poisson(np.exp(codes[:, 1] / 12)).astype(float)
    plan = BoostPlan("poisson", 40, 0.1, row_share=1.0, feature_share=1.0)
    margin, last = np.zeros(300), np.inf
    for row in boost_rows(plan, codes, y, np.arange(300, dtype=np.uint64)):
        margin = margin + np.array(row[6])[walked(codes, *(np.array(x) for x in row[2:6]))]
        deviance = float((np.exp(margin) - y * margin).sum())
        assert deviance < last
        last = deviance


@pytest.fixture(scope="module")
def weeks(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e, n in (("sj", 220), ("iq", 150), ("xx", 40)):
        a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
        y = rng.poisson(np.exp(1.5 + a))
        rows += [(e, i, None if i % 17 == 3 else float(a[i]), float(b[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "city string, pos long, rain double, heat double, cases int").cache()


def values(df):
    return {(r["city"], r["pos"]): r["prediction"] for r in df.collect()}


def test_boosting_by_level_and_partitions_change_nothing(spark, weeks, monkeypatch):
    plans = {"sj": BoostPlan("absolute", 4, 0.5, 2), "iq": BoostPlan("poisson", 3, 0.5, 2)}
    fit = lambda rows: values(fit_boosts(rows, ["rain", "heat"], "cases", plans, "city", ["city", "pos"]).predict(weeks))
    one = fit(weeks)
    monkeypatch.setattr(boost, "PART_ROWS", 50)
    monkeypatch.setattr(boost, "KEPT_ROUNDS", 2)
    many = fit(weeks.repartition(5))
    assert one.keys() == many.keys() and len(one) == 410
    for key, value in one.items():
        assert (value is None) == (key[0] == "xx") and (value is None or many[key] == pytest.approx(value, rel=1e-9))


def test_boosting_learns_and_odd_tables(spark, weeks):
    own = weeks.where("city = 'sj'")
    base = own.agg(F.avg(F.abs(F.col("cases") - 5))).first()[0]
    for objective in ("absolute", "poisson"):
        scored = fit_boosts(own, ["rain", "heat"], "cases", BoostPlan(objective, 60, 0.1), keys=["pos"]).predict(own)
        low, error = scored.agg(F.min("prediction"), F.avg(F.abs(F.col("cases") - F.col("prediction")))).first()
        assert low >= 0 and error < 0.8 * base
    nothing = fit_boosts(weeks.where("false"), ["rain"], "cases", BoostPlan(rounds=2))
    assert set(values(nothing.predict(weeks)).values()) == {None}
    with pytest.raises(ValueError):
        BoostPlan("squared")
