"""Lag correlations from sums of blocks against NumPy over whole series."""

import numpy as np
import pytest

from panelcast.operators import profile


def frame(spark, series):
    rows = [(e, i, *[None if v != v else float(v) for v in row]) for e, cols in series.items() for i, row in enumerate(zip(*cols))]
    return spark.createDataFrame(rows, "city string, pos long, y double, rain double, heat double").repartition(6)


def pairs(y, x, k):
    a, b = y[k:], x[: max(0, len(x) - k)]
    fine = ~np.isnan(a) & ~np.isnan(b)
    return a[fine], b[fine]


def test_equal_to_numpy_far_from_zero(spark, monkeypatch):
    rng = np.random.default_rng(1)
    series = {}
    for name, n, level in (("sj", 700, 1e6), ("iq", 60, 0.0), (None, 9, 5.0)):
        y, rain = rng.normal(level, 1, n), rng.normal(level, 1e-2, n)
        rain[rng.random(n) < 0.1] = np.nan
        series[name] = (y, rain, np.full(n, 0.1))
    df = frame(spark, series)
    monkeypatch.setattr(profile.halo_blocks, "__defaults__", (0, 0, 64))
    got = {(r["city"], r["variable"], r["lag"]): r["corr"] for r in profile.lag_correlation(df, "city", "pos", "y", ["rain", "heat"], 12).collect()}
    auto = {(r["city"], r["lag"]): r["corr"] for r in profile.autocorrelation(df, "city", "pos", "y", 12).collect()}
    assert len(got) == 3 * 2 * 13 and len(auto) == 3 * 12
    for name, (y, rain, _) in series.items():
        for k in range(13):
            assert got[name, "heat", k] is None
            for found, x in ((got[name, "rain", k], rain), (auto.get((name, k)), y)):
                a, b = pairs(y, x, k)
                if k and x is y or x is rain:
                    if len(a) < 2:
                        assert found is None
                    else:
                        assert found == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-7)
