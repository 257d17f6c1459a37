"""Moments of sliding windows, merged from shorter ones, against NumPy over whole series."""

import numpy as np
import pytest

from panelcast.operators import sliding


def test_pieces_cover_the_window():
    for window in (1, 3, 4, 13, 52, 520):
        for shift in (0, 2):
            rows = [r for length, back in sliding._pieces(window, shift) for r in range(back, back + length)]
            assert sorted(rows) == list(range(shift, shift + window))


@pytest.mark.parametrize("shift", [0, 1])
def test_equal_to_numpy(spark, shift):
    rng = np.random.default_rng(4)
    series = {"sj": 900, "iq": 70, None: 5}
    data, rows = {}, []
    for name, n in series.items():
        far, counts = rng.normal(1e9, 1e-3, n), rng.poisson(2, n).astype(float)
        far[n // 3 : n // 2] = 1e9 + 0.25
        far[rng.random(n) < 0.1] = np.nan  # written as null
        data[name] = far, counts
        rows += [(name, i, None if far[i] != far[i] else float(far[i]), int(counts[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "city string, pos long, far double, counts long").repartition(5)
    windows = [1, 4, 13, 52, 90]
    got = sliding.sliding_moments(df, ["city"], "pos", ["far", "counts"], windows, shift, rows=64).collect()
    assert len(got) == len(rows)
    for r in got:
        for c, x in zip(("far", "counts"), data[r["city"]], strict=True):
            for k in windows:
                end = r["pos"] + 1 - shift
                part = x[max(0, end - k) : max(0, end)]
                part = part[~np.isnan(part)]
                mean, std = r[f"{c}_mean_{k}"], r[f"{c}_std_{k}"]
                if not len(part):
                    assert mean is None and std is None
                    continue
                assert mean == pytest.approx(part.mean(), rel=1e-12, abs=1e-12)
                centred = part - part[0]
                if (centred == 0).all():
                    assert std == 0.0
                else:
                    assert std == pytest.approx(centred.std(), rel=1e-3 if c == "far" else 1e-12, abs=1e-12)


def test_a_nan_stays_in_its_windows(spark):
    rows = [("a", i, float("nan") if i == 10 else float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "city string, pos long, x double")
    got = {r["pos"]: r["x_mean_5"] for r in sliding.sliding_moments(df, ["city"], "pos", ["x"], [5]).collect()}
    assert [p for p, v in got.items() if v != v] and {p for p, v in got.items() if v != v} == set(range(10, 15))


def test_one_shuffle_whatever_the_windows(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "city string, pos long, x double")
    plan = sliding.sliding_moments(df, ["city"], "pos", ["x"], [4, 13, 52, 520])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_windows_are_checked(spark):
    df = spark.createDataFrame([("a", 0, 1.0)], "city string, pos long, x double")
    with pytest.raises(ValueError, match="at least one row"):
        sliding.sliding_moments(df, ["city"], "pos", ["x"], [0])
    assert sliding.sliding_moments(df.where("pos > 0"), ["city"], "pos", ["x"], [4]).count() == 0
