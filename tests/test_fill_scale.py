import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SIGNALS, make_panel, to_spark
from panelcast.operators.fill import interpolate_linear
from panelcast.operators.position import row_position, tail_rows
from panelcast.operators.quantile import exact_quantiles
from panelcast.operators.scale import apply_params, fit_minmax, fit_zscore


def series(spark, values: dict[str, list]):
    rows = [(e, i, len(xs), x) for e, xs in values.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "e string, seq long, n long, x double")


def collected(df):
    out = {}
    for r in df.orderBy("e", "seq").collect():
        out.setdefault(r["e"], []).append(r["x"])
    return out


GAPS = {"sj": [None, 1.0, None, 3.0, None], "iq": [None, 9.0, None, None, None]}


@pytest.mark.parametrize("rows", [1, 2, 1024])
def test_gap_fixtures(spark, rows):
    df = series(spark, GAPS)
    frame = interpolate_linear(df, "e", ["x"], scope="frame", entity_order=["sj", "iq"], rows=rows)
    assert collected(frame) == {"sj": [None, 1, 2, 3, 5], "iq": [7, 9, 9, 9, 9]}
    entity = interpolate_linear(df, "e", ["x"], rows=rows)
    assert collected(entity) == {"sj": [None, 1, 2, 3, 3], "iq": [None, 9, 9, 9, 9]}
    last = interpolate_linear(df, "e", ["x"], method="last", rows=rows)
    assert collected(last) == {"sj": [None, 1, 1, 3, 3], "iq": [None, 9, 9, 9, 9]}


@pytest.mark.parametrize("rows", [7, 1024])
def test_frame_scope_matches_pandas(spark, rows):
    rng = np.random.default_rng(1)
    pieces, values = [], {}
    for i in range(12):
        x = rng.normal(size=rng.integers(1, 40))
        x[rng.random(len(x)) < 0.6] = np.nan
        if i in (4, 5):
            x[:] = np.nan
        values[f"k{i:02d}"] = [None if np.isnan(v) else float(v) for v in x]
        pieces.append(pd.Series(x))
    want = pd.concat(pieces, ignore_index=True).interpolate(method="linear", limit_direction="forward")
    got = [v for xs in collected(interpolate_linear(series(spark, values), "e", ["x"], scope="frame", rows=rows)).values() for v in xs]
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy(), rtol=1e-12)


def test_zscore_tail_weight_matches_numpy(spark):
    panel = make_panel({"a": 200}, missing=0.1)
    df = row_position(to_spark(spark, panel), ["city"], "week_start_date", "day")
    got = fit_zscore(df, SIGNALS, weight_tail=53).first()
    doubled = pd.concat([panel.iloc[-53:], panel])
    for s in SIGNALS:
        assert got[f"{s}_mean"] == pytest.approx(np.nanmean(doubled[s]), abs=1e-12)
        assert got[f"{s}_std"] == pytest.approx(np.nanstd(doubled[s]), abs=1e-12)
    assert tail_rows(df).count() == 53


def test_floors(spark):
    df = series(spark, {"c": [4.0] * 5})
    out = apply_params(df, fit_zscore(df, ["x"]), columns=["x"]).toPandas()
    assert (out["x"] == 0).all()
    out = apply_params(df, fit_minmax(df, "x"), minmax_columns=["x"]).toPandas()
    assert (out["x"] == 0).all()


def test_params_per_entity(spark):
    df = series(spark, {"a": [1.0, 3.0], "b": [10.0, 30.0]})
    out = apply_params(df, fit_zscore(df, ["x"], ["e"]), columns=["x"], by=["e"])
    assert collected(out) == {"a": [-1, 1], "b": [-1, 1]}


@pytest.mark.parametrize("resolution", [1, 4, 65536])
def test_quantiles_match_numpy(spark, resolution):
    rng = np.random.default_rng(2)
    rows = [("ties", float(v)) for v in rng.integers(0, 4, 500)]
    rows += [("tail", float(v)) for v in rng.lognormal(0, 3, 700)]
    rows += [("signs", float(v)) for v in rng.normal(0, 1e-3, 300)] + [("signs", 0.0), ("signs", -0.0)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q1": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", wanted, resolution).collect()}
    assert set(got) == {"ties", "tail", "signs", "one", "two"}
    for g in got:
        values = [v for k, v in rows if k == g]
        for name, q in wanted.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_fill_survives_repartitioning(spark):
    panel = make_panel({"a": 300, "b": 90}, missing=0.2)
    df = row_position(to_spark(spark, panel), ["city"], "week_start_date", "day")
    run = lambda d, rows: interpolate_linear(d, "city", SIGNALS, rows=rows).orderBy("city", "seq").toPandas()
    assert run(df, 16).equals(run(df.repartition(7), 512))
    filled = run(df, 16)
    want = panel.groupby("city")[list(SIGNALS)].transform(lambda s: s.interpolate(limit_direction="forward"))
    np.testing.assert_allclose(filled[list(SIGNALS)], want, rtol=1e-12)
    assert filled.select_dtypes("number").isna().sum().sum() == 0
    assert df.where(F.col("rain").isNull()).count() > 0
