"""Lead-ins and feature vectors against plain NumPy on small panels, with blocks far smaller than series."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SIGNALS, make_panel, to_spark
from panelcast.operators.blocks import with_history
from panelcast.operators.history import (
    history_complete,
    lead_in_circular,
    lead_in_none,
    lead_in_previous,
    multiscale_features,
    multiscale_names,
    past_mean_shifted,
    raw_lag_features,
    raw_plus_summaries,
    sparse_lags,
    tree_features,
)
from panelcast.operators.position import row_position

BY = ["city"]


@pytest.fixture(scope="module")
def panel():
    return make_panel({"a": 230, "b": 120})


@pytest.fixture(scope="module")
def placed(spark, panel):
    return row_position(to_spark(spark, panel), BY, "week_start_date", "day", steps=64).cache()


def brute_multiscale(series, weeks, end):
    out = []
    for s in SIGNALS:
        h = series[s].to_numpy()[end - 51 : end + 1]
        mean = lambda k: h[-k:].mean()
        out += [h[-1], *(mean(k) for k in (2, 4, 8, 13, 26, 52)), h[-4:].std(), h[-13:].std()]
        out += [mean(4) - mean(13), (h[51] - h[39]) / 12]
    phase = 2 * np.pi * (weeks[end] - 1) / 52
    return out + [np.sin(phase), np.cos(phase), np.sin(2 * phase), np.cos(2 * phase)]


def test_row_position_is_time_order(panel, placed):
    got = placed.orderBy("city", "seq").select("city", "seq", "n", "week_start_date").toPandas()
    want = panel.sort_values(["city", "week_start_date"])
    assert list(got["week_start_date"]) == list(want["week_start_date"])
    assert list(got["seq"]) == list(range(230)) + list(range(120))
    assert set(zip(got["city"], got["n"])) == {("a", 230), ("b", 120)}


@pytest.mark.parametrize("rows", [53, 64, 4096])
def test_multiscale_matches_numpy(panel, placed, rows):
    got = multiscale_features(
        lead_in_none(placed), BY, SIGNALS, "weekofyear", keep=["city", "pos"], rows=rows
    ).toPandas()
    assert len(got) == (230 - 51) + (120 - 51)
    for city, part in got.groupby("city"):
        series = panel[panel.city == city].reset_index(drop=True)
        for _, row in part.iterrows():
            want = brute_multiscale(series, series.weekofyear.to_numpy(), row.pos)
            np.testing.assert_allclose(row.features, np.float32(want), rtol=1e-5, atol=1e-6)
    assert len(multiscale_names(SIGNALS)) == 3 * 11 + 4


def test_circular_rotation(placed):
    got = history_complete(lead_in_circular(placed, 53, 2)).where("city = 'b'").orderBy("pos").select("seq").toPandas()
    assert list(got["seq"]) == [118, 119, *range(118)]


def test_previous_split_positions(spark, placed):
    train, test = placed.where("seq < n - 30"), placed.where("seq >= n - 30")
    train = train.withColumn("n", F.col("n") - 30)
    test = test.withColumn("seq", F.col("seq") - F.col("n") + 30).withColumn("n", F.lit(30).cast("long"))
    ends = history_complete(lead_in_previous(train, test, BY, 53, 2).where("city='b'")).orderBy("pos").toPandas()
    assert list(ends["seq"]) == [88, 89, *range(28)]
    ends = history_complete(lead_in_previous(train, test, BY, 53, 0).where("city='b'")).orderBy("pos").toPandas()
    assert list(ends["seq"]) == list(range(30))


@pytest.mark.parametrize("rows", [52, 60, 4096])
def test_raw_lags_match_numpy(panel, placed, rows):
    lengths = {"rain": 33, "heat": 3, "damp": 41}
    got = raw_lag_features(lead_in_none(placed), BY, lengths, keep=["city", "pos"], rows=rows).toPandas()
    assert len(got) == (230 - 51) + (120 - 51)
    for city, part in got.groupby("city"):
        series = panel[panel.city == city].reset_index(drop=True)
        for _, row in part.iterrows():
            p = row.pos
            want = np.concatenate([series[c].to_numpy()[p - k + 1 : p + 1] for c, k in lengths.items()])
            np.testing.assert_allclose(row.features, np.float32(want), rtol=1e-6)


def test_both_representations_are_concatenated(placed):
    lengths = {"rain": 5, "heat": 3}
    both = raw_plus_summaries(lead_in_none(placed), BY, SIGNALS, "weekofyear", lengths, keep=["city", "pos"])
    sizes = both.select(F.size("features").alias("k")).distinct().toPandas()["k"].tolist()
    assert sizes == [8 + 37]


def test_shifted_means_and_lags_never_see_the_current_row(panel, placed):
    w = with_history(placed, BY, "seq", lambda w: {"past": past_mean_shifted("rain", 4, w)}, back=4, rows=16)
    got = sparse_lags(w, BY, "seq", ["rain"]).where("city='a'").orderBy("seq").toPandas()
    rain = panel[panel.city == "a"]["rain"].to_numpy()
    assert np.isnan(got["past"][0])
    for t in range(16, 230):
        assert got["past"][t] == pytest.approx(rain[t - 4 : t].mean())
        assert got["rain_lag_16"][t] == rain[t - 16]


def test_future_rows_do_not_change_history(spark, panel):
    early = panel[panel.week_start_date < panel.week_start_date.sort_values().iloc[150]]
    def run(pdf):
        placed = row_position(to_spark(spark, pdf), BY, "week_start_date", "day")
        rows = tree_features(placed, BY, "seq", SIGNALS, "weekofyear").orderBy("city", "seq").toPandas()
        return rows.drop(columns=["n"])
    full, cut = run(panel), run(early)
    merged = cut.merge(full, on=["city", "seq"], suffixes=("", "_full"))
    assert len(merged) == len(cut)
    for c in cut.columns.difference(["city", "seq"]):
        assert merged[c].equals(merged[c + "_full"])


def test_one_shuffle_for_all_window_features(spark, panel):
    df = to_spark(spark, panel.assign(seq=panel.groupby("city").cumcount(), n=panel.groupby("city")["city"].transform("size")))
    plan = multiscale_features(lead_in_none(df), BY, SIGNALS, "weekofyear")._jdf.queryExecution().executedPlan().toString()
    operators = re.findall(r"^[ :+-]*(\w+)", plan, re.M)
    assert operators.count("Exchange") == 1, operators
    assert operators.count("Sort") == 1, operators


def test_many_columns_are_compiled(spark, placed):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        tree_features(placed, BY, "seq", SIGNALS, "weekofyear")
        assert int(spark.conf.get(name)) == 8000  # longer methods are never compiled by the JVM
        spark.conf.set(name, "4000")
        tree_features(placed, BY, "seq", SIGNALS, "weekofyear")
        assert int(spark.conf.get(name)) == 4000
    finally:
        spark.conf.set(name, before)
