"""Exact quantiles: values, and what the plan moves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import quantile


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    values = {
        "wide": rng.lognormal(0, 3, 3000), "even": np.repeat(7.0, 2000), "signs": rng.normal(size=999),
        "mostly zero": np.where(rng.random(4000) < 0.9, 0.0, rng.normal(size=4000)), "one": np.array([5.0]), None: np.arange(10.0),
    }
    data = [(k, float(v)) for k, x in values.items() for v in x] + [("one", None), ("one", float("nan"))]
    return values, spark.createDataFrame(data, "g string, v double").repartition(6)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_equal_to_numpy_on_either_way(rows, monkeypatch, limit):
    monkeypatch.setattr(quantile, "BROADCAST_PIECES", limit)
    values, df = rows
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "hi": 1.0}
    got = quantile.exact_quantiles(df, ["g"], "v", wanted).collect()
    assert {r["g"] for r in got} == set(values)
    for r in got:
        for name, q in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values[r["g"]], q), rel=1e-12)


@pytest.mark.parametrize("automatic", ["10485760", "-1"])
@pytest.mark.parametrize("limit", [100_000, 0])
def test_raw_rows_stay_where_they_are(spark, rows, tmp_path, monkeypatch, automatic, limit):
    """Exchanges of the second pass hold counts: far fewer rows than the table where values repeat."""
    monkeypatch.setattr(quantile, "BROADCAST_PIECES", limit)
    path = str(tmp_path / "rows")
    rows[1].where("g = 'mostly zero'").select("g", F.round("v", 1).alias("v")).repartition(4).write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", automatic)
    try:
        out = quantile.exact_quantiles(spark.read.parquet(path), ["g"], "v", {"mid": 0.5, "p99": 0.99})
        out.collect()
        plan = out._jdf.queryExecution().executedPlan()
        text = plan.toString().split("== Initial Plan ==")[0]
        assert text.count("FileScan parquet") <= 2
        # The raw scan feeds a partial aggregate or a broadcast join, never an exchange.
        lines = [x.strip() for x in text.splitlines()]
        scan = next(i for i, x in enumerate(lines) if path.rsplit("/", 1)[-1] in x and "FileScan" in x)
        above = [x for x in lines[:scan][::-1] if "Exchange" in x or "HashAggregate" in x or "HashJoin" in x or "MergeJoin" in x]
        assert "HashAggregate" in above[0] or "BroadcastHashJoin" in above[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_windows_see_spans_not_groups(spark, monkeypatch):
    monkeypatch.setattr(quantile, "SPAN", 8)
    pieces = spark.createDataFrame([("a", float(p), 2) for p in range(-40, 60)], "g string, _piece double, _w long")
    got = quantile._piece_starts(pieces, ["g"]).orderBy("_piece").collect()
    assert [r["_start"] for r in got] == list(range(0, 200, 2)) and {r["_n"] for r in got} == {200}
