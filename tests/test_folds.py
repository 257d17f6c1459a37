"""Statistics of folds from segments equal those over copied rows, and the copies are not shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import folds as O
from panelcast.operators.evaluate import baseline_climatology, baseline_mean, impute_median, outbreak_threshold
from panelcast.operators.position import expanding_folds
from panelcast.operators.scale import fit_scaling

BY = ["city"]


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(7), []
    for city, n in (("sj", 400), ("iq", 95), (None, 61), ("tiny", 12), ("one", 1)):
        for i in range(n):
            rain = None if rng.random() < 0.2 or city == "one" else float(1e6 + rng.normal())
            rows.append((city, i, n, i % 13, int(rng.poisson(3)), rain, None))
    kinds = "city string, seq long, n long, week long, y long, rain double, heat double"
    return spark.createDataFrame(rows, kinds).repartition(5).cache()


def table(df, keys):
    return {tuple(r[k] for k in keys): {c: r[c] for c in df.columns if c not in keys} for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key, row in want.items():
        for name, value in row.items():
            if value is None:
                assert got[key][name] is None, (key, name)
            else:
                assert got[key][name] == pytest.approx(value, rel=1e-12, abs=1e-9), (key, name)


@pytest.mark.parametrize(("folds", "horizon"), [(1, 20), (3, 20), (7, 13)])
def test_scaling_and_thresholds(panel, folds, horizon):
    train = expanding_folds(panel, folds, horizon).where("role = 'train'")
    keys = ["city", "fold"]
    got = O.fold_scaling(panel, ["rain", "heat", "y"], BY, folds, horizon, ["week"])
    same(table(got, keys), table(fit_scaling(train, ["rain", "heat", "y"], ["week"], keys), keys))
    limits = O.fold_thresholds(panel, BY, "y", folds, horizon)
    same(table(limits, keys), table(outbreak_threshold(train, keys, "y"), keys))


def test_baselines(panel):
    keys = ["city", "fold", "seq"]
    spread = expanding_folds(panel, 4, 20)
    train, held = spread.where("role = 'train'"), spread.where("role = 'validate'")
    # A plain join loses series without a name; they are compared under another one.
    named = lambda df: df.withColumn("city", F.coalesce("city", F.lit("-")))
    want = baseline_mean(named(train), named(held), ["city", "fold"], "y").withColumnRenamed("prediction", "mean")
    want = baseline_climatology(named(train), want, ["city", "fold"], "week", "y").select(*keys, "mean", F.col("prediction").alias("climatology"))
    got = O.fold_baselines(panel, BY, "week", "y", 4, 20).select(*keys, "mean", "climatology")
    same(table(named(got), keys), table(want, keys))


def test_medians_fill_gaps_of_their_fold(panel):
    named = panel.withColumn("city", F.coalesce("city", F.lit("-")))
    spread = expanding_folds(named, 3, 20)
    keys = ["city", "fold", "seq"]
    want = impute_median(spread, spread.where("role = 'train'"), ["city", "fold"], ["rain", "heat"])
    got = O.impute_fold_medians(named, BY, ["rain", "heat"], 3, 20)
    assert got.columns == want.columns
    same(table(got.select(*keys, "rain", "heat"), keys), table(want.select(*keys, "rain", "heat"), keys))


def test_many_pieces_are_joined_instead_of_sent(panel, monkeypatch):
    keys = ["city", "fold"]
    want = table(O.fold_thresholds(panel, BY, "rain", 3, 20, 0.37), keys)
    monkeypatch.setattr(O, "BROADCAST_PIECES", 0)
    same(table(O.fold_thresholds(panel, BY, "rain", 3, 20, 0.37), keys), want)


def test_validation_rows(panel):
    want = expanding_folds(panel, 3, 20).where("role = 'validate'").select("city", "seq", "fold")
    got = O.validation_rows(panel, 3, 20).select("city", "seq", "fold")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_an_empty_panel(panel):
    none = panel.where("seq < 0")
    assert O.fold_scaling(none, ["rain"], BY, 3, 20).count() == 0
    assert O.fold_baselines(none, BY, "week", "y", 3, 20).count() == 0
    assert O.impute_fold_medians(none, BY, ["rain"], 3, 20).count() == 0


def exchanged(df):
    """Rows written to shuffles of the plan that ran."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        for i in range(node.children().size()):
            stack.append(node.children().apply(i))
    return total


def test_shuffled_rows_are_summaries(spark):
    rows = spark.range(20_000).select(
        F.lit("a").alias("city"), F.col("id").alias("seq"), F.lit(20_000).cast("long").alias("n"), F.rand(1).alias("x")
    ).repartition(4).cache()
    rows.count()
    few, many = (exchanged(O.fold_scaling(rows, ["x"], BY, k, 50)) for k in (2, 8))
    assert 0 < few <= 16 + 2 and many <= 4 * 8 + 8
