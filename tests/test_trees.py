import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate as V
from panelcast.operators import trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (400, 3))
    y = rng.poisson(np.exp(1.5 + x[:, 0]))
    rows = [(float(a), float(b), float(c), int(t), i) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y long, i long").cache()
    return df.where("i < 300"), df.where("i >= 300")


def error(df):
    return V.mae(df, "y", "prediction").first()["mae"]


def test_tree_models_beat_the_mean(data):
    train, held = data
    mean = train.agg(F.avg("y")).first()[0]
    base = error(held.withColumn("prediction", F.lit(mean)))
    fits = {
        "forest": trees.forest_regressor(train, ["a", "b", "c"], "y", trees=15, max_depth=5),
        "log forest": trees.forest_regressor(train, ["a", "b", "c"], "y", log_target=True, trees=15, max_depth=5),
        "boosted": trees.boosted_regressor(train, ["a", "b", "c"], "y", rounds=15, learning_rate=0.2),
        "squared": trees.boosted_regressor(train, ["a", "b", "c"], "y", "squared", rounds=15, learning_rate=0.2),
        "counts": trees.boosted_regressor(train, ["a", "b", "c"], "y", "poisson", rounds=40, learning_rate=0.2),
        "poisson": trees.poisson_regressor(train, ["a", "b", "c"], "y"),
    }
    for name, fit in fits.items():
        scored = fit.predict(held)
        assert scored.agg(F.min("prediction")).first()[0] >= 0
        assert error(scored) < 0.7 * base, name


def test_boosting_rejects_unknown_objectives(data):
    with pytest.raises(ValueError, match="no objective"):
        trees.boosted_regressor(data[0], ["a"], "y", objective="quantile")


def test_climatology_falls_back_to_the_mean(spark):
    train = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0), ("a", 2, 9.0)], "e string, week long, y double")
    held = spark.createDataFrame([("a", 1), ("a", 3)], "e string, week long")
    got = {r["week"]: r["prediction"] for r in V.baseline_climatology(train, held, ["e"], "week", "y").collect()}
    assert got == {1: 3.0, 3: 5.0}


def test_median_imputation_uses_training_rows_only(spark):
    train = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("a", None, None)], "e string, x double, z double")
    df = train.unionByName(spark.createDataFrame([("a", None, 7.0)], "e string, x double, z double"))
    got = V.impute_median(df, train, ["e"], ["x", "z"]).collect()
    assert sorted(r["x"] for r in got) == [1.0, 2.0, 2.0, 3.0]
    assert sorted(str(r["z"]) for r in got) == ["7.0", "None", "None", "None"]


def test_groups_without_training_rows_are_kept(spark):
    train = spark.createDataFrame([("a", 1, 2.0)], "e string, week long, y double")
    held = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 3.0)], "e string, week long, y double")
    for scored in (V.baseline_mean(train, held, ["e"], "y"), V.baseline_climatology(train, held, ["e"], "week", "y")):
        assert {r["e"]: r["prediction"] for r in scored.collect()} == {"a": 2.0, "b": None}
    limits = spark.createDataFrame([("a", 1.0)], "e string, threshold double")
    scored = held.withColumn("prediction", F.lit(0.0))
    assert {r["e"]: r["outbreak_mae"] for r in V.outbreak_mae(scored, limits, ["e"], "y", "prediction").collect()} == {"a": 2.0, "b": None}
    runs = scored.withColumns({"m": F.lit("x"), "fold": F.lit(1), "seed": F.lit(1)})
    summary = V.fold_summary(runs, limits, "e", "m", "y", "prediction", threshold_by=["e"])
    assert {r["e"]: (r["mean_mae"], r["outbreak_mae"]) for r in summary.collect()} == {"a": (2.0, 2.0), "b": (3.0, None)}


def test_two_predictions_for_a_key_raise(spark):
    df = spark.createDataFrame([(1, "m", 2.0), (1, "m", 3.0)], "k long, model string, prediction double")
    with pytest.raises(Exception, match="several predictions"):
        V.forecast_comparison(df, ["k"], "model", ["m"]).collect()
