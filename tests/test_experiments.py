"""Chronological folds and grids of models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SIGNALS, make_panel, to_spark
from panelcast.functions import scalar as S
from panelcast.operators import evaluate as V
from panelcast.operators.contracts import ContractError
from panelcast.operators.position import expanding_folds, proportional_prefix, row_position
from panelcast.operators.profile import lag_correlation
from panelcast.operators.storage import save_point
from panelcast.plans.experiments import fold_examples, fold_panel, run_grid, summarise_grid
from panelcast.spec import MlpConfig, PanelSpec

SPEC = PanelSpec("city", "week_start_date", "total_cases", SIGNALS, (), "weekofyear", "day")
SMALL = MlpConfig(hidden=(6, 3), dropout=(0.1, 0.1), epochs=2, steps=10)


@pytest.fixture(scope="module")
def placed(spark):
    return save_point(row_position(to_spark(spark, make_panel({"a": 300, "b": 240})), ["city"], "week_start_date", "day"))


def test_folds_never_train_on_later_rows(placed):
    folds = expanding_folds(placed, 3)
    edges = folds.groupBy("city", "fold").agg(
        F.max(F.when(F.col("role") == "train", F.col("week_start_date"))).alias("last_train"),
        F.min(F.when(F.col("role") == "validate", F.col("week_start_date"))).alias("first_validate"),
        F.count_if(F.col("role") == "validate").alias("held"),
    ).collect()
    assert len(edges) == 6
    assert all(r["last_train"] < r["first_validate"] and r["held"] == 52 for r in edges)
    last = folds.where("fold = 3 and role = 'validate' and city = 'a'").agg(F.max("seq")).first()[0]
    assert last == 299


def test_prefix_keeps_the_published_proportion(spark):
    rows = spark.range(936).select(F.lit("sj").alias("city"), F.col("id").alias("seq"), F.lit(936).alias("n")).unionByName(
        spark.range(520).select(F.lit("iq").alias("city"), F.col("id").alias("seq"), F.lit(520).alias("n"))
    )
    assert proportional_prefix(rows, "city", "sj").count() == 491


def test_scaling_of_a_fold_uses_its_training_rows(placed):
    folded = fold_panel(placed, SPEC, 2).where("role = 'train'").groupBy("city", "fold").agg(
        F.avg("rain").alias("m"), F.stddev_pop("rain").alias("s"), F.min("_week_scaled").alias("lo")
    )
    for r in folded.collect():
        assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1) and r["lo"] == 0


def test_grid_covers_every_combination(placed):
    folded = save_point(fold_panel(placed, SPEC, 2))
    examples = save_point(fold_examples(folded, SPEC, ["multiscale", "raw_lags"], {"rain": 5, "weekofyear": 3}))
    models, predictions = run_grid(examples, SPEC, {"one": SMALL, "two": SMALL}, [1, 2])
    assert models.count() == 2 * 2 * 2 * 2 * 2
    predictions = save_point(predictions)
    assert predictions.count() == 32 * 52
    summary = summarise_grid(predictions, folded, SPEC, "representation").toPandas()
    assert set(summary["representation"]) == {"multiscale", "raw_lags"}
    pdf = predictions.toPandas()
    pdf["e"] = (pdf["y"] - pdf["prediction"]).abs()
    runs = pdf[pdf.representation == "raw_lags"].groupby(["city", "fold", "config", "seed"])["e"].mean()
    by_run = pdf[pdf.representation == "raw_lags"].groupby(["city", "fold", "seed"])["e"].mean()
    row = summary[(summary.representation == "raw_lags") & (summary.city == "a")].iloc[0]
    assert len(runs) == 16
    assert row["mean_mae"] == pytest.approx(by_run["a"].mean())
    assert row["worst_mae"] == pytest.approx(by_run["a"].max())


def test_unfilled_gap_is_reported(placed):
    holed = placed.withColumn("rain", F.when(F.col("seq") != F.col("n") - 52, F.col("rain")))
    examples = fold_examples(fold_panel(holed, SPEC, 1), SPEC, ["multiscale"])
    with pytest.raises(ContractError):
        run_grid(examples, SPEC, {"one": SMALL}, [1])


def test_constant_series_have_no_correlation(placed):
    flat = placed.withColumn("heat", F.when(F.col("city") == "a", F.lit(2.0)).otherwise(F.col("heat")))
    got = lag_correlation(flat, "city", "seq", "total_cases", ["rain", "heat"], 3).collect()
    for r in got:
        assert (r["corr"] is None) == (r["city"] == "a" and r["variable"] == "heat")


def test_missing_predictions_do_not_become_counts(spark):
    df = spark.createDataFrame([(-0.3,), (0.49,), (0.5,), (2.5,), (2.9,), (None,), (float("nan"),)], "x double")
    got = df.select(S.round_nearest_nonneg("x"), S.truncate_nonneg("x"), S.selu("x")).collect()
    assert [r[0] for r in got] == [0, 0, 1, 3, 3, None, None]
    assert [r[1] for r in got] == [0, 0, 0, 2, 2, None, None]
    assert got[5][2] is None and np.isnan(got[6][2])


def test_blend_and_top_residuals(spark):
    df = spark.createDataFrame([("a", i, float(i), 0.0, 2.0 * i) for i in range(10)], "e string, t long, y double, f double, b double")
    best = V.best_blend(V.blend_grid(df, "y", "f", "b", ["e"]), ["e"]).first()
    assert (best["weight"], best["mae"]) == (0.5, 0.0)
    top = V.top_residuals(df, "e", "t", "y", "f", 3).orderBy("rank").collect()
    assert [(r["t"], r["abs_error"]) for r in top] == [(9, 9.0), (8, 8.0), (7, 7.0)]
