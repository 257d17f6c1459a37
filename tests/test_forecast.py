"""End-to-end runs on a small synthetic panel, and the network against finite differences."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SIGNALS, make_panel, to_spark
from panelcast.operators.contracts import ContractError, check_output_schema
from panelcast.operators import mlp
from panelcast.operators.mlp import (
    drawn_rows, fit_network, fit_networks, fits_of, loss_gradients, new_layers, placed_fits, predict, score_mlp,
    train_grouped_mlp, training_history, unpack,
)
from panelcast.plans.forecast import city_features, evaluate, evaluate_files, forecast, forecast_files, prepare
from panelcast.sources.csv import label_schema, read_back
from panelcast.spec import (
    CLIMATE_PANEL,
    CLIMATE_SIGNALS,
    VEGETATION_SIGNALS,
    EntityPlan,
    MlpConfig,
    PanelSpec,
    RunSettings,
    historical_settings,
    holdout_settings,
    raw_lag_table,
)

SPEC = PanelSpec(
    "city", "week_start_date", "total_cases", SIGNALS, ("city", "year", "weekofyear"), "weekofyear", "day"
)
SMALL = MlpConfig(hidden=(8, 4), dropout=(0.1, 0.1), epochs=3, steps=10)
SETTINGS = RunSettings(
    configs={"m": SMALL},
    entities={"iq": EntityPlan("raw_lags", "m", "truncate", lags={"rain": 33, "heat": 4, "damp": 41, "weekofyear": 3})},
    default=EntityPlan("multiscale", "m", "nearest"),
)
HISTORICAL = dataclasses.replace(
    SETTINGS, default=None, entities={"sj": SETTINGS.default, **SETTINGS.entities}, fill_scope="frame", scale_entity="sj", scale_tail=53, lead_in="circular", test_offset=2
)


@pytest.fixture(scope="module")
def tables(spark):
    pdf = make_panel({"sj": 260, "iq": 200}, missing=0.05)
    cut = pdf.groupby("city").cumcount() >= pdf.groupby("city")["city"].transform("size") - 52
    train, test = pdf[~cut], pdf[cut]
    keys = list(SPEC.keys)
    template = test[keys].reset_index(drop=True)
    template["pos"] = range(len(template))
    features = to_spark(spark, train.drop(columns=["total_cases"]))
    return {
        "pdf": pdf,
        "features": features,
        "labels": to_spark(spark, train[[*keys, "total_cases"]]),
        "test": to_spark(spark, test.drop(columns=["total_cases"]).assign(pos=range(len(test)))),
        "template": to_spark(spark, template),
    }


def test_fixed_tables():
    assert sum(raw_lag_table("iq").values()) == 380 and sum(raw_lag_table("sj").values()) == 461
    assert list(raw_lag_table("sj")) == [*CLIMATE_SIGNALS, "weekofyear"]
    assert historical_settings().lead_rows == 53
    assert all((c.epochs, c.steps, c.batch) == (28, 120, 16) for c in holdout_settings().configs.values())
    assert all((c.epochs, c.steps, c.batch) == (40, 200, 16) for c in historical_settings().configs.values())


@pytest.mark.parametrize("settings", [SETTINGS, HISTORICAL], ids=["default", "historical"])
def test_forecast_end_to_end(spark, tables, settings, tmp_path):
    out = str(tmp_path / "submission")
    result = forecast(
        tables["features"], tables["labels"], tables["test"], tables["template"], SPEC, settings, out
    )
    columns = [*SPEC.keys, "total_cases"]
    back = read_back(spark, out, label_schema(SPEC))
    check_output_schema(back.select(*columns), columns, "total_cases")
    written = back.orderBy("pos").toPandas()
    template = tables["template"].orderBy("pos").toPandas()
    assert written[list(SPEC.keys)].astype(str).equals(template[list(SPEC.keys)].astype(str))
    summary = {r["city"]: r for r in result.summary.collect()}
    assert {c: summary[c]["rows"] for c in summary} == {"sj": 52, "iq": 52}
    assert all(r["train_mae"] < 20 for r in summary.values())
    assert result.models.select("train_rows").toPandas()["train_rows"].min() > 90


def brute_examples(pdf, offset):
    """The published alignment with arrays: context of 53 rows, history ending at row 51 + i."""
    out = {}
    parts = {c: g.sort_values("week_start_date").reset_index(drop=True) for c, g in pdf.groupby("city")}
    order = ["sj", "iq"]
    frame = np.concatenate([parts[c][list(SIGNALS)].to_numpy()[:-52] for c in order])
    tests = np.concatenate([parts[c][list(SIGNALS)].to_numpy()[-52:] for c in order])
    import pandas as pd

    fill = lambda a: pd.DataFrame(a).interpolate(limit_direction="forward").to_numpy()
    frame, tests = fill(frame), fill(tests)
    sizes = [len(parts[c]) - 52 for c in order]
    sj = frame[: sizes[0]]
    ref = np.concatenate([sj[-53:], sj])
    mean, std = ref.mean(0), ref.std(0)
    at = 0
    for i, c in enumerate(order):
        train = (frame[at : at + sizes[i]] - mean) / std
        test = (tests[52 * i : 52 * i + 52] - mean) / std
        at += sizes[i]
        for split, body in (("train", train), ("test", test)):
            combined = np.concatenate([train[-53:], body])
            first = 51 if split == "train" else 53 - offset
            for k in range(len(body)):
                out[c, split, first + k] = combined[first + k - 51 : first + k + 1]
    return out


def test_historical_alignment_matches_numpy(spark, tables):
    train = prepare(tables["features"].join(tables["labels"], list(SPEC.keys)), SPEC, HISTORICAL)
    test = prepare(tables["test"].drop("pos"), SPEC, HISTORICAL)
    got = city_features(train, test, SPEC, HISTORICAL).toPandas()
    want = brute_examples(tables["pdf"], 2)
    assert {(r.city, r.split, r.pos) for r in got.itertuples()} == set(want)
    for r in got.itertuples():
        h = want[r.city, r.split, r.pos]
        if r.city == "sj":
            expected = [h[-1][0], h[-2:, 0].mean(), h[-4:, 0].mean()]
            np.testing.assert_allclose(r.features[:3], expected, rtol=1e-4, atol=1e-5)
            np.testing.assert_allclose(r.features[6], h[:, 0].mean(), rtol=1e-4, atol=1e-5)
        else:
            np.testing.assert_allclose(r.features[:33], h[-33:, 0], rtol=1e-4, atol=1e-5)


def test_evaluate_holds_out_the_last_rows(tables):
    run = evaluate(tables["features"], tables["labels"], SPEC, HISTORICAL, "sj")
    rows = run.rows.toPandas()
    assert len(rows) == 52 and rows["abs_error"].notna().all()
    labels = tables["labels"].where("city = 'sj'").toPandas()
    assert rows["total_cases"].sum() == labels.sort_values(["year", "weekofyear"])["total_cases"].tail(52).sum()
    history = run.history.orderBy("epoch").toPandas()
    assert len(history) == 3 and history["train_mae"].notna().all()
    assert history["val_mae"].iloc[-1] == pytest.approx(rows["abs_error"].mean())


def test_offsets_beyond_the_context_lengthen_it(tables):
    settings = dataclasses.replace(SETTINGS, train_offset=5, test_offset=5)
    assert settings.lead_rows == 56
    assert evaluate(tables["features"], tables["labels"], SPEC, settings, "sj").rows.count() == 52


def test_missing_first_value_is_reported(spark, tables):
    first = F.col("week_start_date") == F.lit("2000-01-01").cast("date")
    holes = tables["features"].withColumn("rain", F.when(~first, F.col("rain")))
    with pytest.raises(ContractError):
        forecast(holes, tables["labels"], tables["test"], tables["template"], SPEC, SETTINGS)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    layers = new_layers([5, 4, 3, 1], rng)
    x, y = rng.normal(size=(7, 5)), rng.normal(size=7) * 3
    masks = [rng.random((7, 4)) + 0.5, rng.random((7, 3)) + 0.5]
    loss, gradients = loss_gradients(layers, x, y, masks)
    for (w, b), (gw, gb) in zip(layers, gradients):
        for value, gradient in ((w, gw), (b, gb)):
            for i in np.ndindex(value.shape):
                kept = value[i]
                value[i] = kept + 1e-6
                up, _ = loss_gradients(layers, x, y, masks)
                value[i] = kept - 1e-6
                down, _ = loss_gradients(layers, x, y, masks)
                value[i] = kept
                assert (up - down) / 2e-6 == pytest.approx(gradient[i], abs=1e-5)


def test_fit_is_deterministic_and_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    y = 3 * x[:, 0] + 10
    config = MlpConfig(hidden=(16, 8), dropout=(0.0, 0.0), epochs=10, steps=50)
    layers, history = fit_network(x, y, config, 7)
    again, _ = fit_network(x, y, config, 7)
    assert np.array_equal(predict(layers, x), predict(again, x))
    assert np.abs(predict(layers, x) - y).mean() < 0.5 * np.abs(y - np.median(y)).mean()
    assert [h["epoch"] for h in history] == list(range(1, 11))


def test_grouped_training_ignores_partitioning_and_scores_in_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [
        (e, s, "m", p, float(p % 7), [float(v) for v in rng.normal(size=5)])
        for e in ("a", "b")
        for s in (1, 2)
        for p in range(90)
    ]
    schema = "city string, seed long, config string, pos long, y double, features array<float>"
    by = ["city", "seed", "config"]
    df = spark.createDataFrame(rows, schema)
    one = train_grouped_mlp(df.repartition(1), by, {"m": SMALL}).cache()
    two = train_grouped_mlp(df.repartition(9), by, {"m": SMALL})
    assert one.orderBy(*by).toPandas()["layers"].astype(str).equals(two.orderBy(*by).toPandas()["layers"].astype(str))
    a = score_mlp(df, one, by, rows=16).orderBy(*by, "pos").toPandas()
    b = score_mlp(df, one, by).orderBy(*by, "pos").toPandas()
    assert len(a) == len(rows)
    np.testing.assert_allclose(a["prediction"], b["prediction"], rtol=1e-9)


def _series(spark, count, held=0):
    rng = np.random.default_rng(4)
    rows = [
        ("a", 1, "t", "train" if p < count else "validate", p, float(p % 5), [float(v) for v in rng.normal(size=3)])
        for p in range(count + held)
    ]
    return spark.createDataFrame(
        rows, "city string, seed long, config string, role string, pos long, y double, features array<float>"
    )


@pytest.mark.parametrize("count", [70, 400])  # below and above the rows the solver visits
def test_errors_of_every_epoch_are_measured_over_all_rows(spark, count):
    tiny = MlpConfig(hidden=(3, 2), dropout=(0.0, 0.0), epochs=2, steps=5)
    assert 70 < tiny.epochs * tiny.steps * tiny.batch < 400
    df, by = _series(spark, count, held=count), ["city", "seed", "config"]
    models = train_grouped_mlp(df, by, {"t": tiny}, snapshots=True).cache()
    row = models.first()
    assert row["train_rows"] == count
    history = training_history(models, by, df).orderBy("epoch").toPandas()
    pdf = df.toPandas()
    for part, column, rounded in (("train", "train_mae", False), ("validate", "val_mae", True)):
        own = pdf[pdf.role == part]
        x, y = np.stack(own.features.to_numpy()).astype(float), own.y.to_numpy()
        for epoch, packed in enumerate(row["snapshots"]):
            value = predict(unpack(packed, row["width"]), x)
            value = np.floor(np.maximum(value, 0) + 0.5) if rounded else value
            assert history[column].iloc[epoch] == pytest.approx(np.abs(value - y).mean())
    assert np.allclose([v for v in row["snapshots"][-1][0]["weights"]], row["layers"][0]["weights"])


def test_a_large_group_sends_only_the_rows_it_draws(spark):
    """A group of ten times the rows its steps draw trains as one task holding all its rows would."""
    tiny = MlpConfig(hidden=(3, 2), dropout=(0.1, 0.0), epochs=2, steps=5, batch=4)
    assert drawn_rows(tiny) == 40
    df, by = _series(spark, 400), ["city", "seed", "config"]
    small = _series(spark, 30).withColumn("city", F.lit(None).cast("string"))
    both = df.withColumn("pos", F.col("pos") * 700 + 3).unionByName(small).repartition(7)
    got = {r["city"]: r for r in train_grouped_mlp(both, by, {"t": tiny}).collect()}
    for city, rows in (("a", df), (None, small)):
        pdf = rows.toPandas().sort_values("pos")
        layers, history = fit_network(np.stack(pdf.features.to_numpy()).astype(float), pdf.y.to_numpy(), tiny, 1)
        assert got[city]["train_rows"] == len(pdf) and [h["lr"] for h in got[city]["history"]] == [h["lr"] for h in history]
        for packed, (w, b) in zip(got[city]["layers"], layers, strict=True):
            np.testing.assert_allclose(packed["weights"], w.ravel(), rtol=1e-12)
            np.testing.assert_allclose(packed["bias"], b, rtol=1e-12)


def test_stacked_seeds_train_as_they_would_alone():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=50)
    config = MlpConfig(hidden=(5, 4), dropout=(0.3, 0.5), epochs=3, steps=9, patience=1)
    seen = []
    together = fit_networks(x, y, config, [3, 1, 2], lambda now: seen.append(now))
    for i, seed in enumerate([3, 1, 2]):
        layers, history = fit_network(x, y, config, seed)
        assert history == together[i][1]
        for (w, b), (v, c), (u, _) in zip(layers, together[i][0], seen[-1][i], strict=True):
            assert np.array_equal(w, v) and np.array_equal(b, c) and np.array_equal(u, v)


def test_fits_are_spread_over_tasks(spark):
    rows = [(e, k, p, float(p % 5), [1.0 * p, 2.0]) for e in "abc" for k in range(9) for p in range(20)]
    df = spark.createDataFrame(rows, "city string, fold int, pos long, y double, features array<float>")
    models = train_grouped_mlp(df, ["city", "fold"], {"t": SMALL}, runs=[("t", 1), ("t", 2)])
    tasks = models.select("city", "fold", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(tasks) == 27 and len({r["task"] for r in tasks}) == 27


def test_longest_fits_come_first_and_many_share_places(spark, monkeypatch):
    sizes = [(str(i), 10 + i, 5 + 7 * (i % 4)) for i in range(40)]
    df = spark.createDataFrame(
        [(e, [0.0] * width) for e, rows, width in sizes for _ in range(rows)], "city string, features array<float>"
    )
    costs = fits_of(df, ["city"], {"t": SMALL}, [("t", 1)])
    fits, places, partly = placed_fits(costs)
    placed = fits.orderBy("_place").collect()
    assert places == 40 and not partly
    assert [r["_cost"] for r in placed] == sorted((r["_cost"] for r in placed), reverse=True)
    monkeypatch.setattr(mlp, "FIT_PLACES", 7)
    fits, places, _ = placed_fits(costs)
    loads = [r["s"] for r in fits.groupBy("_place").agg(F.sum("_cost").alias("s")).collect()]
    assert places == len(loads) == 7 and max(loads) - min(loads) <= max(r["_cost"] for r in placed)
    monkeypatch.setattr(mlp, "PLACED_FITS", 10)
    fits, places, _ = placed_fits(costs)
    assert fits.count() == 40 and places == 7


def test_models_beyond_the_sending_bound_meet_their_rows(spark, monkeypatch):
    df = _series(spark, 60, held=20).drop("config", "seed")
    models = train_grouped_mlp(df, ["city"], {"t": SMALL}, runs=[("t", 1), ("t", 2)]).cache()
    rows = df.unionByName(df.where("pos < 3").withColumn("city", F.lit(None).cast("string")))
    sent = score_mlp(rows, models, ["city"], runs=["config", "seed"]).orderBy("city", "pos", "seed").collect()
    monkeypatch.setattr(mlp, "SENT_WEIGHTS", 0)
    met = score_mlp(rows, models, ["city"], runs=["config", "seed"]).orderBy("city", "pos", "seed").collect()
    assert sent == met and len(sent) == 163 and sum(r["prediction"] is None for r in sent) == 3


def test_runs_share_the_rows_of_a_group(spark):
    df = _series(spark, 60, held=20)
    runs = [("one", 1), ("one", 2), ("two", 1)]
    configs = {"one": SMALL, "two": dataclasses.replace(SMALL, hidden=(4, 3))}
    models = train_grouped_mlp(df.drop("config", "seed"), ["city"], configs, runs=runs).cache()
    assert {(r["config"], r["seed"]) for r in models.collect()} == set(runs)
    alone = train_grouped_mlp(df.withColumn("config", F.lit("one")), ["city", "seed", "config"], configs).first()
    assert models.where("config = 'one' and seed = 1").first()["layers"] == alone["layers"]
    held = df.drop("config", "seed").where("role = 'validate'")
    scored = score_mlp(held, models, ["city"], runs=["config", "seed"]).groupBy("config", "seed").count().collect()
    assert sorted(r["count"] for r in scored) == [20, 20, 20]
    lost = score_mlp(held.withColumn("city", F.lit("b")), models, ["city"]).collect()
    assert len(lost) == 20 and all(r["prediction"] is None for r in lost)


def test_examples_that_go_missing_are_reported(spark):
    pdf = make_panel({"sj": 40})
    train = prepare(to_spark(spark, pdf), SPEC, HISTORICAL)
    with pytest.raises(ContractError, match="rows=80"):
        city_features(train, train.drop("total_cases"), SPEC, dataclasses.replace(HISTORICAL, entities={"sj": SETTINGS.default}))


def test_published_vector_widths(spark):
    pdf = make_panel({"sj": 150, "iq": 140}, signals=CLIMATE_SIGNALS)
    cut = pdf.groupby("city").cumcount() >= pdf.groupby("city")["city"].transform("size") - 30
    settings = historical_settings()
    spec = CLIMATE_PANEL
    train = prepare(to_spark(spark, pdf[~cut]), spec, settings)
    test = prepare(to_spark(spark, pdf[cut].drop(columns=["total_cases"])), spec, settings)
    sizes = city_features(train, test, spec, settings).groupBy("city", "split").agg(
        F.max(F.size("features")), F.count("*")
    ).collect()
    assert {tuple(r) for r in sizes} == {
        ("sj", "train", 180, 120), ("sj", "test", 180, 30), ("iq", "train", 380, 110), ("iq", "test", 380, 30)
    }


def test_runs_from_csv_files(spark, tmp_path):
    pdf = make_panel({"sj": 170, "iq": 150}, signals=CLIMATE_SIGNALS, missing=0.03)
    for c in VEGETATION_SIGNALS:
        pdf[c] = np.nan
    cut = pdf.groupby("city").cumcount() >= pdf.groupby("city")["city"].transform("size") - 20
    # A gap at the start of a test file or hold-out cannot be filled and is refused: start both with values.
    starts = pdf.groupby("city").cumcount(ascending=False).isin([19, 49])
    pdf.loc[starts, list(CLIMATE_SIGNALS)] = pdf.loc[starts, list(CLIMATE_SIGNALS)].fillna(1.0)
    keys = list(CLIMATE_PANEL.keys)
    columns = [*keys, "week_start_date", *VEGETATION_SIGNALS, *CLIMATE_SIGNALS]
    path = lambda name: str(tmp_path / name)
    pdf[~cut][columns].to_csv(path("features.csv"), index=False)
    pdf[cut][columns].to_csv(path("test.csv"), index=False)
    pdf[~cut][[*keys, "total_cases"]].to_csv(path("labels.csv"), index=False)
    pdf[cut][keys].assign(total_cases=0).to_csv(path("template.csv"), index=False)
    quick = {name: dataclasses.replace(c, epochs=1, steps=5) for name, c in historical_settings().configs.items()}
    settings = dataclasses.replace(historical_settings(), configs=quick)
    result = forecast_files(
        spark, path("features.csv"), path("labels.csv"), path("test.csv"), path("template.csv"), path("out"),
        settings=settings,
    )
    assert {r["city"]: r["rows"] for r in result.summary.collect()} == {"sj": 20, "iq": 20}
    written = (tmp_path / "out").read_text().splitlines()
    assert written[0] == ",".join([*keys, "total_cases"])
    wanted = [",".join(map(str, k)) for k in pdf[cut][keys].itertuples(index=False)]
    assert [line.rsplit(",", 1)[0] for line in written[1:]] == wanted
    error, history = evaluate_files(spark, path("features.csv"), path("labels.csv"), "sj", settings=settings, horizon=30)
    assert error > 0 and history.count() == 1
    pdf[cut][columns].iloc[::-1].to_csv(path("test.csv"), index=False)
    with pytest.raises(ContractError):
        forecast_files(
            spark, path("features.csv"), path("labels.csv"), path("test.csv"), path("template.csv"), settings=settings
        )
