"""Queries: training and scoring jobs. Fitted weights have no SQL form: training queries return their keys
and what must hold of any fit; scoring with given weights is checked value by value."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import round_nearest_nonneg
from panelcast.operators import screen, trees
from panelcast.operators.boost import BoostPlan
from panelcast.operators.evaluate import mae
from panelcast.operators.forest import ForestPlan, fit_forests
from panelcast.operators.history import (
    history_complete,
    lead_in_circular,
    lead_in_none,
    multiscale_features,
    multiscale_names,
    tree_feature_names,
)
from panelcast.operators.mlp import score_mlp, train_grouped_mlp, training_history
from panelcast.operators.storage import save_point, scratch_path, written
from panelcast.plans.experiments import (
    fold_examples, fold_panel, run_grid, summarise_grid, tree_blends, tree_fold_predictions,
)
from panelcast.plans.forecast import SPLIT, city_features, count_column, evaluate, forecast, predict_entities
from panelcast.queries.history import FLAG_LAGS, FLAG_SETTINGS, tree_panel
from panelcast.queries.panels import FLAG_SPEC, FLAG_SQL, SIGNALS, SUPPLIER_SQL, flag_week, supplier_week, weekly_raw
from panelcast.queries.prepare import SELU_SQL, split_at
from panelcast.queries.registry import query, rounded, sql6
from panelcast.sources import csv as io
from panelcast.spec import HOLDOUT_EPOCHS, HOLDOUT_STEPS, EntityPlan, MlpConfig, RunSettings

FLAG_FILE = T.StructType(
    [T.StructField("entity", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("year", "week", "target")]]
)

GROUP = ["entity", "config", "seed"]
# The operators' published settings: 40 epochs of 200 steps, three folds and three seeds.
FULL = MlpConfig()
NARROW = MlpConfig(hidden=(48, 12))
FOLDS, SEEDS = 3, (1, 2, 3)
COUNT_FOREST, LOG_FOREST = ForestPlan(extra=True, criterion="poisson"), ForestPlan(log_target=True)
WIDTH = len(multiscale_names(SIGNALS))
TRUE = "true AS"


def _examples(spark, d) -> DataFrame:
    rows = lead_in_circular(flag_week(spark, d), 53, 2).withColumn("y", F.col("target"))
    grouped = rows.withColumns({"config": F.lit("full"), "seed": F.lit(42).cast("long")})
    return multiscale_features(grouped, ["entity"], SIGNALS, "week", keep=[*GROUP, "pos", "y"])


def _trained(spark, d) -> tuple[DataFrame, DataFrame]:
    examples = save_point(_examples(spark, d))
    return examples, save_point(train_grouped_mlp(examples, GROUP, {"full": FULL}, snapshots=True))


@query(
    "train_grouped_mlp",
    f"{FLAG_SQL} SELECT entity, CAST({WIDTH} AS BIGINT) AS width, COUNT(*) AS train_rows, "
    f"CAST(3 AS BIGINT) AS layers, CAST(40 AS BIGINT) AS epochs, {TRUE} learned FROM flag_week GROUP BY 1",
)
def train_mlp(spark, d):
    """Checked: sizes, and that the fitted network errs less than its initial weights do."""
    examples, models = _trained(spark, d)
    size = lambda c: F.size(c).cast("long").alias
    sizes = models.select("entity", F.col("width").cast("long").alias("width"), "train_rows",
                          size("layers")("layers"), size("history")("epochs"))
    start = train_grouped_mlp(examples, GROUP, {"full": dataclasses.replace(FULL, epochs=0)})
    errors = lambda m, name: score_mlp(examples, m, GROUP).groupBy("entity").agg(
        F.avg(F.abs(F.col("y") - F.col("prediction"))).alias(name)
    )
    both = errors(models, "_fitted").join(errors(start, "_start"), "entity")
    return sizes.join(both, "entity").select(*sizes.columns, (F.col("_fitted") < F.col("_start")).alias("learned"))


def _follows_plateau(history: DataFrame, by: list[str], config: MlpConfig) -> DataFrame:
    """(by, epoch, rate_follows): whether each recorded learning rate is what the recorded losses make it."""
    keys = [history.schema[c] for c in by]
    schema = T.StructType([*keys, T.StructField("epoch", T.IntegerType()), T.StructField("rate_follows", T.BooleanType())])

    def check(pdf):
        pdf = pdf.sort_values("epoch")
        rate, best, wait, out = config.learning_rate, math.inf, 0, []
        for lr, loss in zip(pdf["lr"], pdf["train_mae_dropout"], strict=True):
            out.append(math.isclose(lr, rate))
            best, wait = (loss, 0) if loss < best else (best, wait + 1)
            if wait >= config.patience:
                rate, wait = max(1e-6, 0.8 * rate), 0
        return pdf[[*by, "epoch"]].assign(rate_follows=out)

    return history.select(*by, "epoch", "lr", "train_mae_dropout").groupBy(*by).applyInPandas(check, schema)


@query(
    "training_history",
    f"{FLAG_SQL} SELECT DISTINCT entity, CAST(k AS BIGINT) AS fold, CAST(e AS BIGINT) AS epoch, {TRUE} rate_follows, "
    f"{TRUE} measured FROM flag_week, generate_series(1, 2) f(k), generate_series(1, 40) g(e)",
)
def history_rows(spark, d):
    """Per-epoch metrics of every fold and entity, with both errors over all rows."""
    folded = save_point(fold_panel(flag_week(spark, d), FLAG_SPEC, 2))
    examples = save_point(fold_examples(folded, FLAG_SPEC, ["multiscale"]))
    models, predicted = run_grid(examples, FLAG_SPEC, {"full": FULL}, [42], snapshots=True)
    by = ["entity", "fold"]
    history = save_point(training_history(models, [*by, "representation"], examples, runs=["config", "seed"]))
    counts = F.abs(round_nearest_nonneg("prediction") - F.col("y"))
    last = predicted.groupBy(*by).agg(F.avg(counts).alias("_last"))
    rates = _follows_plateau(history, by, FULL)
    agrees = (F.col("epoch") < FULL.epochs) | (F.abs(F.col("val_mae") - F.col("_last")) < 1e-9)
    measured = (F.col("train_mae") > 0) & F.col("val_mae").isNotNull() & agrees
    return history.join(rates, [*by, "epoch"]).join(last, by).select(
        "entity", F.col("fold").cast("long").alias("fold"), F.col("epoch").cast("long").alias("epoch"), "rate_follows",
        measured.alias("measured"),
    )


@query(
    "training_history_all_rows",
    f"{FLAG_SQL} SELECT DISTINCT entity, CAST(e AS BIGINT) AS epoch, {TRUE} rate_follows, {TRUE} agrees "
    "FROM flag_week, generate_series(1, 40) g(e)",
)
def history_all_rows(spark, d):
    """Errors of every epoch; the last must be what scoring with the final layers gives."""
    examples, models = _trained(spark, d)
    history = save_point(training_history(models, GROUP, examples))
    scored = score_mlp(examples, models, GROUP).groupBy("entity").agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("_last"))
    agrees = (F.col("epoch") < FULL.epochs) | (F.abs(F.col("train_mae") - F.col("_last")) < 1e-9)
    rates = _follows_plateau(history, ["entity"], FULL)
    return history.join(rates, ["entity", "epoch"]).join(scored, "entity").select(
        "entity", F.col("epoch").cast("long").alias("epoch"), "rate_follows", (agrees & (F.col("train_mae") > 0)).alias("agrees")
    )


def _weight(i: int) -> float:
    return round(math.sin(i + 1), 6)


HIDDEN = (3, 2)
W1 = [[_weight(i * 3 + j) for j in range(3)] for i in range(4)]
B1 = [_weight(20 + j) for j in range(3)]
W2 = [[_weight(30 + i * 2 + j) for j in range(2)] for i in range(3)]
B2 = [_weight(40 + j) for j in range(2)]
W3 = [_weight(50 + i) for i in range(2)]


def _dense_sql(inputs, weights, bias) -> list[str]:
    return [
        "(" + " + ".join([f"{x} * ({row[j]})" for x, row in zip(inputs, weights)] + [f"({bias[j]})"]) + ")"
        for j in range(len(bias))
    ]


_SELECT = lambda exprs, p: ", ".join(f"{e} AS {p}{j}" for j, e in enumerate(exprs))
_ACTIVE = lambda p, n: [SELU_SQL.format(x=f"{p}{j}") for j in range(n)]
SCORE_SQL = f"""{SUPPLIER_SQL}, x AS (SELECT entity, time, """ + ", ".join(
    f"CAST(CAST({s} AS FLOAT) AS DOUBLE) AS x{i}" for i, s in enumerate(SIGNALS)
) + f""" FROM supplier_week),
z1 AS (SELECT entity, time, {_SELECT(_dense_sql([f'x{i}' for i in range(4)], W1, B1), 'z')} FROM x),
a1 AS (SELECT entity, time, {_SELECT(_ACTIVE('z', 3), 'a')} FROM z1),
z2 AS (SELECT entity, time, {_SELECT(_dense_sql(['a0', 'a1', 'a2'], W2, B2), 'z')} FROM a1),
a2 AS (SELECT entity, time, {_SELECT(_ACTIVE('z', 2), 'a')} FROM z2)
SELECT entity, time, """ + sql6(f"a0 * ({W3[0]}) + a1 * ({W3[1]}) + entity % 5", "prediction") + " FROM a2"


@query("score_mlp", SCORE_SQL)
def score(spark, d):
    """Given weights; the output bias differs by entity, so every row must meet its own model."""
    panel = save_point(supplier_week(spark, d))
    lits = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    layer = lambda w, b: F.struct(w.alias("weights"), b.alias("bias"))
    flat = lambda m: [x for row in m for x in row]
    models = panel.select("entity").distinct().select(
        "entity",
        F.lit(4).alias("width"),
        F.array(
            layer(lits(flat(W1)), lits(B1)),
            layer(lits(flat(W2)), lits(B2)),
            layer(lits(W3), F.array((F.col("entity") % 5).cast("double"))),
        ).alias("layers"),
    )
    rows = panel.select("entity", "time", "seq", F.array(*SIGNALS).cast("array<float>").alias("features"))
    return rounded(score_mlp(rows, models, ["entity"], order="seq"), "entity", "time", prediction="prediction")


@query(
    "predict_entity",
    f"{FLAG_SQL} SELECT entity, CAST(g AS BIGINT) AS pos, {TRUE} rounded, {TRUE} learned "
    "FROM (SELECT DISTINCT entity FROM flag_week), generate_series(51, 102) t(g)",
)
def predict_entity(spark, d):
    """Features, fit, score, training error and counts, for all entities in one job."""
    train, test = split_at(save_point(flag_week(spark, d)))
    settings = dataclasses.replace(FLAG_SETTINGS, configs={"m": FULL})
    examples = city_features(train, test, FLAG_SPEC, settings)
    _, scored = predict_entities(examples, FLAG_SPEC, settings)
    scored = save_point(scored)
    fitted = scored.where(F.col(SPLIT) == "train")
    errors = mae(fitted, "y", "prediction", ["entity"]).select("entity", F.col("mae").alias("train_mae"))
    level = fitted.groupBy("entity").agg(F.avg("y").alias("_mean"))
    spread = fitted.join(level, "entity").groupBy("entity").agg(F.avg(F.abs(F.col("y") - F.col("_mean"))).alias("_spread"))
    tests = scored.where(F.col(SPLIT) == "test").select(
        "entity", "pos", (count_column(FLAG_SPEC, settings) == F.floor(F.greatest("prediction", F.lit(0.0)) + 0.5)).alias("rounded")
    )
    return tests.join(errors, "entity").join(spread, "entity").select(
        "entity", "pos", "rounded", (F.col("train_mae") < F.col("_spread")).alias("learned")
    )


@query(
    "validate_holdout",
    f"{FLAG_SQL} SELECT entity, year, week, target, {TRUE} error_agrees, {TRUE} epochs FROM flag_week WHERE entity = 'N' AND seq >= n - 52",
)
def validate_holdout(spark, d):
    """The published hold-out: 28 epochs of 120 steps, errors of every epoch over all rows."""
    panel = save_point(weekly_raw(spark, d))
    holdout = MlpConfig(epochs=HOLDOUT_EPOCHS, steps=HOLDOUT_STEPS)
    settings = dataclasses.replace(FLAG_SETTINGS, configs={"m": holdout}, fill_scope="frame")
    keys = list(FLAG_SPEC.keys)
    run = evaluate(panel.drop("target"), panel.select(*keys, "target"), FLAG_SPEC, settings, "N")
    rows = save_point(run.rows)
    last = run.history.agg(F.max("epoch").alias("e"), F.max_by("val_mae", "epoch").alias("v"))
    mean = rows.agg(F.avg("abs_error")).scalar()
    epochs = last.select(((F.col("e") == HOLDOUT_EPOCHS) & (F.abs(F.col("v") - mean) < 1e-9)).alias("ok")).scalar()
    agrees = F.col("abs_error") == F.abs(F.col("target") - F.col("predicted_count"))
    return rows.select(*keys, "target", agrees.alias("error_agrees"), epochs.alias("epochs"))


@query(
    "forecast",
    f"{FLAG_SQL} SELECT entity, year, week, true AS predicted FROM flag_week WHERE seq >= n - 52",
)
def forecast_all(spark, d):
    """One model per series, trained on all but the last 52 weeks, which are predicted.

    Checked: every template row has exactly one prediction, and the predictions of a series lie around
    its training level (between a tenth and ten times its mean).
    """
    panel = save_point(flag_week(spark, d))
    train, test = split_at(panel)
    keys = list(FLAG_SPEC.keys)
    path = scratch_path(spark, "template")
    io.write_csv(test.orderBy("time", "entity").select(*keys, "target"), path)
    template = io.read_template(spark, path, FLAG_FILE)
    drop = ("seq", "n")
    settings = RunSettings(configs={"full": FULL}, default=EntityPlan("multiscale", "full", "nearest"))
    result = forecast(
        train.drop("target", *drop), train.select(*keys, "target"), test.drop("target", *drop), template, FLAG_SPEC, settings
    )
    level = train.groupBy("entity").agg(F.avg("target").alias("_level"))
    mean = F.avg("target").over(Window.partitionBy("entity"))
    near = (F.col("target") >= 0) & mean.between(F.col("_level") / 10, F.col("_level") * 10)
    return result.submission.join(level, "entity").select(*keys, near.alias("predicted"))


def _grid_sql(column: str, values: list[str], runs: int) -> str:
    listed = ", ".join(f"('{v}')" for v in values)
    return (
        f"{FLAG_SQL} SELECT DISTINCT entity, {column}, CAST({runs} AS BIGINT) AS runs, {TRUE} ordered, {TRUE} sane "
        f"FROM flag_week, (VALUES {listed}) v({column})"
    )


def _grid_checks(summary: DataFrame, panel: DataFrame, column: str) -> DataFrame:
    """Every cell of the grid; the worst fold is no better than the mean, and errors are below the target's mean."""
    level = panel.groupBy("entity").agg(F.avg("target").alias("_level"))
    return summary.join(level, "entity").select(
        "entity", column, "runs", (F.col("worst_mae") >= F.col("mean_mae")).alias("ordered"),
        ((F.col("mean_mae") > 0) & (F.col("mean_mae") < F.col("_level"))).alias("sane"),
    )


@query("architecture_sweep", _grid_sql("config", ["full", "narrow"], FOLDS * len(SEEDS)))
def architecture_sweep(spark, d):
    panel = save_point(flag_week(spark, d))
    folded = save_point(fold_panel(panel, FLAG_SPEC, FOLDS))
    examples = save_point(fold_examples(folded, FLAG_SPEC, ["multiscale"]))
    _, predicted = run_grid(examples, FLAG_SPEC, {"full": FULL, "narrow": NARROW}, SEEDS)
    return _grid_checks(summarise_grid(predicted, folded, FLAG_SPEC, "config"), panel, "config")


@query("representation_ablation", _grid_sql("representation", ["raw_lags", "multiscale", "both"], FOLDS * len(SEEDS)))
def representation_ablation(spark, d):
    panel = save_point(flag_week(spark, d))
    folded = save_point(fold_panel(panel, FLAG_SPEC, FOLDS))
    examples = save_point(fold_examples(folded, FLAG_SPEC, ["raw_lags", "multiscale", "both"], FLAG_LAGS))
    _, predicted = run_grid(examples, FLAG_SPEC, {"full": FULL}, SEEDS)
    return _grid_checks(summarise_grid(predicted, folded, FLAG_SPEC, "representation"), panel, "representation")


@query(
    "fold_examples",
    f"{FLAG_SQL} SELECT entity, CAST(k AS BIGINT) AS fold, "
    "COUNT(*) FILTER (WHERE seq >= 51 AND seq < n - (2 - k + 1) * 52) AS train_rows, "
    "COUNT(*) FILTER (WHERE seq >= n - (2 - k + 1) * 52 AND seq < n - (2 - k) * 52) AS validate_rows, "
    f"CAST({WIDTH} AS BIGINT) AS width FROM flag_week, generate_series(1, 2) g(k) GROUP BY 1, 2",
)
def fold_example_rows(spark, d):
    folded = fold_panel(flag_week(spark, d), FLAG_SPEC, 2)
    examples = fold_examples(folded, FLAG_SPEC, ["multiscale"])
    return examples.groupBy("entity", F.col("fold").cast("long").alias("fold")).agg(
        F.count_if(F.col("role") == "train").alias("train_rows"),
        F.count_if(F.col("role") == "validate").alias("validate_rows"),
        F.max(F.size("features")).cast("long").alias("width"),
    )


def _design(panel: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Tree features of all series with a full history, cut before the last 52 rows."""
    panel = lead_in_none(panel)
    wide = tree_panel(panel)
    names = tree_feature_names(panel, wide, SIGNALS)
    rows = save_point(history_complete(wide).select("entity", "time", "seq", "n", "target", *names))
    return rows.where("seq < n - 52"), rows.where("seq >= n - 52"), names


HELD_SQL = f"{FLAG_SQL} SELECT entity, time, target, {TRUE} inside FROM flag_week WHERE seq >= n - 52 AND seq >= 51"


def _inside(scored: DataFrame, train: DataFrame, *by: str) -> DataFrame:
    """Averages of training targets cannot leave their range."""
    span = train.groupBy(*by).agg(F.min("target").alias("_lo"), F.max("target").alias("_hi"))
    ranged = scored.join(span, list(by)) if by else scored.withColumn("_s", span.select(F.struct("_lo", "_hi").alias("s")).scalar()).select("*", "_s.*")
    inside = F.col("prediction").between(F.col("_lo") - 1e-9, F.col("_hi") + 1e-9)
    return ranged.select("entity", "time", "target", inside.alias("inside"))


@query("forest_regressor", HELD_SQL)
def forest(spark, d):
    """500 trees over the pooled rows of all series."""
    train, held, names = _design(flag_week(spark, d))
    return _inside(trees.forest_regressor(train, names, "target", keys=["entity", "time"]).predict(held), train)


@query("forest_by_entity", HELD_SQL)
def forest_by_entity(spark, d):
    """Random thresholds and Poisson splits for the series with the largest mean, forests of log(1 + y) for the
    others; which series there are comes from the data (a handful of flags)."""
    train, held, names = _design(flag_week(spark, d))
    ranked = [r["entity"] for r in train.groupBy("entity").agg(F.avg("target").alias("m")).orderBy(F.desc("m"), "entity").collect()]
    plans = {e: COUNT_FOREST if not i else LOG_FOREST for i, e in enumerate(ranked)}
    forests = fit_forests(train, names, "target", plans, "entity", ["entity", "time"])
    return _inside(forests.predict(held), train, "entity")


BEATS_SQL = f"{FLAG_SQL} SELECT entity, COUNT(*) AS rows, {TRUE} not_negative, {TRUE} learned FROM flag_week WHERE seq >= 51 AND seq < n - 52 GROUP BY 1"


def _beats_mean(fitted, train: DataFrame) -> DataFrame:
    """On its training rows a model must err less than their common mean."""
    level = train.agg(F.avg("target")).scalar()
    scored = fitted.predict(train).withColumns({"_e": F.abs(F.col("target") - F.col("prediction")), "_m": F.abs(F.col("target") - level)})
    whole = scored.agg((F.avg("_e") < F.avg("_m")).alias("ok")).scalar()
    return scored.groupBy("entity").agg(
        F.count(F.lit(1)).alias("rows"), (F.min("prediction") >= 0).alias("not_negative")
    ).withColumn("learned", whole)


@query("boosted_regressor", BEATS_SQL)
def boosted(spark, d):
    """Absolute loss; the published 500 rounds."""
    train, _, names = _design(flag_week(spark, d))
    keys = ["entity", "time"]
    return _beats_mean(trees.boosted_regressor(train, names, "target", rounds=500, learning_rate=0.03, keys=keys), train)


@query("boosted_counts", BEATS_SQL)
def boosted_counts(spark, d):
    """The same for the Poisson objective."""
    train, _, names = _design(flag_week(spark, d))
    return _beats_mean(trees.boosted_regressor(train, names, "target", "poisson", keys=["entity", "time"]), train)


@query(
    "tree_blend_folds",
    f"{FLAG_SQL} SELECT DISTINCT entity, CAST(k AS BIGINT) AS fold, CAST(52 AS BIGINT) AS rows, CAST(11 AS BIGINT) AS weights, "
    f"{TRUE} ends_agree, {TRUE} best_is_least FROM flag_week, generate_series(1, {FOLDS}) g(k)",
)
def tree_blend_folds(spark, d):
    """Forests, boosting and their blends over chronological folds, with the published settings."""
    panel = lead_in_none(flag_week(spark, d))
    wide = tree_panel(panel)
    names = tree_feature_names(panel, wide, SIGNALS)
    rows = written(history_complete(wide).select("entity", "time", "seq", "n", "target", *names))
    ranked = [r["entity"] for r in rows.groupBy("entity").agg(F.avg("target").alias("m")).orderBy(F.desc("m"), "entity").collect()]
    forests = {e: COUNT_FOREST if not i else LOG_FOREST for i, e in enumerate(ranked)}
    boosts = {e: BoostPlan("absolute" if i else "poisson") for i, e in enumerate(ranked)}
    predicted = written(tree_fold_predictions(rows, FLAG_SPEC, names, FOLDS, forests, boosts))
    by_fold, best = tree_blends(predicted, FLAG_SPEC)
    error = lambda c: F.avg(F.abs(F.col("target") - F.col(c)))
    plain = predicted.groupBy("entity", "fold").agg(F.count(F.lit(1)).alias("rows"), error("forest").alias("_f"), error("boosted").alias("_b"))
    at = lambda w: F.max(F.when(F.col("weight") == w, F.col("mae")))
    ends = by_fold.groupBy("entity", "fold").agg(F.count(F.lit(1)).alias("weights"), at(0.0).alias("_0"), at(1.0).alias("_1"))
    whole = predicted.groupBy("entity").agg(F.least(error("forest"), error("boosted")).alias("_alone"))
    return plain.join(ends, ["entity", "fold"]).join(best, "entity").join(whole, "entity").select(
        "entity", F.col("fold").cast("long").alias("fold"), "rows", "weights",
        ((F.abs(F.col("_0") - F.col("_f")) < 1e-9) & (F.abs(F.col("_1") - F.col("_b")) < 1e-9)).alias("ends_agree"),
        (F.col("mae") <= F.col("_alone") + 1e-9).alias("best_is_least"),
    )


@query("poisson_regressor", BEATS_SQL)
def poisson(spark, d):
    train, _, names = _design(flag_week(spark, d))
    return _beats_mean(trees.poisson_regressor(train, names, "target"), train)


SCREENED = tuple(range(3, 52))


@query(
    "window_screen",
    f"{FLAG_SQL} SELECT DISTINCT entity, variable, true AS in_grid FROM flag_week, "
    "(VALUES " + ", ".join(f"('{s}')" for s in SIGNALS) + ") v(variable)",
)
def window_screen(spark, d):
    """Pooled over all series and signals, ten folds, all 49 lengths."""
    panel = save_point(flag_week(spark, d))
    errors = written(screen.window_screen(panel, "entity", "seq", "target", SIGNALS, SCREENED))
    best = screen.best_window(errors, "entity")
    return best.select("entity", "variable", (F.col("length").isin(*SCREENED) & (F.col("mae") > 0)).alias("in_grid"))
