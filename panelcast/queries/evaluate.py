"""Queries: baselines, error tables and comparisons on chronological folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import round_nearest_nonneg
from panelcast.operators import evaluate as V
from panelcast.operators import folds as O
from panelcast.operators.blocks import with_history
from panelcast.operators.history import trailing_mean
from panelcast.operators.storage import save_point, scratch_path, written
from panelcast.plans.forecast import assemble_submission
from panelcast.queries.history import folds, folds_sql, over
from panelcast.queries.panels import (
    FLAG_SPEC,
    FLAG_SQL,
    REGION_SQL,
    SUPPLIER_SQL,
    flag_week,
    region_day,
    supplier_week,
)
from panelcast.queries.prepare import KEYS, LABEL_FILE
from panelcast.queries.registry import query, rounded, sql6
from panelcast.sources import csv as io

FOLD = ["entity", "fold"]
ROW = ["entity", "fold", "time"]


def fold_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    spread = folds(save_point(supplier_week(spark, d, signals=[])))
    return spread.where("role = 'train'"), spread.where("role = 'validate'")


def predictions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Training rows, and validation rows with both baseline predictions."""
    train, validate = fold_parts(spark, d)
    both = V.baseline_mean(train, validate, FOLD, "target").withColumnRenamed("prediction", "mean_p")
    both = V.baseline_climatology(train, both, FOLD, "week", "target").withColumnRenamed("prediction", "clim_p")
    return train, save_point(both.select(*ROW, "week", "target", "mean_p", "clim_p"))


PREDICTED_SQL = SUPPLIER_SQL + folds_sql("supplier_week") + """,
m AS (SELECT entity, fold, AVG(target) AS mean_p FROM folds WHERE role = 'train' GROUP BY 1, 2),
wk AS (SELECT entity, fold, week, MEDIAN(target) AS wm FROM folds WHERE role = 'train' GROUP BY 1, 2, 3),
thr AS (SELECT entity, fold, QUANTILE_CONT(target, 0.9) AS threshold FROM folds WHERE role = 'train' GROUP BY 1, 2),
p AS (SELECT f.entity, f.fold, f.time, f.week, f.target, mean_p, COALESCE(wm, mean_p) AS clim_p, threshold
  FROM folds f JOIN m USING (entity, fold) JOIN thr USING (entity, fold) LEFT JOIN wk USING (entity, fold, week)
  WHERE role = 'validate'),
long AS (SELECT entity, fold, time, target, threshold, 'mean' AS model, mean_p AS prediction FROM p
  UNION ALL SELECT entity, fold, time, target, threshold, 'climatology', clim_p FROM p)"""


def long_fold(df: DataFrame) -> DataFrame:
    return df.withColumn("fold", F.col("fold").cast("long"))


def stacked(predicted: DataFrame) -> DataFrame:
    """One row per (row, model)."""
    models = F.array(
        F.struct(F.lit("mean").alias("model"), F.col("mean_p").alias("prediction")),
        F.struct(F.lit("climatology").alias("model"), F.col("clim_p").alias("prediction")),
    )
    return predicted.select(*ROW, "target", F.inline(models))


@query("baseline_mean", f"{PREDICTED_SQL} SELECT entity, fold, time, {sql6('mean_p', 'prediction')} FROM p")
def baseline_mean(spark, d):
    train, validate = fold_parts(spark, d)
    return rounded(V.baseline_mean(train, validate, FOLD, "target"), *ROW, prediction="prediction")


@query("baseline_climatology", f"{PREDICTED_SQL} SELECT entity, fold, time, {sql6('clim_p', 'prediction')} FROM p")
def baseline_climatology(spark, d):
    train, validate = fold_parts(spark, d)
    return rounded(V.baseline_climatology(train, validate, FOLD, "week", "target"), *ROW, prediction="prediction")


@query(
    "baseline_climatology_mean",
    f"{PREDICTED_SQL}, wa AS (SELECT entity, fold, week, AVG(target) AS wa FROM folds WHERE role = 'train' GROUP BY 1, 2, 3) "
    f"SELECT entity, fold, time, {sql6('COALESCE(wa, mean_p)', 'prediction')} FROM p LEFT JOIN wa USING (entity, fold, week)",
)
def baseline_climatology_mean(spark, d):
    train, validate = fold_parts(spark, d)
    out = V.baseline_climatology(train, validate, FOLD, "week", "target", statistic="mean")
    return rounded(out, *ROW, prediction="prediction")


@query(
    "mae",
    f"{PREDICTED_SQL} SELECT entity, fold, model, {sql6('AVG(ABS(target - prediction))', 'mae')}, COUNT(*) AS rows FROM long GROUP BY 1, 2, 3",
)
def mae(spark, d):
    out = V.mae(stacked(predictions(spark, d)[1]), "target", "prediction", [*FOLD, "model"])
    return rounded(out, *FOLD, "model", "rows", mae="mae")


@query("outbreak_threshold", f"{PREDICTED_SQL} SELECT entity, fold, {sql6('threshold', 'threshold')} FROM thr")
def outbreak_threshold(spark, d):
    limits = O.fold_thresholds(written(supplier_week(spark, d, signals=[])), ["entity"], "target", 3)
    return rounded(long_fold(limits), *FOLD, threshold="threshold")


@query(
    "outbreak_mae",
    f"{PREDICTED_SQL} SELECT entity, fold, {sql6('AVG(ABS(target - clim_p)) FILTER (WHERE target > threshold)', 'outbreak_mae')}, "
    "COUNT(*) FILTER (WHERE target > threshold) AS outbreak_rows FROM p GROUP BY 1, 2",
)
def outbreak_mae(spark, d):
    train, predicted = predictions(spark, d)
    thresholds = V.outbreak_threshold(train, FOLD, "target")
    out = V.outbreak_mae(predicted, thresholds, FOLD, "target", "clim_p")
    return rounded(out, *FOLD, "outbreak_rows", outbreak_mae="outbreak_mae")


@query(
    "fold_summary",
    f"{PREDICTED_SQL}, runs AS (SELECT entity, model, fold, AVG(ABS(target - prediction)) AS e, "
    "AVG(ABS(target - prediction)) FILTER (WHERE target > threshold) AS high FROM long GROUP BY 1, 2, 3) "
    f"SELECT entity, model, {sql6('AVG(e)', 'mean_mae')}, {sql6('MAX(e)', 'worst_mae')}, {sql6('AVG(high)', 'outbreak_mae')}, "
    "COUNT(*) AS runs FROM runs GROUP BY 1, 2",
)
def fold_summary(spark, d):
    panel = written(supplier_week(spark, d, signals=[]))
    predicted = O.fold_baselines(panel, ["entity"], "week", "target", 3)
    predicted = predicted.withColumnsRenamed({"mean": "mean_p", "climatology": "clim_p"})
    thresholds = O.fold_thresholds(panel, ["entity"], "target", 3)
    out = V.fold_summary(stacked(predicted), thresholds, "entity", "model", "target", "prediction", ("fold",))
    return rounded(out, "entity", "model", "runs", mean_mae="mean_mae", worst_mae="worst_mae", outbreak_mae="outbreak_mae")


@query(
    "fold_scaling",
    SUPPLIER_SQL + folds_sql("supplier_week", 5)
    + f" SELECT entity, fold, {sql6('AVG(qty)', 'qty_mean')}, {sql6('STDDEV_POP(qty)', 'qty_std')}, "
    f"{sql6('AVG(price)', 'price_mean')}, {sql6('STDDEV_POP(price)', 'price_std')}, CAST(MIN(week) AS DOUBLE) AS week_low, "
    "CAST(MAX(week) AS DOUBLE) AS week_high FROM folds WHERE role = 'train' GROUP BY 1, 2",
)
def fold_scaling(spark, d):
    """Scaling parameters of five folds from one pass over the rows."""
    panel = supplier_week(spark, d, signals=["qty", "price"])
    names = ["qty_mean", "qty_std", "price_mean", "price_std"]
    fitted = O.fold_scaling(panel, ["qty", "price"], ["entity"], 5, minmax_columns=["week"])
    return rounded(long_fold(fitted), *FOLD, "week_low", "week_high", **{n: n for n in names})


@query(
    "top_residuals",
    f"{PREDICTED_SQL}, r AS (SELECT entity, time, target, ABS(target - mean_p) AS e, "
    "ROW_NUMBER() OVER (PARTITION BY entity ORDER BY ABS(target - mean_p) DESC, time) AS rank FROM p) "
    f"SELECT entity, time, target, {sql6('e', 'abs_error')}, rank FROM r WHERE rank <= 10",
)
def top_residuals(spark, d):
    out = V.top_residuals(predictions(spark, d)[1], "entity", "time", "target", "mean_p", 10)
    return rounded(out.withColumn("rank", F.col("rank").cast("long")), "entity", "time", "target", "rank", abs_error="abs_error")


BLEND_SQL = PREDICTED_SQL + """, grid AS (SELECT entity, CAST(k / 10.0 AS DOUBLE) AS weight,
  AVG(ABS(target - (mean_p * (1 - k / 10.0) + clim_p * (k / 10.0)))) AS e
  FROM p, generate_series(0, 10) g(k) GROUP BY 1, 2)"""


@query("blend_grid", f"{BLEND_SQL} SELECT entity, weight, {sql6('e', 'mae')} FROM grid")
def blend_grid(spark, d):
    out = V.blend_grid(predictions(spark, d)[1], "target", "mean_p", "clim_p", ["entity"])
    return rounded(out, "entity", "weight", mae="mae")


@query(
    "best_blend",
    f"{BLEND_SQL} SELECT entity, weight, {sql6('e', 'mae')} FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY ROUND(e, 9), weight) AS r FROM grid) WHERE r = 1",
)
def best_blend(spark, d):
    grid = V.blend_grid(predictions(spark, d)[1], "target", "mean_p", "clim_p", ["entity"])
    best = V.best_blend(grid.withColumn("mae", F.round("mae", 9)), ["entity"])
    return rounded(best, "entity", "weight", mae="mae")


@query(
    "seed_ensemble",
    f"{SUPPLIER_SQL} SELECT entity, time, {sql6('(AVG(target) ' + over(2) + ' + AVG(target) ' + over(4) + ' + AVG(target) ' + over(8) + ') / 3', 'prediction')}, "
    "CAST(3 AS BIGINT) AS members FROM supplier_week",
)
def seed_ensemble(spark, d):
    """Three members per row: means over the last 2, 4 and 8 weeks."""
    windows = (2, 4, 8)
    wide = with_history(supplier_week(spark, d, signals=[]), ["entity"], "seq",
                        lambda w: {f"m{k}": trailing_mean("target", k, w) for k in windows}, back=7)
    members = F.array(*[F.struct(F.lit(i).alias("seed"), F.col(f"m{k}").alias("prediction")) for i, k in enumerate(windows)])
    out = V.seed_ensemble(wide.select("entity", "time", F.inline(members)), ["entity", "time"])
    return rounded(out, "entity", "time", "members", prediction="prediction")


@query(
    "forecast_comparison",
    f"{PREDICTED_SQL} SELECT entity, fold, time, target, {sql6('mean_p', 'mean')}, {sql6('clim_p', 'climatology')} FROM p",
)
def forecast_comparison(spark, d):
    out = V.forecast_comparison(stacked(predictions(spark, d)[1]), [*ROW, "target"], "model", ["mean", "climatology"])
    return rounded(out, *ROW, "target", mean="mean", climatology="climatology")


@query(
    "amplitude_check",
    f"{PREDICTED_SQL}, f AS (SELECT entity, model, fold, MAX(target) AS peak, MAX(prediction) AS reached, "
    "AVG(ABS(target - prediction)) AS e FROM long GROUP BY 1, 2, 3) "
    f"SELECT entity, model, MAX(peak) AS peak, {sql6('MAX(reached)', 'predicted_peak')}, {sql6('AVG(reached / peak)', 'peak_ratio')}, "
    f"{sql6('STDDEV_POP(e)', 'fold_mae_std')} FROM f GROUP BY 1, 2",
)
def amplitude_check(spark, d):
    out = V.amplitude_check(stacked(predictions(spark, d)[1]), "entity", "model", "fold", "target", "prediction")
    return rounded(out, "entity", "model", "peak", predicted_peak="predicted_peak", peak_ratio="peak_ratio", fold_mae_std="fold_mae_std")


@query(
    "rounding_comparison",
    f"{PREDICTED_SQL} SELECT entity, COUNT(*) AS rows, COUNT(*) FILTER (WHERE FLOOR(clim_p + 0.5) <> FLOOR(clim_p)) AS changed, "
    f"{sql6('AVG(ABS(target - FLOOR(clim_p + 0.5)))', 'mae_nearest')}, {sql6('AVG(ABS(target - FLOOR(clim_p)))', 'mae_truncated')} "
    "FROM p GROUP BY 1",
)
def rounding_comparison(spark, d):
    out = V.rounding_comparison(predictions(spark, d)[1], ["entity"], "target", "clim_p")
    return rounded(out, "entity", "rows", "changed", mae_nearest="mae_nearest", mae_truncated="mae_truncated")


@query(
    "submission_summary",
    f"{SUPPLIER_SQL} SELECT entity, COUNT(*) AS count, MIN(target) AS min, {sql6('AVG(target)', 'mean')}, MAX(target) AS max "
    "FROM supplier_week WHERE seq >= n - 52 GROUP BY 1",
)
def submission_summary(spark, d):
    last = supplier_week(spark, d, signals=[]).where("seq >= n - 52")
    return rounded(V.submission_summary(last, "entity", "target"), "entity", "count", "min", "max", mean="mean")


@query(
    "impute_median",
    REGION_SQL + folds_sql("region_day")
    + ", med AS (SELECT entity, fold, MEDIAN(price) AS mp, MEDIAN(balance) AS mb FROM folds WHERE role = 'train' GROUP BY 1, 2) "
    f"SELECT entity, fold, time, role, {sql6('COALESCE(price, mp)', 'price')}, {sql6('COALESCE(balance, mb)', 'balance')} "
    "FROM folds JOIN med USING (entity, fold)",
)
def impute_median(spark, d):
    out = O.impute_fold_medians(written(region_day(spark, d)), ["entity"], ["price", "balance"], 3)
    return rounded(long_fold(out), *ROW, "role", price="price", balance="balance")


@query(
    "assemble_submission",
    FLAG_SQL + ", t AS (SELECT entity, year, week, time, RANK() OVER (ORDER BY n - seq, entity) - 1 AS pos FROM flag_week WHERE seq >= n - 52), "
    "m AS (SELECT entity, AVG(target) AS p FROM flag_week WHERE seq < n - 52 GROUP BY 1) "
    "SELECT entity, year, week, pos, CAST(FLOOR(p + 0.5) AS BIGINT) AS target FROM t JOIN m USING (entity)",
)
def assembled(spark, d):
    panel = save_point(flag_week(spark, d))
    held = panel.where("seq >= n - 52")
    path = scratch_path(spark, "template")
    io.write_csv(held.orderBy(F.col("n") - F.col("seq"), "entity").select(*KEYS, "target"), path)
    template = io.read_template(spark, path, LABEL_FILE)
    predicted = V.baseline_mean(panel.where("seq < n - 52"), held.drop("target"), ["entity"], "target")
    predicted = predicted.withColumn("target", round_nearest_nonneg("prediction"))
    return assemble_submission(template, predicted, FLAG_SPEC).select(*KEYS, "pos", "target")
