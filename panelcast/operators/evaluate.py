"""Error metrics, baselines and comparisons. Predictions arrive as rows (keys, y, prediction)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.scalar import abs_error, round_nearest_nonneg, truncate_nonneg
from panelcast.operators.quantile import exact_quantiles


def mae(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(abs_error(y, prediction)).alias("mae"), F.count(F.lit(1)).alias("rows"))


def outbreak_threshold(train: DataFrame, by: Sequence[str], target: str, q: float = 0.9) -> DataFrame:
    """High-count threshold per group, fitted on training rows only."""
    return exact_quantiles(train, by, target, {"threshold": q})


def outbreak_mae(df: DataFrame, thresholds: DataFrame, by: Sequence[str], y: str, prediction: str) -> DataFrame:
    """Error over the rows above their group's threshold (null when there are none, or no threshold)."""
    high = F.col(y) > F.col("threshold")
    return (
        df.join(thresholds, list(by), "left")
        .groupBy(*by)
        .agg(
            F.avg(F.when(high, abs_error(y, prediction))).alias("outbreak_mae"),
            F.count_if(high).alias("outbreak_rows"),
        )
    )


def fold_summary(
    df: DataFrame, thresholds: DataFrame, entity: str, model: str, y: str, prediction: str,
    runs: Sequence[str] = ("fold", "seed"), threshold_by: Sequence[str] | None = None,
) -> DataFrame:
    """Mean, worst and outbreak error per (entity, model) over all fold and seed runs.

    Runs without a threshold count in the first two and leave the outbreak error to the others.
    """
    threshold_by = list(threshold_by or [entity, runs[0]])
    error = abs_error(y, prediction)
    per_run = (
        df.join(thresholds, threshold_by, "left")
        .groupBy(entity, model, *runs)
        .agg(F.avg(error).alias("_mae"), F.avg(F.when(F.col(y) > F.col("threshold"), error)).alias("_high"))
    )
    return per_run.groupBy(entity, model).agg(
        F.avg("_mae").alias("mean_mae"),
        F.max("_mae").alias("worst_mae"),
        F.avg("_high").alias("outbreak_mae"),
        F.count(F.lit(1)).alias("runs"),
    )


def baseline_mean(train: DataFrame, validate: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """Predict each group's training mean; null for a group without training rows."""
    means = train.groupBy(*by).agg(F.avg(target).alias("prediction"))
    return validate.join(means, list(by), "left")


def baseline_climatology(
    train: DataFrame, validate: DataFrame, by: Sequence[str], week: str, target: str, statistic: str = "median"
) -> DataFrame:
    """Predict the training median (or mean) of the same calendar week; group mean where it is unseen, null
    for a group without training rows."""
    if statistic == "median":
        weekly = exact_quantiles(train, [*by, week], target, {"_weekly": 0.5})
    elif statistic == "mean":
        weekly = train.groupBy(*by, week).agg(F.avg(target).alias("_weekly"))
    else:
        raise ValueError(f"unknown statistic {statistic!r}")
    overall = train.groupBy(*by).agg(F.avg(target).alias("_overall"))
    return (
        validate.join(overall, list(by), "left")
        .join(weekly, [*by, week], "left")
        .withColumn("prediction", F.coalesce("_weekly", "_overall"))
        .drop("_weekly", "_overall")
    )


def impute_median(
    df: DataFrame, train: DataFrame, by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Replace missing values by the group's training median.

    A column without any training value in a group stays missing there.
    """
    long = train.unpivot(list(by), [F.col(c).cast("double").alias(c) for c in columns], "_column", "_value")
    medians = exact_quantiles(long, [*by, "_column"], "_value", {"_median": 0.5})
    wide = medians.groupBy(*by).pivot("_column", list(columns)).agg(F.first("_median"))
    wide = wide.select(*by, *[F.col(c).alias(f"_{c}_median") for c in columns])
    joined = df.join(wide, list(by), "left")
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}_median")) for c in columns}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def blend_grid(
    df: DataFrame, y: str, first: str, second: str, by: Sequence[str], steps: int = 10
) -> DataFrame:
    """Error of (1-w)·first + w·second for w = 0, 1/steps, …, 1: one aggregate per weight, one pass."""
    names = [f"_w_{i}" for i in range(steps + 1)]
    wide = df.groupBy(*by).agg(
        *[
            F.avg(abs_error(y, F.col(first) * (1 - i / steps) + F.col(second) * (i / steps))).alias(name)
            for i, name in enumerate(names)
        ]
    )
    long = wide.unpivot(list(by), names, "weight", "mae")
    return long.withColumn("weight", F.substring_index("weight", "_", -1).cast("double") / steps)


def best_blend(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weight with the lowest error; the smaller weight wins a tie."""
    return grid.groupBy(*by).agg(F.min(F.struct("mae", "weight")).alias("_best")).select(
        *by, F.col("_best.weight").alias("weight"), F.col("_best.mae").alias("mae")
    )


def seed_ensemble(df: DataFrame, keys: Sequence[str], prediction: str = "prediction") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(prediction).alias(prediction), F.count(F.lit(1)).alias("members"))


def top_residuals(
    df: DataFrame, entity: str, time: str, y: str, prediction: str, k: int = 10
) -> DataFrame:
    """The k largest absolute errors per entity, earlier time first on ties.

    Spark keeps only k rows per task and entity before the shuffle.
    """
    order = Window.partitionBy(entity).orderBy(F.desc("abs_error"), time)
    return (
        df.withColumn("abs_error", abs_error(y, prediction))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def forecast_comparison(df: DataFrame, keys: Sequence[str], model: str, models: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """One row per key with one prediction column per model; a second prediction for a key raises."""
    single = F.when(
        F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"several predictions of one model for a key {list(keys)}")).cast("double")
    ).otherwise(F.first(prediction))
    return df.groupBy(*keys).pivot(model, list(models)).agg(single)


def amplitude_check(df: DataFrame, entity: str, model: str, fold: str, y: str, prediction: str) -> DataFrame:
    """Per (entity, model): how much of the peak is reached and how much the error varies over folds."""
    per_fold = df.groupBy(entity, model, fold).agg(
        F.max(y).alias("_peak"), F.max(prediction).alias("_reached"), F.avg(abs_error(y, prediction)).alias("_mae")
    )
    return per_fold.groupBy(entity, model).agg(
        F.max("_peak").alias("peak"),
        F.max("_reached").alias("predicted_peak"),
        F.avg(F.try_divide("_reached", "_peak")).alias("peak_ratio"),
        F.stddev_pop("_mae").alias("fold_mae_std"),
    )


def rounding_comparison(df: DataFrame, by: Sequence[str], y: str, prediction: str) -> DataFrame:
    nearest, cut = round_nearest_nonneg(prediction), truncate_nonneg(prediction)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(nearest != cut).alias("changed"),
        F.avg(abs_error(y, nearest)).alias("mae_nearest"),
        F.avg(abs_error(y, cut)).alias("mae_truncated"),
    )


def submission_summary(df: DataFrame, entity: str, target: str) -> DataFrame:
    y = F.col(target)
    return df.groupBy(entity).agg(
        F.count(y).alias("count"), F.min(y).alias("min"), F.avg(y).alias("mean"), F.max(y).alias("max")
    )
