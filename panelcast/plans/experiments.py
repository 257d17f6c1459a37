"""Chronological experiments: folds, representations, architectures and seeds as grouping keys.

One training job covers every combination; the number of groups, not the size of one, is what grows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.contracts import check_finite_features
from panelcast.operators.boost import BoostPlan, fit_boosts
from panelcast.operators.evaluate import best_blend, blend_grid, fold_summary, outbreak_threshold
from panelcast.operators.fill import interpolate_linear
from panelcast.operators.folds import impute_fold_medians
from panelcast.operators.forest import ForestPlan, fit_forests
from panelcast.operators.history import (
    lead_in_none,
    multiscale_features,
    raw_lag_features,
    raw_plus_summaries,
)
from panelcast.operators.mlp import score_mlp, train_grouped_mlp
from panelcast.operators.position import expanding_folds
from panelcast.operators.scale import apply_params, fit_scaling
from panelcast.operators.storage import save_point, written
from panelcast.spec import HORIZON_ROWS, MlpConfig, PanelSpec

SCALED_WEEK = "_week_scaled"
GRID = ["fold", "representation"]


def fold_panel(panel: DataFrame, spec: PanelSpec, folds: int, horizon: int = HORIZON_ROWS) -> DataFrame:
    """Rows of every fold, filled and scaled with what the fold's training rows know.

    Training and validation rows are filled separately; scaling is fitted per entity and fold.
    """
    by = [spec.entity, "fold"]
    spread = expanding_folds(panel, folds, horizon).withColumn(SCALED_WEEK, F.col(spec.week))
    filled = save_point(interpolate_linear(spread, spec.entity, spec.signals, by=["fold", "role"]))
    params = fit_scaling(filled.where("role = 'train'"), spec.signals, [SCALED_WEEK], by)
    return apply_params(filled, params, spec.signals, [SCALED_WEEK], by)


def fold_examples(
    folded: DataFrame, spec: PanelSpec, representations: Sequence[str], lags: Mapping[str, int] | None = None
) -> DataFrame:
    """(entity, fold, role, representation, pos, y, week, features) for every listed representation.

    History runs across the cut of a fold: a validation row looks back on training rows.
    """
    by = [spec.entity, "fold"]
    rows = lead_in_none(folded).withColumn("y", F.col(spec.target).cast("double"))
    keep = [spec.entity, "fold", "role", "pos", "y"]
    lengths = {SCALED_WEEK if c == spec.week else c: n for c, n in (lags or {}).items()}
    stacked = None
    for name in representations:
        if name == "multiscale":
            part = multiscale_features(rows, by, spec.signals, spec.week, keep=keep)
        elif name == "raw_lags":
            part = raw_lag_features(rows, by, lengths, keep=keep)
        elif name == "both":
            part = raw_plus_summaries(rows, by, spec.signals, spec.week, lengths, keep=keep)
        else:
            raise ValueError(f"unknown representation {name!r}")
        part = part.withColumn("representation", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def run_grid(
    examples: DataFrame, spec: PanelSpec, configs: Mapping[str, MlpConfig], seeds: Sequence[int], snapshots: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Train every config and seed on every (entity, fold, representation) and score its validation rows:
    (models, predictions). Rows are sent once per group, not once per config and seed.

    ``examples`` are read several times, so save them beforehand.
    """
    check_finite_features(examples, [spec.entity, *GRID, "role", "pos"])
    by = [spec.entity, *GRID]
    runs = [(c, s) for c in configs for s in seeds]
    models = save_point(train_grouped_mlp(examples, by, dict(configs), runs=runs, snapshots=snapshots))
    return models, score_mlp(examples.where("role = 'validate'"), models, by, runs=["config", "seed"])


def summarise_grid(
    predictions: DataFrame, folded: DataFrame, spec: PanelSpec, compare: str, q: float = 0.9
) -> DataFrame:
    """Mean, worst and outbreak error per (entity, ``compare``) over folds and seeds."""
    thresholds = outbreak_threshold(folded.where("role = 'train'"), [spec.entity, "fold"], spec.target, q)
    return fold_summary(predictions, thresholds, spec.entity, compare, "y", "prediction", ("fold", "seed"))


def tree_fold_predictions(
    rows: DataFrame, spec: PanelSpec, columns: Sequence[str], folds: int, forests: Mapping[object, ForestPlan],
    boosts: Mapping[object, BoostPlan], horizon: int = HORIZON_ROWS,
) -> DataFrame:
    """Validation rows of expanding folds with the ``forest`` and the ``boosted`` prediction of their series and fold.

    ``rows`` carry the inputs ``columns`` (looking backwards only), seq and n; ``forests`` and ``boosts`` name the
    listed series and their settings. Forests get missing inputs filled with medians of the fold's training rows, boosting
    routes them itself. All series and folds grow in the same jobs.
    """
    entity = spec.entity
    part = "_series_fold"
    listed = rows.where(F.col(entity).isin(list(forests)))
    named = lambda df: written(df.withColumn(part, F.concat_ws("|", F.col(entity).cast("string"), "fold")))
    spread, train = named(expanding_folds(listed, folds, horizon)), F.col("role") == "train"
    filled = named(impute_fold_medians(listed, [entity], columns, folds, horizon))
    each = lambda plans: {f"{e}|{k}": plan for e, plan in plans.items() for k in range(1, folds + 1)}
    keys = [entity, spec.time]
    grove = fit_forests(filled.where(train), columns, spec.target, each(forests), part, keys)
    boosted = fit_boosts(spread.where(train), columns, spec.target, each(boosts), part, keys)
    first = grove.predict(filled.where(~train)).select(*keys, "fold", F.col("prediction").alias("forest"))
    second = boosted.predict(spread.where(~train)).withColumnRenamed("prediction", "boosted").drop(part)
    return second.join(first, [*keys, "fold"])


def tree_blends(predictions: DataFrame, spec: PanelSpec, steps: int = 10) -> tuple[DataFrame, DataFrame]:
    """Errors of the blends (1 - w) forest + w boosted per (entity, fold, weight), and the best weight per entity over
    all its folds."""
    y = F.col(spec.target).cast("double")
    rows = predictions.withColumn("_y", y)
    by_fold = blend_grid(rows, "_y", "forest", "boosted", [spec.entity, "fold"], steps)
    return by_fold, best_blend(blend_grid(rows, "_y", "forest", "boosted", [spec.entity], steps), [spec.entity])
