"""End-to-end runs: forecast a template and evaluate a hold-out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.scalar import abs_error, to_count
from panelcast.operators.blocks import with_history
from panelcast.operators.contracts import (
    check_counts,
    check_feature_shape,
    check_no_missing,
    check_row_order,
    check_submission,
)
from panelcast.operators.evaluate import mae
from panelcast.operators.fill import interpolate_linear
from panelcast.operators.history import (
    EXAMPLES,
    FIRST,
    POS,
    lead_in_circular,
    lead_in_none,
    lead_in_previous,
    multiscale_features,
    raw_lag_features,
    raw_plus_summaries,
)
from panelcast.operators.mlp import score_mlp, train_grouped_mlp, training_history
from panelcast.operators.position import LENGTH, SEQ, concat_fold, holdout_split, row_position
from panelcast.operators.relational import attach_predictions, drop_columns, join_one_to_one
from panelcast.operators.scale import apply_params, fit_scaling
from panelcast.operators.storage import save_point
from panelcast.sources.csv import (
    climate_schema,
    label_schema,
    read_features,
    read_labels,
    read_template,
    write_submission,
)
from panelcast.spec import (
    CLIMATE_PANEL,
    HISTORY_ROWS,
    HORIZON_ROWS,
    LEAD_ROWS,
    VEGETATION_SIGNALS,
    EntityPlan,
    PanelSpec,
    RunSettings,
    historical_settings,
    holdout_settings,
)

SPLIT = "split"
MODEL = ["config", "seed"]
SCALED_WEEK = "_week_scaled"


@dataclass(frozen=True)
class ForecastResult:
    """Tables of a finished run; all are small next to the inputs or saved."""

    submission: DataFrame
    models: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Evaluation:
    """A hold-out run: its rows with predictions and errors, the models, and the errors of every epoch
    over all training and all held-out rows."""

    rows: DataFrame
    models: DataFrame
    history: DataFrame


def prepare(df: DataFrame, spec: PanelSpec, settings: RunSettings) -> DataFrame:
    """Position, fill and check one split."""
    placed = save_point(row_position(df, [spec.entity], spec.time, spec.step))
    filled = interpolate_linear(
        placed,
        spec.entity,
        spec.signals,
        scope=settings.fill_scope,
        method=settings.fill_method,
        entity_order=list(settings.entities),
    )
    saved = save_point(filled)
    check_no_missing(saved, spec.signals)
    return saved


def scaled_split(train: DataFrame, split: DataFrame, spec: PanelSpec, settings: RunSettings) -> DataFrame:
    """Scale a split with parameters fitted on ``train``; the week of year is also kept unscaled."""
    by = [] if settings.scale_entity else [spec.entity]
    source = train.where(F.col(spec.entity) == settings.scale_entity) if settings.scale_entity else train
    source = source.withColumn(SCALED_WEEK, F.col(spec.week))
    params = fit_scaling(source, spec.signals, [SCALED_WEEK], by, settings.scale_tail)
    ready = split.withColumn(SCALED_WEEK, F.col(spec.week))
    return apply_params(ready, params, spec.signals, [SCALED_WEEK], by)


def lead_in(train: DataFrame, test: DataFrame, spec: PanelSpec, settings: RunSettings) -> DataFrame:
    """Both splits with positions counted from the start of their context."""
    if settings.train_offset:
        ahead = settings.train_offset
        train = with_history(
            train.withColumnRenamed(spec.target, "_target"),
            [spec.entity],
            SEQ,
            lambda w: {spec.target: F.lead("_target", ahead).over(w)},
            ahead=ahead,
        ).drop("_target")
    if settings.lead_in == "circular":
        head = lead_in_circular(train, LEAD_ROWS, LEAD_ROWS - HISTORY_ROWS + 1)
    elif settings.lead_in == "none":
        head = lead_in_none(train)
    else:
        raise ValueError(f"unknown lead-in {settings.lead_in!r}")
    tail = lead_in_previous(train, test, [spec.entity], settings.lead_rows, settings.test_offset)
    return head.withColumn(SPLIT, F.lit("train")).unionByName(
        tail.withColumn(SPLIT, F.lit("test")), allowMissingColumns=True
    )


def _entity_setting(spec: PanelSpec, settings: RunSettings, attribute: str) -> Column:
    """A plan attribute per row: listed entities by name, the default for all others."""
    default = F.lit(getattr(settings.default, attribute)) if settings.default else F.lit(None)
    if not settings.entities:
        return default
    pairs = [F.lit(v) for e, plan in settings.entities.items() for v in (e, getattr(plan, attribute))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(spec.entity)), default)


def modelled(spec: PanelSpec, settings: RunSettings) -> Column:
    return F.lit(True) if settings.default else F.col(spec.entity).isin(list(settings.entities))


def representation_groups(spec: PanelSpec, settings: RunSettings) -> list[tuple[EntityPlan, Column]]:
    """Distinct representations with the rows they apply to."""
    groups: list[tuple[EntityPlan, list]] = []
    for entity, plan in settings.entities.items():
        for known, members in groups:
            if (known.representation, known.lags) == (plan.representation, plan.lags):
                members.append(entity)
                break
        else:
            groups.append((plan, [entity]))
    out = [(plan, F.col(spec.entity).isin(members)) for plan, members in groups]
    if settings.default:
        listed = list(settings.entities)
        out.append((settings.default, ~F.col(spec.entity).isin(listed) if listed else F.lit(True)))
    return out


def build_examples(
    context: DataFrame, spec: PanelSpec, settings: RunSettings, plan: EntityPlan
) -> DataFrame:
    """(entity, split, pos, y, config, seed, features) of every row that ends a full history."""
    by = [spec.entity, SPLIT]
    ready = context.select(
        spec.entity,
        SPLIT,
        POS,
        EXAMPLES,
        FIRST,
        F.col(spec.target).cast("float").cast("double").alias("y"),
        _entity_setting(spec, settings, "config").alias("config"),
        _entity_setting(spec, settings, "seed").cast("long").alias("seed"),
        spec.week,
        SCALED_WEEK,
        *spec.signals,
    )
    keep = [spec.entity, SPLIT, POS, "y", *MODEL]
    lengths = {SCALED_WEEK if c == spec.week else c: n for c, n in plan.lags.items()}
    representation = plan.representation
    if representation == "multiscale":
        return multiscale_features(ready, by, spec.signals, spec.week, keep=keep)
    if representation == "raw_lags":
        return raw_lag_features(ready, by, lengths, keep=keep)
    if representation == "both":
        return raw_plus_summaries(ready, by, spec.signals, spec.week, lengths, keep=keep)
    raise ValueError(f"unknown representation {representation!r}")


def expected_examples(context: DataFrame, spec: PanelSpec, settings: RunSettings) -> int:
    """How many examples a context must give: one per row of a split, less the first rows of a series that
    has nothing in front of its training split."""
    per_series = context.groupBy(spec.entity, SPLIT).agg(F.max(EXAMPLES).alias("n"), F.min(FIRST).alias("first"))
    without = F.greatest(F.lit(0), F.lit(HISTORY_ROWS - 1) - F.col("first")) if settings.lead_in == "none" else F.lit(0)
    given = F.when(F.col(SPLIT) == "train", F.greatest(F.col("n") - without, F.lit(0))).otherwise(F.col("n"))
    return int(per_series.agg(F.sum(given)).first()[0] or 0)


def city_features(train: DataFrame, test: DataFrame, spec: PanelSpec, settings: RunSettings) -> DataFrame:
    """Examples of both splits for all modelled entities.

    Entities sharing a representation are built by the same plan: the number of plans is the number of
    distinct representations, not of entities.
    """
    context = lead_in(
        scaled_split(train, train, spec, settings), scaled_split(train, test, spec, settings), spec, settings
    )
    stacked = None
    for plan, applies in representation_groups(spec, settings):
        own = context.where(applies)
        examples = save_point(build_examples(own, spec, settings, plan))
        check_feature_shape(examples, plan.width(spec), expected_examples(own, spec, settings))
        stacked = examples if stacked is None else stacked.unionByName(examples)
    return stacked


def training_rows(examples: DataFrame) -> DataFrame:
    return examples.where((F.col(SPLIT) == "train") & F.col("y").isNotNull()).withColumn("role", F.lit("train"))


def predict_entities(
    examples: DataFrame, spec: PanelSpec, settings: RunSettings, snapshots: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Train every entity's model and score all examples: (models, scored examples)."""
    by = [spec.entity, *MODEL]
    models = save_point(train_grouped_mlp(training_rows(examples), by, settings.configs, order=POS, snapshots=snapshots))
    return models, score_mlp(examples, models, by, order=POS)


def count_column(spec: PanelSpec, settings: RunSettings, prediction: str = "prediction") -> Column:
    nearest = _entity_setting(spec, settings, "rounding") == "nearest"
    return F.when(nearest, to_count(prediction, "nearest")).otherwise(to_count(prediction, "truncate"))


def attach_test(scored: DataFrame, test: DataFrame, spec: PanelSpec, settings: RunSettings) -> DataFrame:
    """Integer predictions on the keys of the test rows."""
    predictions = scored.where(F.col(SPLIT) == "test").select(spec.entity, POS, "prediction")
    attached = attach_predictions(
        test.select(*spec.join_keys, SEQ), predictions, spec.entity, settings.lead_rows, settings.test_offset
    )
    return attached.select(*spec.join_keys, count_column(spec, settings).alias(spec.target), "prediction")


def assemble_submission(template: DataFrame, predictions: DataFrame, spec: PanelSpec) -> DataFrame:
    """Template rows in template order with their predicted counts."""
    keys = spec.join_keys
    joined = join_one_to_one(template.select(*keys, "pos"), predictions.select(*keys, spec.target), keys, "left")
    return joined.withColumn(spec.target, F.col(spec.target).cast("long"))


def forecast(
    features: DataFrame,
    labels: DataFrame,
    test: DataFrame,
    template: DataFrame,
    spec: PanelSpec,
    settings: RunSettings,
    output: str | None = None,
) -> ForecastResult:
    """Train on the labelled panel, predict the template rows and, with ``output``, write them.

    ``template`` and, if it should be checked against it, ``test`` carry ``pos``.
    """
    keys = spec.join_keys
    template = save_point(template)
    if POS in test.columns:
        check_row_order(test, template, keys)
        test = test.drop(POS)
    train = prepare(join_one_to_one(features, labels, keys), spec, settings)
    future = prepare(test, spec, settings)
    examples = city_features(train, future, spec, settings)
    models, scored = predict_entities(examples, spec, settings)
    scored = save_point(scored)

    submission = save_point(assemble_submission(template, attach_test(scored, future, spec, settings), spec))
    check_submission(template, submission, keys, spec.target)
    check_counts(submission, spec.target, template.count())
    if output:
        write_submission(submission, output, [*keys, spec.target])
    errors = mae(scored.where((F.col(SPLIT) == "train") & F.col("y").isNotNull()), "y", "prediction", [spec.entity]).select(
        spec.entity, F.col("mae").alias("train_mae")
    )
    rows = submission.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("rows"))
    return ForecastResult(submission, models, rows.join(errors, spec.entity, "left"))


def evaluate(
    features: DataFrame,
    labels: DataFrame,
    spec: PanelSpec,
    settings: RunSettings,
    reference: str,
    horizon: int = HORIZON_ROWS,
) -> Evaluation:
    """Hold out the last ``horizon`` rows of ``reference`` and predict them.

    Filling, scaling and training see the rows before the cut (plus, for frame-wide filling, the
    proportional part of the other series).
    """
    keys = spec.join_keys
    plan = settings.entities.get(reference, settings.default)
    if plan is None:
        raise ValueError(f"no plan for {reference!r}")
    settings = replace(settings, entities={reference: plan}, default=None)
    raw = save_point(row_position(join_one_to_one(features, labels, keys), [spec.entity], spec.time, spec.step))
    fold_rows = concat_fold(raw, spec.entity, reference, horizon).drop(SEQ, LENGTH)
    held = holdout_split(raw.where(F.col(spec.entity) == reference), horizon)[1].drop(SEQ, LENGTH)
    train = prepare(fold_rows, spec, settings)
    future = prepare(drop_columns(held, spec.target), spec, settings)
    examples = city_features(train, future, spec, settings)

    truth = save_point(future.select(*keys, SEQ).join(held.select(*keys, spec.target), keys))
    offset = settings.test_offset
    labelled = truth.select(
        spec.entity, (F.col(SEQ) + settings.lead_rows - offset).alias(POS), F.col(spec.target).cast("double").alias("y")
    )
    tests = examples.where(F.col(SPLIT) == "test").drop("y").join(labelled, [spec.entity, POS])
    models, scored = predict_entities(examples, spec, settings, snapshots=True)
    measured = training_rows(examples).unionByName(tests.withColumn("role", F.lit("validate")), allowMissingColumns=True)
    history = training_history(models, [spec.entity, *MODEL], save_point(measured), order=POS)
    result = attach_test(scored, future, spec, settings)
    joined = result.withColumnRenamed(spec.target, "predicted_count").join(
        truth.select(*keys, F.col(spec.target)), keys
    )
    rows = joined.withColumn("abs_error", abs_error(spec.target, "predicted_count"))
    return Evaluation(rows, models, history)


def forecast_files(
    spark: SparkSession,
    features: str,
    labels: str,
    test: str,
    template: str,
    output: str | None = None,
    spec: PanelSpec = CLIMATE_PANEL,
    settings: RunSettings | None = None,
    vegetation: Sequence[str] = VEGETATION_SIGNALS,
) -> ForecastResult:
    """``forecast`` from the four CSV files of the weekly climate panel, with the published settings."""
    wide, narrow = climate_schema(spec, vegetation), label_schema(spec)
    return forecast(
        read_features(spark, features, wide, spec.time),
        read_labels(spark, labels, narrow),
        read_features(spark, test, wide, spec.time, positions=True),
        read_template(spark, template, narrow),
        spec,
        settings or historical_settings(),
        output,
    )


def evaluate_files(
    spark: SparkSession,
    features: str,
    labels: str,
    reference: str,
    spec: PanelSpec = CLIMATE_PANEL,
    settings: RunSettings | None = None,
    vegetation: Sequence[str] = VEGETATION_SIGNALS,
    horizon: int = HORIZON_ROWS,
) -> tuple[float, DataFrame]:
    """Mean absolute error over the held-out last rows of one series, and the errors of every epoch; by
    default the published hold-out run."""
    result = evaluate(
        read_features(spark, features, climate_schema(spec, vegetation), spec.time),
        read_labels(spark, labels, label_schema(spec)),
        spec,
        settings or holdout_settings(),
        reference,
        horizon,
    )
    return result.rows.agg(F.avg("abs_error")).first()[0], result.history
