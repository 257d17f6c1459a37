"""Tree models: forests and boosting of our own, squared-error boosting and a linear count model on MLlib. Every fit is distributed over its training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import expm1_target, log1p_target
from panelcast.operators.boost import BoostPlan, FittedBoost, fit_boosts
from panelcast.operators.forest import FittedForest, ForestPlan, fit_forests
from panelcast.operators.storage import checkpoint_dir

FEATURES = "_features"


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add the design vector; rows with a missing input raise when it is used."""
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="error").transform(df)


class FittedTree:
    """A fitted regressor with its target transform: ``predict`` adds a non-negative ``prediction``."""

    def __init__(self, model, columns: Sequence[str], log_target: bool):
        self.model, self.columns, self.log_target = model, list(columns), log_target

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(assemble(df, self.columns)).drop(FEATURES)
        value = expm1_target("prediction") if self.log_target else F.col("prediction")
        return scored.withColumn("prediction", F.greatest(value, F.lit(0.0)))


def _fit(regressor, train: DataFrame, columns: Sequence[str], target: str, log_target: bool) -> FittedTree:
    label = log1p_target(target) if log_target else F.col(target).cast("double")
    data = assemble(train, columns).select(FEATURES, label.alias("_label"))
    return FittedTree(regressor.fit(data), columns, log_target)


def forest_regressor(
    train: DataFrame,
    columns: Sequence[str],
    target: str,
    log_target: bool = False,
    trees: int = 500,
    min_leaf: int = 5,
    max_depth: int = 12,
    seed: int = 42,
    extra: bool = False,
    criterion: str = "squared",
    keys: Sequence[str] | None = None,
) -> FittedForest:
    """A forest over all rows with a minimum leaf size, optionally on log(1+y), with random thresholds (``extra``) or
    Poisson splits: see `fit_forests`."""
    plan = ForestPlan(trees, min_leaf, max_depth, extra=extra, criterion=criterion, log_target=log_target, seed=seed)
    return fit_forests(train, columns, target, plan, keys=keys)


def boosted_regressor(
    train: DataFrame,
    columns: Sequence[str],
    target: str,
    objective: str = "absolute",
    rounds: int = 500,
    learning_rate: float = 0.03,
    depth: int = 3,
    min_child: int = 10,
    row_share: float = 0.85,
    feature_share: float = 0.8,
    l1: float = 0.1,
    l2: float = 10.0,
    seed: int = 42,
    keys: Sequence[str] | None = None,
) -> FittedBoost | FittedTree:
    """Boosted trees over all rows for ``absolute`` error or ``poisson`` counts (see `fit_boosts`), or on MLlib for
    ``squared`` error, which has no penalties."""
    if objective != "squared":
        plan = BoostPlan(objective, rounds, learning_rate, depth, min_child, row_share, feature_share, l1, l2, seed)
        return fit_boosts(train, columns, target, plan, keys=keys)
    checkpoint_dir(train.sparkSession)
    boosted = GBTRegressor(
        featuresCol=FEATURES,
        labelCol="_label",
        lossType=objective,
        maxIter=rounds,
        stepSize=learning_rate,
        maxDepth=depth,
        minInstancesPerNode=min_child,
        subsamplingRate=row_share,
        featureSubsetStrategy=str(feature_share),
        seed=seed,
    )
    return _fit(boosted, train, columns, target, False)


def poisson_regressor(
    train: DataFrame, columns: Sequence[str], target: str, regularisation: float = 0.1
) -> FittedTree:
    """A linear model of the logarithm of a Poisson mean. Not boosting: MLlib boosts no Poisson loss."""
    glm = GeneralizedLinearRegression(
        featuresCol=FEATURES, labelCol="_label", family="poisson", link="log", regParam=regularisation
    )
    return _fit(glm, train, columns, target, False)
