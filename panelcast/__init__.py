"""panelcast: forecasting counts over many keyed time series, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from panelcast.plans.forecast import ForecastResult, evaluate, evaluate_files, forecast, forecast_files
from panelcast.spec import EntityPlan, MlpConfig, PanelSpec, RunSettings, historical_settings, holdout_settings


def ship_by_value() -> None:
    """Send task functions by value from now on: executors then need no copy of this package.

    Not needed where the package is installed on executors or sent with ``--py-files``.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


__all__ = [
    "EntityPlan",
    "ForecastResult",
    "MlpConfig",
    "PanelSpec",
    "RunSettings",
    "evaluate",
    "evaluate_files",
    "forecast",
    "forecast_files",
    "historical_settings",
    "holdout_settings",
    "ship_by_value",
]
