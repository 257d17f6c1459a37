"""Column expressions used across the operators. All of them stay inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.spec import WEEKS_PER_YEAR

# SELU constants and the scaling floors.
SELU_ALPHA = 1.6732632423543772
SELU_SCALE = 1.0507009873554805
STD_FLOOR = 1e-12
RANGE_FLOOR = 1.0


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zscore(x, mean, std) -> Column:
    return (_col(x) - _col(mean)) / F.greatest(_col(std), F.lit(STD_FLOOR))


def minmax(x, low, high) -> Column:
    return (_col(x).cast("double") - _col(low)) / F.greatest(
        (_col(high) - _col(low)).cast("double"), F.lit(RANGE_FLOOR)
    )


def fourier_terms(week, harmonics: int = 4, period: float = WEEKS_PER_YEAR) -> dict[str, Column]:
    """sin and cos of the annual phase and its multiples, first harmonic first."""
    phase = (_col(week).cast("double") - 1.0) * (2.0 * math.pi) / period
    terms = {}
    for k in range(1, harmonics + 1):
        terms[f"sin_{k}"] = F.sin(phase * k)
        terms[f"cos_{k}"] = F.cos(phase * k)
    return terms


def season_terms(week) -> dict[str, Column]:
    """Annual and semi-annual phase."""
    return fourier_terms(week, harmonics=2)


def _nonneg(x) -> Column:
    """max(x, 0); a missing prediction stays missing instead of becoming a count of zero."""
    x = _col(x).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(x, F.lit(0.0)))


def round_nearest_nonneg(x) -> Column:
    return F.floor(_nonneg(x) + 0.5).cast("long")


def truncate_nonneg(x) -> Column:
    return _nonneg(x).cast("long")


def to_count(x, rounding: str) -> Column:
    if rounding == "nearest":
        return round_nearest_nonneg(x)
    if rounding == "truncate":
        return truncate_nonneg(x)
    raise ValueError(f"unknown rounding {rounding!r}")


def to_float32(x) -> Column:
    return _col(x).cast("float")


def is_finite(x) -> Column:
    x = _col(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def selu(x) -> Column:
    x = _col(x)
    negative = SELU_ALPHA * F.expm1(F.when(x < -30.0, F.lit(-30.0)).otherwise(x))
    return SELU_SCALE * F.when(x > 0, x).otherwise(negative)


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over the columns that hold a value."""
    total = reduce(lambda a, b: a + b, [F.coalesce(_col(c).cast("double"), F.lit(0.0)) for c in columns])
    return total / F.nullif(_row_count(columns), F.lit(0))


def row_spread(columns: Sequence[str]) -> Column:
    """Population standard deviation over the columns that hold a value."""
    centre = row_mean(columns)
    squares = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.pow(_col(c).cast("double") - centre, 2), F.lit(0.0)) for c in columns],
    )
    return F.sqrt(squares / F.nullif(_row_count(columns), F.lit(0)))


def _row_count(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(_col(c).isNotNull(), 1).otherwise(0) for c in columns])


def ndvi_mean_spread(columns: Sequence[str]) -> dict[str, Column]:
    return {"ndvi_mean": row_mean(columns), "ndvi_spread": row_spread(columns)}


def temp_range(high, low) -> Column:
    return _col(high) - _col(low)


def temp_humidity(temperature, humidity) -> Column:
    return _col(temperature) * _col(humidity)


def log1p_target(y) -> Column:
    return F.log1p(_col(y).cast("double"))


def expm1_target(z) -> Column:
    return F.expm1(_col(z))


def abs_error(y, prediction) -> Column:
    return F.abs(_col(y).cast("double") - _col(prediction).cast("double"))


def nan_to_null(x) -> Column:
    x = _col(x)
    return F.when(~F.isnan(x), x)


def null_to_nan(x) -> Column:
    return F.coalesce(_col(x).cast("double"), F.lit(float("nan")))
