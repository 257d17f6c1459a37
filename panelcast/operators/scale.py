"""Fitting and applying scaling parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.scalar import minmax, zscore
from panelcast.operators.position import LENGTH, SEQ


def _moments(column: str, inside: Column | None) -> list[Column]:
    x = F.col(column).cast("double")
    name = f"_{column}_all"
    if inside is not None:
        x, name = F.when(inside, x), f"_{column}_tail"
    return [
        F.count(x).alias(f"{name}_n"),
        F.avg(x).alias(f"{name}_m"),
        F.var_pop(x).alias(f"{name}_v"),
    ]


def fit_scaling(
    df: DataFrame,
    columns: Sequence[str],
    minmax_columns: Sequence[str] = (),
    by: Sequence[str] = (),
    weight_tail: int = 0,
) -> DataFrame:
    """All scaling parameters in one pass: one row, or one per group of ``by``.

    ``{c}_mean`` and ``{c}_std`` (population) of ``columns``, ``{c}_low`` and ``{c}_high`` of
    ``minmax_columns``; nulls are skipped. With ``weight_tail`` the last rows of each series count
    twice in the moments, merged from the counts, means and variances of both parts.
    """
    tail = F.col(SEQ) >= F.col(LENGTH) - weight_tail if weight_tail else None
    parts = [m for c in columns for m in _moments(c, None)]
    if tail is not None:
        parts += [m for c in columns for m in _moments(c, tail)]
    bounds = []
    for c in minmax_columns:
        x = F.col(c).cast("double")
        parts += [F.min(x).alias(f"{c}_low"), F.max(x).alias(f"{c}_high")]
        bounds += [f"{c}_low", f"{c}_high"]
    fitted = df.groupBy(*by).agg(*parts)
    out = []
    for c in columns:
        n, m, v = (F.col(f"_{c}_all_{k}") for k in "nmv")
        if tail is not None:
            tn, tm, tv = (F.col(f"_{c}_tail_{k}") for k in "nmv")
            tm, tv = F.coalesce(tm, m), F.coalesce(tv, F.lit(0.0))
            total = n + tn
            mean = m + (tm - m) * tn / total
            spread = (n * v + tn * tv + (tm - m) * (tm - m) * n * tn / total) / total
        else:
            mean, spread = m, v
        out += [mean.alias(f"{c}_mean"), F.sqrt(spread).alias(f"{c}_std")]
    return fitted.select(*by, *out, *bounds)


def fit_zscore(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight_tail: int = 0) -> DataFrame:
    return fit_scaling(df, columns, by=by, weight_tail=weight_tail)


def fit_minmax(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return fit_scaling(df, [], [column], by)


def apply_params(
    df: DataFrame,
    params: DataFrame,
    columns: Sequence[str] = (),
    minmax_columns: Sequence[str] = (),
    by: Sequence[str] = (),
    suffix: str = "",
) -> DataFrame:
    """Scale ``columns`` by z-score and ``minmax_columns`` by range.

    Shared parameters (no ``by``) are one row, more raise, and enter as a scalar subquery; parameters per
    group come in through an equi-join on the group columns. Rows of a group without parameters become null.
    """
    if by:
        joined = df.join(params, list(by), "left")
        param = F.col
    else:
        # One column for the whole row: every reference to the subquery itself would plan it again.
        several = F.raise_error(F.lit("shared scaling parameters have several rows"))
        whole = F.struct(*[F.col(c) for c in params.columns])
        single = F.when(F.count(F.lit(1)) > 1, several.cast(params.select(whole.alias("p")).schema["p"].dataType)).otherwise(
            F.first(whole)
        )
        joined = df.withColumn("_params", params.agg(single.alias("params")).scalar())
        param = lambda name: F.col("_params")[name]
    scaled = {c + suffix: zscore(c, param(f"{c}_mean"), param(f"{c}_std")) for c in columns}
    scaled |= {c + suffix: minmax(c, param(f"{c}_low"), param(f"{c}_high")) for c in minmax_columns}
    kept = [F.col(c) for c in df.columns if c not in scaled]
    return joined.select(*kept, *[column.alias(name) for name, column in scaled.items()])
