"""Profiling tables: what a panel looks like before anything is modelled."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import null_to_nan
from panelcast.operators.blocks import BLOCK, OWN, halo_blocks
from panelcast.operators.quantile import exact_quantiles, null_safe
from panelcast.operators.storage import written


def count_rows_entity(df: DataFrame, entity: str) -> DataFrame:
    """Rows per entity and in total (entity null), from one aggregation."""
    return df.rollup(entity).agg(F.count(F.lit(1)).alias("rows"))


def dataset_overview(df: DataFrame, entity: str, time: str, target: str) -> DataFrame:
    y = F.col(target)
    totals = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        F.avg(y).alias("mean"),
        F.max(y).alias("max"),
    )
    return totals.join(exact_quantiles(df, [entity], target, {"median": 0.5}), entity, "left")


def missing_share(df: DataFrame, entity: str, columns: Sequence[str], at_least: float = 0.01) -> DataFrame:
    """Share of missing rows per (entity, variable). Aggregated wide, turned long afterwards."""
    wide = df.groupBy(entity).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = wide.unpivot(entity, list(columns), "variable", "share")
    return long.where(F.col("share") >= at_least)


def seasonal_profile(df: DataFrame, entity: str, week: str, target: str) -> DataFrame:
    means = df.groupBy(entity, week).agg(F.avg(target).alias("mean"), F.count(F.lit(1)).alias("rows"))
    spread = exact_quantiles(df, [entity, week], target, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return means.join(spread, [entity, week], "left")


def target_distribution(df: DataFrame, entity: str, target: str, width: float) -> DataFrame:
    """Histogram rows (bin start, count), each with the entity's median."""
    bins = df.groupBy(entity, (F.floor(F.col(target) / width) * width).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return bins.join(exact_quantiles(df, [entity], target, {"median": 0.5}), entity)


_LAG_SUMS = "variable int, lag long, n double, mx double, my double, xx double, yy double, xy double"


def lagged_moments(x: np.ndarray, y: np.ndarray, own: np.ndarray, lags: int) -> np.ndarray:
    """(lags + 1, 6): pairs of ``y`` with ``x`` k rows before, k = 0..lags: their number, means and centred sums.

    Rows follow each other; ``own`` marks those whose pairs count, the others only serve as history.
    """
    history = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(lags, np.nan), x]), lags + 1)[own, ::-1]
    label = y[own][:, None]
    both = ~np.isnan(history) & ~np.isnan(label)
    n = both.sum(axis=0)
    least = np.maximum(n, 1)
    mean = lambda v: np.where(both, v, 0.0).sum(axis=0) / least
    mx, my = mean(history), mean(label)
    dx, dy = np.where(both, history - mx, 0.0), np.where(both, label - my, 0.0)
    return np.stack([n, mx, my, (dx * dx).sum(axis=0), (dy * dy).sum(axis=0), (dx * dy).sum(axis=0)], axis=1)


def _lag_moments(df: DataFrame, entity: str, order: str, target: Column, signals: Sequence[str | Column], lags: int) -> DataFrame:
    """(entity, variable number, lag, n, mx, my, xx, yy, xy) over all pairs of a series.

    A series is cut into blocks of rows with the history they need. A block returns six numbers per signal and lag, which
    are written, merged to means, and merged to sums around these means: no row is widened by its lags, and nothing
    cancels however far the values lie from zero.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in signals]
    narrow = df.select(entity, order, null_to_nan(target).alias("_y"), *[null_to_nan(c).alias(f"_x{i}") for i, c in enumerate(columns)])
    blocked, width = halo_blocks(narrow, order, back=lags), len(columns)
    schema = T.StructType([df.schema[entity], *T._parse_datatype_string(_LAG_SUMS).fields])

    def sums(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        own, y = table[OWN].to_numpy(zero_copy_only=False).astype(bool), table["_y"].to_numpy()
        found = [lagged_moments(table[f"_x{i}"].to_numpy(), y, own, lags) for i in range(width)]
        count = width * (lags + 1)
        values = np.concatenate(found)
        return pa.table([
            pa.concat_arrays([table[entity].combine_chunks().slice(0, 1)] * count), pa.array(np.repeat(np.arange(width), lags + 1), pa.int32()),
            pa.array(np.tile(np.arange(lags + 1), width), pa.int64()), *[pa.array(v) for v in values.T.copy()],
        ], names=[f.name for f in schema.fields])

    parts = written(blocked.groupBy(entity, BLOCK).applyInArrow(sums, schema).where("n > 0"))
    by = [entity, "variable", "lag"]
    means = parts.groupBy(*by).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("_mx"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("_my")
    )
    dx, dy = F.col("mx") - F.col("_mx"), F.col("my") - F.col("_my")
    return null_safe(parts, means, by).groupBy(*by).agg(
        F.max("_n").alias("n"), F.max("_mx").alias("mx"), F.max("_my").alias("my"),
        F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"),
        F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"),
    )


def _lag_corr(df: DataFrame, entity: str, variables: Sequence[str], moments: DataFrame, first: int, lags: int) -> DataFrame:
    """(entity, name of the variable, lag, corr) for every series and lag; null where either side is constant or no pair exists."""
    listed = F.array(*[F.struct(F.lit(i).alias("variable"), F.lit(name).alias("_name")) for i, name in enumerate(variables)])
    grid = df.select(entity).distinct().select(entity, F.inline(listed)).withColumn(
        "lag", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(lags).cast("long")))
    )
    # A constant column leaves no more than rounding in its centred sum.
    varies = lambda v, m: F.col(v) > 1e-28 * F.col("n") * F.greatest(F.col(m) * F.col(m), F.lit(1e-280))
    corr = F.when(varies("xx", "mx") & varies("yy", "my"), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    met = null_safe(grid, moments.withColumn("corr", corr), [entity, "variable", "lag"], "left")
    return met.select(entity, "_name", "lag", "corr")


def autocorrelation(df: DataFrame, entity: str, order: str, target: str, lags: int = 20) -> DataFrame:
    """Correlation of the target with itself, per entity and lag 1..``lags``. ``order`` is a dense row position."""
    y = F.col(target).cast("double")
    moments = _lag_moments(df, entity, order, y, [y], lags)
    return _lag_corr(df, entity, [target], moments, 1, lags).drop("_name")


def lag_correlation(
    df: DataFrame, entity: str, order: str, target: str, signals: Sequence[str], lags: int = 20
) -> DataFrame:
    """Correlation of each signal, 0..``lags`` rows back, with the target: (entity, variable, lag, corr).

    One pass over blocks of rows for all signals and lags; the shuffle after it carries sums only. ``order`` is a
    dense row position.
    """
    moments = _lag_moments(df, entity, order, F.col(target).cast("double"), list(signals), lags)
    return _lag_corr(df, entity, list(signals), moments, 0, lags).withColumnRenamed("_name", "variable")
