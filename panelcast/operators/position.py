"""Row positions, splits and folds. Order always comes from the time column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.storage import save_point
from panelcast.spec import HORIZON_ROWS, LEAD_ROWS, STEP_SECONDS

SLOT_STEPS = 16384
SEQ = "seq"
LENGTH = "n"


def seconds_of(df: DataFrame, time: str) -> Column:
    """Seconds on the column's own clock, increasing with it whatever the session time zone is."""
    kind, t = df.schema[time].dataType, F.col(time)
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(t)
    days = F.unix_date(F.to_date(t)).cast("long") * 86400
    if isinstance(kind, T.DateType):
        return days
    return days + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))


def time_slot(df: DataFrame, time: str, step: str, steps: int = SLOT_STEPS) -> Column:
    """Coarse time bucket: with unique times it holds at most ``steps`` rows of a series."""
    return F.floor(seconds_of(df, time) / (STEP_SECONDS[step] * steps))


def row_position(df: DataFrame, by: Sequence[str], time: str, step: str, steps: int = SLOT_STEPS) -> DataFrame:
    """Add ``seq`` (0-based position in time order) and ``n`` (rows of the series).

    Counts per (series, time slot) give each slot its first position; rows are numbered inside their
    slot. Neither step puts a whole series into one task. A null key or time and a time that occurs
    twice in a series raise when positions are computed: both would make them wrong.
    """
    # A struct is never null: rows with a null key reach the check below instead of being lost in the join.
    slotted = df.withColumns({
        "_series": F.struct(*by), "_slot": F.coalesce(time_slot(df, time, step, steps), F.lit(0))
    })
    counts = slotted.groupBy("_series", "_slot").agg(F.count(F.lit(1)).alias("_rows"))
    series = Window.partitionBy("_series")
    earlier = series.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_series",
        "_slot",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(series).alias(LENGTH),
    )
    inside = Window.partitionBy("_series", "_slot").orderBy(time)
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*by, time)])
    at = F.concat_ws(" ", *[F.col(c).cast("string") for c in (*by, time)])
    number = (
        F.when(missing, F.raise_error(F.concat(F.lit("null series key or time near: "), at)).cast("int"))
        .when(
            F.lag(time).over(inside) == F.col(time),
            F.raise_error(F.concat(F.lit("time occurs twice in a series: "), at)).cast("int"),
        )
        .otherwise(F.row_number().over(inside))
    )
    return (
        slotted.withColumn("_row", number)
        .join(offsets, ["_series", "_slot"])
        .withColumn(SEQ, F.col("_offset") + F.col("_row") - 1)
        .drop("_series", "_slot", "_row", "_offset")
    )


def ordered_scan(df: DataFrame, order: Sequence[str], sums: Sequence[str], carries: Sequence[str]) -> DataFrame:
    """Prefix totals and nearest non-null neighbours over one global order.

    Adds ``{c}_before`` running totals (rows strictly before) for ``sums``; for each column of
    ``carries`` the last value before (``{c}_prev``) and the first value after (``{c}_next``). The
    table is range-partitioned, each partition is scanned on its own, and partition summaries (one row
    per partition) carry the state across. The range bounds are sampled, so the partitioned table is
    saved before it is used twice.
    """
    placed = save_point(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    )
    key = F.struct(*order)
    summary = placed.groupBy("_part").agg(
        *[F.sum(c).alias(f"_{c}_sum") for c in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_{c}_last") for c in carries],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_{c}_first") for c in carries],
    )
    # One row per partition of the table above: bounded by the partition count, not by the data.
    up = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    state = summary.select(
        "_part",
        *[F.coalesce(F.sum(f"_{c}_sum").over(up), F.lit(0)).alias(f"_{c}_base") for c in sums],
        *[F.last(f"_{c}_last", True).over(up).alias(f"_{c}_in") for c in carries],
        *[F.last(f"_{c}_first", True).over(down).alias(f"_{c}_out") for c in carries],
    )
    up = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = (
        Window.partitionBy("_part")
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    scanned = placed.join(state, "_part").select(
        *df.columns,
        *[(F.col(f"_{c}_base") + F.coalesce(F.sum(c).over(up), F.lit(0))).alias(f"{c}_before") for c in sums],
        *[F.coalesce(F.last(c, True).over(up), F.col(f"_{c}_in")).alias(f"{c}_prev") for c in carries],
        *[F.coalesce(F.last(c, True).over(down), F.col(f"_{c}_out")).alias(f"{c}_next") for c in carries],
    )
    return scanned


def series_lengths(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(LENGTH))


def tail_rows(df: DataFrame, rows: int = LEAD_ROWS) -> DataFrame:
    return df.where(F.col(SEQ) >= F.col(LENGTH) - rows)


def holdout_split(df: DataFrame, horizon: int = HORIZON_ROWS) -> tuple[DataFrame, DataFrame]:
    """Everything before the last ``horizon`` rows of each series, and those rows."""
    cut = F.col(LENGTH) - horizon
    return df.where(F.col(SEQ) < cut), df.where(F.col(SEQ) >= cut)


def _prefix_condition(df: DataFrame, entity: str, reference: str, horizon: int, minimum: int) -> Column:
    length = (
        df.where(F.col(entity) == reference)
        .agg(F.max(LENGTH).cast("double").alias("length"))
        .scalar()
    )
    share = F.floor(F.col(LENGTH) * (length - horizon) / length)
    return (F.col(entity) != reference) & (F.col(SEQ) < F.greatest(F.lit(minimum), share))


def proportional_prefix(
    df: DataFrame, entity: str, reference: str, horizon: int = HORIZON_ROWS, minimum: int = LEAD_ROWS
) -> DataFrame:
    """First rows of every other series, in the proportion the reference series keeps for training."""
    return df.where(_prefix_condition(df, entity, reference, horizon, minimum))


def concat_fold(
    df: DataFrame, entity: str, reference: str, horizon: int = HORIZON_ROWS, minimum: int = LEAD_ROWS
) -> DataFrame:
    """Training rows of one hold-out fold: the reference series before its cut plus the prefixes."""
    head = (F.col(entity) == reference) & (F.col(SEQ) < F.col(LENGTH) - horizon)
    return df.where(head | _prefix_condition(df, entity, reference, horizon, minimum))


def expanding_folds(df: DataFrame, folds: int, horizon: int = HORIZON_ROWS) -> DataFrame:
    """Copy each row into the folds that use it, with ``fold`` (1-based) and ``role``.

    Fold k trains on everything before its cut and validates on the next ``horizon`` rows; the last
    fold ends with the series. A row that no fold uses disappears.
    """
    copies = []
    for fold in range(1, folds + 1):
        cut = F.col(LENGTH) - (folds - fold + 1) * horizon
        role = F.when(F.col(SEQ) < cut, "train").when(F.col(SEQ) < cut + horizon, "validate")
        copies.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    spread = df.select("*", F.inline(F.array(*copies)))
    return spread.where(F.col("role").isNotNull())


def sort_time(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Order for output; the range shuffle also splits a dominant entity by time."""
    return df.orderBy(entity, time)


def head_rows(df: DataFrame, order: str, rows: int = 10) -> DataFrame:
    return df.orderBy(order).limit(rows)
