"""Gap filling along a series, block by block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.blocks import BLOCK, block_of
from panelcast.operators.position import LENGTH, SEQ, ordered_scan

# Running frames need no rows from other blocks, so a block may be long; the carry table has one row
# per block.
FILL_ROWS = 65536


def _known(column: str, position: str | Column) -> Column:
    """(position, value) where a value is present, null otherwise."""
    position = F.col(position) if isinstance(position, str) else position
    value = F.col(column).cast("double")
    return F.when(value.isNotNull(), F.struct(position.alias("p"), value.alias("v")))


def _shifted(known: Column, offset: Column) -> Column:
    return F.when(known.isNotNull(), F.struct((known["p"] + offset).alias("p"), known["v"].alias("v")))


def entity_rank(entity: str, entity_order: Sequence[str] | None) -> Column:
    """Frame order of the series: the listed order, then the entity value itself."""
    if not entity_order:
        return F.lit(0)
    ranks = F.array_position(F.array(*[F.lit(e) for e in entity_order]), F.col(entity))
    return F.when(ranks > 0, ranks).otherwise(len(entity_order) + 1)


def _frame_neighbours(df: DataFrame, entity: str, columns: Sequence[str], entity_order) -> DataFrame:
    """Per series: nearest known value in earlier and later series, as positions relative to it."""
    ends = df.groupBy(entity).agg(
        F.max(LENGTH).alias("_len"),
        *[F.min(_known(c, SEQ)).alias(f"_{c}_lo") for c in columns],
        *[F.max(_known(c, SEQ)).alias(f"_{c}_hi") for c in columns],
    )
    ranked = ends.withColumn("_rank", entity_rank(entity, entity_order))
    bases = ordered_scan(ranked, ["_rank", entity], ["_len"], []).withColumnRenamed("_len_before", "_base")
    framed = bases.select(
        entity,
        "_rank",
        "_base",
        *[_shifted(F.col(f"_{c}_lo"), F.col("_base")).alias(f"_{c}_lo") for c in columns],
        *[_shifted(F.col(f"_{c}_hi"), F.col("_base")).alias(f"_{c}_hi") for c in columns],
    )
    ends_in_frame = [f"_{c}_{side}" for c in columns for side in ("lo", "hi")]
    scanned = ordered_scan(framed, ["_rank", entity], [], ends_in_frame)
    return scanned.select(
        entity,
        *[_shifted(F.col(f"_{c}_hi_prev"), -F.col("_base")).alias(f"_{c}_outer_prev") for c in columns],
        *[_shifted(F.col(f"_{c}_lo_next"), -F.col("_base")).alias(f"_{c}_outer_next") for c in columns],
    )


def interpolate_linear(
    df: DataFrame,
    entity: str,
    columns: Sequence[str],
    scope: str = "entity",
    method: str = "linear",
    by: Sequence[str] = (),
    entity_order: Sequence[str] | None = None,
    rows: int = FILL_ROWS,
) -> DataFrame:
    """Fill missing values of ``columns`` by position, forward only.

    Inner gaps are linear between their neighbours, a trailing gap repeats the last value and a leading
    gap stays missing. ``scope='frame'`` treats the series as one frame, so a gap may be closed by a
    neighbouring series; ``method='last'`` carries the last value forward instead, which never looks
    ahead. ``by`` adds grouping columns next to ``entity`` (folds, splits) for entity scope.
    """
    if scope not in ("entity", "frame") or method not in ("linear", "last"):
        raise ValueError(f"unknown scope {scope!r} or method {method!r}")
    if scope == "frame" and by:
        raise ValueError("frame scope fills one frame at a time")
    series = [entity, *by]
    blocked = df.withColumn(BLOCK, block_of(SEQ, rows))

    # First and last known value of every block, then the nearest known value outside the block. The
    # table has one row per block, so its per-series window is smaller than the data by ``rows``.
    summary = blocked.groupBy(*series, BLOCK).agg(
        *[F.min(_known(c, SEQ)).alias(f"_{c}_first") for c in columns],
        *[F.max(_known(c, SEQ)).alias(f"_{c}_last") for c in columns],
    )
    up = Window.partitionBy(*series).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*series).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *series,
        BLOCK,
        *[F.last(f"_{c}_last", True).over(up).alias(f"_{c}_prev") for c in columns],
        *[F.last(f"_{c}_first", True).over(down).alias(f"_{c}_next") for c in columns],
    )
    if scope == "frame":
        outer = _frame_neighbours(df, entity, columns, entity_order)
        carry = carry.join(outer, entity).select(
            *series,
            BLOCK,
            *[
                F.coalesce(f"_{c}_{side}", f"_{c}_outer_{side}").alias(f"_{c}_{side}")
                for c in columns
                for side in ("prev", "next")
            ],
        )

    inside = Window.partitionBy(*series, BLOCK)
    back = inside.orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    # Reading backwards keeps the running frame linear in the block size.
    ahead = inside.orderBy(F.desc(SEQ)).rowsBetween(Window.unboundedPreceding, 0)
    with_neighbours = blocked.join(carry, [*series, BLOCK]).select(
        *df.columns,
        *[F.coalesce(F.last(_known(c, SEQ), True).over(back), F.col(f"_{c}_prev")).alias(f"_{c}_a") for c in columns],
        *(
            [
                F.coalesce(F.last(_known(c, SEQ), True).over(ahead), F.col(f"_{c}_next")).alias(f"_{c}_b")
                for c in columns
            ]
            if method == "linear"
            else []
        ),
    )
    filled = {c: _between(c, method) for c in columns}
    return with_neighbours.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def _between(column: str, method: str) -> Column:
    before = F.col(f"_{column}_a")
    if method == "last":
        return F.coalesce(F.col(column).cast("double"), before["v"])
    after = F.col(f"_{column}_b")
    slope = (after["v"] - before["v"]) / (after["p"] - before["p"])
    return (
        F.when(F.col(column).isNotNull(), F.col(column).cast("double"))
        .when(before.isNull(), F.lit(None).cast("double"))
        .when(after.isNull(), before["v"])
        .otherwise(before["v"] + slope * (F.col(SEQ) - before["p"]))
    )
