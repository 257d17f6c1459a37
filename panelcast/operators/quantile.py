"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.storage import scratch_path

RESOLUTION = 65536
SPAN = 4096
BROADCAST_PIECES = 100_000


def value_piece(value: Column, resolution: int = RESOLUTION) -> Column:
    """Monotone piece number of a value: neighbours within about 1/resolution of it share a piece."""
    size = F.rint(F.log(F.abs(value)) * resolution) + 1e9
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0.0))


def _piece_starts(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Add to (group, piece, count) the rows before each piece and the rows of its group.

    Two levels: sums of spans of pieces (a bounded number per group) give each span its start, and inside
    a span a window sees at most ``SPAN`` pieces. No window sees a group's pieces as a whole.
    """
    cut = pieces.withColumn("_span", F.floor(F.col("_piece") / SPAN))
    spans = cut.groupBy(*by, "_span").agg(F.sum("_w").alias("_sum"))
    group = Window.partitionBy(*by)
    earlier = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    based = spans.select(
        *by, "_span", F.coalesce(F.sum("_sum").over(earlier(group, "_span")), F.lit(0)).alias("_base"),
        F.sum("_sum").over(group).alias("_n"),
    )
    inside = earlier(Window.partitionBy(*by, "_span"), "_piece")
    started = cut.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return null_safe(started, based, [*by, "_span"]).withColumn("_start", F.col("_base") + F.col("_in")).drop("_base", "_in", "_span")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; keys come from ``left``."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    meets = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"_r_{c}"]) for c in on])
    return left.join(named, meets, how).drop(*[f"_r_{c}" for c in on])


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float], resolution: int = RESOLUTION
) -> DataFrame:
    """One row per group with the linearly interpolated quantiles named in ``wanted``.

    Nulls and NaN are skipped; all numbers travel as doubles. The first pass counts rows per piece of
    the value range, combined on the map side, and finds the pieces that hold a wanted rank: at most two per
    quantile and group. The second pass counts equal values inside those pieces and ranks them.

    The table of wanted pieces is written and counted. Up to ``BROADCAST_PIECES`` rows it is sent to the tasks, so
    that only values of wanted pieces leave them; beyond, values are counted before they are joined, so that
    what is shuffled is combined on the map side. Raw rows are neither shuffled nor broadcast.
    """
    by = list(by)
    v = F.col(value).cast("double")
    values = df.select(*by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    values = values.withColumn("_piece", value_piece(F.col("_v"), resolution))

    ranks = {}
    for name, q in wanted.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        ranks[name] = (F.floor(h), F.ceil(h), h - F.floor(h))

    pieces = _piece_starts(values.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_w")), by)
    inside = lambda rank: (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_w"))
    holds = reduce(lambda a, b: a | b, [inside(r) for lo, hi, _ in ranks.values() for r in (lo, hi)])
    path = scratch_path(df.sparkSession, "pieces")
    needed = pieces.where(holds).select(*by, "_piece", "_start", "_n")
    needed.write.parquet(path)
    needed = df.sparkSession.read.schema(needed.schema).parquet(path)

    found = [*by, "_piece", "_v"]
    if needed.count() <= BROADCAST_PIECES:
        counted = null_safe(values, F.broadcast(needed), [*by, "_piece"]).groupBy(*found, "_start", "_n").agg(
            F.count(F.lit(1)).alias("_c")
        )
    else:
        counted = null_safe(values.groupBy(*found).agg(F.count(F.lit(1)).alias("_c")), needed, [*by, "_piece"])
    running = Window.partitionBy(*by, "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_end", F.col("_start") + F.sum("_c").over(running))

    def at(rank):
        covers = (F.col("_end") - F.col("_c") <= rank) & (rank < F.col("_end"))
        return F.max(F.when(covers, F.col("_v")))

    picks = [
        p
        for name, (lo, hi, share) in ranks.items()
        for p in (at(lo).alias(f"_{name}_lo"), at(hi).alias(f"_{name}_hi"), F.max(share).alias(f"_{name}_f"))
    ]
    between = lambda n: F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")
    return ranked.groupBy(*by).agg(*picks).select(*by, *[between(n).alias(n) for n in wanted])
