"""Statistics of all chronological folds from summaries of segments.

Fold k trains on everything before its cut, so the training rows of the folds are prefixes of one series. Cuts part a
series into segments; a segment is summarised once (count, mean and spread, or counts of equal values) and the summaries
of the segments before a cut are merged for its fold. Rows are never copied into folds: what is shuffled are summaries,
and the pass over the rows costs the same for any number of folds. Results equal those of the same statistic over the
training rows of `expanding_folds`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.position import LENGTH, SEQ, expanding_folds
from panelcast.operators.quantile import BROADCAST_PIECES, RESOLUTION, SPAN, null_safe, value_piece
from panelcast.operators.storage import written
from panelcast.spec import HORIZON_ROWS

FOLD = "fold"


def _steps_to_end(horizon: int) -> Column:
    """Horizons from a row to the end of its series, the begun one included."""
    return F.floor((F.col(LENGTH) - F.col(SEQ) + (horizon - 1)) / horizon).cast("int")


def first_fold(folds: int, horizon: int = HORIZON_ROWS) -> Column:
    """The first fold that trains on a row, and so does every later one; ``folds`` + 1 where none does."""
    return F.greatest(F.lit(1), F.lit(folds + 2) - _steps_to_end(horizon))


def validation_rows(df: DataFrame, folds: int, horizon: int = HORIZON_ROWS) -> DataFrame:
    """Rows that a fold validates on, with that ``fold``: a filter, as no row validates two of them."""
    fold = F.lit(folds + 1) - _steps_to_end(horizon)
    return df.withColumn(FOLD, fold).where(F.col(FOLD).between(1, folds))


def _training(df: DataFrame, folds: int, horizon: int) -> DataFrame:
    return df.withColumn("_first", first_fold(folds, horizon)).where(F.col("_first") <= folds)


def fold_scaling(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], folds: int, horizon: int = HORIZON_ROWS,
    minmax_columns: Sequence[str] = (),
) -> DataFrame:
    """The parameters of `fit_scaling` per group of ``by`` and ``fold``.

    One pass gives count, mean and variance per segment; the means of a fold are merged first and the spreads around
    them, so nothing cancels. A series that begins after a fold's cut has no row for that fold.
    """
    by, parts = list(by), []
    for c in columns:
        x = F.col(c).cast("double")
        parts += [F.count(x).alias(f"_{c}_n"), F.avg(x).alias(f"_{c}_m"), F.var_pop(x).alias(f"_{c}_v")]
    for c in minmax_columns:
        x = F.col(c).cast("double")
        parts += [F.min(x).alias(f"{c}_low"), F.max(x).alias(f"{c}_high")]
    segments = _training(df, folds, horizon).groupBy(*by, "_first").agg(*parts)
    # Dealt by series before segments meet their folds: neither the window nor the sums below move them again.
    spread = segments.repartition(*by).withColumn(FOLD, F.explode(F.sequence(F.col("_first"), F.lit(folds))))
    fold = Window.partitionBy(*by, FOLD)
    centred = spread.select("*", *[
        F.try_divide(F.sum(F.col(f"_{c}_n") * F.col(f"_{c}_m")).over(fold), F.sum(f"_{c}_n").over(fold)).alias(f"_{c}_c")
        for c in columns
    ])
    out = []
    for c in columns:
        n, off = F.col(f"_{c}_n"), F.col(f"_{c}_m") - F.col(f"_{c}_c")
        spread_of = F.try_divide(F.sum(n * (F.col(f"_{c}_v") + off * off)), F.sum(n))
        out += [F.max(f"_{c}_c").alias(f"{c}_mean"), F.sqrt(spread_of).alias(f"{c}_std")]
    for c in minmax_columns:
        out += [F.min(f"{c}_low").alias(f"{c}_low"), F.max(f"{c}_high").alias(f"{c}_high")]
    return centred.groupBy(*by, FOLD).agg(*out)


def fold_quantiles(
    df: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, float], folds: int,
    horizon: int = HORIZON_ROWS, resolution: int = RESOLUTION,
) -> DataFrame:
    """The quantiles of `exact_quantiles` per group of ``by`` and ``fold``; groups without values have no row.

    The same two passes as for one fold. A piece of the value range carries one count per fold, those of the segments
    before its cut, so the pieces and their number do not depend on the folds; only pieces that hold a wanted rank
    are told apart by fold.
    """
    by, each = list(by), range(1, folds + 1)
    v = F.col(value).cast("double")
    values = _training(df, folds, horizon).select(*by, "_first", v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    values = values.withColumn("_piece", value_piece(F.col("_v"), resolution))
    counts = lambda name: [F.count_if(F.col("_first") <= f).alias(f"{name}{f}") for f in each]

    cut = values.groupBy(*by, "_piece").agg(*counts("_w")).withColumn("_span", F.floor(F.col("_piece") / SPAN))
    earlier = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name, w: F.coalesce(F.sum(name).over(w), F.lit(0))
    spans = cut.groupBy(*by, "_span").agg(*[F.sum(f"_w{f}").alias(f"_s{f}") for f in each])
    group = Window.partitionBy(*by)
    based = spans.select(
        *by, "_span", *[before(f"_s{f}", earlier(group, "_span")).alias(f"_base{f}") for f in each],
        *[F.sum(f"_s{f}").over(group).alias(f"_n{f}") for f in each],
    )
    inside = earlier(Window.partitionBy(*by, "_span"), "_piece")
    started = null_safe(cut.select("*", *[before(f"_w{f}", inside).alias(f"_in{f}") for f in each]), based, [*by, "_span"])
    placed = started.select(*by, "_piece", F.inline(F.array(*[
        F.struct(
            F.lit(f).alias(FOLD), (F.col(f"_base{f}") + F.col(f"_in{f}")).alias("_start"), F.col(f"_w{f}").alias("_w"),
            F.col(f"_n{f}").alias("_n"),
        )
        for f in each
    ])))
    ranks = {}
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        ranks[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    covers = lambda low, width, rank: (low <= rank) & (rank < low + width)
    holds = reduce(lambda a, b: a | b, [
        covers(F.col("_start"), F.col("_w"), r) for lo, hi, _ in ranks.values() for r in (lo, hi)
    ])
    needed = written(placed.where(holds).select(*by, "_piece", FOLD, "_start", "_n"))
    pieces, found = needed.select(*by, "_piece").distinct(), [*by, "_piece", "_v"]
    if needed.count() <= BROADCAST_PIECES:
        counted = null_safe(values, F.broadcast(pieces), [*by, "_piece"]).groupBy(*found).agg(*counts("_c"))
    else:
        counted = null_safe(values.groupBy(*found).agg(*counts("_c")), pieces, [*by, "_piece"])
    long = counted.select(*found, F.inline(F.array(*[
        F.struct(F.lit(f).alias(FOLD), F.col(f"_c{f}").alias("_c")) for f in each
    ]))).where("_c > 0")
    running = Window.partitionBy(*by, "_piece", FOLD).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = null_safe(long, needed, [*by, "_piece", FOLD]).withColumn(
        "_from", F.col("_start") + F.sum("_c").over(running) - F.col("_c")
    )
    picked = [
        column
        for name, (lo, hi, share) in ranks.items()
        for column in (
            F.max(F.when(covers(F.col("_from"), F.col("_c"), lo), F.col("_v"))).alias(f"_{name}_lo"),
            F.max(F.when(covers(F.col("_from"), F.col("_c"), hi), F.col("_v"))).alias(f"_{name}_hi"),
            F.max(share).alias(f"_{name}_f"),
        )
    ]
    between = lambda n: F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")
    return ranked.groupBy(*by, FOLD).agg(*picked).select(*by, FOLD, *[between(n).alias(n) for n in wanted])


def fold_thresholds(
    df: DataFrame, by: Sequence[str], target: str, folds: int, horizon: int = HORIZON_ROWS, q: float = 0.9
) -> DataFrame:
    """(by, fold, threshold): `outbreak_threshold` of every fold."""
    return fold_quantiles(df, by, target, {"threshold": q}, folds, horizon)


def fold_baselines(
    df: DataFrame, by: Sequence[str], week: str, target: str, folds: int, horizon: int = HORIZON_ROWS
) -> DataFrame:
    """Validation rows of all folds with ``mean``, the training mean of their group, and ``climatology``, the training
    median of the same calendar week (the mean where the week is unseen)."""
    means = fold_scaling(df, [target], by, folds, horizon).select(*by, FOLD, F.col(f"{target}_mean").alias("mean"))
    weekly = fold_quantiles(df, [*by, week], target, {"_weekly": 0.5}, folds, horizon)
    scored = null_safe(validation_rows(df, folds, horizon), means, [*by, FOLD], "left")
    scored = null_safe(scored, weekly, [*by, FOLD, week], "left")
    return scored.withColumn("climatology", F.coalesce("_weekly", "mean")).drop("_weekly")


def impute_fold_medians(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], folds: int, horizon: int = HORIZON_ROWS
) -> DataFrame:
    """The rows of `expanding_folds`, missing values replaced by the median of their group's training rows of that fold.

    Rows meet the medians of all folds at once, one short map per column, and are copied where they lie
    afterwards. A column without a training value in a fold stays missing there.
    """
    by, columns = list(by), list(columns)
    names = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])
    long = df.select(*by, SEQ, LENGTH, F.inline(names))
    medians = fold_quantiles(long, [*by, "_column"], "_value", {"_median": 0.5}, folds, horizon)
    entry = F.struct(FOLD, "_median")
    maps = medians.groupBy(*by).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("_column") == c, entry))).alias(f"_{c}_medians") for c in columns
    ])
    copied = expanding_folds(null_safe(df, maps, by, "left"), folds, horizon)
    filled = {
        c: F.coalesce(F.col(c).cast("double"), F.try_element_at(F.col(f"_{c}_medians"), F.col(FOLD))) for c in columns
    }
    return copied.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns], FOLD, "role")
