"""Lead-ins and history features: everything that looks back along a series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.scalar import (
    fourier_terms,
    ndvi_mean_spread,
    null_to_nan,
    season_terms,
    temp_humidity,
    temp_range,
)
from panelcast.operators.blocks import BLOCK_ROWS, small_methods, with_history
from panelcast.operators.position import LENGTH, SEQ, series_lengths, tail_rows
from panelcast.spec import (
    GAP_WINDOWS,
    HISTORY_ROWS,
    LEAD_ROWS,
    MEAN_WINDOWS,
    STD_WINDOWS,
    TREE_LAGS,
    TREE_MEANS,
    TREND_ROWS,
)

POS = "pos"
EXAMPLES = "examples"
FIRST = "first_pos"
REACH = "_reach"


# --- lead-ins ---------------------------------------------------------------------------------------


def _examples(first: Column) -> list[Column]:
    """Number of examples the split yields and the position of the first one."""
    return [F.col(LENGTH).alias(EXAMPLES), first.cast("long").alias(FIRST)]


def lead_in_none(df: DataFrame) -> DataFrame:
    """Positions without any context: the first rows of a series never get a full history."""
    return df.select("*", F.col(SEQ).alias(POS), *_examples(F.lit(0)))


def lead_in_circular(df: DataFrame, rows: int = LEAD_ROWS, offset: int = 0) -> DataFrame:
    """Put the last ``rows`` rows of each series in front of it.

    Early rows then take the end of their own series as history, which is not causal; it exists to
    match the published run. Examples start ``offset`` rows before the first own row, so the last rows
    of the series come first and every row is an example once. A row is duplicated in place: no shuffle.
    """
    lead = F.least(F.lit(rows), F.col(LENGTH))
    own = F.col(SEQ) + lead
    repeated = F.col(SEQ) - F.col(LENGTH) + lead
    places = F.when(repeated >= 0, F.array(own, repeated)).otherwise(F.array(own))
    return df.select("*", F.explode(places).alias(POS), *_examples(lead - offset))


def lead_in_previous(
    train: DataFrame, test: DataFrame, by: Sequence[str], rows: int = LEAD_ROWS, offset: int = 0
) -> DataFrame:
    """Put the last ``rows`` training rows of each series in front of its test rows.

    With ``offset`` the histories end that many rows before the test row they are meant for.
    """
    tail = (
        tail_rows(train, rows)
        .join(series_lengths(test, by).withColumnRenamed(LENGTH, EXAMPLES), list(by))
        .withColumn(POS, F.col(SEQ) - F.col(LENGTH) + rows)
        .withColumn(FIRST, F.lit(rows - offset).cast("long"))
    )
    body = test.select("*", (F.col(SEQ) + rows).alias(POS), *_examples(F.lit(rows - offset)))
    return body.unionByName(tail, allowMissingColumns=True)


def history_complete(df: DataFrame, history: int = HISTORY_ROWS) -> DataFrame:
    """Rows that are examples of their split and have ``history`` rows, their own included."""
    pos = F.col(POS)
    return df.where(
        (pos >= history - 1) & (pos >= F.col(FIRST)) & (pos < F.col(FIRST) + F.col(EXAMPLES))
    )


def endpoint_offset(
    df: DataFrame, by: Sequence[str], order: str, features: Mapping[str, str], rows: int
) -> DataFrame:
    """Add each feature (source -> new name) as it stood ``rows`` rows earlier."""
    return with_history(
        df, by, order, lambda w: {new: F.lag(old, rows).over(w) for old, new in features.items()}, back=rows
    )


# --- single window columns --------------------------------------------------------------------------


def trailing(w: WindowSpec, rows: int, shift: int = 0) -> WindowSpec:
    """The last ``rows`` rows; with ``shift=1`` the current row is left out."""
    return w.rowsBetween(-(rows - 1) - shift, -shift)


def trailing_mean(column: str, rows: int, w: WindowSpec) -> Column:
    return F.avg(column).over(trailing(w, rows))


def trailing_std(column: str, rows: int, w: WindowSpec) -> Column:
    return F.stddev_pop(column).over(trailing(w, rows))


def past_mean_shifted(column: str, rows: int, w: WindowSpec) -> Column:
    return F.avg(column).over(trailing(w, rows, shift=1))


def trend(column: str, rows: int, w: WindowSpec) -> Column:
    return (F.col(column) - F.lag(column, rows).over(w)) / float(rows)


# --- feature vectors --------------------------------------------------------------------------------


def multiscale_names(columns: Sequence[str]) -> list[str]:
    """Vector order: the eleven summaries of each signal, then the season terms."""
    short, long = GAP_WINDOWS
    per_signal = [
        "now",
        *[f"mean_{k}" for k in MEAN_WINDOWS],
        *[f"std_{k}" for k in STD_WINDOWS],
        f"gap_{short}_{long}",
        f"trend_{TREND_ROWS + 1}",
    ]
    return [f"{c}_{s}" for c in columns for s in per_signal] + ["sin_1", "cos_1", "sin_2", "cos_2"]


def _tiling(windows: Sequence[int]) -> dict[int, int]:
    """Long mean -> the shorter mean it can be laid out from, end to end, in two or four pieces.

    The mean of equally long pieces is the mean of their means, so a 52-row window costs three lags of
    the 13-row mean instead of 52 additions per row.
    """
    tiles = {}
    for k in windows:
        pieces = [b for b in windows if b >= 4 and k % b == 0 and k // b in (2, 4)]
        if pieces:
            tiles[k] = min(pieces)
    return tiles


def multiscale_columns(
    df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], week: str, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add every multiscale summary as a named column: one shuffle and one sort for all signals.

    Rows with less than a full history behind them are dropped. Missing values become NaN and show up
    in the feature-shape contract.
    """
    tiles = _tiling(MEAN_WINDOWS)
    direct = [k for k in MEAN_WINDOWS if k not in tiles]
    short, long = GAP_WINDOWS

    def base(w):
        out = {REACH: F.lag(order, HISTORY_ROWS - 1).over(w)}
        for c in columns:
            x = null_to_nan(c)
            out[f"{c}_now"] = x
            out |= {f"{c}_mean_{k}": F.avg(x).over(trailing(w, k)) for k in direct}
            out |= {f"{c}_std_{k}": F.stddev_pop(x).over(trailing(w, k)) for k in STD_WINDOWS}
            out[f"{c}_trend_{TREND_ROWS + 1}"] = (x - F.lag(x, TREND_ROWS).over(w)) / float(TREND_ROWS)
        return out

    def shifted(w):
        steps = sorted({(b, i * b) for k, b in tiles.items() for i in range(1, k // b)})
        return {f"_{c}_{b}_{s}": F.lag(f"{c}_mean_{b}", s).over(w) for c in columns for b, s in steps}

    def derived(_):
        out = {}
        for c in columns:
            for k, b in tiles.items():
                pieces = [F.col(f"{c}_mean_{b}"), *[F.col(f"_{c}_{b}_{i * b}") for i in range(1, k // b)]]
                out[f"{c}_mean_{k}"] = sum(pieces[1:], pieces[0]) / len(pieces)
            out[f"{c}_gap_{short}_{long}"] = F.col(f"{c}_mean_{short}") - F.col(f"{c}_mean_{long}")
        return out | season_terms(week)

    wide = with_history(df, by, order, base, shifted, derived, back=HISTORY_ROWS - 1, rows=rows)
    return wide.where(F.col(REACH).isNotNull()).select(*df.columns, *multiscale_names(columns))


def multiscale_features(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    week: str,
    order: str = POS,
    keep: Sequence[str] | None = None,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``features``: the multiscale vector of each row with a complete history, as 32-bit floats."""
    keep = list(df.columns if keep is None else keep)
    wide = history_complete(multiscale_columns(df, by, order, columns, week, rows))
    return wide.select(*keep, F.array(*multiscale_names(columns)).cast("array<float>").alias("features"))


def raw_lag_arrays(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    lengths: Mapping[str, int],
    rows: int = BLOCK_ROWS,
    complete: bool = False,
) -> DataFrame:
    """Add ``{c}_lags``: the last L values of each column, oldest first; null while there are fewer.

    ``complete`` keeps only rows with a full 52-row history, whatever the lengths are.

    One window collects the rows of the longest history as structs (a struct is never skipped, so a
    missing value keeps its place, as NaN); shorter histories are slices of it.
    """
    longest = max(lengths.values())
    back = max(longest, HISTORY_ROWS if complete else 1) - 1
    record = F.struct(*[null_to_nan(c).alias(c) for c in lengths])
    wide = with_history(
        df,
        by,
        order,
        lambda w: {
            "_history": F.collect_list(record).over(trailing(w, longest)),
            REACH: F.lag(order, back).over(w),
        },
        back=back,
        rows=rows,
    )
    if complete:
        wide = wide.where(F.col(REACH).isNotNull())
    held = F.size("_history")
    return wide.select(
        *df.columns,
        *[
            F.when(held >= n, F.slice(F.col("_history")[c], F.greatest(held - n + 1, F.lit(1)), n)).alias(f"{c}_lags")
            for c, n in lengths.items()
        ],
    )


def raw_lag_features(
    df: DataFrame,
    by: Sequence[str],
    lengths: Mapping[str, int],
    order: str = POS,
    keep: Sequence[str] | None = None,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``features``: the histories of all columns laid out one after the other, as 32-bit floats."""
    keep = list(df.columns if keep is None else keep)
    wide = history_complete(raw_lag_arrays(df, by, order, lengths, rows, complete=True))
    vector = F.concat(*[F.col(f"{c}_lags") for c in lengths])
    return wide.select(*keep, vector.cast("array<float>").alias("features"))


def raw_plus_summaries(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    week: str,
    lengths: Mapping[str, int],
    scaled_week: str | None = None,
    order: str = POS,
    keep: Sequence[str] | None = None,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Both representations in one vector, raw histories first."""
    keep = list(df.columns if keep is None else keep)
    wide = raw_lag_arrays(df, by, order, lengths, rows)
    both = history_complete(multiscale_columns(wide, by, order, columns, week, rows))
    vector = F.concat(*[F.col(f"{c}_lags") for c in lengths], F.array(*multiscale_names(columns)))
    return both.select(*keep, vector.cast("array<float>").alias("features"))


def sparse_lags(
    df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], lags: Sequence[int] = TREE_LAGS
) -> DataFrame:
    return with_history(
        df,
        by,
        order,
        lambda w: {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags},
        back=max(lags),
    )


def tree_features(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    signals: Sequence[str],
    week: str,
    lagged: Sequence[str] | None = None,
    vegetation: Sequence[str] = (),
    ranges: Mapping[str, tuple[str, str]] | None = None,
    interaction: tuple[str, str] | None = None,
    lags: Sequence[int] = TREE_LAGS,
    means: Sequence[int] = TREE_MEANS,
) -> DataFrame:
    """Current values, four annual harmonics, vegetation summary, ranges, interaction, lags, past means.

    Which series are lagged, which pairs form ranges and which pair interacts are parameters. All
    windows look strictly backwards; past means leave out the current row. Earlier targets are not used.
    """
    small_methods(df.sparkSession)
    lagged = list(signals if lagged is None else lagged)
    plain = fourier_terms(week)
    if vegetation:
        plain |= ndvi_mean_spread(vegetation)
    plain |= {name: temp_range(high, low) for name, (high, low) in (ranges or {}).items()}
    if interaction:
        plain["temp_humidity"] = temp_humidity(*interaction)

    def windows(w):
        out = {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in lagged for k in lags}
        return out | {f"{c}_past_{k}": past_mean_shifted(c, k, w) for c in lagged for k in means}

    wide = with_history(df, by, order, windows, back=max(*lags, *means))
    return wide.select("*", *[column.alias(name) for name, column in plain.items()])


def tree_feature_names(df: DataFrame, featured: DataFrame, signals: Sequence[str], vegetation: Sequence[str] = ()) -> list[str]:
    """Design-matrix columns of ``tree_features``: current measurements plus every added column."""
    return [*signals, *vegetation, *[c for c in featured.columns if c not in df.columns]]


def long_features(df: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Vector to one row per (key, feature)."""
    labels = F.array(*[F.lit(n) for n in names])
    pairs = F.arrays_zip(labels.alias("feature"), F.col("features").alias("value"))
    return df.select(*keys, F.inline(pairs)).toDF(*keys, "feature", "value")
