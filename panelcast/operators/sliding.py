"""Means and spreads of long windows, merged from shorter ones.

The moments (count, mean, centred sum of squares) of 4, 16, 64, ... rows are merged from four windows of a quarter of
that length, and a window of any length from the pieces its digits name: 52 rows are three times 16 and once 4. The cost
of a row grows with the logarithm of the window instead of its length, and all windows share the same pieces. Moments are only
ever merged, never subtracted, so nothing cancels: constant stretches have spread zero however large their values
are, and a NaN reaches the windows that hold it and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.blocks import BLOCK, BLOCK_ROWS, OWN, halo_blocks

RADIX = 4
PARTS = ("n", "m", "s")


def _pieces(window: int, shift: int) -> list[tuple[int, int]]:
    """(length, rows back) of the pieces that a window is laid out from, the latest rows first."""
    out, back, length = [], shift, 1
    while window:
        window, digit = divmod(window, RADIX)
        for _ in range(digit):
            out.append((length, back))
            back += length
        length *= RADIX
    return out


def _merge(a: str, b: str) -> dict[str, Column]:
    """Moments of two sets of rows together; an empty set has count, mean and sum zero."""
    n = F.col(f"{a}_n") + F.col(f"{b}_n")
    share = F.col(f"{b}_n") / F.greatest(n, F.lit(1.0))
    apart = F.col(f"{b}_m") - F.col(f"{a}_m")
    return {"n": n, "m": F.col(f"{a}_m") + apart * share, "s": F.col(f"{a}_s") + F.col(f"{b}_s") + apart * apart * F.col(f"{a}_n") * share}


def _merged(df: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Add the moments named by the keys of ``sets``, each merged pairwise from those listed.

    Every round is a projection of its own: as one expression, the pieces would be written out again in each merge.
    """
    round_, sets = 0, dict(sets)
    while any(len(parts) > 1 for parts in sets.values()):
        added, after = [], {}
        for name, parts in sets.items():
            pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
            after[name] = [pair[0] if len(pair) == 1 else f"{name}_r{round_}_{i}" for i, pair in enumerate(pairs)]
            for pair, new in zip(pairs, after[name], strict=True):
                if len(pair) == 2:
                    added += [column.alias(f"{new}_{p}") for p, column in _merge(*pair).items()]
        df, sets, round_ = df.select("*", *added), after, round_ + 1
    return df.select("*", *[F.col(f"{parts[0]}_{p}").alias(f"{name}_{p}") for name, parts in sets.items() for p in PARTS])


def _looked_back(df: DataFrame, wanted: dict[str, tuple[str, int]], w) -> DataFrame:
    """Add moments (new name -> moments, rows back); before the first row they are those of no rows."""
    held = lambda name: F.struct(*[F.col(f"{name}_{p}").alias(p) for p in PARTS])
    lagged = df.select("*", *[F.lag(held(old), back).over(w).alias(new) for new, (old, back) in wanted.items()])
    return lagged.select("*", *[F.coalesce(F.col(new)[p], F.lit(0.0)).alias(f"{new}_{p}") for new in wanted for p in PARTS])


def sliding_moments(
    df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], windows: Sequence[int], shift: int = 0,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``{c}_mean_{k}`` and ``{c}_std_{k}`` (population) of the last ``k`` rows for every column and window.

    ``order`` is a dense position within ``by``. With ``shift`` the window ends that many rows before the row. Nulls are
    skipped; a window without values gives null, at the start of a series it holds the rows there are. One shuffle and one
    sort serve all windows. An infinite value gives NaN.
    """
    windows = sorted(set(windows))
    if not windows or windows[0] < 1 or shift < 0:
        raise ValueError("windows must hold at least one row and end at the row or before it")
    spread = halo_blocks(df, order, back=windows[-1] - 1 + shift, rows=rows)
    w = Window.partitionBy(*by, BLOCK).orderBy(order)
    level = lambda i, length: f"_w{i}_{length}"
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        start = {"n": F.when(x.isNull(), 0.0).otherwise(1.0), "m": F.coalesce(x, F.lit(0.0)), "s": F.lit(0.0)}
        spread = spread.select("*", *[column.alias(f"{level(i, 1)}_{p}") for p, column in start.items()])
    each, length = range(len(columns)), 1
    while length * RADIX <= windows[-1]:
        longer = length * RADIX
        back = {i: [f"{level(i, longer)}_b{j}" for j in range(1, RADIX)] for i in each}
        spread = _looked_back(spread, {
            name: (level(i, length), j * length) for i in each for j, name in enumerate(back[i], 1)
        }, w)
        spread = _merged(spread, {level(i, longer): [*reversed(back[i]), level(i, length)] for i in each})
        length = longer
    pieces = {(i, k): _pieces(k, shift) for i in each for k in windows}
    name = lambda i, piece: f"_p{i}_{piece[0]}_{piece[1]}"
    used = {name(i, p): (level(i, p[0]), p[1]) for (i, _), listed in pieces.items() for p in listed}
    spread = _looked_back(spread, used, w)
    spread = _merged(spread, {f"_k{i}_{k}": [name(i, p) for p in reversed(listed)] for (i, k), listed in pieces.items()})
    out = []
    for i, c in enumerate(columns):
        for k in windows:
            n, m, s = (F.col(f"_k{i}_{k}_{p}") for p in PARTS)
            out.append(F.when(n > 0, m).alias(f"{c}_mean_{k}"))
            out.append(F.when(n > 0, F.sqrt(s / F.greatest(n, F.lit(1.0)))).alias(f"{c}_std_{k}"))
    return spread.where(F.col(OWN)).select(*df.columns, *out)
