"""Comparing large tables by checksums of ranges: only rows of ranges that differ are moved and joined.

A key's hash names its range and, inside it, a finer one. A range is summed up by the number of its rows and the sums of two
64-bit hashes of them, so the order in which rows arrive does not matter and repeated rows count. Both tables are summed
in one aggregate with opposite signs; what is not zero differs. Rows that are alike on both sides cost a scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.storage import written

RANGES = 4096
BROADCAST_RANGES = 100_000
SIDE = "_side"


def _hash(columns: Sequence[str], seed: int) -> Column:
    """Hash of a row; a null is hashed as such, since Spark's hash would pass over it."""
    return F.xxhash64(F.lit(seed), *columns, *[F.col(c).isNull() for c in columns])


def _sides(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    cells = [*keys, *values]
    signed = lambda df, sign: df.select(*cells, F.lit(sign).alias(SIDE))
    at = _hash(keys, 1)
    return signed(left, 1).unionByName(signed(right, -1)).withColumns({
        "_range": F.pmod(at, F.lit(RANGES)).cast("int"),
        "_finer": F.pmod(F.shiftrightunsigned(at, 24), F.lit(RANGES)).cast("int"),
    })


def _unequal(rows: DataFrame, cells: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Ranges whose checksums differ. Hashes are summed in halves, which no number of rows in a range overflows."""
    low, high = F.lit(0xFFFFFFFF), 32
    parts = [half for seed in (2, 3) for h in [_hash(cells, seed)] for half in (h.bitwiseAND(low), F.shiftrightunsigned(h, high))]
    sums = rows.groupBy(*by).agg(
        F.sum(SIDE).alias("_rows"), *[F.sum(p * F.col(SIDE)).alias(f"_sum{i}") for i, p in enumerate(parts)]
    )
    zero = F.col("_rows") == 0
    for i in range(len(parts)):
        zero = zero & (F.col(f"_sum{i}") == 0)
    return sums.where(~zero).select(*by)


def equal_tables(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> bool:
    """Whether both tables hold the same rows equally often; nulls are equal, columns of unlike types may not be."""
    rows = _sides(left, right, columns, [])
    return _unequal(rows, columns, ["_range"]).isEmpty()


def differing_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, ``left``, ``right``): rows whose values differ, as structs, null on the side that has no such key.

    Keys are unique on each side; null keys and null values are equal to each other. At most ``RANGES`` ranges are told
    to the tasks, finer ones as long as they are few; many differences are joined by coarse range.
    """
    keys, values = list(keys), list(values)
    rows, cells = _sides(left, right, keys, values), [*keys, *values]
    coarse = written(_unequal(rows, cells, ["_range"]))
    found = coarse.count()
    rows = rows.join(F.broadcast(coarse), "_range", "left_semi")
    if 0 < found <= RANGES // 8:
        fine = written(_unequal(rows, cells, ["_range", "_finer"]))
        if fine.count() <= BROADCAST_RANGES:
            rows = rows.join(F.broadcast(fine), ["_range", "_finer"], "left_semi")
    side = lambda sign, name: rows.where(F.col(SIDE) == sign).select(*keys, F.struct(*values).alias(name))
    a, b = side(1, "left"), side(-1, "right")
    named = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "right")
    meets = a[keys[0]].eqNullSafe(named[f"_r_{keys[0]}"])
    for k in keys[1:]:
        meets = meets & a[k].eqNullSafe(named[f"_r_{k}"])
    joined = a.join(named, meets, "full_outer")
    own = [F.when(F.col("left").isNull(), F.col(f"_r_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return joined.where(~F.col("left").eqNullSafe(F.col("right"))).select(*own, "left", "right")


def compare_tables(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = ()
) -> DataFrame:
    """The counts of `diff_tables` (compared, differing, left_only, right_only) per group of ``by``, which are key columns.

    Keys are unique on each side and null keys equal to each other.
    """
    by, none = list(by), F.lit(0).cast("long")
    counted = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_left"), *[none.alias(c) for c in ("differing", "left_only", "right_only")])
    found = differing_rows(left, right, keys, [value])
    one_sided = {"left_only": F.col("right").isNull(), "right_only": F.col("left").isNull()}
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    changes = found.groupBy(*by).agg(
        none.alias("_left"), F.count_if(both).alias("differing"), *[F.count_if(c).alias(n) for n, c in one_sided.items()]
    )
    names = ["differing", "left_only", "right_only"]
    total = counted.unionByName(changes).groupBy(*by).agg(F.sum("_left").alias("_left"), *[F.sum(n).alias(n) for n in names])
    return total.select(*by, (F.col("_left") - F.col("left_only")).alias("compared"), *names)
