"""Projection helpers, keyed joins and table comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions.scalar import nan_to_null
from panelcast.operators.position import SEQ


def filter_entity(df: DataFrame, entity: str, value) -> DataFrame:
    return df.where(F.col(entity) == value)


def project_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop a target before feature building, or identifiers from a design matrix; all must exist."""
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*names)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def floating_nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name: nan_to_null(f.name) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(floats) if floats else df


def missing_predicate(columns: Sequence[str]) -> Column:
    """True where any of ``columns`` is missing."""
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNull()
    return test


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that raises on a key that is not unique on both sides.

    Rows are numbered within their key on the shuffle that the join needs anyway, so each side is read
    once. Null keys never match and are not compared.
    """
    keys = list(keys)

    def numbered(df: DataFrame, side: str) -> DataFrame:
        own = Window.partitionBy(*keys).orderBy(F.lit(0))
        named = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        message = F.concat_ws(" ", F.lit(f"{side} side: key is not unique:"), *[F.col(k).cast("string") for k in keys])
        copy = F.row_number().over(own)
        return df.withColumn(f"_{side}_copy", F.when(named & (copy > 1), F.raise_error(message).cast("int")).otherwise(F.lit(1)))

    joined = numbered(left, "left").join(numbered(right, "right"), keys, how)
    # Reads both marks, or they would be pruned with the check in them.
    checked = joined.where(F.coalesce(F.col("_left_copy"), F.lit(1)) + F.coalesce(F.col("_right_copy"), F.lit(1)) > 0)
    return checked.drop("_left_copy", "_right_copy")


def attach_predictions(
    keyed: DataFrame, predictions: DataFrame, entity: str, lead_rows: int, offset: int
) -> DataFrame:
    """Give row ``seq`` of each series the prediction whose history ends ``offset`` rows earlier.

    ``predictions`` carries (entity, pos) with ``pos`` counted from the start of the lead-in.
    """
    aligned = predictions.withColumn(SEQ, F.col("pos") - lead_rows + offset).drop("pos")
    return keyed.join(aligned, [entity, SEQ])


def diff_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows compared, rows whose value differs, and rows present on one side only."""
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, list(keys), "full_outer")
    in_both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return both.groupBy(*by).agg(
        F.count_if(in_both).alias("compared"),
        F.count_if(in_both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing"),
        F.count_if(F.col("_in_b").isNull()).alias("left_only"),
        F.count_if(F.col("_in_a").isNull()).alias("right_only"),
    )
