"""Data-quality contracts. ``*_report`` returns the counts, ``check_*`` raises on a violation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.checksums import equal_tables


class ContractError(ValueError):
    """A table breaks a contract the next step relies on."""


def missing_report(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing cells over ``columns`` in one pass."""
    counts = [F.count_if(F.col(c).isNull()) for c in columns]
    return df.groupBy(*by).agg(sum(counts[1:], counts[0]).alias("missing"))


def check_no_missing(df: DataFrame, columns: Sequence[str]) -> None:
    missing = missing_report(df, columns).first()["missing"]
    if missing:
        raise ContractError(f"{missing} missing values in {list(columns)}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def assert_unique_keys(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    duplicate = duplicate_keys(df, keys).first()
    if duplicate is not None:
        raise ContractError(f"{what}: key {duplicate.asDict()} is not unique")


check_one_to_one = assert_unique_keys


def row_order_report(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """Positions at which the keys of two ordered tables differ, including positions on one side only."""
    a = left.select(order, F.struct(*keys).alias("_a"))
    b = right.select(order, F.struct(*keys).alias("_b"))
    return a.join(b, order, "full_outer").agg(
        F.count(F.lit(1)).alias("positions"),
        F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatches"),
    )


def check_row_order(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str = "pos") -> None:
    """Raise where the keys of two ordered tables differ at a position; equal tables exchange checksums only."""
    if equal_tables(left, right, [order, *keys]):
        return
    report = row_order_report(left, right, keys, order).first()
    if report["mismatches"]:
        raise ContractError(f"{report['mismatches']} of {report['positions']} rows out of order")


def _all_finite(features: str) -> Column:
    finite = F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(finite, F.lit(False))


def feature_shape_report(df: DataFrame, width: int, features: str = "features", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.coalesce(F.size(features) != width, F.lit(True))).alias("wrong_width"),
        F.count_if(~_all_finite(features)).alias("not_finite"),
    )


def check_feature_shape(df: DataFrame, width: int, rows: int | None = None, features: str = "features") -> None:
    report = feature_shape_report(df, width, features).first()
    if report["wrong_width"] or report["not_finite"] or (rows is not None and report["rows"] != rows):
        raise ContractError(f"invalid features (expected rows={rows}, width={width}): {report.asDict()}")


def check_finite_features(df: DataFrame, keys: Sequence[str], features: str = "features") -> None:
    bad = df.where(~_all_finite(features)).select(*keys).first()
    if bad is not None:
        raise ContractError(f"missing or infinite feature at {bad.asDict()}")


def count_report(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(target).isNull()).alias("nulls"),
        F.count_if(F.col(target) < 0).alias("negative"),
    )


def check_counts(df: DataFrame, target: str, rows: int) -> None:
    report = count_report(df, target).first()
    if report["rows"] != rows or report["nulls"] or report["negative"]:
        raise ContractError(f"expected {rows} non-negative values: {report.asDict()}")


def submission_report(template: DataFrame, predictions: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Template rows without a prediction and predictions without a template row."""
    a = template.select(*keys, F.lit(True).alias("_wanted"))
    b = predictions.select(*keys, F.col(target).alias("_value"), F.lit(True).alias("_given"))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("_wanted").isNotNull()).alias("wanted"),
        F.count_if(F.col("_wanted").isNotNull() & F.col("_value").isNull()).alias("uncovered"),
        F.count_if(F.col("_wanted").isNull()).alias("unexpected"),
    )


def check_submission(template: DataFrame, submission: DataFrame, keys: Sequence[str], target: str) -> None:
    """Full coverage in template order; both tables carry ``pos``."""
    report = submission_report(template, submission, keys, target).first()
    if report["uncovered"] or report["unexpected"]:
        raise ContractError(f"submission does not cover the template: {report.asDict()}")
    check_row_order(submission, template, keys)


def check_output_schema(df: DataFrame, columns: Sequence[str], target: str) -> None:
    """Exact column list, integer target, no nulls, nothing below zero."""
    if df.columns != list(columns):
        raise ContractError(f"columns {df.columns}, expected {list(columns)}")
    if not isinstance(df.schema[target].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ContractError(f"{target} is {df.schema[target].dataType.simpleString()}, expected an integer")
    report = count_report(df, target).first()
    if report["nulls"] or report["negative"]:
        raise ContractError(f"null or negative {target}: {report.asDict()}")
