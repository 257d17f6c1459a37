"""CSV sources and the submission sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.relational import floating_nan_to_null
from panelcast.sources.single_file import write_one_csv
from panelcast.spec import CLIMATE_PANEL, VEGETATION_SIGNALS, PanelSpec

POS = "pos"


def climate_schema(
    spec: PanelSpec = CLIMATE_PANEL, vegetation: Sequence[str] = VEGETATION_SIGNALS
) -> T.StructType:
    """Feature-file layout: keys, date as text, vegetation indices, weather signals."""
    fields = [
        T.StructField("city", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("weekofyear", T.IntegerType()),
        T.StructField(spec.time, T.StringType()),
    ]
    fields += [T.StructField(c, T.DoubleType()) for c in (*vegetation, *spec.signals)]
    return T.StructType(fields)


def label_schema(spec: PanelSpec = CLIMATE_PANEL) -> T.StructType:
    return T.StructType(
        [
            T.StructField("city", T.StringType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("weekofyear", T.IntegerType()),
            T.StructField(spec.target, T.LongType()),
        ]
    )


def _read(spark: SparkSession, path: str, schema: T.StructType, positions: bool = False) -> DataFrame:
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return _positioned(rows) if positions else rows


def _positioned(rows: DataFrame) -> DataFrame:
    """Add ``pos``, the 0-based place of a row in its file (files in name order).

    Every file split numbers its own rows and a table with one row per split supplies the starting
    points, so the file may be large and is never gathered in one task.
    """
    placed = rows.select("*", "_metadata.file_path", "_metadata.file_block_start").withColumn(
        "_id", F.monotonically_increasing_id()
    )
    split = ["file_path", "file_block_start"]
    sizes = placed.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row per file split.
    earlier = Window.partitionBy(F.lit(0)).orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *split, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return placed.join(starts, split).withColumn(POS, F.col("_id") + F.col("_shift")).select(*rows.columns, POS)


def parse_date(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_date(column))


def read_features(
    spark: SparkSession, path: str, schema: T.StructType, time: str, positions: bool = False
) -> DataFrame:
    """Feature rows; NaN becomes NULL so that aggregates skip it. ``positions`` adds the file order."""
    return parse_date(floating_nan_to_null(_read(spark, path, schema, positions)), time)


def read_labels(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return _read(spark, path, schema)


def read_template(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with their place in the file, which is the order the output must have."""
    return _read(spark, path, schema, positions=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).csv(path)


def write_submission(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Write ``columns`` in ``pos`` order as one file with a header, which appears only once it is complete."""
    write_one_csv(df.orderBy(POS).select(*columns), path)


def read_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A written submission with the order it has on disk."""
    return read_template(spark, path, schema)
