"""Panels built from the star-schema tables, as Spark plans and as SQL.

Panels are aggregated from the raw table once and saved before rows are numbered or filled, so no plan
reads the raw table twice. Signals are logarithms of averages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.position import row_position
from panelcast.operators.storage import save_point
from panelcast.spec import PanelSpec

SIGNALS = ("qty", "price", "discount", "tax")

FLAG_SPEC = PanelSpec("entity", "time", "target", SIGNALS, ("entity", "year", "week"), "week", "week")
SUPPLIER_SPEC = FLAG_SPEC
REGION_SPEC = PanelSpec("entity", "time", "target", ("price", "balance"), ("entity", "time"), None, "day")
HOUR_SPEC = PanelSpec("entity", "hour", "target", ("value",), ("entity", "hour"), None, "hour")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _calendar(df: DataFrame) -> DataFrame:
    """ISO year and week of a Monday: (entity, year, week) stays unique across new year."""
    return df.withColumns(
        {
            "year": F.expr("extract(YEAROFWEEK FROM time)").cast("long"),
            "week": F.weekofyear("time").cast("long"),
        }
    )


def _weekly(spark: SparkSession, sf_dir: str, entity: str, signals: Sequence[str]) -> DataFrame:
    levels = {
        "qty": F.avg("l_quantity"),
        "price": F.avg("l_extendedprice"),
        "discount": F.avg("l_discount") + 0.01,
        "tax": F.avg("l_tax") + 0.01,
    }
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col(entity).alias("entity"), F.date_trunc("week", "l_shipdate").cast("date").alias("time")
    ).agg(F.count(F.lit(1)).alias("target"), *[F.log(levels[s]).alias(s) for s in signals])


def weekly_raw(
    spark: SparkSession, sf_dir: str, entity: str = "l_returnflag", signals: Sequence[str] = SIGNALS
) -> DataFrame:
    """The weekly panel before rows are numbered; only the columns of ``signals`` are read."""
    return _calendar(save_point(_weekly(spark, sf_dir, entity, signals)))


def flag_week(spark: SparkSession, sf_dir: str, signals: Sequence[str] = SIGNALS) -> DataFrame:
    return row_position(weekly_raw(spark, sf_dir, signals=signals), ["entity"], "time", "week")


def supplier_week(spark: SparkSession, sf_dir: str, signals: Sequence[str] = SIGNALS) -> DataFrame:
    return row_position(weekly_raw(spark, sf_dir, "l_suppkey", signals), ["entity"], "time", "week")


def region_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily orders per region on a complete calendar: days without orders are gaps in the signals."""
    orders = table(spark, sf_dir, "orders")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    located = customers.join(nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")),
                             F.col("c_nationkey") == F.col("n_nationkey"))
    daily = save_point(
        orders.select("o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("time"))
        .join(located.select("c_custkey", "c_acctbal", F.col("r_name").alias("entity")),
              F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("entity", "time")
        .agg(
            F.count(F.lit(1)).alias("target"),
            F.log(F.avg("o_totalprice")).alias("price"),
            F.log(F.avg("c_acctbal") + 1001.0).alias("balance"),
        )
    )
    span = daily.agg(F.struct(F.min("time").alias("lo"), F.max("time").alias("hi")).alias("s")).scalar()
    days = F.sequence(span["lo"], span["hi"])
    calendar = regions.select(
        F.col("r_name").alias("entity"),
        (F.datediff(span["hi"], span["lo"]) + 1).cast("long").alias("n"),
        F.posexplode(days).alias("seq", "time"),
    )
    return calendar.join(daily, ["entity", "time"], "left").select(
        "entity", "time", F.col("seq").cast("long").alias("seq"), "n",
        F.coalesce("target", F.lit(0)).cast("long").alias("target"), "price", "balance",
    )


def type_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hourly = events.groupBy(
        F.col("event_type").alias("entity"), F.date_trunc("hour", "ts").alias("hour")
    ).agg(F.count(F.lit(1)).alias("target"), F.log(F.avg(F.abs("value")) + 1.0).alias("value"))
    return row_position(save_point(hourly), ["entity"], "hour", "hour")


def _weekly_sql(entity: str, name: str) -> str:
    return f"""{name}_raw AS (
  SELECT {entity} AS entity, CAST(date_trunc('week', l_shipdate) AS DATE) AS time, COUNT(*) AS target,
         LN(AVG(l_quantity)) AS qty, LN(AVG(l_extendedprice)) AS price,
         LN(AVG(l_discount) + 0.01) AS discount, LN(AVG(l_tax) + 0.01) AS tax
  FROM lineitem GROUP BY 1, 2),
{name} AS (
  SELECT *, CAST(isoyear(time) AS BIGINT) AS year, CAST(weekofyear(time) AS BIGINT) AS week,
         ROW_NUMBER() OVER (PARTITION BY entity ORDER BY time) - 1 AS seq,
         COUNT(*) OVER (PARTITION BY entity) AS n
  FROM {name}_raw)"""


FLAG_SQL = "WITH " + _weekly_sql("l_returnflag", "flag_week")
SUPPLIER_SQL = "WITH " + _weekly_sql("l_suppkey", "supplier_week")
REGION_SQL = """WITH daily AS (
  SELECT r_name AS entity, CAST(o_orderdate AS DATE) AS time, COUNT(*) AS target,
         LN(AVG(o_totalprice)) AS price, LN(AVG(c_acctbal) + 1001.0) AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
span AS (SELECT MIN(time) AS lo, MAX(time) AS hi FROM daily),
calendar AS (
  SELECT r_name AS entity, CAST(UNNEST(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS time FROM region, span),
region_day AS (
  SELECT entity, time, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY time) - 1 AS seq,
         COUNT(*) OVER (PARTITION BY entity) AS n, COALESCE(target, 0) AS target, price, balance
  FROM calendar LEFT JOIN daily USING (entity, time))"""
HOUR_SQL = """WITH hourly AS (
  SELECT event_type AS entity, date_trunc('hour', ts) AS hour, COUNT(*) AS target,
         LN(AVG(ABS(value)) + 1.0) AS value
  FROM events GROUP BY 1, 2),
type_hour AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY hour) - 1 AS seq,
         COUNT(*) OVER (PARTITION BY entity) AS n FROM hourly)"""
