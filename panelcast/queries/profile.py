"""Queries: profiling tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import profile as P
from panelcast.queries.panels import (
    FLAG_SQL,
    HOUR_SQL,
    REGION_SQL,
    SIGNALS,
    SUPPLIER_SQL,
    flag_week,
    region_day,
    table,
    type_hour,
    weekly_raw,
)
from panelcast.queries.registry import query, rounded, sql6


@query(
    "count_missing",
    f"{REGION_SQL} SELECT COUNT(*) FILTER (WHERE price IS NULL) + COUNT(*) FILTER (WHERE balance IS NULL) AS missing FROM region_day",
)
def count_missing(spark, d):
    from panelcast.operators.contracts import missing_report

    return missing_report(region_day(spark, d), ["price", "balance"])


@query("count_rows_entity", "SELECT l_returnflag, COUNT(*) AS rows FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def count_rows_entity(spark, d):
    return P.count_rows_entity(table(spark, d, "lineitem"), "l_returnflag")


@query(
    "dataset_overview",
    f"{SUPPLIER_SQL} SELECT entity, COUNT(*) AS rows, MIN(time) AS first_time, MAX(time) AS last_time, "
    f"{sql6('AVG(target)', 'mean')}, MAX(target) AS max, {sql6('MEDIAN(target)', 'median')} FROM supplier_week GROUP BY 1",
)
def dataset_overview(spark, d):
    out = P.dataset_overview(weekly_raw(spark, d, "l_suppkey", signals=[]), "entity", "time", "target")
    return rounded(out, "entity", "rows", "first_time", "last_time", "max", mean="mean", median="median")


@query(
    "dataset_overview_lines",
    "SELECT l_returnflag, COUNT(*) AS rows, CAST(MIN(l_shipdate) AS DATE) AS first_time, CAST(MAX(l_shipdate) AS DATE) AS last_time, "
    + "ROUND(AVG(l_extendedprice) / 1000, 4) + 0.0 AS mean, MAX(l_extendedprice) AS max, "
    + "ROUND(MEDIAN(l_extendedprice), 3) + 0.0 AS median FROM lineitem GROUP BY 1",
)
def dataset_overview_lines(spark, d):
    """The same table over raw rows, where one group holds about half of them."""
    lines = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    out = P.dataset_overview(lines, "l_returnflag", "day", "l_extendedprice")
    return out.withColumns({"mean": F.round(F.col("mean") / 1000, 4), "median": F.round("median", 3)})


@query(
    "missing_share",
    f"{REGION_SQL}, s AS (SELECT entity, AVG(CAST(price IS NULL AS DOUBLE)) AS price, AVG(CAST(balance IS NULL AS DOUBLE)) AS balance, "
    "0.0 AS target FROM region_day GROUP BY 1) "
    f"SELECT entity, variable, {sql6('CAST(share AS DOUBLE)', 'share')} FROM s UNPIVOT (share FOR variable IN (price, balance)) WHERE share >= 0.01",
)
def missing_share(spark, d):
    out = P.missing_share(region_day(spark, d), "entity", ["price", "balance", "target"])
    return rounded(out, "entity", "variable", share="share")


@query(
    "seasonal_profile",
    f"{SUPPLIER_SQL} SELECT entity, week, COUNT(*) AS rows, {sql6('AVG(target)', 'mean')}, {sql6('QUANTILE_CONT(target, 0.25)', 'q25')}, "
    f"{sql6('MEDIAN(target)', 'median')}, {sql6('QUANTILE_CONT(target, 0.75)', 'q75')} FROM supplier_week GROUP BY 1, 2",
)
def seasonal_profile(spark, d):
    out = P.seasonal_profile(weekly_raw(spark, d, "l_suppkey", signals=[]), "entity", "week", "target")
    return rounded(out, "entity", "week", "rows", mean="mean", q25="q25", median="median", q75="q75")


@query(
    "target_distribution",
    f"{FLAG_SQL}, m AS (SELECT entity, MEDIAN(target) AS median FROM flag_week GROUP BY 1) "
    f"SELECT entity, CAST(FLOOR(target / 5.0) * 5 AS BIGINT) AS bin, COUNT(*) AS rows, {sql6('ANY_VALUE(median)', 'median')} "
    "FROM flag_week JOIN m USING (entity) GROUP BY 1, 2",
)
def target_distribution(spark, d):
    return rounded(P.target_distribution(weekly_raw(spark, d, signals=[]), "entity", "target", 5), "entity", "bin", "rows", median="median")


def _lag_join(panel: str, x: str, first: int, last: int) -> str:
    return (
        f"SELECT a.entity, CAST(k AS BIGINT) AS lag, CORR(b.{x}, a.target) AS c FROM {panel} a, generate_series({first}, {last}) g(k), {panel} b "
        "WHERE b.entity = a.entity AND b.seq = a.seq - k GROUP BY 1, 2"
    )


@query(
    "autocorrelation",
    f"{HOUR_SQL} SELECT entity, lag, {sql6('c', 'corr')} FROM ({_lag_join('type_hour', 'target', 1, 20)})",
)
def autocorrelation(spark, d):
    return rounded(P.autocorrelation(type_hour(spark, d), "entity", "seq", "target", 20), "entity", "lag", corr="corr")


@query(
    "lag_correlation",
    f"{FLAG_SQL} " + " UNION ALL ".join(
        f"SELECT entity, '{s}' AS variable, lag, {sql6('c', 'corr')} FROM ({_lag_join('flag_week', s, 0, 20)})" for s in SIGNALS
    ),
)
def lag_correlation(spark, d):
    out = P.lag_correlation(flag_week(spark, d), "entity", "seq", "target", SIGNALS, 20)
    return rounded(out, "entity", "variable", "lag", corr="corr")
