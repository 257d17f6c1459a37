"""Queries: sources and sinks, projections, joins, concatenation, contracts, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.functions import scalar as S
from panelcast.operators import contracts as C
from panelcast.operators import relational as R
from panelcast.operators.blocks import with_history
from panelcast.operators.checksums import compare_tables as compare_by_checksum
from panelcast.operators.history import (
    history_complete,
    lead_in_circular,
    lead_in_previous,
    multiscale_features,
    multiscale_names,
    trailing_mean,
)
from panelcast.operators.position import SEQ, LENGTH, concat_fold, holdout_split
from panelcast.operators.scale import apply_params, fit_minmax, fit_zscore
from panelcast.operators.storage import save_point, scratch_path
from panelcast.queries.panels import (
    FLAG_SQL,
    REGION_SQL,
    SIGNALS,
    SUPPLIER_SQL,
    flag_week,
    region_day,
    supplier_week,
    table,
    weekly_raw,
)
from panelcast.queries.registry import query, r6, rounded, sql6
from panelcast.sources import csv as io

KEYS = ["entity", "year", "week"]
SIGNALS6 = {s: s for s in SIGNALS}
SIGNALS_SQL = ", ".join(sql6(s, s) for s in SIGNALS)

FEATURE_FILE = T.StructType(
    [T.StructField("entity", T.StringType()), T.StructField("year", T.LongType()),
     T.StructField("week", T.LongType()), T.StructField("time", T.StringType())]
    + [T.StructField(s, T.DoubleType()) for s in SIGNALS]
)
LABEL_FILE = T.StructType(
    [T.StructField("entity", T.StringType()), T.StructField("year", T.LongType()),
     T.StructField("week", T.LongType()), T.StructField("target", T.LongType())]
)


def split_at(df: DataFrame, horizon: int = 52) -> tuple[DataFrame, DataFrame]:
    """Train and test tables of the last ``horizon`` rows, each with its own positions."""
    train, test = holdout_split(df, horizon)
    return (
        train.withColumn(LENGTH, F.col(LENGTH) - horizon),
        test.withColumns({SEQ: F.col(SEQ) - F.col(LENGTH) + horizon, LENGTH: F.lit(horizon).cast("long")}),
    )


# --- sources and sinks ------------------------------------------------------------------------------


@query("read_features", f"{FLAG_SQL} SELECT entity, year, week, time, {SIGNALS_SQL} FROM flag_week")
def read_features(spark, d):
    path = scratch_path(spark, "features")
    io.write_csv(weekly_raw(spark, d).select(*KEYS, "time", *SIGNALS), path)
    return rounded(io.read_features(spark, path, FEATURE_FILE, "time"), *KEYS, "time", **SIGNALS6)


@query("read_labels", f"{FLAG_SQL} SELECT entity, year, week, target FROM flag_week")
def read_labels(spark, d):
    path = scratch_path(spark, "labels")
    io.write_csv(weekly_raw(spark, d, signals=[]).select(*KEYS, "target"), path)
    return io.read_labels(spark, path, LABEL_FILE)


@query(
    "read_template",
    f"{SUPPLIER_SQL} SELECT CAST(entity AS VARCHAR) AS entity, year, week, target, "
    "ROW_NUMBER() OVER (ORDER BY entity, time) - 1 AS pos FROM supplier_week",
)
def read_template(spark, d):
    path = scratch_path(spark, "template")
    ordered = weekly_raw(spark, d, "l_suppkey", signals=[]).orderBy("entity", "time")
    io.write_csv(ordered.select(*KEYS, "target"), path)
    return io.read_template(spark, path, LABEL_FILE)


@query("parse_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def parse_date(spark, d):
    text = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return io.parse_date(text, "day")


def _submission(spark, d) -> DataFrame:
    """Rounded trailing means as predictions, in a template order that is not time order."""
    mean = with_history(flag_week(spark, d, signals=[]), ["entity"], SEQ,
                        lambda w: {"p": trailing_mean("target", 4, w)}, back=3)
    return mean.select(*KEYS, S.round_nearest_nonneg("p").alias("target"), (F.col("n") - 1 - F.col("seq")).alias("back"))


SUBMISSION_SQL = FLAG_SQL + """, submission AS (
  SELECT entity, year, week, n - 1 - seq AS back,
         CAST(FLOOR(AVG(target) OVER (PARTITION BY entity ORDER BY seq ROWS 3 PRECEDING) + 0.5) AS BIGINT) AS target
  FROM flag_week),
written AS (SELECT entity, year, week, target,
         RANK() OVER (ORDER BY back, entity) - 1 AS pos FROM submission)"""


def _written(spark, d) -> DataFrame:
    """Template order: latest week of every entity first."""
    scratch, path = scratch_path(spark, "order"), scratch_path(spark, "submission")
    io.write_csv(_submission(spark, d).orderBy("back", "entity").select(*KEYS, "target"), scratch)
    io.write_submission(io.read_template(spark, scratch, LABEL_FILE), path, [*KEYS, "target"])
    return io.read_back(spark, path, LABEL_FILE)


@query("write_submission", f"{SUBMISSION_SQL} SELECT entity, year, week, target FROM written")
def write_submission(spark, d):
    return _written(spark, d).drop("pos")


@query("read_back", f"{SUBMISSION_SQL} SELECT entity, year, week, target, pos FROM written")
def read_back(spark, d):
    return _written(spark, d)


# --- projections and predicates ---------------------------------------------------------------------


@query("filter_entity", f"{FLAG_SQL} SELECT entity, time, target FROM flag_week WHERE entity = 'R'")
def filter_entity(spark, d):
    return R.filter_entity(weekly_raw(spark, d, signals=[]), "entity", "R").select("entity", "time", "target")


@query("project_keys", f"{SUPPLIER_SQL} SELECT entity, year, week FROM supplier_week")
def project_keys(spark, d):
    return R.project_keys(weekly_raw(spark, d, "l_suppkey", signals=[]), KEYS)


@query("drop_target", f"{FLAG_SQL} SELECT entity, time, year, week, seq, n, {SIGNALS_SQL} FROM flag_week")
def drop_target(spark, d):
    kept = R.drop_columns(flag_week(spark, d), "target")
    return rounded(kept, "entity", "time", "year", "week", "seq", "n", **SIGNALS6)


@query(
    "drop_identifiers",
    f"{SUPPLIER_SQL} SELECT week, {SIGNALS_SQL} FROM supplier_week",
)
def drop_identifiers(spark, d):
    design = R.drop_columns(weekly_raw(spark, d, "l_suppkey"), "entity", "time", "target", "year")
    return rounded(design, "week", **SIGNALS6)


@query(
    "numeric_columns",
    "SELECT SUM(l_orderkey)::BIGINT AS l_orderkey, SUM(l_partkey)::BIGINT AS l_partkey, "
    "SUM(l_suppkey)::BIGINT AS l_suppkey, SUM(l_linenumber)::BIGINT AS l_linenumber, "
    "SUM(CAST(l_quantity AS BIGINT))::BIGINT AS l_quantity, SUM(CAST(FLOOR(l_extendedprice) AS BIGINT))::BIGINT AS l_extendedprice, "
    "SUM(CAST(ROUND(l_discount * 100) AS BIGINT))::BIGINT AS l_discount, SUM(CAST(ROUND(l_tax * 100) AS BIGINT))::BIGINT AS l_tax FROM lineitem",
)
def numeric_columns(spark, d):
    """Totals of every numeric column, whatever the table holds; shares in per cent."""
    lines = table(spark, d, "lineitem")
    scale = {"l_discount": 100, "l_tax": 100}
    whole = {c: F.round(F.col(c) * scale[c]) if c in scale else F.floor(c) for c in R.numeric_columns(lines)}
    return lines.agg(*[F.sum(x.cast("long")).alias(c) for c, x in whole.items()])


@query("with_column", f"{FLAG_SQL} SELECT entity, time, target * 2 AS target, {sql6('LN(1 + target)', 'z')} FROM flag_week")
def with_column(spark, d):
    changed = weekly_raw(spark, d, signals=[]).withColumns({"z": S.log1p_target("target"), "target": F.col("target") * 2})
    return rounded(changed, "entity", "time", "target", z="z")


@query("missing_predicate", f"{REGION_SQL} SELECT entity, time FROM region_day WHERE price IS NULL OR balance IS NULL")
def missing_predicate(spark, d):
    return region_day(spark, d).where(R.missing_predicate(["price", "balance"])).select("entity", "time")


@query(
    "negative_predicate",
    "SELECT c_mktsegment, COUNT(*) AS rows, COUNT(*) FILTER (WHERE c_acctbal IS NULL) AS nulls, "
    "COUNT(*) FILTER (WHERE c_acctbal < 0) AS negative, BOOL_OR(c_acctbal < 0) AS any_negative "
    "FROM customer GROUP BY 1",
)
def negative_predicate(spark, d):
    report = C.count_report(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"])
    return report.withColumn("any_negative", F.col("negative") > 0)


# --- joins ------------------------------------------------------------------------------------------


@query(
    "join_labels",
    f"{SUPPLIER_SQL} SELECT entity, year, week, target, {SIGNALS_SQL} FROM supplier_week WHERE week % 3 <> 0 AND week % 2 = 0",
)
def join_labels(spark, d):
    """Both sides hold rows the other lacks: an inner join keeps neither."""
    panel = weekly_raw(spark, d, "l_suppkey")
    features, labels = panel.where("week % 3 <> 0"), panel.where("week % 2 = 0")
    joined = R.join_one_to_one(features.select(*KEYS, *SIGNALS), labels.select(*KEYS, "target"), KEYS)
    return rounded(joined, *KEYS, "target", **SIGNALS6)


@query(
    "join_template",
    f"{FLAG_SQL} SELECT entity, time, ROW_NUMBER() OVER (ORDER BY time, entity) - 1 AS pos, "
    "CASE WHEN seq >= n - 52 THEN target END AS target FROM flag_week",
)
def join_template(spark, d):
    panel = save_point(flag_week(spark, d, signals=[]))
    path = scratch_path(spark, "template")
    io.write_csv(panel.orderBy("time", "entity").select("entity", "time"), path)
    layout = T.StructType([T.StructField("entity", T.StringType()), T.StructField("time", T.DateType())])
    template = io.read_template(spark, path, layout)
    known = holdout_split(panel)[1].select("entity", "time", "target")
    return R.join_one_to_one(template, known, ["entity", "time"], "left")


CIRCULAR_SQL = """, circular AS (
  SELECT *, seq + 53 AS pos FROM {t} UNION ALL
  SELECT *, seq - n + 53 AS pos FROM {t} WHERE seq >= n - 53)"""


@query(
    "align_target",
    SUPPLIER_SQL + CIRCULAR_SQL.format(t="supplier_week")
    + " SELECT entity, pos - 51 AS example, target FROM circular WHERE pos >= 51 AND pos < n + 51",
)
def align_target(spark, d):
    rows = history_complete(lead_in_circular(supplier_week(spark, d, signals=[]), 53, 2))
    return rows.select("entity", (F.col("pos") - 51).alias("example"), "target")


PREVIOUS_SQL = """, test AS (SELECT *, seq - n + 52 AS i FROM {t} WHERE seq >= n - 52),
previous AS (
  SELECT entity, i + 53 AS pos, qty, 'test' AS part, seq FROM test UNION ALL
  SELECT entity, seq - (n - 52) + 53 AS pos, qty, 'train' AS part, seq
  FROM {t} WHERE seq < n - 52 AND seq >= n - 52 - 53)"""


@query(
    "attach_predictions",
    SUPPLIER_SQL + PREVIOUS_SQL.format(t="supplier_week")
    + f""", ends AS (SELECT entity, pos, AVG(qty) OVER (PARTITION BY entity ORDER BY pos ROWS 51 PRECEDING) AS m FROM previous)
SELECT t.entity, t.year, t.week, {sql6('m', 'prediction')}
FROM test t JOIN ends e ON t.entity = e.entity AND t.i = e.pos - 51""",
)
def attach_predictions(spark, d):
    train, test = split_at(save_point(supplier_week(spark, d, signals=["qty"])))
    context = lead_in_previous(train, test, ["entity"], 53, 2)
    scored = with_history(context, ["entity"], "pos", lambda w: {"prediction": trailing_mean("qty", 52, w)}, back=51)
    scored = history_complete(scored).select("entity", "pos", "prediction")
    attached = R.attach_predictions(test.select(*KEYS, SEQ), scored, "entity", 53, 2)
    return rounded(attached, *KEYS, prediction="prediction")


SCALED_SQL = FLAG_SQL + """, ref AS (
  SELECT qty, week FROM flag_week WHERE entity = 'N' UNION ALL
  SELECT qty, week FROM flag_week WHERE entity = 'N' AND seq >= n - 53),
params AS (SELECT AVG(qty) AS m, STDDEV_POP(qty) AS s, MIN(week) AS lo, MAX(week) AS hi FROM ref)"""


def _scaled(spark, d) -> DataFrame:
    panel = flag_week(spark, d, signals=["qty"])
    source = R.filter_entity(panel, "entity", "N")
    scaled = apply_params(panel, fit_zscore(source, ["qty"], weight_tail=53), columns=["qty"])
    return apply_params(scaled, fit_minmax(source, "week"), minmax_columns=["week"])


@query(
    "apply_params",
    f"{SCALED_SQL} SELECT entity, time, {sql6('(qty - m) / GREATEST(s, 1e-12)', 'qty')}, "
    f"{sql6('(week - lo) / GREATEST(hi - lo, 1.0)', 'week')} FROM flag_week, params",
)
def apply_shared(spark, d):
    return rounded(_scaled(spark, d), "entity", "time", qty="qty", week="week")


DIFF_SQL = f"""{SUPPLIER_SQL}, p AS (SELECT *, AVG(target) OVER (PARTITION BY entity ORDER BY seq ROWS 3 PRECEDING) AS m
  FROM supplier_week)
SELECT entity, COUNT(*) FILTER (WHERE seq >= 4) AS compared,
  COUNT(*) FILTER (WHERE seq >= 4 AND FLOOR(m + 0.5) <> FLOOR(m)) AS differing,
  COUNT(*) FILTER (WHERE seq < 4) AS left_only, CAST(0 AS BIGINT) AS right_only FROM p GROUP BY 1"""


def rounded_and_cut(spark, d) -> tuple[DataFrame, DataFrame]:
    """Means rounded to the nearest count, and the later ones cut to whole counts."""
    mean = save_point(with_history(supplier_week(spark, d, signals=[]), ["entity"], SEQ,
                                   lambda w: {"m": trailing_mean("target", 4, w)}, back=3))
    nearest = mean.select(*KEYS, S.round_nearest_nonneg("m").alias("v"))
    cut = mean.where("seq >= 4").select(*KEYS, S.truncate_nonneg("m").alias("v"))
    return nearest, cut


@query("diff_tables", DIFF_SQL)
def diff_tables(spark, d):
    return R.diff_tables(*rounded_and_cut(spark, d), KEYS, "v", ["entity"])


@query("compare_tables", DIFF_SQL)
def compare_tables(spark, d):
    """The same counts by checksums: only rows of ranges that differ are joined."""
    return compare_by_checksum(*rounded_and_cut(spark, d), KEYS, "v", ["entity"])


# --- lead-ins and concatenation ---------------------------------------------------------------------


@query(
    "lead_in_circular",
    SUPPLIER_SQL + CIRCULAR_SQL.format(t="supplier_week") + f" SELECT entity, pos, time, {sql6('qty', 'qty')} FROM circular",
)
def circular(spark, d):
    return rounded(lead_in_circular(supplier_week(spark, d, signals=["qty"]), 53, 2), "entity", "pos", "time", qty="qty")


@query(
    "lead_in_previous",
    SUPPLIER_SQL + PREVIOUS_SQL.format(t="supplier_week") + f" SELECT entity, pos, {sql6('qty', 'qty')} FROM previous",
)
def previous(spark, d):
    train, test = split_at(save_point(supplier_week(spark, d, signals=["qty"])))
    return rounded(lead_in_previous(train, test, ["entity"], 53, 2), "entity", "pos", qty="qty")


@query(
    "concat_entities",
    "SELECT l_returnflag AS part, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N') "
    "UNION ALL SELECT 'rest', l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')",
)
def concat_entities(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("part"), "l_orderkey", "l_linenumber")
    first = R.filter_entity(lines, "part", "A").unionByName(R.filter_entity(lines, "part", "N"))
    return first.unionByName(lines.where(~F.col("part").isin("A", "N")).withColumn("part", F.lit("rest")))


@query(
    "concat_fold",
    FLAG_SQL + ", ref AS (SELECT MAX(n) AS rn FROM flag_week WHERE entity = 'N') "
    "SELECT entity, time, target FROM flag_week, ref WHERE (entity = 'N' AND seq < n - 52) "
    "OR (entity <> 'N' AND seq < GREATEST(53, FLOOR(n * (rn - 52) / rn)))",
)
def fold_rows(spark, d):
    return concat_fold(flag_week(spark, d, signals=[]), "entity", "N").select("entity", "time", "target")


# --- contracts --------------------------------------------------------------------------------------


@query(
    "check_row_order",
    f"{FLAG_SQL}, a AS (SELECT entity, time, ROW_NUMBER() OVER (ORDER BY time, entity) AS pos FROM flag_week), "
    "b AS (SELECT entity, time, ROW_NUMBER() OVER (ORDER BY time, entity DESC) AS pos FROM flag_week) "
    "SELECT COUNT(*) AS positions, COUNT(*) FILTER (WHERE (a.entity, a.time) IS DISTINCT FROM (b.entity, b.time)) AS mismatches "
    "FROM a FULL JOIN b ON a.pos = b.pos",
)
def check_row_order(spark, d):
    panel = weekly_raw(spark, d, signals=[]).select("entity", "time")
    layout = T.StructType([T.StructField("entity", T.StringType()), T.StructField("time", T.DateType())])
    sides = []
    for order in (["time", "entity"], ["time", F.desc("entity")]):
        path = scratch_path(spark, "order")
        io.write_csv(panel.orderBy(*order), path)
        sides.append(io.read_template(spark, path, layout))
    return C.row_order_report(*sides, ["entity", "time"])


@query(
    "check_no_missing",
    f"{REGION_SQL} SELECT entity, COUNT(*) FILTER (WHERE price IS NULL) + COUNT(*) FILTER (WHERE balance IS NULL) AS missing "
    "FROM region_day GROUP BY 1",
)
def check_no_missing(spark, d):
    return C.missing_report(region_day(spark, d), ["price", "balance"], ["entity"])


@query(
    "check_one_to_one",
    "SELECT l_orderkey, l_suppkey, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
def check_one_to_one(spark, d):
    return C.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(
    "check_feature_shape",
    f"{SUPPLIER_SQL} SELECT entity, COUNT(*) AS rows, COUNT(*) FILTER (WHERE (seq + 2) % n % 5 = 0) AS wrong_width, "
    "COUNT(*) FILTER (WHERE (seq + 2) % n % 7 = 0 AND (seq + 2) % n % 5 <> 0) AS not_finite FROM supplier_week GROUP BY 1",
)
def check_feature_shape(spark, d):
    """Vectors are spoilt on purpose: every fifth is cut, every seventh of the others holds an infinity."""
    rows = lead_in_circular(supplier_week(spark, d), 53, 2)
    features = multiscale_features(rows, ["entity"], SIGNALS, "week", keep=["entity", "pos"])
    nth = F.col("pos") - 51
    width = len(multiscale_names(SIGNALS))
    endless = F.concat(F.slice("features", 1, width - 1), F.array(F.lit(float("inf")).cast("float")))
    spoilt = F.when(nth % 5 == 0, F.slice("features", 1, 3)).when(nth % 7 == 0, endless).otherwise(F.col("features"))
    features = features.withColumn("features", spoilt)
    return C.feature_shape_report(features, len(multiscale_names(SIGNALS)), by=["entity"])


@query(
    "check_submission",
    f"{SUPPLIER_SQL} SELECT COUNT(*) AS wanted, COUNT(*) FILTER (WHERE seq < n - 52) AS uncovered, "
    "CAST(0 AS BIGINT) AS unexpected FROM supplier_week",
)
def check_submission(spark, d):
    panel = save_point(supplier_week(spark, d, signals=[]))
    return C.submission_report(panel, holdout_split(panel)[1], KEYS, "target")


@query(
    "check_counts",
    f"{SUPPLIER_SQL} SELECT entity, COUNT(*) AS rows, CAST(0 AS BIGINT) AS nulls, "
    "COUNT(*) FILTER (WHERE target - 2 < 0) AS negative FROM supplier_week GROUP BY 1",
)
def check_counts(spark, d):
    return C.count_report(weekly_raw(spark, d, "l_suppkey", signals=[]).withColumn("target", F.col("target") - 2), "target", ["entity"])


@query("check_output_schema", f"{SUBMISSION_SQL} SELECT entity, year, week, target FROM submission")
def check_output_schema(spark, d):
    """Raises when the table breaks the layout; otherwise the table itself."""
    out = save_point(_submission(spark, d).select(*KEYS, "target"))
    C.check_output_schema(out, [*KEYS, "target"], "target")
    return out


# --- scalar functions -------------------------------------------------------------------------------


@query(
    "zscore",
    "WITH p AS (SELECT AVG(l_extendedprice) AS m, STDDEV_POP(l_extendedprice) AS s FROM lineitem) "
    f"SELECT l_orderkey, l_linenumber, {sql6('(l_extendedprice - m) / GREATEST(s, 1e-12)', 'z')} FROM lineitem, p",
)
def zscore(spark, d):
    lines = table(spark, d, "lineitem")
    scaled = apply_params(lines, fit_zscore(lines, ["l_extendedprice"]), columns=["l_extendedprice"])
    return rounded(scaled, "l_orderkey", "l_linenumber", z="l_extendedprice")


@query(
    "minmax",
    "WITH p AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem) "
    f"SELECT l_orderkey, l_linenumber, {sql6('(l_extendedprice - lo) / GREATEST(hi - lo, 1.0)', 'z')} FROM lineitem, p",
)
def minmax(spark, d):
    lines = table(spark, d, "lineitem")
    scaled = apply_params(lines, fit_minmax(lines, "l_extendedprice"), minmax_columns=["l_extendedprice"])
    return rounded(scaled, "l_orderkey", "l_linenumber", z="l_extendedprice")


def fourier_sql(harmonics: int, week: str = "week") -> str:
    phase = f"2 * PI() * ({week} - 1) / 52.0"
    return ", ".join(
        sql6(f"{f.upper()}({phase} * {k})", f"{f}_{k}") for k in range(1, harmonics + 1) for f in ("sin", "cos")
    )


@query("season_terms", f"{SUPPLIER_SQL} SELECT entity, time, {fourier_sql(2)} FROM supplier_week")
def season_terms(spark, d):
    return rounded(weekly_raw(spark, d, "l_suppkey", signals=[]), "entity", "time", **S.season_terms("week"))


@query("fourier_terms", f"{SUPPLIER_SQL} SELECT entity, time, {fourier_sql(4)} FROM supplier_week")
def fourier_terms(spark, d):
    return rounded(weekly_raw(spark, d, "l_suppkey", signals=[]), "entity", "time", **S.fourier_terms("week", 4))


@query("round_nearest_nonneg", "SELECT c_custkey, CAST(FLOOR(GREATEST(c_acctbal, 0) + 0.5) AS BIGINT) AS v FROM customer")
def round_nearest(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.round_nearest_nonneg("c_acctbal").alias("v"))


@query("truncate_nonneg", "SELECT c_custkey, CAST(FLOOR(GREATEST(c_acctbal, 0)) AS BIGINT) AS v FROM customer")
def truncate(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.truncate_nonneg("c_acctbal").alias("v"))


@query("to_float32", "SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS v FROM orders")
def to_float32(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.to_float32("o_totalprice").cast("double").alias("v"))


@query(
    "is_finite",
    "SELECT l_returnflag, COUNT(*) AS rows, "
    "COUNT(*) FILTER (WHERE l_discount > 0) AS finite FROM lineitem GROUP BY 1",
)
def is_finite(spark, d):
    """Price per unit of discount: division by a zero discount is infinite or missing."""
    lines = table(spark, d, "lineitem").withColumn(
        "ratio", F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount"))
        .when(F.col("l_linenumber") % 3 == 0, F.lit(float("inf")))
        .when(F.col("l_linenumber") % 3 == 1, F.lit(float("nan")))
    )
    return lines.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(S.is_finite("ratio")).alias("finite")
    )


SELU_SQL = (
    "1.0507009873554805 * CASE WHEN {x} > 0 THEN {x} "
    "ELSE 1.6732632423543772 * (EXP(GREATEST({x}, -30.0)) - 1) END"
)


@query("selu", f"SELECT c_custkey, {sql6(SELU_SQL.format(x='(c_acctbal / 1000)'), 'v')} FROM customer")
def selu(spark, d):
    return table(spark, d, "customer").select("c_custkey", r6(S.selu(F.col("c_acctbal") / 1000)).alias("v"))


@query(
    "ndvi_mean_spread",
    f"{FLAG_SQL} SELECT entity, time, {sql6('(qty + price + discount + tax) / 4', 'ndvi_mean')}, "
    + sql6("list_stddev_pop([qty, price, discount, tax])", "ndvi_spread") + " FROM flag_week",
)
def ndvi_mean_spread(spark, d):
    return rounded(weekly_raw(spark, d), "entity", "time", **S.ndvi_mean_spread(SIGNALS))


@query("temp_ranges", f"{SUPPLIER_SQL} SELECT entity, time, {sql6('price - qty', 'v')} FROM supplier_week")
def temp_ranges(spark, d):
    return rounded(weekly_raw(spark, d, "l_suppkey", signals=["qty", "price"]), "entity", "time", v=S.temp_range("price", "qty"))


@query("temp_humidity", f"{SUPPLIER_SQL} SELECT entity, time, {sql6('price * tax', 'v')} FROM supplier_week")
def temp_humidity(spark, d):
    return rounded(weekly_raw(spark, d, "l_suppkey", signals=["price", "tax"]), "entity", "time", v=S.temp_humidity("price", "tax"))


@query("log1p_target", f"{SUPPLIER_SQL} SELECT entity, time, {sql6('LN(1 + target)', 'v')} FROM supplier_week")
def log1p_target(spark, d):
    return rounded(weekly_raw(spark, d, "l_suppkey", signals=[]), "entity", "time", v=S.log1p_target("target"))


@query("expm1", f"SELECT o_orderkey, {sql6('EXP(LN(1 + o_totalprice) / 3) - 1', 'v')} FROM orders")
def expm1(spark, d):
    orders = table(spark, d, "orders").withColumn("z", S.log1p_target("o_totalprice") / 3)
    return rounded(orders, "o_orderkey", v=S.expm1_target("z"))
