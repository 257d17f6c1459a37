"""Queries: window functions, splits and feature vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import history as H
from panelcast.operators import position as P
from panelcast.operators.blocks import with_history
from panelcast.operators.fill import interpolate_linear
from panelcast.operators.history import POS
from panelcast.operators.scale import fit_minmax, fit_zscore
from panelcast.operators.sliding import sliding_moments
from panelcast.operators.storage import save_point
from panelcast.plans.forecast import SPLIT, city_features
from panelcast.queries.panels import (
    FLAG_SPEC,
    FLAG_SQL,
    HOUR_SQL,
    REGION_SQL,
    SIGNALS,
    SUPPLIER_SQL,
    flag_week,
    region_day,
    supplier_week,
    type_hour,
    weekly_raw,
)
from panelcast.queries.prepare import CIRCULAR_SQL, fourier_sql, split_at
from panelcast.queries.registry import query, r6, rounded, sql6
from panelcast.spec import MEAN_WINDOWS, STD_WINDOWS, TREE_LAGS, TREE_MEANS, EntityPlan, MlpConfig, RunSettings

E = ["entity"]


def windowed(df: DataFrame, back: int, **columns) -> DataFrame:
    """(entity, time) plus rounded window columns; each value maps a window to a column."""
    wide = with_history(df, E, P.SEQ, lambda w: {name: build(w) for name, build in columns.items()}, back=back)
    return rounded(wide, "entity", "time", **{name: name for name in columns})


def over(rows: int, order: str = "seq", last: int = 0) -> str:
    return f"OVER (PARTITION BY entity ORDER BY {order} ROWS BETWEEN {rows - 1 + last} PRECEDING AND {last} PRECEDING)"


# --- positions, gaps, scaling -----------------------------------------------------------------------


@query("row_position", f"{SUPPLIER_SQL} SELECT entity, time, seq, n FROM supplier_week")
def row_position(spark, d):
    return supplier_week(spark, d, signals=[]).select("entity", "time", "seq", "n")


def _gap_sql(column: str, partition: str, order: str) -> str:
    """Last known (position, value) up to a row and first known one from it on."""
    known = f"CASE WHEN {column} IS NOT NULL THEN {order} END"
    before = f"OVER ({partition} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"OVER ({partition} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return (
        f"LAST_VALUE({column} IGNORE NULLS) {before} AS {column}_a, LAST_VALUE({known} IGNORE NULLS) {before} AS {column}_pa, "
        f"FIRST_VALUE({column} IGNORE NULLS) {after} AS {column}_b, FIRST_VALUE({known} IGNORE NULLS) {after} AS {column}_pb"
    )


def _between_sql(column: str, order: str) -> str:
    return (
        f"CASE WHEN {column} IS NOT NULL THEN {column} WHEN {column}_b IS NULL THEN {column}_a "
        f"ELSE {column}_a + ({column}_b - {column}_a) / ({column}_pb - {column}_pa) * ({order} - {column}_pa) END"
    )


ENTITY_GAPS_SQL = (
    f"{REGION_SQL}, g AS (SELECT *, {_gap_sql('price', 'PARTITION BY entity', 'seq')}, "
    f"{_gap_sql('balance', 'PARTITION BY entity', 'seq')} FROM region_day)"
)


@query(
    "interpolate_linear",
    f"{ENTITY_GAPS_SQL} SELECT entity, time, {sql6(_between_sql('price', 'seq'), 'price')}, "
    f"{sql6(_between_sql('balance', 'seq'), 'balance')} FROM g",
)
def interpolate_entity(spark, d):
    filled = interpolate_linear(region_day(spark, d), "entity", ["price", "balance"])
    return rounded(filled, "entity", "time", price="price", balance="balance")


@query(
    "interpolate_frame_scope",
    f"{REGION_SQL}, f AS (SELECT *, ROW_NUMBER() OVER (ORDER BY entity, time) AS p FROM region_day), "
    f"g AS (SELECT *, {_gap_sql('price', '', 'p')}, {_gap_sql('balance', '', 'p')} FROM f) "
    f"SELECT entity, time, {sql6(_between_sql('price', 'p'), 'price')}, "
    f"{sql6(_between_sql('balance', 'p'), 'balance')} FROM g",
)
def interpolate_frame(spark, d):
    filled = interpolate_linear(region_day(spark, d), "entity", ["price", "balance"], scope="frame")
    return rounded(filled, "entity", "time", price="price", balance="balance")


@query(
    "interpolate_last",
    f"{ENTITY_GAPS_SQL} SELECT entity, time, {sql6('price_a', 'price')}, {sql6('balance_a', 'balance')} FROM g",
)
def interpolate_last(spark, d):
    filled = interpolate_linear(region_day(spark, d), "entity", ["price", "balance"], method="last")
    return rounded(filled, "entity", "time", price="price", balance="balance")


@query(
    "fit_zscore",
    f"{SUPPLIER_SQL}, twice AS (SELECT entity, qty, price FROM supplier_week UNION ALL "
    "SELECT entity, qty, price FROM supplier_week WHERE seq >= n - 53) "
    f"SELECT entity, {sql6('AVG(qty)', 'qty_mean')}, {sql6('STDDEV_POP(qty)', 'qty_std')}, "
    f"{sql6('AVG(price)', 'price_mean')}, {sql6('STDDEV_POP(price)', 'price_std')} FROM twice GROUP BY 1",
)
def zscore_params(spark, d):
    names = ["qty_mean", "qty_std", "price_mean", "price_std"]
    fitted = fit_zscore(supplier_week(spark, d, signals=["qty", "price"]), ["qty", "price"], E, weight_tail=53)
    return rounded(fitted, "entity", **{n: n for n in names})


@query(
    "fit_minmax",
    f"{SUPPLIER_SQL} SELECT entity, CAST(MIN(week) AS DOUBLE) AS week_low, CAST(MAX(week) AS DOUBLE) AS week_high "
    "FROM supplier_week GROUP BY 1",
)
def minmax_params(spark, d):
    return fit_minmax(weekly_raw(spark, d, "l_suppkey", signals=[]), "week", E)


# --- window functions -------------------------------------------------------------------------------


@query("current_value", f"{SUPPLIER_SQL} SELECT entity, time, {sql6('qty', 'v')} FROM supplier_week")
def current_value(spark, d):
    return rounded(weekly_raw(spark, d, "l_suppkey", signals=["qty"]), "entity", "time", v="qty")


@query(
    "trailing_mean",
    f"{SUPPLIER_SQL} SELECT entity, time, "
    + ", ".join(sql6(f"AVG(qty) {over(k)}", f"mean_{k}") for k in MEAN_WINDOWS)
    + " FROM supplier_week",
)
def trailing_mean(spark, d):
    columns = {f"mean_{k}": (lambda w, k=k: H.trailing_mean("qty", k, w)) for k in MEAN_WINDOWS}
    return windowed(supplier_week(spark, d, signals=["qty"]), 51, **columns)


@query(
    "trailing_std",
    f"{SUPPLIER_SQL} SELECT entity, time, "
    + ", ".join(sql6(f"STDDEV_POP(qty) {over(k)}", f"std_{k}") for k in STD_WINDOWS)
    + " FROM supplier_week",
)
def trailing_std(spark, d):
    columns = {f"std_{k}": (lambda w, k=k: H.trailing_std("qty", k, w)) for k in STD_WINDOWS}
    return windowed(supplier_week(spark, d, signals=["qty"]), 12, **columns)


@query(
    "short_long_gap",
    f"{SUPPLIER_SQL} SELECT entity, time, {sql6(f'AVG(qty) {over(4)} - AVG(qty) {over(13)}', 'gap')} FROM supplier_week",
)
def short_long_gap(spark, d):
    return windowed(supplier_week(spark, d, signals=["qty"]), 12,
                    gap=lambda w: H.trailing_mean("qty", 4, w) - H.trailing_mean("qty", 13, w))


@query(
    "trend_13",
    f"{SUPPLIER_SQL} SELECT entity, time, "
    + sql6("(qty - LAG(qty, 12) OVER (PARTITION BY entity ORDER BY seq)) / 12", "trend")
    + " FROM supplier_week",
)
def trend_13(spark, d):
    return windowed(supplier_week(spark, d, signals=["qty"]), 12, trend=lambda w: H.trend("qty", 12, w))


@query(
    "history_complete",
    f"{SUPPLIER_SQL} SELECT entity, time, {sql6('m', 'm')} FROM (SELECT *, AVG(price) {over(52)} AS m FROM supplier_week) "
    "WHERE seq >= 51",
)
def history_complete(spark, d):
    wide = with_history(H.lead_in_none(supplier_week(spark, d, signals=["price"])), E, POS,
                        lambda w: {"m": H.trailing_mean("price", 52, w)}, back=51)
    return rounded(H.history_complete(wide), "entity", "time", m="m")


@query(
    "endpoint_offset",
    f"{SUPPLIER_SQL}, m AS (SELECT *, AVG(qty) {over(4)} AS a FROM supplier_week) "
    f"SELECT entity, time, {sql6('LAG(a, 2) OVER (PARTITION BY entity ORDER BY seq)', 'a')} FROM m",
)
def endpoint_offset(spark, d):
    mean = with_history(supplier_week(spark, d, signals=["qty"]), E, P.SEQ, lambda w: {"now": H.trailing_mean("qty", 4, w)}, back=3)
    return rounded(H.endpoint_offset(mean, E, P.SEQ, {"now": "a"}, 2), "entity", "time", a="a")


# History lengths of the panel's series, shaped like the two published tables.
FLAG_LAGS = {"qty": 33, "price": 10, "discount": 4, "tax": 41, "week": 3}
FLAG_LAGS_OTHER = {"qty": 40, "price": 16, "discount": 15, "tax": 39, "week": 3}


def _lag_sql(lengths: dict[str, int], t: str) -> str:
    """One row per (entity, time, series, place), oldest first, for rows with all their histories."""
    longest = max(lengths.values())
    parts = [
        f"SELECT a.entity, a.time, '{c}' AS series, {n} - (a.seq - b.seq) AS place, {sql6(f'b.{c}', 'v')} "
        f"FROM {t} a JOIN {t} b ON a.entity = b.entity AND b.seq BETWEEN a.seq - {n - 1} AND a.seq "
        f"WHERE a.seq >= {longest - 1}"
        for c, n in lengths.items()
    ]
    return " UNION ALL ".join(parts)


def _lags(df: DataFrame, lengths: dict[str, int]) -> DataFrame:
    wide = H.raw_lag_arrays(df, E, P.SEQ, lengths).where(F.col(P.SEQ) >= max(lengths.values()) - 1)
    series = F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"{c}_lags").alias("lags")) for c in lengths])
    rows = wide.select("entity", "time", F.inline(series))
    exploded = rows.select("entity", "time", "series", F.posexplode("lags").alias("place", "v"))
    return exploded.select("entity", "time", "series", (F.col("place") + 1).cast("long").alias("place"), r6("v").alias("v"))


@query("raw_lags", f"{FLAG_SQL} {_lag_sql(FLAG_LAGS, 'flag_week')}")
def raw_lags(spark, d):
    return _lags(flag_week(spark, d), FLAG_LAGS)


@query("raw_lags_sj", f"{FLAG_SQL} {_lag_sql(FLAG_LAGS_OTHER, 'flag_week')}")
def raw_lags_other(spark, d):
    return _lags(flag_week(spark, d), FLAG_LAGS_OTHER)


@query(
    "sparse_lags",
    f"{SUPPLIER_SQL} SELECT entity, time, "
    + ", ".join(sql6(f"LAG(qty, {k}) OVER (PARTITION BY entity ORDER BY seq)", f"qty_lag_{k}") for k in TREE_LAGS)
    + " FROM supplier_week",
)
def sparse_lags(spark, d):
    wide = H.sparse_lags(supplier_week(spark, d, signals=["qty"]), E, P.SEQ, ["qty"])
    return rounded(wide, "entity", "time", **{f"qty_lag_{k}": f"qty_lag_{k}" for k in TREE_LAGS})


@query(
    "past_mean_shifted",
    f"{SUPPLIER_SQL} SELECT entity, time, "
    + ", ".join(sql6(f"AVG(qty) {over(k, last=1)}", f"past_{k}") for k in TREE_MEANS)
    + " FROM supplier_week",
)
def past_mean_shifted(spark, d):
    columns = {f"past_{k}": (lambda w, k=k: H.past_mean_shifted("qty", k, w)) for k in TREE_MEANS}
    return windowed(supplier_week(spark, d, signals=["qty"]), max(TREE_MEANS), **columns)


LONG_WINDOWS = (13, 52, 520)


@query(
    "sliding_moments",
    f"{HOUR_SQL} SELECT entity, hour, "
    + ", ".join(
        f"{sql6(f'AVG(value) {over(k)}', f'mean_{k}')}, {sql6(f'STDDEV_POP(value) {over(k)}', f'std_{k}')}" for k in LONG_WINDOWS
    )
    + " FROM type_hour",
)
def long_moments(spark, d):
    """Means and spreads of short and long windows from one set of pieces."""
    wide = sliding_moments(type_hour(spark, d), E, P.SEQ, ["value"], LONG_WINDOWS)
    names = {f"{s}_{k}": f"value_{s}_{k}" for k in LONG_WINDOWS for s in ("mean", "std")}
    return rounded(wide, "entity", "hour", **names)


# --- sorting and splits -----------------------------------------------------------------------------


@query("sort_time", f"{SUPPLIER_SQL} SELECT entity, time, target FROM supplier_week ORDER BY 1, 2")
def sort_time(spark, d):
    return P.sort_time(weekly_raw(spark, d, "l_suppkey", signals=[]), "entity", "time").select("entity", "time", "target")


@query("tail_rows", f"{SUPPLIER_SQL} SELECT entity, time, seq FROM supplier_week WHERE seq >= n - 53")
def tail_rows(spark, d):
    return P.tail_rows(supplier_week(spark, d, signals=[])).select("entity", "time", "seq")


@query(
    "holdout_split",
    f"{SUPPLIER_SQL} SELECT entity, time, CASE WHEN seq < n - 52 THEN 'train' ELSE 'holdout' END AS part FROM supplier_week",
)
def holdout_split(spark, d):
    train, held = P.holdout_split(save_point(supplier_week(spark, d, signals=[])))
    train, held = (x.select("entity", "time", F.lit(part).alias("part")) for x, part in ((train, "train"), (held, "holdout")))
    return train.unionByName(held)


@query(
    "proportional_prefix",
    f"{FLAG_SQL}, ref AS (SELECT MAX(n) AS rn FROM flag_week WHERE entity = 'N') SELECT entity, time FROM flag_week, ref "
    "WHERE entity <> 'N' AND seq < GREATEST(53, FLOOR(n * (rn - 52) / rn))",
)
def proportional_prefix(spark, d):
    return P.proportional_prefix(flag_week(spark, d, signals=[]), "entity", "N").select("entity", "time")


def folds_sql(panel: str, folds: int = 3) -> str:
    rows = ", ".join(f"({k})" for k in range(1, folds + 1))
    cut = f"n - ({folds} - CAST(k.fold AS BIGINT) + 1) * 52"
    return (
        f", folds AS (SELECT * FROM (SELECT p.*, CAST(k.fold AS BIGINT) AS fold, CASE WHEN seq < {cut} THEN 'train' "
        f"WHEN seq < {cut} + 52 THEN 'validate' END AS role FROM {panel} p, (VALUES {rows}) k(fold)) WHERE role IS NOT NULL)"
    )


def folds(df: DataFrame, count: int = 3) -> DataFrame:
    return P.expanding_folds(df, count).withColumn("fold", F.col("fold").cast("long"))


@query("expanding_folds", SUPPLIER_SQL + folds_sql("supplier_week") + " SELECT entity, time, fold, role FROM folds")
def expanding_folds(spark, d):
    return folds(supplier_week(spark, d, signals=[])).select("entity", "time", "fold", "role")


@query("head_rows", f"{SUPPLIER_SQL} SELECT entity, time, target, (time - DATE '1990-01-01') * 100000 + entity AS place FROM supplier_week ORDER BY 4 LIMIT 10")
def head_rows(spark, d):
    place = F.datediff("time", F.lit("1990-01-01")).cast("long") * 100000 + F.col("entity")
    rows = weekly_raw(spark, d, "l_suppkey", signals=[]).select("entity", "time", "target", place.alias("place"))
    return P.head_rows(rows, "place", 10)


# --- feature vectors --------------------------------------------------------------------------------


def multiscale_sql(columns=SIGNALS, by: str = "entity", order: str = "seq") -> str:
    """Select list of the wide multiscale row, unrounded."""
    window = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS %d PRECEDING)"
    out = []
    for c in columns:
        means = {k: f"AVG({c}) {window % (k - 1)}" for k in MEAN_WINDOWS}
        out.append(f"{c} AS {c}_now")
        out += [f"{m} AS {c}_mean_{k}" for k, m in means.items()]
        out += [f"STDDEV_POP({c}) {window % (k - 1)} AS {c}_std_{k}" for k in STD_WINDOWS]
        out.append(f"{means[4]} - {means[13]} AS {c}_gap_4_13")
        out.append(f"({c} - LAG({c}, 12) OVER (PARTITION BY {by} ORDER BY {order})) / 12 AS {c}_trend_13")
    return ", ".join(out) + ", " + fourier_sql(2)


NAMES = H.multiscale_names(SIGNALS)


def _unpivot_sql(source: str, names, keys: str) -> str:
    columns = ", ".join(sql6(n, n) for n in names)
    return (
        f"SELECT {keys}, feature, value FROM (SELECT {keys}, {columns} FROM {source}) "
        f"UNPIVOT (value FOR feature IN ({', '.join(names)}))"
    )


@query(
    "multiscale_features",
    f"{FLAG_SQL}, wide AS (SELECT entity, time, seq, {multiscale_sql()} FROM flag_week), "
    "full_history AS (SELECT * FROM wide WHERE seq >= 51) " + _unpivot_sql("full_history", NAMES, "entity, time"),
)
def multiscale_features(spark, d):
    """Named summaries in long form, in double precision."""
    wide = H.multiscale_columns(flag_week(spark, d), E, P.SEQ, SIGNALS, "week")
    return wide.select("entity", "time", *[r6(n).alias(n) for n in NAMES]).unpivot(
        ["entity", "time"], NAMES, "feature", "value"
    )


@query(
    "multiscale_vectors",
    SUPPLIER_SQL + CIRCULAR_SQL.format(t="supplier_week")
    + f", wide AS (SELECT entity, pos, n, {multiscale_sql(order='pos')} FROM circular), "
    "ok AS (SELECT * FROM wide WHERE pos >= 51 AND pos < n + 51) "
    "SELECT entity, COUNT(*) AS examples, CAST(%d AS BIGINT) AS width, " % len(NAMES)
    + sql6("AVG(qty_mean_52)", "level") + ", " + sql6("AVG(tax_std_13)", "spread") + ", " + sql6("AVG(price_gap_4_13)", "gap")
    + ", " + sql6("AVG(discount_trend_13)", "trend") + " FROM ok GROUP BY 1",
)
def multiscale_vectors(spark, d):
    """Float vectors of all series with circular context, summarised per series."""
    rows = H.lead_in_circular(supplier_week(spark, d), 53, 2)
    vectors = H.multiscale_features(rows, E, SIGNALS, "week", keep=["entity", "pos"])
    pick = lambda name: F.avg(F.col("features")[NAMES.index(name)].cast("double"))
    out = vectors.groupBy("entity").agg(
        F.count(F.lit(1)).alias("examples"), F.max(F.size("features")).cast("long").alias("width"),
        pick("qty_mean_52").alias("level"), pick("tax_std_13").alias("spread"),
        pick("price_gap_4_13").alias("gap"), pick("discount_trend_13").alias("trend"),
    )
    return rounded(out, "entity", "examples", "width", level="level", spread="spread", gap="gap", trend="trend")


def _place_sql(lengths: dict[str, int], t: str, order: str, keys: str) -> str:
    """(keys, place, v): the concatenated history vector, place counted from 1."""
    parts, at = [], 0
    for c, n in lengths.items():
        parts.append(
            f"SELECT {keys}, {at + n} - (a.{order} - b.{order}) AS place, CAST(b.{c} AS DOUBLE) AS v "
            f"FROM {t} a JOIN {t} b ON a.entity = b.entity AND b.{order} BETWEEN a.{order} - {n - 1} AND a.{order} "
            f"WHERE a.{order} >= 51 AND a.{order} < a.n + 51"
        )
        at += n
    return " UNION ALL ".join(parts)


@query(
    "raw_lag_features",
    FLAG_SQL + CIRCULAR_SQL.format(t="flag_week")
    + f" SELECT entity, pos, place, {sql6('CAST(CAST(v AS FLOAT) AS DOUBLE)', 'v')} FROM ("
    + _place_sql(FLAG_LAGS, "circular", "pos", "a.entity, a.pos") + ")",
)
def raw_lag_features(spark, d):
    rows = H.lead_in_circular(flag_week(spark, d), 53, 2)
    vectors = H.raw_lag_features(rows, E, FLAG_LAGS, keep=["entity", "pos"])
    long = vectors.select("entity", "pos", F.posexplode("features").alias("place", "v"))
    return long.select("entity", "pos", (F.col("place") + 1).cast("long").alias("place"), r6(F.col("v").cast("double")).alias("v"))


def _as_float(name: str) -> str:
    return sql6(f"CAST(CAST({name} AS FLOAT) AS DOUBLE)", "v")


def _named_places_sql(source: str, keys: str, first: int = 0) -> str:
    """The multiscale columns of ``source`` as rows (keys, place, v), places counted from ``first``."""
    return " UNION ALL ".join(
        f"SELECT {keys}, CAST({first + i} AS BIGINT) AS place, {_as_float(n)} FROM {source}" for i, n in enumerate(NAMES, 1)
    )


def _vector_places(df: DataFrame, *keys: str) -> DataFrame:
    long = df.select(*keys, F.posexplode("features").alias("place", "v"))
    return long.select(*keys, (F.col("place") + 1).cast("long").alias("place"), r6(F.col("v").cast("double")).alias("v"))


@query(
    "raw_plus_summaries",
    FLAG_SQL + CIRCULAR_SQL.format(t="flag_week")
    + f", wide AS (SELECT entity, pos, n, {multiscale_sql(order='pos')} FROM circular), "
    "ok AS (SELECT * FROM wide WHERE pos >= 51 AND pos < n + 51) "
    f"SELECT entity, pos, place, {_as_float('v')} FROM ("
    + _place_sql(FLAG_LAGS, "circular", "pos", "a.entity, a.pos") + ") UNION ALL "
    + _named_places_sql("ok", "entity, pos", sum(FLAG_LAGS.values())),
)
def raw_plus_summaries(spark, d):
    """Every place of the joint vector."""
    rows = H.lead_in_circular(flag_week(spark, d), 53, 2)
    vectors = H.raw_plus_summaries(rows, E, SIGNALS, "week", FLAG_LAGS, keep=["entity", "pos"])
    return _vector_places(vectors, "entity", "pos")


FLAG_SETTINGS = RunSettings(
    default=EntityPlan("multiscale", "m", "nearest"),
    configs={"m": MlpConfig()},
    scale_entity="N",
    scale_tail=53,
    lead_in="circular",
    test_offset=2,
)

CITY_SQL = FLAG_SQL + """, train0 AS (SELECT * REPLACE (n - 52 AS n) FROM flag_week WHERE seq < n - 52),
ref AS (SELECT * FROM train0 WHERE entity = 'N' UNION ALL SELECT * FROM train0 WHERE entity = 'N' AND seq >= n - 53),
p AS (SELECT """ + ", ".join(f"AVG({s}) AS {s}_m, STDDEV_POP({s}) AS {s}_s" for s in SIGNALS) + """ FROM ref),
scaled AS (SELECT f.* REPLACE (""" + ", ".join(f"(f.{s} - {s}_m) / GREATEST({s}_s, 1e-12) AS {s}" for s in SIGNALS) + """) FROM flag_week f, p),
train AS (SELECT * REPLACE (n - 52 AS n) FROM scaled WHERE seq < n - 52),
test AS (SELECT * REPLACE (seq - n + 52 AS seq, CAST(52 AS BIGINT) AS n) FROM scaled WHERE seq >= n - 52),
context AS (
  SELECT *, 'train' AS split, seq + 53 AS pos FROM train UNION ALL
  SELECT *, 'train', seq - n + 53 FROM train WHERE seq >= n - 53 UNION ALL
  SELECT *, 'test', seq + 53 FROM test UNION ALL
  SELECT * REPLACE (CAST(52 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS target), 'test', seq - n + 53 FROM train WHERE seq >= n - 53),
wide AS (SELECT entity, split, pos, n, CASE WHEN split = 'train' THEN CAST(target AS DOUBLE) END AS y, """ + multiscale_sql(
    by="entity, split", order="pos"
) + """ FROM context),
ok AS (SELECT * FROM wide WHERE pos >= 51 AND pos < n + 51)"""


@query("city_features", CITY_SQL + " " + _named_places_sql("ok", "entity, split, pos, y"))
def city_feature_rows(spark, d):
    """Every place of every example's vector, and the training targets."""
    train, test = split_at(save_point(flag_week(spark, d)))
    examples = city_features(train, test.drop("target"), FLAG_SPEC, FLAG_SETTINGS)
    y = F.when(F.col(SPLIT) == "train", F.col("y"))
    return _vector_places(examples.withColumn("y", y), "entity", SPLIT, "pos", "y")


TREE_NAMES = [f"{c}_lag_{k}" for c in SIGNALS for k in TREE_LAGS] + [f"{c}_past_{k}" for c in SIGNALS for k in TREE_MEANS]
TREE_SQL = ", ".join(
    [sql6(f"LAG({c}, {k}) OVER (PARTITION BY entity ORDER BY seq)", f"{c}_lag_{k}") for c in SIGNALS for k in TREE_LAGS]
    + [sql6(f"AVG({c}) {over(k, last=1)}", f"{c}_past_{k}") for c in SIGNALS for k in TREE_MEANS]
)


def tree_panel(df: DataFrame) -> DataFrame:
    return H.tree_features(
        df, E, P.SEQ, SIGNALS, "week", vegetation=SIGNALS,
        ranges={"range_price": ("price", "qty"), "range_tax": ("tax", "discount")}, interaction=("price", "tax"),
    )


@query(
    "tree_features",
    f"{SUPPLIER_SQL} SELECT entity, time, {TREE_SQL}, {fourier_sql(4)}, "
    + sql6("(qty + price + discount + tax) / 4", "ndvi_mean") + ", "
    + sql6("list_stddev_pop([qty, price, discount, tax])", "ndvi_spread")
    + f", {sql6('price - qty', 'range_price')}, {sql6('tax - discount', 'range_tax')}, {sql6('price * tax', 'temp_humidity')} "
    "FROM supplier_week",
)
def tree_features(spark, d):
    panel = supplier_week(spark, d)
    wide = tree_panel(panel)
    added = [c for c in wide.columns if c not in panel.columns]
    return rounded(wide, "entity", "time", **{c: c for c in added})
