import datetime

import pytest
from pyspark.sql import functions as F

from panelcast.operators import contracts as C
from panelcast.operators.position import row_position
from panelcast.operators.scale import apply_params
from panelcast.operators.relational import diff_tables, drop_columns, join_one_to_one
from panelcast.sources.csv import label_schema, read_features, read_labels, read_template, write_submission
from panelcast.spec import CLIMATE_PANEL


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("a", 1, 10, 0), ("a", 2, 11, 1), ("b", 1, 12, 2)], "k string, w long, v long, pos long")


def test_duplicate_keys_raise(table):
    C.check_one_to_one(table, ["k", "w"])
    with pytest.raises(C.ContractError):
        C.check_one_to_one(table, ["k"])
    for left, right in ((table, table.unionByName(table)), (table.unionByName(table), table)):
        for how in ("inner", "left"):
            joined = join_one_to_one(left.withColumnRenamed("v", "x"), right.drop("pos"), ["k", "w"], how)
            with pytest.raises(Exception, match="key is not unique"):
                joined.count()
    once = join_one_to_one(table.withColumnRenamed("v", "x"), table.where("w = 1").drop("pos"), ["k", "w"], "left")
    assert once.count() == 3 and once.columns == ["k", "w", "x", "pos", "v"]


def test_one_to_one_join_reads_each_side_once(spark, tmp_path):
    rows = [("a", i, float(i)) for i in range(20)]
    for name, column in (("left", "x"), ("right", "y")):
        spark.createDataFrame(rows, f"k string, w long, {column} double").write.parquet(str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in ("left", "right"))
    joined = join_one_to_one(left, right, ["k", "w"])
    joined.write.format("noop").mode("overwrite").save()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 20 and plan.count("FileScan parquet") == 2


@pytest.mark.parametrize(
    "bad, message",
    [((None, 5), "null series key or time"), (("a", None), "null series key or time"), (("a", 3), "occurs twice")],
)
def test_positions_need_unique_keys(spark, bad, message):
    rows = [(e, i) for e in ("a", "b") for i in range(9)]
    day = "make_date(2001, 1, d + 1) as time"
    good = spark.createDataFrame(rows, "e string, d int").selectExpr("e", day)
    assert row_position(good, ["e"], "time", "day").agg(F.max("seq")).first()[0] == 8
    df = spark.createDataFrame([*rows, bad], "e string, d int").selectExpr("e", day)
    with pytest.raises(Exception, match=message):
        row_position(df, ["e"], "time", "day").collect()


def test_shared_parameters_are_one_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "e string, x double")
    params = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "x_mean double, x_std double")
    with pytest.raises(Exception, match="several rows"):
        apply_params(df, params, ["x"]).collect()
    own = params.limit(1).withColumn("e", F.lit("a"))
    assert {r["e"]: r["x"] for r in apply_params(df, own, ["x"], by=["e"]).collect()} == {"a": 1.0, "b": None}


def test_row_order(table):
    C.check_row_order(table, table, ["k", "w"])
    swapped = table.withColumn("pos", 2 - F.col("pos"))
    with pytest.raises(C.ContractError):
        C.check_row_order(table, swapped, ["k", "w"])
    with pytest.raises(C.ContractError):
        C.check_row_order(table, table.where("pos < 2"), ["k", "w"])


def test_missing_counts_and_schema(table):
    C.check_no_missing(table, ["v"])
    holed = table.withColumn("v", F.when(F.col("w") == 2, None).otherwise(F.col("v")))
    with pytest.raises(C.ContractError):
        C.check_no_missing(holed, ["v"])
    C.check_counts(table, "v", 3)
    for bad in (table.limit(2), holed, table.withColumn("v", F.col("v") - 11)):
        with pytest.raises(C.ContractError):
            C.check_counts(bad, "v", 3)
    C.check_output_schema(table.select("k", "v"), ["k", "v"], "v")
    for bad, columns in (
        (table.select("v", "k"), ["k", "v"]),
        (table.select("k", F.col("v").cast("double").alias("v")), ["k", "v"]),
        (holed.select("k", "v"), ["k", "v"]),
    ):
        with pytest.raises(C.ContractError):
            C.check_output_schema(bad, columns, "v")


def test_submission_cover(table):
    C.check_submission(table, table, ["k", "w"], "v")
    with pytest.raises(C.ContractError):
        C.check_submission(table, table.where("w = 1"), ["k", "w"], "v")
    with pytest.raises(C.ContractError):
        C.check_submission(table.where("w = 1"), table, ["k", "w"], "v")


@pytest.mark.parametrize("value", [float("nan"), float("inf"), None])
def test_feature_shape(spark, value):
    good = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "features array<float>")
    C.check_feature_shape(good, 2, 2)
    bad = spark.createDataFrame([([1.0, 2.0],), ([3.0, value],)], "features array<float>")
    for df, width, rows in ((good, 3, 2), (good, 2, 3), (bad, 2, 2)):
        with pytest.raises(C.ContractError):
            C.check_feature_shape(df, width, rows)


def test_dropping_an_absent_column_raises(table):
    with pytest.raises(ValueError):
        drop_columns(table, "nothing")


def test_diff_counts_each_kind(spark):
    a = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("b", 1, 1)], "k string, w long, v long")
    b = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 8), ("b", 2, 1)], "k string, w long, v long")
    got = {r["k"]: tuple(r)[1:] for r in diff_tables(a, b, ["k", "w"], "v", ["k"]).collect()}
    assert got == {"a": (3, 1, 0, 0), "b": (0, 0, 1, 1)}


def test_template_order_survives_file_splits(spark, tmp_path):
    lines = [f"c{i % 7},{1990 + i // 52},{i % 53 + 1},0" for i in range(3000)]
    (tmp_path / "t.csv").write_text("city,year,weekofyear,total_cases\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        template = read_template(spark, str(tmp_path / "t.csv"), label_schema(CLIMATE_PANEL))
        assert template.rdd.getNumPartitions() > 1
        got = template.orderBy("pos").toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert list(got["pos"]) == list(range(3000))
    assert list(got["city"] + "," + got["year"].astype(str) + "," + got["weekofyear"].astype(str) + ",0") == lines


def test_year_end_weeks_are_read_by_date(spark, tmp_path):
    schema = "city string, year int, weekofyear int, week_start_date string, x double"
    rows = ["sj,1992,52,1992-12-24,1.5", "sj,1993,53,1993-01-01,NaN", "sj,1993,1,1993-01-08,"]
    (tmp_path / "f.csv").write_text("city,year,weekofyear,week_start_date,x\n" + "\n".join(rows) + "\n")
    from pyspark.sql import types as T

    fields = T._parse_datatype_string(schema)
    got = read_features(spark, str(tmp_path / "f.csv"), fields, "week_start_date").orderBy("week_start_date").collect()
    assert [r["weekofyear"] for r in got] == [52, 53, 1]
    assert got[0]["week_start_date"] == datetime.date(1992, 12, 24)
    assert [r["x"] for r in got] == [1.5, None, None]


def test_malformed_rows_fail(spark, tmp_path):
    (tmp_path / "l.csv").write_text("city,year,weekofyear,total_cases\nsj,1990,eighteen,4\n")
    with pytest.raises(Exception):  # noqa: B017
        read_labels(spark, str(tmp_path / "l.csv"), label_schema()).collect()


def test_submission_is_one_ordered_file(spark, table, tmp_path):
    write_submission(table.repartition(3), str(tmp_path / "out"), ["k", "w", "v"])
    assert (tmp_path / "out").read_text().splitlines() == ["k,w,v", "a,1,10", "a,2,11", "b,1,12"]
