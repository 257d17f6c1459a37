"""Tables compared by checksums of ranges against a full join."""

import pytest
from pyspark.sql import functions as F

from panelcast.operators import checksums as K
from panelcast.operators import contracts as C
from panelcast.operators.relational import diff_tables


def panel(spark, n=3000):
    return spark.range(n).select(
        (F.col("id") % 3).cast("string").alias("city"), F.col("id").alias("pos"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("cases"),
    )


def counts(df, by):
    return {tuple(r[c] for c in by): (r["compared"], r["differing"], r["left_only"], r["right_only"]) for r in df.collect()}


@pytest.fixture(params=["few", "many", "none"])
def pair(spark, request):
    left = panel(spark)
    if request.param == "none":
        return left, left.repartition(3).orderBy(F.desc("pos"))
    if request.param == "many":
        return left, left.withColumn("cases", F.col("cases") + 1)
    changed = F.when(F.col("pos").isin(5, 7, 2000), F.lit(99)).otherwise(F.col("cases"))
    return left.where("pos <> 11"), left.where("pos <> 40").withColumn("cases", changed)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_equal_to_a_full_join(pair, limit, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_RANGES", limit)
    for by in ([], ["city"]):
        got = K.compare_tables(*pair, ["city", "pos"], "cases", by)
        assert counts(got, by) == counts(diff_tables(*pair, ["city", "pos"], "cases", by), by)


def test_listed_rows(spark):
    left = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), (None, 3, 1.0), ("b", 4, 0.0)], "k string, i long, v double")
    right = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), (None, 3, 2.0), ("b", 4, -0.0), ("c", None, 1.0)], "k string, i long, v double")
    got = {(r["k"], r["i"]): (r["left"] and r["left"]["v"], r["right"] and r["right"]["v"]) for r in K.differing_rows(left, right, ["k", "i"], ["v"]).collect()}
    assert got == {("a", 1): (None, 0.0), (None, 3): (1.0, 2.0), ("c", None): (None, 1.0)}
    assert K.compare_tables(left.limit(0), right.limit(0), ["k", "i"], "v", ["k"]).count() == 0


def test_repeats_and_nulls_count(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "a long, b long")
    assert K.equal_tables(rows((1, 2), (3, 4)), rows((3, 4), (1, 2)), ["a", "b"])
    assert not K.equal_tables(rows((1, 2), (1, 2), (3, 4)), rows((1, 2), (3, 4), (3, 4)), ["a", "b"])
    assert not K.equal_tables(rows((None, 5)), rows((5, None)), ["a", "b"])
    assert not K.equal_tables(rows((1, 2)), rows((1, 2), (1, 2)), ["a", "b"])


def test_row_order_contract(spark):
    left = panel(spark, 50)
    C.check_row_order(left, left.repartition(4), ["city"])
    swapped = left.withColumn("pos", F.when(F.col("pos") == 3, 4).when(F.col("pos") == 4, 3).otherwise(F.col("pos")))
    with pytest.raises(C.ContractError, match="2 of 50 rows out of order"):
        C.check_row_order(left, swapped, ["city"])


def test_only_rows_of_differing_ranges_are_joined(spark):
    left = panel(spark, 20_000).cache()
    right = left.withColumn("cases", F.when(F.col("pos") == 123, -1).otherwise(F.col("cases"))).cache()
    found = K.differing_rows(left, right, ["city", "pos"], ["cases"])
    met = found._jdf.queryExecution().optimizedPlan().toString()
    assert met.count("LeftSemi") == 4 and found.count() == 1
