"""One series holds a third of all rows: results stay right and no task gets the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import profile
from panelcast.operators.blocks import halo_blocks, with_history
from panelcast.operators.fill import interpolate_linear
from panelcast.operators.history import multiscale_columns, trailing_mean
from panelcast.operators.position import row_position, time_slot
from panelcast.operators.storage import save_point

HOT = 20_000


@pytest.fixture(scope="module")
def panel(spark):
    hot = spark.range(HOT).select(F.lit("hot").alias("e"), F.col("id").alias("h"))
    cold = spark.range(2 * HOT).select(F.concat(F.lit("c"), F.col("id") % 40).alias("e"), F.floor(F.col("id") / 40).alias("h"))
    x = F.when(F.col("h") % 7 != 3, F.sin(F.col("h") / 10) + F.col("h") % 5)
    return save_point(
        hot.unionByName(cold).select(
            "e", F.timestamp_seconds(F.col("h") * 3600).alias("t"), x.alias("x"), (F.col("h") % 11).alias("y"),
            (F.col("h") % 52 + 1).alias("week"),
        ).repartition(6)
    )


def test_slots_and_blocks_bound_every_group(panel):
    slots = panel.groupBy("e", time_slot(panel, "t", "hour", 512)).count()
    assert slots.agg(F.max("count")).first()[0] <= 512
    placed = row_position(panel, ["e"], "t", "hour", 512)
    blocks = halo_blocks(placed, "seq", back=51, rows=256).groupBy("e", "_block").count()
    assert blocks.agg(F.max("count")).first()[0] <= 256 + 51
    assert placed.where("e = 'hot'").agg(F.countDistinct("seq"), F.max("seq"), F.max("n")).first() == (HOT, HOT - 1, HOT)


def test_hot_series_matches_pandas(panel):
    placed = save_point(row_position(panel, ["e"], "t", "hour", 512))
    filled = save_point(interpolate_linear(placed, "e", ["x"], rows=300))
    wide = multiscale_columns(filled, ["e"], "seq", ["x"], "week", rows=256)
    got = wide.where("e = 'hot'").orderBy("seq").toPandas()
    raw = placed.where("e = 'hot'").orderBy("seq").toPandas()["x"]
    want = raw.interpolate(limit_direction="forward")
    np.testing.assert_allclose(got["x"], want[51:], rtol=1e-12)
    for k in (2, 4, 8, 13, 26, 52):
        np.testing.assert_allclose(got[f"x_mean_{k}"], want.rolling(k).mean()[51:], rtol=1e-9, atol=1e-9)
    for k in (4, 13):
        np.testing.assert_allclose(got[f"x_std_{k}"], want.rolling(k).std(ddof=0)[51:], rtol=1e-6, atol=1e-7)


def test_partial_history_at_the_start_of_a_series(panel):
    placed = row_position(panel, ["e"], "t", "hour", 512)
    got = with_history(placed, ["e"], "seq", lambda w: {"m": trailing_mean("y", 13, w)}, back=12, rows=64)
    got = got.where("e = 'hot'").orderBy("seq").toPandas()
    want = pd.Series(np.arange(HOT) % 11).rolling(13, min_periods=1).mean()
    np.testing.assert_allclose(got["m"], want, rtol=1e-12)


def test_profiles_of_the_hot_series(panel):
    placed = save_point(row_position(panel, ["e"], "t", "hour", 512))
    y = pd.Series(np.arange(HOT) % 11)
    auto = profile.autocorrelation(placed, "e", "seq", "y", 12).where("e = 'hot'").orderBy("lag").toPandas()
    np.testing.assert_allclose(auto["corr"], [y.corr(y.shift(k)) for k in range(1, 13)], rtol=1e-9)
    overview = profile.dataset_overview(panel, "e", "t", "y").where("e = 'hot'").first()
    assert (overview["rows"], overview["median"], overview["max"]) == (HOT, y.median(), 10)
