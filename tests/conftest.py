import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("panelcast-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SIGNALS = ("rain", "heat", "damp")


def make_panel(rows: dict[str, int], signals=SIGNALS, missing=0.0, seed=3, start="2000-01-01") -> pd.DataFrame:
    """Weekly panel with calendar-year restarts, a seasonal target and optional gaps."""
    rng = np.random.default_rng(seed)
    frames = []
    for entity, n in rows.items():
        first = pd.Timestamp(start)
        dates = [pd.Timestamp(first.year + i // 52, 1, 1) + pd.Timedelta(days=7 * (i % 52)) for i in range(n)]
        week = np.arange(n) % 52 + 1
        frame = pd.DataFrame(
            {"city": entity, "year": [d.year for d in dates], "weekofyear": week, "week_start_date": dates}
        )
        for j, s in enumerate(signals):
            x = np.sin(2 * np.pi * week / 52 + j) + rng.normal(0, 0.3, n) + 5 * j
            if missing:
                gaps = rng.random(n) < missing
                gaps[0] = False
                x[gaps] = np.nan
            frame[s] = x
        frame["total_cases"] = rng.poisson(np.exp(1.5 + np.sin(2 * np.pi * week / 52)))
        frames.append(frame)
    out = pd.concat(frames, ignore_index=True)
    out["week_start_date"] = out["week_start_date"].dt.date
    return out


def to_spark(spark, pdf: pd.DataFrame, shuffled=True):
    """Upload with NaN as NULL and rows in random order."""
    if shuffled:
        pdf = pdf.sample(frac=1, random_state=5)
    data = [
        tuple(None if isinstance(v, float) and np.isnan(v) else (v.item() if hasattr(v, "item") else v) for v in row)
        for row in pdf.itertuples(index=False)
    ]
    kinds = {"object": "string", "int64": "long", "int32": "long", "float64": "double", "bool": "boolean"}
    fields = []
    for c in pdf.columns:
        kind = kinds.get(str(pdf[c].dtype), "string")
        if c == "week_start_date" or c == "time":
            kind = "date"
        fields.append(f"{c} {kind}")
    return spark.createDataFrame(data, ", ".join(fields))
