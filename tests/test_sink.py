"""The submission sink: one file, one header, template order, nothing after a failure."""

import pytest
from pyspark.sql import functions as F

from panelcast.sources import csv as io
from panelcast.sources.single_file import write_one_csv


@pytest.fixture()
def template(tmp_path):
    lines = ["city,year,weekofyear,total_cases"]
    lines += [f"{city},{2008 + i // 52},{i % 52 + 1},0" for city in ("sj", "iq") for i in range(120)]
    path = tmp_path / "template.csv"
    path.write_text("\n".join(lines) + "\n")
    return path


def test_template_round_trips_byte_for_byte(spark, template, tmp_path):
    rows = io.read_template(spark, str(template), io.label_schema())
    for parts, out in ((1, "one.csv"), (7, "folder/many.csv")):
        io.write_submission(rows.repartition(parts), str(tmp_path / out), rows.columns[:-1])
        assert (tmp_path / out).read_bytes() == template.read_bytes()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["folder", "one.csv", "template.csv"]
    back = io.read_back(spark, f"file://{tmp_path}/one.csv", io.label_schema())
    assert back.orderBy("pos").collect() == rows.orderBy("pos").collect()


def test_a_failed_task_leaves_no_file(spark, template, tmp_path):
    rows = io.read_template(spark, str(template), io.label_schema()).repartition(4)
    broken = rows.withColumn("year", F.when(F.col("pos") == 200, F.raise_error(F.lit("broken row")).cast("int")).otherwise(F.col("year")))
    with pytest.raises(Exception, match="broken row"):
        io.write_submission(broken, str(tmp_path / "out.csv"), rows.columns[:-1])
    assert [p.name for p in tmp_path.iterdir()] == ["template.csv"]


def test_values_that_need_quotes_nulls_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([("a,b", None), ('say "x"', 1.5), ("é\nü", 2.0)], "name string, x double").coalesce(1)
    write_one_csv(df, str(tmp_path / "odd.csv"))
    assert (tmp_path / "odd.csv").read_text() == 'name,x\n"a,b",\n"say ""x""",1.5\n"é\nü",2.0\n'
    write_one_csv(df.where("false"), str(tmp_path / "none.csv"))
    assert (tmp_path / "none.csv").read_text() == "name,x\n"
    with pytest.raises(FileExistsError):
        write_one_csv(df, str(tmp_path / "odd.csv"))
