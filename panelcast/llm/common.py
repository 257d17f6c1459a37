"""Small helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.storage import checkpoint_dir

# The white space that ends a word, and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT_ROWS = 1000
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    For tables that are read more than once: they are computed once, and an executor that is lost
    later costs nothing but a read.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many pieces of about ``each`` make up ``total``."""
    return max(least, -(-int(total) // each))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which nulls match; key columns come from ``left`` only."""
    keyed = right.select(*[F.col(c).alias(f"_right_{c}") if c in on else F.col(c) for c in right.columns])
    meets = reduce(lambda a, b: a & b, [left[c].eqNullSafe(keyed[f"_right_{c}"]) for c in on])
    joined = left.join(keyed, meets, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{c}" for c in on])


def lower_ascii(text: str | Column) -> Column:
    """A-Z lower-cased, all other letters left alone."""
    return F.translate(text, UPPER, LOWER)


def free_names(df: DataFrame, names: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """``df`` without the columns an operator is about to add; ``kept`` are its inputs and must not clash."""
    clash = {n.lower() for n in names} & {k.lower() for k in kept}
    if clash:
        raise ValueError(f"output names clash with inputs: {sorted(clash)}")
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def limit_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most ``TEXT_ROWS`` rows, unless it already asks for fewer.

    Whole texts travel in these batches, in the executor's memory and in its Python worker's; Spark's default of
    10,000 rows suits narrow tables.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))


def small_batches(batches, rows: int = 512):
    """Arrow batches cut to at most ``rows`` rows, so that long texts do not pile up in a worker."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null gives the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


# Arrow types by their names in Spark.
_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
}


def arrow_rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """Rows of simple columns as an Arrow batch; ``ddl`` is the Spark schema they are returned under."""
    fields = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in ddl.split(", "))])
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields
    )
