"""Window functions over long series without one task per series.

A series is cut into blocks of consecutive rows. Rows that the windows of the next (or previous) block
reach are copied into that block as well, so every window is complete inside one block. The shuffle key
is (series, block): a series holding a third of all rows is spread over as many tasks as any other
third, and a task never sees more than ``block + back + ahead`` rows of a series at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
BLOCK = "_block"
OWN = "_own"

METHOD_BYTES = 8000

Stage = Callable[[WindowSpec], dict[str, Column]]


def small_methods(spark: SparkSession) -> None:
    """Let this session generate no methods of more than ``METHOD_BYTES`` of byte code, unless it already asks for less.

    The JVM never compiles longer ones, so a projection of many columns would be interpreted for every row; Spark then
    splits it instead. Results are the same.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > METHOD_BYTES:
        spark.conf.set(name, str(METHOD_BYTES))


def block_of(order: str | Column, rows: int = BLOCK_ROWS) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / rows)


def halo_blocks(df: DataFrame, order: str, back: int = 0, ahead: int = 0, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the block id; a row near a block edge appears once more in the neighbour that needs it."""
    rows = max(rows, back, ahead)
    home = block_of(order, rows)
    inside = F.pmod(F.col(order), F.lit(rows))
    to_next = inside >= rows - back
    to_previous = (inside < ahead) & (home > 0)
    copies = (
        F.when(to_next & to_previous, F.array(home, home + 1, home - 1))
        .when(to_next, F.array(home, home + 1))
        .when(to_previous, F.array(home, home - 1))
        .otherwise(F.array(home))
    )
    if not (back or ahead):
        return df.select("*", home.alias(BLOCK), F.lit(True).alias(OWN))
    spread = df.select("*", F.explode(copies).alias(BLOCK))
    return spread.withColumn(OWN, F.col(BLOCK) == home)


def with_history(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    *stages: Stage,
    back: int = 0,
    ahead: int = 0,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows behind and ``ahead`` rows in front.

    ``order`` must be a dense row position within ``by``. Each stage maps the window to new columns;
    later stages may use the columns of earlier ones. All stages share one shuffle and one sort.
    """
    spread = halo_blocks(df, order, back, ahead, rows)
    window = Window.partitionBy(*by, BLOCK).orderBy(order)
    for stage in stages:
        spread = spread.select("*", *[column.alias(name) for name, column in stage(window).items()])
    return spread.where(F.col(OWN)).drop(BLOCK, OWN)
