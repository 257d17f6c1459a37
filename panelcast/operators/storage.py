"""Save points: the only places where the library writes intermediate data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; below the warehouse where the session names none.

    Both are folders that a cluster points at storage all its machines reach.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def save_point(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder so later uses read it instead of recomputing it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet below the checkpoint folder, of which later reads take the columns they need."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as an address with a scheme: without one it lies on the session's default file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    address = system.makeQualified(place).toString()
    return "file://" + address.removeprefix("file:") if address.startswith("file:/") and not address.startswith("file://") else address
