"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only local mode may do without it."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-"))
    return _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again, which ends its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: tuple, buckets: int, name: str) -> DataFrame:
    """As staged, but in buckets by keys and sorted by them: joins on these keys move none of its rows."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    (df.write.format("parquet").option("path", f"{shared_dir(spark)}/{table}").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone: the files stay, and so does what out knows of them
    return out
