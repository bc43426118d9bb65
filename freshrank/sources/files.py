"""Sources and sinks."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def pack(files: DataFrame, root: str) -> None:
    """files (path, content) as a Parquet table: a tree of many small files in a few large ones, each a row with its path and its bytes."""
    files.select("path", F.col("content").cast("binary").alias("content")).write.parquet(root)


def _packed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content) of a packed tree's files whose name fits glob (without braces)."""
    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.schema("path string, content binary").parquet(root).where(name.rlike("^" + fnmatch.translate(glob).replace(r"\Z", r"\z")))


def read_sources(spark: SparkSession, root: str, glob: str = "*.py", packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files (path, text), excluded (path, reason)) of a tree of text files, loose or packed; those that are not UTF-8 are excluded."""
    raw = _packed(spark, root, glob) if packed else spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    fine = F.is_valid_utf8(F.col("content").cast("string"))
    return (raw.where(fine).select("path", F.decode("content", "UTF-8").alias("text")),
            raw.where(~fine).select("path", F.lit("UnicodeDecodeError").alias("reason")))


def read_traces(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Nested run records, one JSON document a file, gzip or not."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_table_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as strings; an empty one is an error."""
    df = spark.read.option("header", True).csv(path)
    if not df.head(1):
        raise ValueError(f"no rows in {path}")
    return df


def last_match_per_file(spark: SparkSession, path: str, pattern: str, packed: bool = False) -> DataFrame:
    """(path, found): the last match's first group in each text file, loose or packed; null where there is none."""
    if packed:
        raw = _packed(spark, path).select("path", F.col("content").cast("string").alias("value"))
    else:
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    hits = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    return raw.select("path", F.when(F.size(hits) > 0, F.element_at(hits, -1)).alias("found"))


def write_rows_csv(frames: list[DataFrame], path: str) -> None:
    """Rows of several shapes as one CSV with the union of their columns."""
    first, *others = frames
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    first.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, gzip: bool = False) -> None:
    """JSON that readers see whole or not at all."""
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").json(path)


def flatten_observations(traces: DataFrame, keys: list[str], records: str = "records", observations: str = "observations") -> DataFrame:
    """A row for each (run, record, policy): keys of the run, the record's scalar fields and the policy's metrics."""
    r = traces.select(*keys, F.explode(records).alias("r"))
    o = r.select(*keys, F.col("r"), F.explode(f"r.{observations}").alias("policy", "m"))
    plain = [f.name for f in o.schema["r"].dataType.fields if f.name != observations]
    return o.select(*keys, *[F.col(f"r.{c}") for c in plain], "policy", "m.*")
