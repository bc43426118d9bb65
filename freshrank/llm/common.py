"""What several of the operators share: the scratch folder, blocks of rows, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white space itself, as SQL functions take it.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 8 << 20

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only in local mode."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage ends there, so that
    a lost executor costs no more than the tasks it ran, and its size is known to the planner."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As staged, but in buckets by key: grouping or cogrouping it by key then moves none of its rows."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = fresh_path(spark, name)
    (df.write.format("parquet").option("compression", "zstd").option("path", path)
       .bucketBy(partitions(spark), key).saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone: the files stay, and so does what out knows of them
    return out


def blocks(docs: DataFrame, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) in blocks of about block_bytes of text, bucketed by block.

    Adds block (long) and row (int, from 0 in its block). A block is what one call of a Python function
    holds in memory; a longer text makes a block alone. Rows stay in the task that read them, so this
    needs no shuffle. (block, row) tells rows apart even where all their columns are equal.
    """
    schema = StructType(list(docs.schema)).add("block", "long").add("row", "integer")

    def cut(batches):
        first = TaskContext.get().partitionId() << 32
        block, held, row = first, 0, 0
        for batch in batches:
            ids, rows = [], []
            for n in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
                if row and held + n > block_bytes:
                    block, held, row = block + 1, 0, 0
                ids.append(block)
                rows.append(row)
                held, row = held + n + 64, row + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.int64()), pa.array(rows, pa.int32())], [*batch.schema.names, "block", "row"])

    return bucketed(docs.mapInArrow(cut, schema), "block", name)


def packed(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, text, rest): whatever else it has, by whatever names, lies in one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("rest")] if others else []))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[c if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in columns])


def only(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of blocks that chosen (block, row) names; texts stay where they are."""

    def some(table: pa.Table, own: pa.Table) -> pa.Table:
        return table.filter(pc.is_in(table.column("row"), own.column("row").combine_chunks())) if len(table) else table

    return rows.groupBy("block").cogroup(chosen.select("block", "row").groupBy("block")).applyInArrow(some, rows.schema)


def texts(column) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def joined_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _mark(edges: DataFrame) -> tuple:
    """A digest of an edge set that does not depend on the order of its rows."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(src, dst))")).first())


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the undirected edges (src, dst): (node, root), root the least node.

    Large-star and small-star in turn until nothing changes: every round joins each node's neighbours to
    their minimum. Minima are taken map-side first and written apart, so that the joins can split a hub. Nodes without
    an edge to another node do not appear. All rounds are tables in the shared folder.
    """
    a, b = F.col("src"), F.col("dst")
    now = staged(edges.where((a != b)).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct(), name)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(b.alias("src"), a.alias("dst")))
        least = staged(both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m")), name)
        large = both.join(least, "src").where(b > a).select(b.alias("src"), F.col("m").alias("dst")).where(a != b).distinct()
        large = staged(large, name)
        least = staged(large.groupBy("src").agg(F.min("dst").alias("m")), name)
        small = (large.join(least, "src").where(b != F.col("m")).select(b.alias("src"), F.col("m").alias("dst"))
                 .unionByName(least.select("src", F.col("m").alias("dst"))))
        now = staged(small.where(a != b).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct(), name)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root"))).distinct()
