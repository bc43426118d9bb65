"""The driver's tables as the library's inputs: bodies, a change log, its initial state, queries, cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import numbered
from ..plans.corpus import add_alternates, distinct_tokens, label_df, plan_rare, token_labels

#: Substitutions of labels for a query's second alternative.
ALTERNATES = {"the": "of", "and": "to", "was": "is", "der": "die", "la": "de", "with": "by", "for": "at", "that": "it"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(prefix: str, number: Column) -> Column:
    return F.format_string(prefix + "%06d", number)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(code("b", F.col("doc_id")).alias("body"), token_labels(F.col("text")).alias("labels"))


def n_docs(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "documents").count()


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, seq, pos, ident, body): one change a batch; errors are tombstones."""
    n = n_docs(spark, sf_dir)
    e = table(spark, sf_dir, "events").withColumn("shard", (F.col("user_id") % 3).cast("int"))
    body = F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(code("b", F.col("event_id") % n))
    return numbered(e.select("shard", "event_id", code("u", F.col("user_id")).alias("ident"), body.alias("body")), "shard", "event_id", "seq").select(
        "shard", "seq", F.lit(0).alias("pos"), "ident", "body")


def initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = n_docs(spark, sf_dir)
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select((F.col("user_id") % 3).cast("int").alias("shard"), code("u", F.col("user_id")).alias("ident"), code("b", F.col("user_id") % n).alias("body"))


def body_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body, label): the labels of bodies, a row each."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(code("b", F.col("doc_id")).alias("body"), F.explode(distinct_tokens(F.col("text"))).alias("label"))


def query_terms(spark: SparkSession, sf_dir: str, df: DataFrame | None = None) -> DataFrame:
    """(query_id, alt, pos, label): for each benchmark item its 4 rarest labels that 2 % of the documents hold; for even
    items a second alternative by ALTERNATES. df (label, df): the labels' frequencies, if at hand."""
    n = n_docs(spark, sf_dir)
    df = (label_df(bodies(spark, sf_dir)) if df is None else df.select("label", "df")).where(F.col("df") * 50 >= n)
    items = table(spark, sf_dir, "benchmark").select(F.format_string("q%03d", "item_id").alias("query_id"), "item_id", token_labels(F.col("text")).alias("labels"))
    base = plan_rare(items, df, "query_id", 4)
    even = items.where("item_id % 2 = 0").select("query_id")
    return add_alternates(base, ALTERNATES, even)


def cuts(log: DataFrame) -> DataFrame:
    """(cut_id, shard, at): 0, 25, 50, 75 and 100 % of each shard's log."""
    top = log.groupBy("shard").agg(F.max("seq").alias("top"))
    return top.withColumn("cut_id", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("cut_id", "shard", F.expr("top * cut_id div 4").alias("at"))


def batches(log: DataFrame, size: int = 4) -> DataFrame:
    """The log in batches of up to `size` changes of distinct idents: (shard, seq, ident, body)."""
    b = log.withColumn("b", F.expr(f"(seq - 1) div {size} + 1"))
    return b.groupBy("shard", "b", "ident").agg(F.max(F.struct("seq", "body")).alias("last")).select(
        "shard", F.col("b").alias("seq"), "ident", F.col("last.body").alias("body"))


def deliveries(log: DataFrame) -> DataFrame:
    """The log as it might arrive: late by up to four places, every 17th change twice, every 5th of those with another body; and faults:
    an unknown body before every 53rd change, one ident twice in a batch before every 59th, every 1000th also without a valid seq."""
    known = F.lit("b000000")
    first = log.select("shard", "seq", "ident", "body", (F.col("seq") * 10 + F.col("seq") * 7 % 5 * 10).alias("arrival"))
    again = log.where("seq % 17 = 0").select(
        "shard", "seq", "ident", F.when(F.col("seq") % 5 == 0, known).otherwise(F.col("body")).alias("body"), (F.col("seq") * 10 + 55).alias("arrival"))
    unknown = log.where("seq % 53 = 0").select("shard", "seq", "ident", F.lit("b00000x").alias("body"), (F.col("seq") * 10 - 3).alias("arrival"))
    twice = log.where("seq % 59 = 0").select("shard", "seq", "ident", F.explode(F.array("body", known)).alias("body"), (F.col("seq") * 10 - 4).alias("arrival"))
    unplaced = log.where("seq % 1000 = 0").select("shard", (-F.col("seq")).alias("seq"), "ident", "body", (F.col("seq") * 10 - 5).alias("arrival"))
    return first.unionByName(again).unionByName(unknown).unionByName(twice).unionByName(unplaced)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, text): each document's labels as code of two functions of one name; every 10th file cannot be parsed."""
    call = F.transform("labels", lambda x: F.concat(F.lit("        n_"), x, F.lit(".a_"), x, F.lit("(w_"), x, F.lit(")\n")))
    head, tail = "class Doc:\n    def body(self):\n        pass\n", "    def body(self):\n        return w_last\n"
    broken = F.when(F.col("doc_id") % 10 == 7, "def (").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", token_labels(F.col("text")).alias("labels"))
    return docs.select(F.coalesce("source", F.lit("none")).alias("project"), F.concat(code("b", F.col("doc_id")), F.lit(".py")).alias("path"),
                       F.concat(F.lit(head), F.array_join(call, ""), F.lit(tail), broken).alias("text"))
