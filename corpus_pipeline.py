"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing to target weights, packing.

Each stage is one of the operators of freshrank.llm applied to what the stage before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshrank.llm import common, exact, mixing, near, packing, toxicity
from freshrank.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3, by a net that learns from a bounded sample of the labelled rows among docs.

    Null and empty texts have a score as others do; repeated rows have one score; no rows, or no labels of both kinds: nothing goes.
    """
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return common.unpacked(toxicity.toxicity(common.packed(docs), net).where("score < 0.3"), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the row that exact dedup keeps: null counts as empty, ties go to the smaller doc_id, one of repeated rows stays."""
    rows, decided = exact.exact_dedup(docs)
    kept = decided.where("kept").select("block", "row")
    return common.unpacked(common.only(rows, kept), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one document, that of the smallest doc_id; texts without words, null among them, are one group.

    op4's fingerprints and Gray-order index give the first links, each checked by the sets; the pairs that fingerprints miss are looked for by an exact way.
    """
    return near.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources: documents as often as they are taken, the last in part. Null is a source too; texts without words come once."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix_sources", mix_sources), ("pack", pack_windows)]

#: Training a net, a search of components and tokenizing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
