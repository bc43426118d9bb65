"""Scores, postings, exact top-k, prefixes and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import bucketed, staged
from .log import final_assignments, state_as_of, versions


def plan_score(labels: Column, plan: Column) -> Column:
    """Of a plan (arrays of labels) the most labels that one alternative has among labels; 0 for an empty plan."""
    return F.coalesce(F.array_max(F.transform(plan, lambda alt: F.size(F.array_intersect(alt, labels)))), F.lit(0))


def build_postings(state: DataFrame, bodies: DataFrame) -> DataFrame:
    """(shard, label, ident, body) of a state; bodies (body, labels) or, a row a label, (body, label)."""
    return state.join(bodies, "body").select("shard", "label" if "label" in bodies.columns else F.explode("labels").alias("label"), "ident", "body")


class PostingIndex:
    """Stored postings (label, holder): a table bucketed by (label, part) and sorted, so that a lookup moves only the labels that are asked for.

    A label of over `most` postings is dealt to parts by its holders' hash, each in a bucket of its own. Which labels that are is guessed from the holders whose hash is 0 modulo
    `every`; a wrong guess makes a part larger or smaller and no posting is lost, since the parts of each label are then read off the table, with its frequency: labels (label, df, parts).
    """

    def __init__(self, postings: DataFrame, holder: str, name: str, most: int = 1 << 20, a_bucket: int = 1 << 22, every: int = 64):
        spark = postings.sparkSession
        some = staged(postings.where(F.pmod(F.xxhash64(holder), F.lit(every)) == 0).groupBy("label").agg((F.count("*") * every).alias("n")), f"{name}_guess")
        total = some.agg(F.sum("n")).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // a_bucket))
        large = some.where(F.col("n") > most).select("label", F.ceil(F.col("n") / most).cast("int").alias("large"))
        part = F.pmod(F.xxhash64(holder), F.coalesce("large", F.lit(1))).cast("int")
        keyed = postings.join(large, "label", "left").select("label", part.alias("part"), holder)
        self.table = bucketed(keyed.repartition(buckets, "label", "part"), ("label", "part"), buckets, name)
        parts = self.table.groupBy("label", "part").agg(F.count("*").alias("n"))
        self.labels = staged(parts.groupBy("label").agg(F.sum("n").alias("df"), (F.max("part") + 1).alias("parts")), f"{name}_labels")
        self.holder = holder

    def lookup(self, labels: DataFrame) -> DataFrame:
        """(label, holder) of all postings of labels (label, ...)."""
        asked = labels.select("label").distinct().join(self.labels, "label").select("label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return self.table.join(asked, ["label", "part"]).select("label", self.holder)


def apply_to_postings(postings: DataFrame, changes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Postings after the changes: those of touched idents go, those of their live last values come."""
    final = final_assignments(changes)
    return postings.join(final.select("shard", "ident"), ["shard", "ident"], "left_anti").unionByName(build_postings(final.where("body is not null"), bodies))


def score_bodies(bodies: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, body, score), positive ones only: each distinct body is scored once, whoever holds it when. bodies (body, labels), or (body, label) as an index's lookup gives them."""
    held = bodies if "label" in bodies.columns else bodies.select("body", F.explode("labels").alias("label"))
    hits = held.join(terms.select("query_id", "alt", "label").distinct(), "label")
    return hits.groupBy("query_id", "body", "alt").agg(F.count("*").alias("n")).groupBy("query_id", "body").agg(F.max("n").alias("score"))


def best_first(*keys: str) -> W:
    return W.partitionBy(*keys).orderBy(F.desc("score"), "ident")


def top_n(rows: DataFrame, keys: tuple, n: int) -> DataFrame:
    """The first n rows of each key by (score descending, ident), with their rank from 1. n is a literal, so tasks prune before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(best_first(*keys))).where(F.col("rank") <= n)


def merge_topk(rows: DataFrame, keys: tuple, k: int) -> DataFrame:
    """Top k over all shards: of each shard first, then of those."""
    return top_n(top_n(rows, (*keys, "shard"), k).drop("rank"), keys, k)


def rank_state(state: DataFrame, scores: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Rows of a state (..., shard, ident, body) with each query's positive score; idents in exclude (shard, ident) left out."""
    rows = state if exclude is None else state.join(exclude.select("shard", "ident").distinct(), ["shard", "ident"], "left_anti")
    return rows.join(scores, "body")


def rank_postings(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, shard, ident, body, score) from postings (shard, label, ident, body) and terms (query_id, alt, label): of an ident's labels
    as many as one alternative has; only postings of queried labels are counted."""
    hits = postings.join(terms.select("query_id", "alt", "label").distinct(), "label")
    n = hits.groupBy("query_id", "shard", "ident", "body", "alt").agg(F.count("*").alias("n"))
    return n.groupBy("query_id", "shard", "ident", "body").agg(F.max("n").alias("score"))


def prefix(ranked: DataFrame, keys: tuple, length: int) -> DataFrame:
    """The first `length` rows of each key as rows with rank, each with the boundary: score and ident of the row after them (null: none).

    With length 0 a key gives one row of rank 0 that has only the boundary.
    """
    some = top_n(ranked, keys, length + 1)
    beyond = F.max(F.when(F.col("rank") == length + 1, F.struct("score", "ident"))).over(W.partitionBy(*keys))
    some = some.withColumn("beyond", beyond).withColumn("tail_score", F.col("beyond.score")).withColumn("tail_ident", F.col("beyond.ident")).drop("beyond")
    if length:
        return some.where(F.col("rank") <= length)
    return some.withColumn("rank", F.lit(0)).withColumn("ident", F.lit(None).cast("string")).withColumn("body", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("long"))


def delta(changes: DataFrame, scores: DataFrame, bounds: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(dirty (shard, ident), rows): what a suffix touched, and the top k of its live last assignments for each (query, shard)."""
    final = final_assignments(changes.join(bounds, "shard").where((F.col("seq") > F.col("lo")) & (F.col("seq") <= F.col("hi"))))
    rows = top_n(rank_state(final.where("body is not null"), scores), ("query_id", "shard"), k)
    return final.select("shard", "ident"), rows


def exact_topk(initial: DataFrame, changes: DataFrame, bodies: DataFrame, terms: DataFrame, cuts: DataFrame, k: int = 5, scores: DataFrame | None = None) -> DataFrame:
    """(cut_id, query_id, rank, shard, ident, body, score): the k best of every query at every cut, from the log alone. scores: those of the bodies, if at hand."""
    state = state_as_of(versions(initial, changes), cuts)
    rows = rank_state(state, score_bodies(bodies, terms) if scores is None else scores)
    return merge_topk(rows, ("cut_id", "query_id"), k).select("cut_id", "query_id", F.col("rank").cast("long").alias("rank"), "shard", "ident", "body", "score")


def tfidf_rank(state: DataFrame, bodies: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, ident, weight): cosine of the query's labels (idf) and the body's (idf), idf = ln(N / df) over the state."""
    post = build_postings(state, bodies)
    n = state.count()
    idf = post.groupBy("label").agg((F.log(F.lit(float(n)) / F.count("*"))).alias("idf"))
    w = post.join(idf, "label")
    norm = w.groupBy("ident").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    hit = w.join(terms.where("alt = 0").select("query_id", "label"), "label").groupBy("query_id", "ident").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    return hit.join(norm, "ident").where("norm > 0").select("query_id", "ident", (F.col("dot") / F.col("norm")).alias("weight"))


def rank_flips(before: DataFrame, after: DataFrame, same: DataFrame, k: int) -> DataFrame:
    """Pairs of documents that did not change and yet changed places, since the weights of all labels move with the corpus.

    before, after (query_id, ident, weight), same (ident) -> (query_id, ident, other): of the k best of a query before, among same, those
    of which ident weighed more than other before and less after. k is a literal: a query has at most k (k - 1) / 2 pairs.
    """
    w = W.partitionBy("query_id").orderBy(F.desc("weight"), "ident")
    best = before.join(same.select("ident"), "ident", "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    best = best.join(after.select("query_id", "ident", F.col("weight").alias("now")), ["query_id", "ident"], "left").withColumn("now", F.coalesce("now", F.lit(0.0)))
    a, b = best.alias("a"), best.alias("b")
    flips = a.join(b, "query_id").where((F.col("a.rank") < F.col("b.rank")) & (F.col("a.weight") > F.col("b.weight")) & (F.col("a.now") < F.col("b.now")))
    return flips.select("query_id", F.col("a.ident").alias("ident"), F.col("b.ident").alias("other"))


def rank_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """(cut_id, query_id, stability): the share of the ids in `after` (cut_id, query_id, ident) that `before` (query_id, ident) has."""
    b = before.select("query_id", "ident").distinct().withColumn("had", F.lit(1))
    return after.join(b, ["query_id", "ident"], "left").groupBy("cut_id", "query_id").agg((F.count("had") / F.count("*")).alias("stability"))
