"""Ways to answer at a cut besides the overlay: a cache by cut, a full mirror, and the choice of an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .log import frontiers, state_as_of, versions
from .rank import merge_topk, rank_state


def cut_cache(requests: DataFrame) -> DataFrame:
    """requests (tick, query_id, shard, cut, available) with outcome: hit (the entry held is of this very cut), fetched or missing.

    An entry survives an outage, but one of another cut is never served: then the shard is missing.
    """
    before = W.partitionBy("query_id", "shard").orderBy("tick").rowsBetween(W.unboundedPreceding, -1)
    held = F.last(F.when(F.col("available"), F.col("cut")), ignorenulls=True).over(before)
    return requests.withColumn("outcome", F.when(held == F.col("cut"), "hit").when(F.col("available"), "fetched").otherwise("missing"))


def cached_topk(outcomes: DataFrame, shard_rows: DataFrame, k: int) -> DataFrame:
    """(tick, query_id, rank, shard, ident, body, score) from the shards that outcomes serve; shard_rows has each shard's top k by (cut, query_id)."""
    served = outcomes.where("outcome <> 'missing'").select("tick", "query_id", "shard", "cut")
    return merge_topk(served.join(shard_rows, ["cut", "query_id", "shard"]).drop("cut"), ("tick", "query_id"), k)


def mirror_topk(initial: DataFrame, feed: DataFrame, scores: DataFrame, cuts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, coverage): answers from complete states folded from the feed. A shard counts at a cut only if its feed has no gap below it.

    coverage is (cut_id, covered), the number of shards that count.
    """
    reach = frontiers(feed)
    cover = cuts.join(reach, "shard", "left").withColumn("counts", F.coalesce("frontier", F.lit(0)) >= F.col("at"))
    good = cover.where("counts").select("cut_id", "shard", "at")
    rows = merge_topk(rank_state(state_as_of(versions(initial, feed), good), scores), ("cut_id", "query_id"), k)
    return rows, cover.groupBy("cut_id").agg(F.count_if("counts").alias("covered"))


def pick_owner(replies: DataFrame, owners: DataFrame, cut: DataFrame, rule: str) -> DataFrame:
    """(query_id, shard, owner, at): of each (query, shard) the first eligible reply in the owners' order; no row if none is.

    replies (query_id, shard, owner, at, covered), owners (shard, owner, place), cut (shard, cut). Rule acquire wants the cut itself,
    repair a position up to it whose suffix is covered.
    """
    fit = {"acquire": F.col("at") == F.col("cut"), "repair": (F.col("at") <= F.col("cut")) & F.col("covered")}[rule]
    able = replies.join(owners, ["shard", "owner"]).join(cut, "shard").where(fit)
    return able.groupBy("query_id", "shard").agg(F.min_by(F.struct("owner", "at"), "place").alias("o")).select("query_id", "shard", "o.*")


def unverified_topk(ranked: DataFrame, replied: DataFrame, shards: int, k: int) -> tuple[DataFrame, DataFrame]:
    """ranked (query_id, shard, ident, body, score) from indexes of any age, replied (query_id, shard) -> (rows with rank, (query_id, covered, claim)).

    The k best of the shards that replied. Complete is claimed where all did, whatever their age: availability taken for freshness.
    """
    rows = merge_topk(ranked.join(replied.select("query_id", "shard").distinct(), ["query_id", "shard"], "left_semi"), ("query_id",), k)
    heads = replied.groupBy("query_id").agg(F.count_distinct("shard").alias("covered"))
    return rows, heads.select("query_id", "covered", (F.col("covered") == shards).alias("claim"))
