"""Answers at a cut from a lagging index, and candidate buffers (tokens) that a log suffix carries forward.

A token is held as two tables: heads (query_id, shard, at, capacity, generation, tail_score, tail_ident) and rows
(query_id, shard, ident, body, score). No live row that a token omits ranks before its tail; a null tail: none is omitted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .log import final_assignments, state_at
from .rank import best_first, merge_topk, rank_state, top_n

KEYS = ("query_id", "shard")


def key_of(score: Column, ident: Column) -> Column:
    """A rank key as a struct that orders as ranks do; null for a null score."""
    return F.when(score.isNotNull(), F.struct((-score.cast("long")).alias("neg"), ident.alias("ident")))


def index_at(initial: DataFrame, changes: DataFrame, at: DataFrame) -> DataFrame:
    return state_at(initial, changes, at)


def overlay_topk(index: DataFrame, final: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, shard, ident, body, score): index rows that the suffix has not touched and its live last assignments."""
    clean = rank_state(index, scores, exclude=final)
    fresh = rank_state(final.where("body is not null"), scores)
    return merge_topk(clean.unionByName(fresh), ("query_id",), k)


def status_of(missing: Column, blockers: Column) -> Column:
    return F.when(missing > 0, "partial").when(blockers > 0, "rank-underdetermined").otherwise("complete")


def blockers(rows: DataFrame, tails: DataFrame, k: int) -> DataFrame:
    """tails (query_id, shard, tail_score, tail_ident) with blocks: a row beyond the tail could still be among the first k of rows."""
    last = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max(key_of(F.col("score"), F.col("ident"))).alias("last"))
    t = tails.join(last, "query_id", "left").withColumn("tail", key_of(F.col("tail_score"), F.col("tail_ident")))
    short = F.coalesce("n", F.lit(0)) < k
    return t.withColumn("blocks", F.col("tail").isNotNull() & (short | (F.col("last") >= F.col("tail")))).drop("n", "last", "tail")


def certify(prefix_rows: DataFrame, tails: DataFrame, final: DataFrame, scores: DataFrame, shards: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Prefix and delta: (rows, heads). Rows are the k best of prefix rows not dirty and of the delta; heads say query_id,
    status, missing and blockers (counts). tails has a row for each (query, shard) that replied."""
    kept = prefix_rows.join(final.select("shard", "ident"), ["shard", "ident"], "left_anti").select("query_id", "shard", "ident", "body", "score")
    fresh = top_n(rank_state(final.where("body is not null"), scores), KEYS, k).select("query_id", "shard", "ident", "body", "score")
    rows = top_n(kept.unionByName(fresh), ("query_id",), k)
    return rows, heads_of(rows, tails, shards, k)


def heads_of(rows: DataFrame, tails: DataFrame, shards: int, k: int) -> DataFrame:
    b = blockers(rows, tails, k).groupBy("query_id").agg(F.count("*").alias("replied"), F.count_if("blocks").alias("blockers"))
    b = b.withColumn("missing", F.lit(shards) - F.col("replied"))
    return b.select("query_id", status_of(F.col("missing"), F.col("blockers")).alias("status"), "missing", "blockers")


def status_lists(rows: DataFrame, tails: DataFrame, grid: DataFrame, k: int) -> DataFrame:
    """(query_id, status, missing, blockers): the shards of grid (query_id, shard) that tails lacks, and those whose tail could still enter the first k of rows, both in
    order. The lists are as long as a query has shards; blockers are told also where the status is partial."""
    told = blockers(rows, tails, k).select(*KEYS, "blocks", F.lit(True).alias("replied"))
    j = grid.select(*KEYS).join(told, list(KEYS), "left")
    shards = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("shard"))))
    g = j.groupBy("query_id").agg(shards(F.col("replied").isNull()).alias("missing"), shards(F.col("blocks")).alias("blockers"))
    return g.select("query_id", status_of(F.size("missing"), F.size("blockers")).alias("status"), "missing", "blockers")


def acquire_tokens(state: DataFrame, scores: DataFrame, grid: DataFrame, capacity: int, k: int = 1, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """(heads, rows) from the first `capacity` rows of a state; grid (query_id, shard, at) names the tokens, also those of no rows. A capacity below k, or
    above `most`, is an error: no later step looks at more rows than that."""
    if not k <= capacity <= most:
        raise ValueError(f"capacity {capacity} is not between k = {k} and {most}")
    some = top_n(rank_state(state, scores), KEYS, capacity + 1).join(grid.select(*KEYS), list(KEYS), "left_semi")
    tail = some.where(F.col("rank") == capacity + 1).select(*KEYS, F.col("score").alias("tail_score"), F.col("ident").alias("tail_ident"))
    heads = grid.join(tail, list(KEYS), "left").select(*KEYS, "at", F.lit(capacity).alias("capacity"), F.lit(0).alias("generation"), "tail_score", "tail_ident")
    return heads, some.where(F.col("rank") <= capacity).select(*KEYS, "ident", "body", "score")


def keep_tokens(heads: DataFrame, rows: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """(heads, rows) as one table that keep(df, name) writes: both come from the same pool, which one job so makes once."""
    h = heads.select(F.lit(True).alias("head"), *KEYS, "at", "capacity", "generation", "tail_score", "tail_ident")
    r = rows.select(F.lit(False).alias("head"), *KEYS, "ident", "body", "score")
    both = keep(h.unionByName(r, allowMissingColumns=True), "tokens")
    return both.where("head").select(*h.columns[1:]), both.where("not head").select(*r.columns[1:])


def fold_suffixes(changes: DataFrame, heads: DataFrame, hi: DataFrame) -> DataFrame:
    """(shard, at, ident, body): the last assignments since each position at which tokens of a shard stand, folded once however many tokens stand there."""
    spans = heads.select("shard", "at").distinct().join(hi, "shard").where("at < hi")
    return final_assignments(changes.join(spans, "shard").where("seq > at and seq <= hi"), ("shard", "at"))


def advance_tokens(heads: DataFrame, rows: DataFrame, folded: DataFrame, hi: DataFrame, scores: DataFrame, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Tokens over one suffix each: folded (shard, at, ident, body), or (shard, ident, body) if all of a shard stand at one place, are its last assignments, hi (shard, hi) its end.

    Touched rows go, live positive last values come, the first `capacity` stay; the tail is the lesser of itself and the
    first row that was dropped. A token already at hi stays as it is. The tail never rises here. The suffix meets the scores by body and the tokens' rows by
    ident: what moves are changes, hits and rows held, never queries x changes.
    """
    on = [c for c in ("shard", "at") if c in folded.columns]
    moving = heads.join(hi, "shard").where("at < hi").select(*KEYS, "at")
    held = rows.select(*KEYS, "ident", "body", "score").join(moving.withColumnRenamed("at", "since"), list(KEYS), "left").alias("r")
    touched = folded.select(*on, "ident").alias("f")
    same = (F.col("r.shard") == F.col("f.shard")) & (F.col("r.ident") == F.col("f.ident"))
    same = same & (F.col("r.since") == F.col("f.at") if "at" in on else F.col("r.since").isNotNull())
    clean = held.join(touched, same, "left_anti").select(*KEYS, "ident", "body", "score")
    hits = folded.where("body is not null").join(scores, "body")
    fresh = hits.join(moving if "at" in on else moving.drop("at"), ["query_id", *on]).select(*KEYS, "ident", "body", "score")
    pool = clean.unionByName(fresh).withColumn("rank", F.row_number().over(best_first(*KEYS))).where(F.col("rank") <= most + 1).join(heads.select(*KEYS, "capacity"), list(KEYS))
    dropped = pool.where(F.col("rank") == F.col("capacity") + 1).select(*KEYS, F.col("score").alias("d_score"), F.col("ident").alias("d_ident"))
    h = heads.join(dropped, list(KEYS), "left").join(hi, "shard")
    tail = F.least(key_of(F.col("tail_score"), F.col("tail_ident")), key_of(F.col("d_score"), F.col("d_ident")))
    h = h.withColumn("tail", tail)
    out = h.select(*KEYS, F.greatest("at", "hi").alias("at"), "capacity", (F.col("generation") + (F.col("at") < F.col("hi")).cast("int")).alias("generation"),
                   (-F.col("tail.neg")).alias("tail_score"), F.col("tail.ident").alias("tail_ident"))
    return out, pool.where("rank <= capacity").select(*KEYS, "ident", "body", "score")


def merge_tokens(heads: DataFrame, rows: DataFrame, shards: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows with rank, heads (query_id, status, missing, blockers)) of the tokens of one cut."""
    best = top_n(rows, ("query_id",), k)
    return best, heads_of(best, heads, shards, k)


def repair_lengths(queries: DataFrame, dirty: DataFrame, k: int, base: int, reserve: int = 0, most: int = 64) -> DataFrame:
    """queries (query_id, shard) with length: k + distinct idents changed since the feed's floor + reserve, at least base; beyond most it is
    most and not guaranteed."""
    need = F.coalesce("dirty", F.lit(0)) + k + reserve
    d = queries.join(dirty, "shard", "left").withColumn("required", F.least(need, F.lit(most)))
    return d.select("query_id", "shard", F.greatest("required", F.lit(base)).alias("length"), (need <= most).alias("guaranteed"))


def _refetch(heads: DataFrame, rows: DataFrame, pick: DataFrame, state: DataFrame, scores: DataFrame, hi: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(heads, rows) with those of pick (query_id, shard, length) replaced by prefixes of the state at hi."""
    wanted = pick.join(scores, "query_id")  # few tokens need a prefix: only their queries' scores meet the state
    some = state.join(wanted, ["shard", "body"]).withColumn("rank", F.row_number().over(best_first(*KEYS))).where(F.col("rank") <= most + 1)
    tail = some.where("rank = length + 1").select(*KEYS, F.col("score").alias("tail_score"), F.col("ident").alias("tail_ident"))
    fresh = pick.join(tail, list(KEYS), "left").join(hi, "shard").select(
        *KEYS, F.col("hi").alias("at"), F.col("length").cast("int").alias("capacity"), F.lit(0).alias("generation"), "tail_score", "tail_ident")
    heads = heads.join(pick, list(KEYS), "left_anti").select(*fresh.columns).unionByName(fresh)
    rows = rows.join(pick, list(KEYS), "left_anti").unionByName(some.where("rank <= length").select(*KEYS, "ident", "body", "score"))
    return heads, rows


def repair_round(heads: DataFrame, rows: DataFrame, state: DataFrame, scores: DataFrame, hi: DataFrame, done: DataFrame, lengths: DataFrame, shards: int, k: int, most: int = 64):
    """One set-based round: of each query that is not partial its most threatening blocker not repaired yet gets a fresh prefix of the
    state at the cut. Returns (heads, rows, repaired (query_id, shard))."""
    best, answer = merge_tokens(heads, rows, shards, k)
    b = blockers(best, heads, k).where("blocks").join(answer.where("missing = 0").select("query_id"), "query_id", "left_semi").join(done, list(KEYS), "left_anti")
    first = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("tail_score"), "tail_ident"))
    pick = b.withColumn("n", first).where("n = 1").select(*KEYS).join(lengths, list(KEYS))
    return *_refetch(heads, rows, pick, state, scores, hi, most), pick.select(*KEYS)


def missing_shards(heads: DataFrame, grid: DataFrame, epochs: DataFrame, cover: DataFrame) -> DataFrame:
    """(query_id, shard, why) of grid (query_id, shard, cut): no token, another epoch, past the cut, or a suffix that the feed has not in whole.

    heads carry an epoch; epochs (shard, epoch) are those in force; cover (shard, base, frontier) says what the feed keeps.
    """
    t = heads.select(*KEYS, "at", F.col("epoch").alias("held"))
    j = grid.join(t, list(KEYS), "left").join(epochs, "shard", "left").join(cover, "shard", "left")
    fed = (F.col("at") == F.col("cut")) | ((F.col("base") <= F.col("at")) & (F.col("cut") <= F.col("frontier")))
    why = (F.when(F.col("at").isNull(), "no-token").when(~F.col("held").eqNullSafe(F.col("epoch")), "epoch").when(F.col("at") > F.col("cut"), "past-cut")
           .when(~F.coalesce(fed, F.lit(False)), "uncovered"))
    return j.withColumn("why", why).where("why is not null").select(*KEYS, "why")


def rebind_tokens(heads: DataFrame, epochs: DataFrame) -> DataFrame:
    """Tokens of shards in epochs (shard, new_epoch) under that epoch, a generation later; the others as they are. An epoch that is not later is an error."""
    j = heads.join(epochs, "shard", "left")
    later = F.col("new_epoch") > F.col("epoch")
    epoch = F.when(F.col("new_epoch").isNull(), F.col("epoch")).when(later, F.col("new_epoch")).otherwise(F.raise_error(F.lit("new epoch required")))
    return j.withColumn("generation", F.col("generation") + F.col("new_epoch").isNotNull().cast("int")).withColumn("epoch", epoch).select(heads.columns)


def own_blockers(heads: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, shard): tokens whose own k-th row does not come before their own tail."""
    kth = top_n(rows, KEYS, k).where(F.col("rank") == k).select(*KEYS, key_of(F.col("score"), F.col("ident")).alias("kth"))
    tail = key_of(F.col("tail_score"), F.col("tail_ident"))
    return heads.join(kth, list(KEYS), "left").where(tail.isNotNull() & (F.col("kth").isNull() | (F.col("kth") >= tail))).select(*KEYS)


def refill_local(heads: DataFrame, rows: DataFrame, state: DataFrame, scores: DataFrame, hi: DataFrame, lengths: DataFrame, k: int, most: int = 64):
    """Overfetch and refill with a stop in each shard: every token that blocks itself gets a fresh prefix, whatever the others hold.

    No refill depends on another, so one set-based pass does all. Returns (heads, rows, refilled (query_id, shard)).
    """
    pick = own_blockers(heads, rows, k).join(lengths, list(KEYS))
    return *_refetch(heads, rows, pick, state, scores, hi, most), pick.select(*KEYS)


def refill_global(heads: DataFrame, rows: DataFrame, state: DataFrame, scores: DataFrame, hi: DataFrame, lengths: DataFrame, shards: int, k: int, keep, most: int = 64):
    """Overfetch and refill with one stop for the merged answer: rounds of repair_round until none blocks, at most one refill a shard."""
    done = heads.select(*KEYS).where("false")
    for _ in range(shards):
        new_heads, new_rows, pick = repair_round(heads, rows, state, scores, hi, done, lengths, shards, k, most)
        pick = keep(pick, "token_repairs")
        if not pick.head(1):
            break
        heads, rows = keep_tokens(new_heads, new_rows, keep)
        done = done.unionByName(pick)
    return heads, rows, done


def run_standing(initial: DataFrame, changes: DataFrame, scores: DataFrame, queries: DataFrame, ticks: list[DataFrame], keep, capacity: int = 5, k: int = 5,
                 schedule: DataFrame | None = None, base: int = 5, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Standing queries over ticks; ticks[0] is the start cut, each (shard, at). Returns (answers (tick, query_id, rank, ident, body, score, status, repairs), repairs (tick, query_id, shard)).

    A tick's active queries (schedule (tick, query_id); all without one) advance over everything since their own last activation,
    merge, and repair blocked shards in up to as many rounds as there are shards. The state goes from tick to tick by the changes between
    them. keep(df, name) ends a table's lineage.
    """
    n = ticks[0].select("shard").distinct().count()
    every = queries.select("query_id").distinct()
    state, before = keep(state_at(initial, changes, ticks[0]), "token_state"), ticks[0].select("shard", F.col("at").alias("lo"))
    log = keep(changes.join(before, "shard").where("seq > lo").drop("lo"), "token_log")  # all that any tick can need
    heads, rows = keep_tokens(*acquire_tokens(state, scores, every.crossJoin(ticks[0].select("shard", "at")), capacity, k, most), keep)
    answers, repairs = [], []
    for tick, cut in enumerate(ticks[1:], 1):
        hi = cut.select("shard", F.col("at").alias("hi"))
        active = every if schedule is None else schedule.where(F.col("tick") == tick).select("query_id")
        whole = schedule is None
        now_heads, now_rows = (heads, rows) if whole else (t.join(active, "query_id", "left_semi") for t in (heads, rows))
        floor = heads.groupBy("shard").agg(F.min("at").alias("lo"))
        dirty = log.join(floor, "shard").join(hi, "shard").where("seq > lo and seq <= hi").groupBy("shard").agg(F.count_distinct("ident").alias("dirty"))
        lengths = repair_lengths(now_heads.select(*KEYS), dirty, k, base, most=most)
        now_heads, now_rows = keep_tokens(*advance_tokens(now_heads, now_rows, fold_suffixes(log, now_heads, hi), hi, scores, most), keep)
        step = log.join(before, "shard").join(hi, "shard").where("seq > lo and seq <= hi").drop("lo", "hi")
        state, before = keep(state_at(state, step, cut), "token_state"), cut.select("shard", F.col("at").alias("lo"))
        now_heads, now_rows, done = refill_global(now_heads, now_rows, state, scores, hi, lengths, n, k, keep, most)
        best, answer = merge_tokens(now_heads, now_rows, n, k)
        per_query = done.groupBy("query_id").agg(F.count("*").alias("repairs"))
        got = answer.join(best, "query_id", "left").join(per_query, "query_id", "left").select(
            F.lit(tick).alias("tick"), "query_id", F.col("rank").cast("long").alias("rank"), "ident", "body", "score", "status", F.coalesce("repairs", F.lit(0)).cast("long").alias("repairs"))
        answers.append(keep(got, "token_answers"))
        repairs.append(done.select(F.lit(tick).alias("tick"), *KEYS))
        heads, rows = (now_heads, now_rows) if whole else keep_tokens(
            *(old.join(active, "query_id", "left_anti").unionByName(new) for old, new in ((heads, now_heads), (rows, now_rows))), keep)
    return reduce(DataFrame.unionByName, answers), reduce(DataFrame.unionByName, repairs)
