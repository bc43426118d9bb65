"""Checks of answers against the log, and what they cost."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unsound_rows(answers: DataFrame, state: DataFrame, scores: DataFrame) -> DataFrame:
    """answers (cut_id, query_id, ident, body, score) whose body or score is not that of the state at their cut."""
    s = state.select("cut_id", "ident", F.col("body").alias("true_body"))
    v = scores.select("query_id", F.col("body").alias("true_body"), F.col("score").alias("true_score"))
    j = answers.join(s, ["cut_id", "ident"], "left").join(v, ["query_id", "true_body"], "left")
    return j.where(~(F.col("body").eqNullSafe(F.col("true_body")) & F.col("score").eqNullSafe(F.col("true_score")))).select(*answers.columns)


def assess(answers: DataFrame, exact: DataFrame, heads: DataFrame) -> DataFrame:
    """heads (cut_id, query_id, claimed) with exact, false_complete, returned, body_recall and id_recall; 1.0 where there is nothing to find."""
    keys = ["cut_id", "query_id"]
    a = answers.select(*keys, "rank", F.col("ident").alias("a_ident"), F.col("body").alias("a_body"), F.col("score").alias("a_score"))
    e = exact.select(*keys, "rank", F.col("ident").alias("e_ident"), F.col("body").alias("e_body"), F.col("score").alias("e_score"))
    same = F.col("a_ident").eqNullSafe(F.col("e_ident")) & F.col("a_body").eqNullSafe(F.col("e_body")) & F.col("a_score").eqNullSafe(F.col("e_score"))
    ordered = a.join(e, [*keys, "rank"], "full").groupBy(*keys).agg(F.bool_and(same).alias("same"), F.count("a_ident").alias("returned"), F.count("e_ident").alias("n"))
    ids = a.select(*keys, F.col("a_ident").alias("e_ident"), F.col("a_body").alias("found")).distinct()
    hits = e.join(ids, [*keys, "e_ident"]).groupBy(*keys).agg(F.count("*").alias("id_hits"), F.count_if(F.col("found") == F.col("e_body")).alias("body_hits"))
    j = heads.select(*keys, "claimed").join(ordered, keys, "left").join(hits, keys, "left")
    ok = F.coalesce("same", F.lit(True))
    share = lambda c: F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(F.coalesce(c, F.lit(0)) / F.col("n"))
    return j.select(*keys, "claimed", ok.alias("exact"), (F.col("claimed") & ~ok).alias("false_complete"), F.coalesce("returned", F.lit(0)).alias("returned"),
                    share("body_hits").alias("body_recall"), share("id_hits").alias("id_recall"))


def changed_answers(exact: DataFrame, queries: DataFrame, cuts: DataFrame) -> DataFrame:
    """(query_id, cut_id, changed): the answer differs from that of the cut before (the first: not changed)."""
    rows = exact.groupBy("query_id", "cut_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ident", "body", "score"))).alias("a"))
    grid = queries.select("query_id").distinct().crossJoin(cuts.select("cut_id").distinct())
    g = grid.join(rows, ["query_id", "cut_id"], "left")
    w = W.partitionBy("query_id").orderBy("cut_id")
    return g.select("query_id", "cut_id", ((F.row_number().over(w) > 1) & ~F.col("a").eqNullSafe(F.lag("a").over(w))).alias("changed"))


def nearest_rank(column: str, p: float) -> Column:
    """The element at ceil(p * n), at least the first."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def summarize(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, means and rates of assessed answers by keys."""
    return obs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if("claimed").alias("complete"), F.count_if("false_complete").alias("false_complete"),
        F.sum("returned").alias("returned"), F.round(F.avg("body_recall"), 9).alias("body_recall"), F.round(F.avg("id_recall"), 9).alias("id_recall"),
        F.expr("percentile_disc(0.5) within group (order by returned)").alias("p50_returned"), F.expr("percentile_disc(0.95) within group (order by returned)").alias("p95_returned"))


def summarize_levels(obs: DataFrame, levels: list[str]) -> DataFrame:
    """One pass for the whole, each level and all levels down to the last (a rollup), null for what a row sums over."""
    return obs.rollup(*levels).agg(F.count("*").alias("n"), F.count_if("exact").alias("exact"), F.count_if("claimed").alias("complete"))


def case_table(obs: DataFrame, keys: list[str], policies: list[str], metric: str) -> DataFrame:
    return obs.groupBy(*keys).pivot("policy", policies).agg(F.sum(F.col(metric).cast("long")))


def relative_to(df: DataFrame, baseline: str, metric: str) -> DataFrame:
    """df (policy, metric) with the percent by which each is below the baseline policy; null where that is 0."""
    b = df.where(F.col("policy") == baseline).select(F.col(metric).alias("base"))
    return df.crossJoin(F.broadcast(b.limit(1))).select("policy", metric, F.round(F.when(F.col("base") != 0, 100.0 * (1 - F.col(metric) / F.col("base"))), 9).alias("reduction"))


def _poisson_steps(most: int = 12) -> list[int]:
    """Numbers of 32 bits from which a Poisson variable of mean 1 is 1 or more, 2 or more, and so on."""
    cumulated, term, out = 0.0, exp(-1), []
    for k in range(most):
        cumulated += term
        term /= k + 1
        out.append(int(cumulated * (1 << 32)))
    return out


def bootstrap_mean(pairs: DataFrame, column: str, key: str, by: tuple = (), n: int = 10_000, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(by, mean, low, high): percentile interval of the mean of column over n resamples of the rows; key names a row within by.

    In a resample a row counts as often as a Poisson variable of mean 1 says, which the hash of seed, by, key and the resample's number decides. So no row is drawn from
    elsewhere: weights are added up where the rows are, n sums a group and task leave it, and reruns agree. Values are taken to 9 digits, so that sums are exact in any order.
    """
    steps = [F.lit(x) for x in _poisson_steps()]
    v = F.round(F.col(column) * 1e9).cast("long")
    rows = pairs.select(*by, F.concat_ws(":", F.lit(str(seed)), *by, key).alias("_key"), v.alias("_v")).where("_v is not null")
    draws = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "_key", "b")), 1, 8), 16, 10).cast("long")
    weight = sum((number >= x).cast("int") for x in steps)
    sums = draws.select(*by, "b", "_v", weight.alias("w")).groupBy(*by, "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("_v")).alias("wv")).where("w > 0")
    a = round((1 - level) / 2, 12)
    means = sums.withColumn("m", F.col("wv") / F.col("w") / 1e9)
    ends = means.groupBy(*by).agg(nearest_rank("m", a).alias("low"), nearest_rank("m", 1 - a).alias("high"))
    mean = rows.groupBy(*by).agg((F.sum("_v") / F.count("*") / 1e9).alias("mean"))
    return (mean.join(ends, list(by)) if by else mean.crossJoin(ends)).select(*by, "mean", "low", "high")


def counter_deltas(df: DataFrame, keys: list[str], order: str, counter: str) -> DataFrame:
    """A cumulative counter's increase since the row before (the first: since 0)."""
    return df.withColumn("delta", F.col(counter) - F.coalesce(F.lag(counter).over(W.partitionBy(*keys).orderBy(order)), F.lit(0)))


def work_census(initial: DataFrame, changes: DataFrame, label_counts: DataFrame) -> DataFrame:
    """(shard, assignments, updates): of the log, identifier assignments and posting updates (labels of the old value and of the new)."""
    every = initial.select("shard", "ident", "body", F.lit(0).cast("long").alias("seq"), F.lit(-1).alias("pos")).unionByName(changes.select("shard", "ident", "body", "seq", "pos"))
    w = W.partitionBy("shard", "ident").orderBy("seq", "pos")
    moved = every.withColumn("old", F.lag("body").over(w)).where("seq > 0")
    n = label_counts.select("body", "n")
    j = moved.join(n, "body", "left").join(n.select(F.col("body").alias("old"), F.col("n").alias("old_n")), "old", "left")
    return j.groupBy("shard").agg(F.count("*").alias("assignments"), F.sum(F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))).alias("updates"))


def policy_totals(obs: DataFrame, keys: list[str], state: str | None = None) -> DataFrame:
    """Counts, and sums and means of bytes and messages; with a state column its greatest and its median."""
    more = [F.max(state).alias("peak_state"), F.expr(f"median({state})").alias("median_state")] if state else []
    return obs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("exact").alias("exact"), (F.count("*") - F.count_if("claimed")).alias("not_complete"), F.count_if("false_complete").alias("false_complete"),
        F.sum("bytes").alias("bytes"), F.round(F.avg("bytes"), 9).alias("mean_bytes"), F.sum("messages").alias("messages"), *more)


def case_aggregate(cases: DataFrame, keys: list[str], metric: str, weight: str = "n") -> DataFrame:
    """(keys, weight, metric): the cases' means weighted by how many answers each stands for."""
    return cases.groupBy(*keys).agg(F.sum(weight).alias(weight), F.round(F.sum(F.col(metric) * F.col(weight)) / F.sum(weight), 9).alias(metric))


def repair_report(repaired: DataFrame, queries: DataFrame) -> DataFrame:
    """One row (queries, repaired_queries, repaired_shards, rate) from repaired (query_id, shard) among all queries (query_id)."""
    r = repaired.agg(F.count_distinct("query_id").alias("repaired_queries"), F.count("*").alias("repaired_shards"))
    return queries.agg(F.count_distinct("query_id").alias("queries")).crossJoin(r).select("queries", "repaired_queries", "repaired_shards", F.round(F.col("repaired_queries") / F.col("queries"), 9).alias("rate"))


def sensitivity(obs: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Percent complete and exact for each combination in grid; null where obs has none."""
    rate = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 9)
    return grid.join(obs.groupBy(*keys).agg(F.count("*").alias("n"), rate("claimed").alias("complete_pct"), rate("exact").alias("exact_pct")), keys, "left")


def paired_diff(obs: DataFrame, keys: list[str], a: str, b: str, metric: str) -> DataFrame:
    """(keys, diff): metric of policy a less that of policy b, for the trials that have both."""
    one = lambda p, name: obs.where(F.col("policy") == p).groupBy(*keys).agg(F.avg(F.col(metric)).alias(name))
    return one(a, "_a").join(one(b, "_b"), keys).select(*keys, (F.col("_a") - F.col("_b")).alias("diff"))


def wire_bytes(*columns: str) -> Column:
    """Bytes of the columns as one line of canonical JSON: keys in order, no spaces, nulls kept, all but ASCII as \\uXXXX."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    text = F.regexp_replace(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "x" * 12), r"[^\x00-\x7F]", "x" * 6)
    return F.octet_length(text) + F.lit(1)


def phase_costs(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Messages, bytes and returned rows by phase, and for all phases of a trial together (phase null)."""
    costs = [F.sum(c).cast("long").alias(c) for c in ("messages", "bytes", "returned_rows")]
    return receipts.groupingSets([[*map(F.col, keys), F.col("phase")], [*map(F.col, keys)]], *keys, "phase").agg(*costs)


def token_work(heads: DataFrame, rows: DataFrame, final: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, assignments, buffer_rows, score_evaluations, sort_rows): what one advance of a query's tokens costs its coordinator."""
    keys = ["query_id", "shard"]
    per = final.groupBy("shard").agg(F.count("*").alias("assignments"), F.count("body").alias("score_evaluations"))
    work = heads.select(*keys).join(per, "shard", "left")
    kept = rows.join(final.select("shard", "ident", F.lit(1).alias("touched")), ["shard", "ident"], "left").groupBy(*keys).agg(F.count("*").alias("buffer_rows"), (F.count("*") - F.count("touched")).alias("kept"))
    fresh = final.where("body is not null").join(scores, "body").groupBy(*keys).agg(F.count("*").alias("fresh"))
    j = work.join(kept, keys, "left").join(fresh, keys, "left").fillna(0)
    return j.groupBy("query_id").agg(F.sum("assignments").alias("assignments"), F.sum("buffer_rows").alias("buffer_rows"), F.sum("score_evaluations").alias("score_evaluations"), F.sum(F.col("kept") + F.col("fresh")).alias("sort_rows"))


def matched_answers(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, variants): trials on which the policies' answers (policy, keys, rank, ident, body, score) differ.

    Rows are told apart by one hash each and an answer by count and sum of them, so that no answer is gathered.
    """
    h = F.xxhash64("rank", "ident", "body", "score").cast("decimal(38,0)")
    every = answers.select("policy").distinct().crossJoin(answers.select(*keys).distinct())
    one = every.join(answers.withColumn("h", h), ["policy", *keys], "left").groupBy("policy", *keys).agg(F.count("h").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("s"))
    return one.groupBy(*keys).agg(F.count_distinct(F.struct("n", "s")).alias("variants")).where("variants > 1")


def matched_table(costs: DataFrame, total: DataFrame, trials: list[str]) -> DataFrame:
    """(policy, bytes, trials, whole, balanced): phases summed by policy; all expected trials are there, and the phases make up the total."""
    s = costs.groupBy("policy").agg(F.sum("bytes").alias("bytes"), F.array_sort(F.collect_set("trial")).alias("seen"))
    t = total.groupBy("policy").agg(F.sum("bytes").alias("total"))
    want = F.array(*[F.lit(x) for x in sorted(trials)])
    return s.join(t, "policy", "left").select("policy", "bytes", F.size("seen").alias("trials"), (F.col("seen") == want).alias("whole"), F.col("bytes").eqNullSafe(F.col("total")).alias("balanced"))


def peak_state(sizes: DataFrame, keys: list[str], tick: str) -> DataFrame:
    """sizes (keys, tick, bytes: one row an entry) -> (keys, peak, at): the greatest state and the first tick that has it."""
    per = sizes.groupBy(*keys, tick).agg(F.sum("bytes").alias("bytes"))
    return per.groupBy(*keys).agg(F.max("bytes").alias("peak"), F.min_by(tick, F.struct(-F.col("bytes"), F.col(tick))).alias("at"))


def resource_ledger(commands: DataFrame, suite: str) -> DataFrame:
    """commands (suite, exit_code, wall_seconds, cpu_seconds, maximum_rss_kib) summed, the memory's greatest, and how many failed."""
    return commands.groupBy(suite).agg(F.count("*").alias("commands"), F.count_if(F.col("exit_code") != 0).alias("failed"), F.round(F.sum("wall_seconds"), 6).alias("wall_seconds"),
                                       F.round(F.sum("cpu_seconds"), 6).alias("cpu_seconds"), F.max("maximum_rss_kib").alias("maximum_rss_kib"))


def count_kinds(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("kind").agg(F.count("*").alias("receipts"))


def history_totals(batches: DataFrame) -> DataFrame:
    """(shard, events, assignments, largest) of a log in batches (shard, seq, ident, body)."""
    per = batches.groupBy("shard", "seq").agg(F.count("*").alias("n"))
    return per.groupBy("shard").agg(F.count("*").alias("events"), F.sum("n").alias("assignments"), F.max("n").alias("largest"))
