"""Checks of what sources and coordinators claim: row and request schemas, certificates, receipts, transitions, tokens.

Every check returns its input's keys with the first rule that fails as `reason`, null where all hold, or only the rows that fail.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .rank import best_first
from .tokens import KEYS, key_of

ROW = "OBJECT<body: STRING, id: STRING, score: BIGINT>"


def check_row(text: Column) -> Column:
    """The reason why a JSON text is no ranked row: exactly id and body as strings and score as a positive integer; 1.0, true and "1" are none."""
    v = F.try_parse_json(text)
    score = F.try_variant_get(v, "$.score", "bigint")
    return F.when(v.isNull(), "not-json").when(F.schema_of_variant(v) != ROW, "row-schema").when(score <= 0, "score-not-positive")


def check_tail(text: Column) -> Column:
    """The reason why a JSON text is no tail: null, or [negative integer, string]."""
    v = F.try_parse_json(text)
    types = F.array(*[F.schema_of_variant(F.try_variant_get(v, f"$[{i}]", "variant")) for i in (0, 1)])
    pair = F.size(F.try_variant_get(v, "$", "array<variant>")) == 2
    fine = pair & (types == F.array(F.lit("BIGINT"), F.lit("STRING"))) & (F.try_variant_get(v, "$[0]", "bigint") < 0)
    return F.when(v.isNull(), "not-json").when(F.schema_of_variant(v) == "VOID", F.lit(None).cast("string")).when(~F.coalesce(fine, F.lit(False)), "tail-schema")


def check_request(plan: Column, k: Column, cut: Column, epoch: Column, shards: int) -> Column:
    """The reason why a request is out of bounds: 1 to 2 alternatives of 1 to 4 distinct labels, k 1 to 20, a position a shard, an epoch."""
    alt = lambda a: F.size(a).between(1, 4) & (F.size(F.array_distinct(a)) == F.size(a))
    rules = {"k": k.between(1, 20), "plan": F.size(plan).between(1, 2), "plan-alternate": F.forall(plan, alt),
             "cut": (F.size(cut) == shards) & F.forall(cut, lambda x: x >= 0), "epoch": epoch >= 0}
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])


def _same(a, b) -> bool:
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def _loaded(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(BooleanType())
def same_json(a: pd.Series, b: pd.Series) -> pd.Series:
    """Equal as JSON with types kept (1, 1.0 and true differ) and the order of keys ignored; false where either text is no JSON."""
    pairs = [(_loaded(x), _loaded(y)) for x, y in zip(a, b, strict=True)]
    return pd.Series([(x is not None or str(s).strip() == "null") and _same(x, y) for (x, y), s in zip(pairs, a, strict=True)], dtype="bool")


def check_answers(claims: DataFrame, truth: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """claims and truth (query_id, status, rows: array of (ident, body, score), at most k) -> (query_id, reason).

    Order and duplicates are judged on the claim alone, scores against the bodies, then rows and status against what was recomputed.
    """
    rows = claims.select("query_id", F.explode("rows").alias("r")).select("query_id", "r.body", F.col("r.score").alias("claimed"))
    bad = rows.join(scores, ["query_id", "body"], "left").groupBy("query_id").agg(F.bool_or(~F.col("claimed").eqNullSafe(F.col("score"))).alias("bad"))
    keys = F.transform("rows", lambda r: F.struct((-r.score).alias("neg"), r.ident.alias("ident")))
    ids = F.transform("rows", lambda r: r.ident)
    t = truth.select("query_id", F.col("status").alias("t_status"), F.col("rows").alias("t_rows"))
    reason = (F.when(F.size("rows") > k, "length").when(keys != F.array_sort(keys), "order").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate")
              .when(F.coalesce("bad", F.lit(False)), "score").when(~F.col("rows").eqNullSafe(F.col("t_rows")), "merge").when(~F.col("status").eqNullSafe(F.col("t_status")), "status"))
    return claims.join(bad, "query_id", "left").join(t, "query_id", "left").select("query_id", reason.alias("reason"))


def answer_rows(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, status, rows) of ranked rows, at most k a query, and heads (query_id, status)."""
    sorted_rows = F.array_sort(F.collect_list(F.struct("rank", "ident", "body", "score")))
    got = rows.groupBy("query_id").agg(F.transform(sorted_rows, lambda r: F.struct(r.ident.alias("ident"), r.body.alias("body"), r.score.cast("long").alias("score"))).alias("rows"))
    empty = F.array().cast("array<struct<ident: string, body: string, score: bigint>>")
    return heads.select("query_id", "status").join(got, "query_id", "left").withColumn("rows", F.coalesce("rows", empty))


def check_event_receipts(receipts: DataFrame, events: DataFrame, most: int = 16) -> DataFrame:
    """receipts (shard, n, lo, hi), n from 0, and their events (shard, n, seq, ident) -> (shard, n, reason).

    A receipt begins where the one before it ended (the first at 0), and has every position of (lo, hi], each with at most `most` distinct idents.
    """
    per = events.groupBy("shard", "n", "seq").agg(F.count("*").alias("c"), F.count_distinct("ident").alias("d"))
    per = per.groupBy("shard", "n").agg(F.count("*").alias("seqs"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.bool_or((F.col("c") != F.col("d")) | (F.col("c") > most)).alias("bad"))
    # the receipt before is found by a join on its number, not by a sort of a shard
    before = receipts.select("shard", (F.col("n") + 1).alias("n"), F.col("hi").alias("was"))
    j = receipts.join(before, ["shard", "n"], "left").join(per, ["shard", "n"], "left")
    start = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.col("was"))
    whole = (F.coalesce("seqs", F.lit(0)) == F.col("hi") - F.col("lo")) & ((F.col("hi") == F.col("lo")) | ((F.col("first") == F.col("lo") + 1) & (F.col("last") == F.col("hi"))))
    reason = F.when(~F.col("lo").eqNullSafe(start), "gap").when(~F.coalesce(whole, F.lit(False)), "contiguity").when(F.coalesce("bad", F.lit(False)), "batch-schema")
    return j.select("shard", "n", reason.alias("reason"))


def check_prefix_receipts(heads: DataFrame, rows: DataFrame, scores: DataFrame) -> DataFrame:
    """heads (query_id, shard, capacity, tail_score, tail_ident), rows (query_id, shard, place, ident, body, score) -> (query_id, shard, reason)."""
    r = rows.join(scores.withColumnRenamed("score", "true_score"), ["query_id", "body"], "left").withColumn("key", key_of(F.col("score"), F.col("ident")))
    w = W.partitionBy(*KEYS).orderBy("place")
    r = r.withColumn("falls", F.coalesce(F.lag("key").over(w) > F.col("key"), F.lit(False)))
    per = r.groupBy(*KEYS).agg(F.count("*").alias("n"), F.bool_or("falls").alias("unsorted"), F.count_distinct("ident").alias("ids"),
                               F.bool_or(~F.col("score").eqNullSafe(F.col("true_score"))).alias("bad"), F.max("key").alias("last"))
    j = heads.join(per, list(KEYS), "left").withColumn("tail", key_of(F.col("tail_score"), F.col("tail_ident"))).fillna(0, ["n", "ids"])
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (F.when((F.col("n") > F.col("capacity")) | yes(F.col("unsorted")), "order").when(F.col("ids") < F.col("n"), "duplicate").when(yes(F.col("bad")), "score")
              .when(F.col("tail").isNotNull() & (F.col("n") < F.col("capacity")), "unexhausted").when(yes(F.col("last") >= F.col("tail")), "boundary-order"))
    return j.select(*KEYS, reason.alias("reason"))


def recompute_advance(heads: DataFrame, rows: DataFrame, final: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What advance_tokens must give, by another way: of an ident's old row, the mark that it was touched, and its new score the latest counts. Heads have no position.

    A mark meets only rows held and a score only bodies hit, so nothing is made for each query and change.
    """
    cols = (*KEYS, "ident", "age", "body", "score")
    old = rows.select(*KEYS, "ident", F.lit(0).alias("age"), "body", F.col("score").cast("long").alias("score"))
    gone = rows.select(*KEYS, "ident").join(final.select("shard", "ident"), ["shard", "ident"]).select(*KEYS, "ident", F.lit(1).alias("age"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("long").alias("score"))
    new = final.where("body is not null").join(scores, "body").join(heads.select(*KEYS), list(KEYS), "left_semi").withColumn("age", F.lit(2)).withColumn("score", F.col("score").cast("long"))
    every = old.unionByName(gone).unionByName(new.select(*cols))
    latest = every.groupBy(*KEYS, "ident").agg(F.max(F.struct("age", "body", "score")).alias("v")).select(*KEYS, "ident", "v.body", "v.score").where("score is not null")
    ranked = latest.withColumn("place", F.row_number().over(best_first(*KEYS))).join(heads.select(*KEYS, "capacity"), list(KEYS))
    first_out = ranked.where("place = capacity + 1").select(*KEYS, key_of(F.col("score"), F.col("ident")).alias("out"))
    tail = F.least(key_of(F.col("tail_score"), F.col("tail_ident")), F.col("out"))
    h = heads.join(first_out, list(KEYS), "left").withColumn("t", tail).select(*KEYS, (-F.col("t.neg")).alias("tail_score"), F.col("t.ident").alias("tail_ident"))
    return h, ranked.where("place <= capacity").select(*KEYS, "ident", "body", "score")


def check_results(heads: DataFrame, rows: DataFrame, true_heads: DataFrame, true_rows: DataFrame) -> DataFrame:
    """(query_id, shard, reason): claimed tokens against recomputed ones, rows first, then tails."""
    mine = rows.select(*KEYS, "ident", F.col("body").alias("m_body"), F.col("score").cast("long").alias("m_score"))
    j = mine.join(true_rows, [*KEYS, "ident"], "full").where(~(F.col("m_body").eqNullSafe(F.col("body")) & F.col("m_score").eqNullSafe(F.col("score"))))
    off = j.select(*KEYS).distinct().withColumn("off", F.lit(True))
    t = true_heads.select(*KEYS, F.col("tail_score").alias("t_score"), F.col("tail_ident").alias("t_ident"))
    same = F.col("tail_score").eqNullSafe(F.col("t_score")) & F.col("tail_ident").eqNullSafe(F.col("t_ident"))
    return heads.join(t, list(KEYS), "left").join(off, list(KEYS), "left").select(*KEYS, F.when(F.col("off"), "rows").when(~same, "tail").alias("reason"))


def commit_checked(old: DataFrame, new: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The tokens after an answer: all new ones of a query if every verdict (query_id, shard, reason) on it is null, else all old ones."""
    good = verdicts.groupBy("query_id").agg(F.bool_and(F.col("reason").isNull()).alias("good")).where("good").select("query_id")
    return new.join(good, "query_id", "left_semi").withColumn("committed", F.lit(True)).unionByName(
        old.join(good, "query_id", "left_anti").withColumn("committed", F.lit(False)), allowMissingColumns=True)


def receipt_truth(claims: DataFrame, truth: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(kind, receipts, wrong): claims (kind, keys, fields; one row an entry) against the same entries replayed from the log; lacking and extra ones are wrong."""
    t = truth.select("kind", *keys, F.lit(1).alias("_t"), *[F.col(c).alias(f"_{c}") for c in fields])
    j = claims.withColumn("_c", F.lit(1)).join(t, ["kind", *keys], "full")
    same = F.col("_c").eqNullSafe(F.col("_t"))
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.groupBy("kind").agg(F.count("_c").alias("receipts"), F.count_if(~same).alias("wrong"))


def token_violations(heads: DataFrame, rows: DataFrame, state_rows: DataFrame) -> DataFrame:
    """(query_id, shard, ident, why): token rows that the state has not so (row), and rows of the state before the tail that the token omits (omitted).

    state_rows (query_id, shard, ident, body, score) are all positive rows at the tokens' positions.
    """
    mine = rows.select(*KEYS, "ident", F.col("body").alias("m_body"), F.col("score").cast("long").alias("m_score"))
    j = state_rows.select(*KEYS, "ident", "body", F.col("score").cast("long").alias("score")).join(mine, [*KEYS, "ident"], "full").join(heads.select(*KEYS, "tail_score", "tail_ident"), list(KEYS))
    tail = key_of(F.col("tail_score"), F.col("tail_ident"))
    wrong = F.col("m_body").isNotNull() & ~(F.col("m_body").eqNullSafe(F.col("body")) & F.col("m_score").eqNullSafe(F.col("score")))
    omitted = F.col("m_body").isNull() & (tail.isNull() | (key_of(F.col("score"), F.col("ident")) < tail))
    return j.select(*KEYS, "ident", F.when(wrong, "row").when(omitted, "omitted").alias("why")).where("why is not null")


def receipt_digests(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, n, x, s): a digest of each receipt's rows (place, fields) in their order; rows of one place are a set. Digests add up, so no receipt is gathered."""
    h, g = F.xxhash64("place", *fields), F.xxhash64("place", *fields, F.lit(1))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(g, 24)).alias("s"))


def compare_receipts(claims: DataFrame, truth: DataFrame, fields: list[str]) -> DataFrame:
    """(kind, receipts, wrong): claims and truth (kind, receipt, place, fields), a row an entry. A receipt is wrong if its rows are not those that the log gives at its own
    cut, in their order; one that is claimed of nothing, or not claimed of something, is wrong too."""
    a, b = (receipt_digests(d, ["kind", "receipt"], fields).select("kind", "receipt", F.struct("n", "x", "s").alias(c)) for d, c in ((claims, "a"), (truth, "b")))
    return a.join(b, ["kind", "receipt"], "full").groupBy("kind").agg(F.count("*").alias("receipts"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("wrong"))


def check_certificates(claims: DataFrame, requests: DataFrame, dirty: DataFrame, most: int = 64) -> DataFrame:
    """(query_id, shard, reason): of each certificate the first rule that it breaks, or null.

    claims (query_id, shard, owner, epoch, plan, at, lo, hi, length, n_rows, dirty), requests (query_id, shard, owners, epoch, plan, cut), dirty (shard, dirty): binding (the request's epoch
    and plan), owner (one of the shard's), base-cut (the suffix begins where the prefix stands), interval (it ends at the cut), length (1 to `most`, and no more rows), dirty-set (the digest
    of what the suffix touched, as log.set_digest makes it).
    """
    r = requests.select(*KEYS, "owners", F.col("epoch").alias("r_epoch"), F.col("plan").alias("r_plan"), "cut")
    j = claims.join(r, list(KEYS), "left").join(dirty.select("shard", F.col("dirty").alias("d")), "shard", "left")
    rules = {"binding": F.col("epoch").eqNullSafe(F.col("r_epoch")) & F.col("plan").eqNullSafe(F.col("r_plan")), "owner": F.array_contains("owners", F.col("owner")),
             "base-cut": F.col("at") == F.col("lo"), "interval": (F.col("lo") <= F.col("hi")) & (F.col("hi") == F.col("cut")),
             "length": F.col("length").between(1, most) & (F.col("n_rows") <= F.col("length")), "dirty-set": F.col("dirty").eqNullSafe(F.col("d"))}
    return j.select(*KEYS, F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]).alias("reason"))
