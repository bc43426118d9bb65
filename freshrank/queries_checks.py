"""Registered queries of the policies by cut, token refills, receipt checks, audit tables, table checks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import audit, log, policies, rank, receipts, tables, tokens
from .queries import _OBS, _STANDING, BASE, CERT, LENGTH, K, Inputs, _advanced, _long, _observations, policy_answers, query, standing
from .sources import fixtures as fx
from .sources.scratch import shared_dir, staged
from .streaming import standing as streams


def number(column: str = "query_id"):
    """The benchmark item's number in a query's id."""
    return F.substring(column, 2, 9).cast("int")


_NUM = "CAST(substr(query_id, 2) AS INT)"

# ---- policies by cut

_CACHE = BASE + """, req AS (SELECT tick, query_id, shard, tick // 3 AS cut, (tick + shard) % 4 <> 0 AS available FROM (SELECT unnest(range(1, 9)) AS tick), (SELECT DISTINCT query_id FROM terms), (SELECT shard FROM tops)),
outc AS (SELECT *, CASE WHEN held = cut THEN 'hit' WHEN available THEN 'fetched' ELSE 'missing' END AS outcome FROM (SELECT *,
  last_value(CASE WHEN available THEN cut END IGNORE NULLS) OVER (PARTITION BY query_id, shard ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM req))
"""


def _cache_outcomes(i: Inputs) -> DataFrame:
    shards = i.cuts.select("shard").distinct()
    r = i.terms().select("query_id").distinct().crossJoin(shards).withColumn("tick", F.explode(F.sequence(F.lit(1), F.lit(8))))
    return policies.cut_cache(r.withColumn("cut", F.expr("int(tick div 3)")).withColumn("available", (F.col("tick") + F.col("shard")) % 4 != 0))


@query("""SELECT tick, count(*) FILTER (WHERE outcome = 'hit') AS hits, count(*) FILTER (WHERE outcome = 'fetched') AS fetched, count(*) FILTER (WHERE outcome = 'missing') AS missing FROM outc GROUP BY tick""", _CACHE)
def p4_cache_hits(spark, sf_dir):
    o = _cache_outcomes(Inputs(spark, sf_dir))
    return o.groupBy(*_long("tick")).agg(*[F.count_if(F.col("outcome") == w).alias(n) for n, w in (("hits", "hit"), ("fetched", "fetched"), ("missing", "missing"))])


@query(f"""SELECT tick, query_id, rank, CAST(shard AS BIGINT) AS shard, ident, score FROM (SELECT tick, query_id, shard, ident, score, row_number() OVER (PARTITION BY tick, query_id ORDER BY score DESC, ident) AS rank
FROM outc o JOIN state_cuts s ON s.cut_id = o.cut AND s.shard = o.shard JOIN scores USING (query_id, body) WHERE outcome <> 'missing') WHERE rank <= {K}""".replace("query_id, shard, ident, score, row_number", "query_id, o.shard, ident, score, row_number"), _CACHE)
def p4_cut_cache(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    state = log.state_as_of(log.versions(i.initial, i.changes), i.cuts).withColumnRenamed("cut_id", "cut")
    per_shard = rank.top_n(rank.rank_state(state, i.scores()), ("cut", "query_id", "shard"), K).drop("rank")
    return policies.cached_topk(_cache_outcomes(i), per_shard, K).select(*_long("tick"), "query_id", *_long("rank", "shard"), "ident", "score")


_MIRROR = BASE + """, reach AS (SELECT t.shard, coalesce(min(s.seq) - 1, any_value(t.top)) AS frontier FROM tops t LEFT JOIN changes s ON s.shard = t.shard AND t.shard = 2 AND s.seq > 5 AND s.seq % 211 = 0 GROUP BY t.shard),
good AS (SELECT c.cut_id, c.shard, frontier >= cutp AS counts FROM cuts c JOIN reach USING (shard))
"""


@query(f"""SELECT CAST(cut_id AS BIGINT) AS cut_id, query_id, rank, CAST(shard AS BIGINT) AS shard, ident, body, score FROM (
SELECT cut_id, query_id, shard, ident, body, score, row_number() OVER (PARTITION BY cut_id, query_id ORDER BY score DESC, ident) AS rank FROM state_cuts JOIN good USING (cut_id, shard) JOIN scores USING (body) WHERE counts) WHERE rank <= {K}""", _MIRROR)
def p5_mirror_topk(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    feed = i.changes.where("not (shard = 2 and seq > 5 and seq % 211 = 0)")
    return policies.mirror_topk(i.initial, feed, i.scores(), i.cuts, K)[0].select(*_long("cut_id"), "query_id", *_long("rank", "shard"), "ident", "body", "score")


@query("SELECT CAST(cut_id AS BIGINT) AS cut_id, count(*) FILTER (WHERE counts) AS covered FROM good GROUP BY cut_id", _MIRROR)
def p5_mirror_coverage(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    feed = i.changes.where("not (shard = 2 and seq > 5 and seq % 211 = 0)")
    return policies.mirror_topk(i.initial, feed, i.scores(), i.cuts, K)[1].select(*_long("cut_id"), "covered")


@query(f"""SELECT query_id, CAST(shard AS BIGINT) AS shard, rule, CAST(arg_min(owner, (owner + shard) % 3) AS BIGINT) AS owner FROM (
 SELECT query_id, g.shard, owner, hi, hi - ({_NUM} + g.shard + owner) % 3 * 2 AS at_, ({_NUM} + owner * 2) % 5 <> 0 AS covered FROM grid g, (SELECT unnest([0, 1, 2]) AS owner)),
(SELECT unnest(['acquire', 'repair']) AS rule) WHERE CASE WHEN rule = 'acquire' THEN at_ = hi ELSE at_ <= hi AND covered END GROUP BY query_id, shard, rule""")
def p8_pick_owner(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    top = i.lag().select("shard", F.col("hi").alias("cut"))
    r = i.terms().select("query_id").distinct().crossJoin(top).withColumn("owner", F.explode(F.array(*map(F.lit, range(3)))))
    r = r.select("query_id", "shard", "owner", (F.col("cut") - (number() + F.col("shard") + F.col("owner")) % 3 * 2).alias("at"), ((number() + F.col("owner") * 2) % 5 != 0).alias("covered"))
    owners = top.select("shard", F.explode(F.array(*map(F.lit, range(3)))).alias("owner")).withColumn("place", (F.col("owner") + F.col("shard")) % 3)
    one = lambda rule: policies.pick_owner(r, owners, top, rule).select("query_id", *_long("shard"), F.lit(rule).alias("rule"), *_long("owner"))
    return one("acquire").unionByName(one("repair"))


# ---- tokens


@query(f"""SELECT query_id, CAST(shard AS BIGINT) AS shard, CASE WHEN {_NUM} % 11 = 0 THEN 'no-token' WHEN {_NUM} % 7 = 0 THEN 'epoch' ELSE 'uncovered' END AS why FROM grid
WHERE {_NUM} % 11 = 0 OR {_NUM} % 7 = 0 OR (shard = 1 AND lo < hi)""")
def k6_missing_shards(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    heads = tokens.acquire_tokens(i.index(), i.scores(), i.grid(), LENGTH)[0].where(number() % 11 != 0).withColumn("epoch", F.when(number() % 7 == 0, 1).otherwise(0))
    lag = i.lag()
    epochs = lag.select("shard", F.lit(0).alias("epoch"))
    cover = lag.select("shard", F.when(F.col("shard") == 1, F.expr("hi - (hi - lo) div 2")).otherwise(F.lit(0)).alias("base"), F.col("hi").alias("frontier"))
    grid = i.grid().drop("at").join(lag.select("shard", F.col("hi").alias("cut")), "shard")
    return tokens.missing_shards(heads, grid, epochs, cover).select("query_id", *_long("shard"), "why")


@query("SELECT query_id, CAST(shard AS BIGINT) AS shard, CASE WHEN shard = 1 THEN 0 ELSE 1 END::BIGINT AS epoch, CASE WHEN shard = 1 THEN 1 ELSE 2 END::BIGINT AS generation, tail_score, tail_ident FROM advanced")
def k7_rebind_tokens(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    later = i.lag().where("shard <> 1").select("shard", F.lit(1).alias("new_epoch"))
    t = tokens.rebind_tokens(_advanced(i)[0].withColumn("epoch", F.lit(0)), later)
    return t.select("query_id", *_long("shard", "epoch", "generation"), "tail_score", "tail_ident")


_REFILL = BASE + f""", kth AS (SELECT query_id, shard, score AS k_score, ident AS k_ident FROM pool WHERE rank = {K} AND {K} <= {LENGTH}),
own AS (SELECT a.query_id, a.shard FROM advanced a LEFT JOIN kth USING (query_id, shard) WHERE tail_score IS NOT NULL AND (k_score IS NULL OR (-k_score, k_ident) >= (-tail_score, tail_ident))),
need AS (SELECT shard, greatest({LENGTH}, least(64, {K} + count(*))) AS length FROM finals GROUP BY shard),
now_ranked AS (SELECT query_id, shard, ident, body, score, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, ident) AS rank FROM state_cuts JOIN scores USING (body) WHERE cut_id = 4),
refetched AS (SELECT r.* FROM now_ranked r JOIN own USING (query_id, shard) JOIN need n ON n.shard = r.shard WHERE rank <= length)
"""


def _lengths(i: Inputs) -> DataFrame:
    return tokens.repair_lengths(i.grid(), log.dirty_count(log.suffix(i.changes, i.lag())), K, LENGTH).select("query_id", "shard", "length")


def _refilled(i: Inputs):
    heads, rows = (staged(t, "token") for t in _advanced(i))
    hi = staged(i.lag(), "lag").select("shard", "hi")
    state = log.state_at(i.initial, i.changes, hi.withColumnRenamed("hi", "at"))
    return tokens.refill_local(heads, rows, state, i.scores(), hi, _lengths(i), K)


@query(f"""SELECT query_id, CAST(shard AS BIGINT) AS shard, ident, body, score FROM refetched UNION ALL
SELECT query_id, CAST(shard AS BIGINT), ident, body, score FROM pool WHERE rank <= {LENGTH} AND (query_id, shard) NOT IN (SELECT (query_id, shard) FROM own)""", _REFILL)
def k8_refill_local(spark, sf_dir):
    return _refilled(Inputs(spark, sf_dir))[1].select("query_id", *_long("shard"), "ident", "body", "score")


@query("SELECT query_id, rank, ident, body, score FROM exact WHERE cut_id = 4")
def k9_refill_global(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    scores = i.scores()
    heads, rows = (staged(t, "token") for t in _advanced(i))
    hi = i.lag().select("shard", "hi")
    state = log.state_at(i.initial, i.changes, hi.withColumnRenamed("hi", "at"))
    heads, rows, _ = tokens.refill_global(heads, rows, state, scores, hi, _lengths(i), 3, K, staged)
    best, answer = tokens.merge_tokens(heads, rows, 3, K)
    return best.join(answer.where("status = 'complete'"), "query_id", "left_semi").select("query_id", *_long("rank"), "ident", "body", "score")


# ---- checks of claims

_JSON = f"""SELECT query_id, rank, CASE ({_NUM} + rank) % 8
 WHEN 0 THEN '{{"id":"' || ident || '","body":"' || body || '","score":' || score || '.0}}' WHEN 1 THEN '{{"id":"' || ident || '","body":"' || body || '","score":true}}'
 WHEN 2 THEN '{{"id":"' || ident || '","body":"' || body || '","score":"' || score || '"}}' WHEN 3 THEN '{{"id":"' || ident || '","body":"' || body || '","score":0}}'
 WHEN 4 THEN '{{"id":"' || ident || '","score":' || score || '}}' WHEN 5 THEN '{{"id":"' || ident || '","body":"' || body || '","more":1,"score":' || score || '}}'
 WHEN 6 THEN '{{"id":"' || ident ELSE '{{"id":"' || ident || '","body":"' || body || '","score":' || score || '}}' END AS j"""


@query(f"""SELECT query_id, rank, CASE WHEN NOT json_valid(j) THEN 'not-json'
 WHEN list_sort(json_keys(j)) <> ['body', 'id', 'score'] OR json_type(j, '$.id') <> 'VARCHAR' OR json_type(j, '$.body') <> 'VARCHAR' OR json_type(j, '$.score') NOT IN ('UBIGINT', 'BIGINT') THEN 'row-schema'
 WHEN CAST(j->>'$.score' AS BIGINT) <= 0 THEN 'score-not-positive' END AS reason FROM ({_JSON} FROM exact WHERE cut_id = 4)""")
def v1_check_rows(spark, sf_dir):
    e = Inputs(spark, sf_dir).exact().where("cut_id = 4")
    return e.select("query_id", "rank", F.expr(_JSON.split(" rank, ", 1)[1].rsplit(" AS j", 1)[0]).alias("j")).select("query_id", "rank", receipts.check_row(F.col("j")).alias("reason"))


@query(f"""SELECT query_id, CASE WHEN {_NUM} % 23 NOT BETWEEN 1 AND 20 THEN 'k' WHEN {_NUM} % 7 = 0 OR max(n) > 4 THEN 'plan-alternate' WHEN {_NUM} % 5 = 0 THEN 'cut' WHEN {_NUM} % 9 = 0 THEN 'epoch' END AS reason
FROM (SELECT query_id, alt, count(*) AS n FROM terms GROUP BY query_id, alt) GROUP BY query_id""")
def v2_check_requests(spark, sf_dir):
    alts = Inputs(spark, sf_dir).terms().groupBy("query_id", "alt").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    alts = alts.withColumn("labels", F.when(number() % 7 == 0, F.concat("labels", F.slice("labels", 1, 1))).otherwise(F.col("labels")))
    q = alts.groupBy("query_id").agg(F.collect_list("labels").alias("plan"))
    cut = F.when(number() % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return q.select("query_id", receipts.check_request(F.col("plan"), number() % 23, cut, number() % 9 - 1, 3).alias("reason"))


@query("SELECT event_id, event_id % 4 IN (0, 3) AS same FROM events", "")
def v3_same_json(spark, sf_dir):
    k = F.regexp_extract("props", r"(\d+)", 1)
    other = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"k":'), k, F.lit("}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"k": '), k, F.lit(".0}")))
             .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"k": "'), k, F.lit('"}'))).otherwise(F.col("props")))
    return fx.table(spark, sf_dir, "events").select("event_id", receipts.same_json("props", other).alias("same"))


def _claimed(truth: DataFrame) -> DataFrame:
    """Answers of which five in six are spoilt, each kind by its own query numbers."""
    m, rows, first = number() % 6, F.col("rows"), F.slice("rows", 1, 1)
    more = F.transform(rows, lambda r: F.struct(r.ident.alias("ident"), r.body.alias("body"), (r.score + 1).alias("score")))
    less = F.slice("rows", 1, F.greatest(F.lit(0), F.size("rows") - 1))
    spoilt = F.when(m == 0, F.reverse(rows)).when(m == 1, more).when(m == 3, less).when(m == 4, F.concat(first, less)).otherwise(rows)
    return truth.select("query_id", F.when(m == 2, "partial").otherwise(F.col("status")).alias("status"), spoilt.alias("rows"))


def _answer_sql(rows: str, heads: str) -> str:
    """The claims of _claimed and their check, over tables (query_id, rank, ident, body, score) and (query_id, status)."""
    return f""", t AS (SELECT h.query_id, h.status, coalesce(list({{'ident': ident, 'body': body, 'score': score}} ORDER BY rank) FILTER (WHERE ident IS NOT NULL), []) AS rows FROM {heads} h LEFT JOIN {rows} r ON r.query_id = h.query_id GROUP BY h.query_id, h.status),
cl AS (SELECT query_id, CASE WHEN {_NUM} % 6 = 2 THEN 'partial' ELSE status END AS status, status AS t_status, rows AS t_rows, CASE {_NUM} % 6 WHEN 0 THEN list_reverse(rows)
  WHEN 1 THEN list_transform(rows, lambda r: {{'ident': r.ident, 'body': r.body, 'score': r.score + 1}}) WHEN 3 THEN rows[1:greatest(0, len(rows) - 1)] WHEN 4 THEN list_concat(rows[1:1], rows[1:greatest(0, len(rows) - 1)]) ELSE rows END AS rows FROM t),
one AS (SELECT query_id, r.body AS body, r.score AS claimed FROM (SELECT query_id, unnest(rows) AS r FROM cl)),
bad AS (SELECT DISTINCT query_id FROM one LEFT JOIN scores USING (query_id, body) WHERE claimed IS DISTINCT FROM score)
SELECT query_id, CASE WHEN len(rows) > {K} THEN 'length' WHEN list_transform(rows, lambda r: {{'neg': -r.score, 'id': r.ident}}) <> list_sort(list_transform(rows, lambda r: {{'neg': -r.score, 'id': r.ident}})) THEN 'order'
 WHEN len(list_distinct(list_transform(rows, lambda r: r.ident))) < len(rows) THEN 'duplicate' WHEN query_id IN (FROM bad) THEN 'score' WHEN rows <> t_rows THEN 'merge' WHEN status <> t_status THEN 'status' END AS reason FROM cl"""


@query(_answer_sql(f"(SELECT query_id, rank, ident, body, score FROM (SELECT c.*, p.body FROM cert_rows c JOIN (SELECT DISTINCT query_id, shard, ident, body FROM (SELECT query_id, shard, ident, body FROM idx_ranked WHERE (shard, ident) NOT IN (SELECT (shard, ident) FROM finals) UNION ALL SELECT query_id, shard, ident, body FROM fresh)) p USING (query_id, shard, ident)) WHERE rank <= {K})",
                   "(SELECT query_id, CASE WHEN blockers > 0 THEN 'rank-underdetermined' ELSE 'complete' END AS status FROM cert_heads)"), CERT)
def v4_check_certificates(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    scores = i.scores()
    heads, rows = tokens.acquire_tokens(i.index(), scores, i.grid(), LENGTH)
    best, answer = tokens.certify(rows, heads, i.final(), scores, 3, K)
    truth = receipts.answer_rows(best, answer)
    return receipts.check_answers(_claimed(truth), truth, scores, K)


@query(_answer_sql("(SELECT * FROM exact WHERE cut_id = 4)", "(SELECT DISTINCT query_id, 'complete' AS status FROM terms)"))
def v5_check_overlays(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    best = tokens.overlay_topk(i.index(), i.final(), i.scores(), K)
    truth = receipts.answer_rows(best, i.terms().select("query_id", F.lit("complete").alias("status")).distinct())
    return receipts.check_answers(_claimed(truth), truth, i.scores(), K)


@query("""SELECT CAST(shard AS BIGINT) AS shard, n, CASE WHEN lo <> coalesce(lag(hi) OVER (PARTITION BY shard ORDER BY n), 0) THEN 'gap' WHEN kept < hi - lo THEN 'contiguity' END AS reason
FROM (SELECT shard, (seq - 1) // 50 AS n, min(seq) - 1 AS lo, max(seq) AS hi, count(*) FILTER (WHERE seq % 211 <> 0) AS kept FROM changes GROUP BY ALL) WHERE n % 11 <> 5""")
def v6_check_event_receipts(spark, sf_dir):
    c = fx.changes(spark, sf_dir).withColumn("n", F.expr("(seq - 1) div 50"))
    r = c.groupBy("shard", "n").agg((F.min("seq") - 1).alias("lo"), F.max("seq").alias("hi")).where("n % 11 <> 5")
    return receipts.check_event_receipts(r, c.where("seq % 211 <> 0")).select(*_long("shard"), "n", "reason")


@query(f""", pr AS (SELECT query_id, shard, CASE WHEN {_NUM} % 5 = 0 AND rank <= 2 THEN 3 - rank ELSE rank END AS place, ident, body, CASE WHEN {_NUM} % 5 = 1 AND rank = 1 THEN score + 1 ELSE score END AS score FROM idx_ranked
  WHERE rank <= {LENGTH} AND NOT ({_NUM} % 5 = 2 AND rank = {LENGTH})),
ph AS (SELECT query_id, shard, CASE WHEN {_NUM} % 5 = 3 THEN tail_score + 9 ELSE tail_score END AS tail_score, tail_ident FROM heads),
pc AS (SELECT query_id, shard, count(*) AS n, bool_or(down) AS unsorted, bool_or(score IS DISTINCT FROM true_score) AS bad, max((-score, ident)) AS last
  FROM (SELECT p.*, s.score AS true_score, coalesce(lag((-p.score, ident)) OVER (PARTITION BY query_id, shard ORDER BY place) > (-p.score, ident), false) AS down FROM pr p LEFT JOIN scores s USING (query_id, body)) GROUP BY query_id, shard)
SELECT query_id, CAST(shard AS BIGINT) AS shard, CASE WHEN unsorted THEN 'order' WHEN bad THEN 'score' WHEN tail_score IS NOT NULL AND coalesce(n, 0) < {LENGTH} THEN 'unexhausted' WHEN tail_score IS NOT NULL AND last >= (-tail_score, tail_ident) THEN 'boundary-order' END AS reason
FROM ph LEFT JOIN pc USING (query_id, shard)""")
def v7_check_prefix_receipts(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    scores, m = i.scores(), number() % 5
    heads, rows = tokens.acquire_tokens(i.index(), scores, i.grid(), LENGTH)
    r = rank.top_n(rows, tokens.KEYS, LENGTH).where(~((m == 2) & (F.col("rank") == LENGTH)))
    r = r.withColumn("place", F.when((m == 0) & (F.col("rank") <= 2), 3 - F.col("rank")).otherwise(F.col("rank"))).withColumn("score", F.when((m == 1) & (F.col("rank") == 1), F.col("score") + 1).otherwise(F.col("score")))
    h = heads.withColumn("tail_score", F.when(m == 3, F.col("tail_score") + 9).otherwise(F.col("tail_score")))
    return receipts.check_prefix_receipts(h, r, scores).select("query_id", *_long("shard"), "reason")


def _verdicts(i: Inputs):
    """(old heads, claimed heads, verdicts): claimed tokens lack shard 1's rows for some queries and have other tails for some."""
    scores, final, m = i.scores(), staged(i.final(), "final"), number() % 5
    old_heads, old_rows = (staged(t, "token") for t in tokens.acquire_tokens(i.index(), scores, i.grid(), LENGTH))
    heads, rows = (staged(t, "token") for t in tokens.advance_tokens(old_heads, old_rows, final, i.lag().select("shard", "hi"), scores))
    heads, rows = heads.withColumn("tail_ident", F.when(m == 0, F.concat("tail_ident", F.lit("x"))).otherwise(F.col("tail_ident"))), rows.where(~((m == 1) & (F.col("shard") == 1)))
    return old_heads, heads, receipts.check_results(heads, rows, *receipts.recompute_advance(old_heads, old_rows, final, scores))


_VERDICT = BASE + f""", verdict AS (SELECT a.query_id, a.shard, a.tail_score, h.tail_score AS old_score, CASE WHEN {_NUM.replace('query_id', 'a.query_id')} % 5 = 1 AND a.shard = 1 AND EXISTS (SELECT 1 FROM pool p WHERE p.query_id = a.query_id AND p.shard = 1) THEN 'rows'
 WHEN {_NUM.replace('query_id', 'a.query_id')} % 5 = 0 AND a.tail_score IS NOT NULL THEN 'tail' END AS reason FROM advanced a JOIN heads h ON h.query_id = a.query_id AND h.shard = a.shard)
"""


@query("SELECT query_id, CAST(shard AS BIGINT) AS shard, reason FROM verdict", _VERDICT)
def v8_check_results(spark, sf_dir):
    return _verdicts(Inputs(spark, sf_dir))[2].select("query_id", *_long("shard"), "reason")


@query("SELECT query_id, CAST(shard AS BIGINT) AS shard, good AS committed, CASE WHEN good THEN tail_score ELSE old_score END AS tail_score FROM (SELECT *, bool_and(reason IS NULL) OVER (PARTITION BY query_id) AS good FROM verdict)", _VERDICT)
def v9_commit_checked(spark, sf_dir):
    old, new, verdicts = _verdicts(Inputs(spark, sf_dir))
    return receipts.commit_checked(old, new, verdicts).select("query_id", *_long("shard"), "committed", "tail_score")


@query(f"""SELECT 'prefix' AS kind, count(*) AS receipts, count(*) FILTER (WHERE {_NUM} % 10 = 0) AS wrong FROM idx_ranked WHERE rank <= {LENGTH}
UNION ALL SELECT 'snapshot', count(*) FILTER (WHERE ident NOT LIKE '%7'), count(*) FILTER (WHERE ident LIKE '%7') FROM idx""")
def v10_receipt_truth(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    scores, none = i.scores(), F.lit("")
    index = i.index()
    rows = tokens.acquire_tokens(index, scores, i.grid(), LENGTH)[1]
    claims = rows.select(F.lit("prefix").alias("kind"), "query_id", "shard", "ident", "body", (F.col("score") + (number() % 10 == 0).cast("int")).alias("score")).unionByName(
        index.where("ident not like '%7'").select(F.lit("snapshot").alias("kind"), none.alias("query_id"), "shard", "ident", "body", F.lit(0).cast("long").alias("score")))
    held = log.state_as_of(log.versions(i.initial, i.changes), i.lag().select(F.lit(0).alias("cut_id"), "shard", F.col("lo").alias("at"))).drop("cut_id")
    truth = rank.top_n(rank.rank_state(held, scores), tokens.KEYS, LENGTH).select(F.lit("prefix").alias("kind"), "query_id", "shard", "ident", "body", "score").unionByName(
        held.select(F.lit("snapshot").alias("kind"), none.alias("query_id"), "shard", "ident", "body", F.lit(0).cast("long").alias("score")))
    return receipts.receipt_truth(claims, truth, ["query_id", "shard", "ident"], ["body", "score"])


@query(f"""SELECT s.query_id, CAST(s.shard AS BIGINT) AS shard, s.ident, 'omitted' AS why FROM (SELECT query_id, shard, ident, score FROM state_cuts JOIN scores USING (body) WHERE cut_id = 4) s JOIN advanced a ON a.query_id = s.query_id AND a.shard = s.shard
LEFT JOIN (SELECT * FROM pool WHERE rank <= {LENGTH} AND {_NUM} % 4 <> 0) p ON p.query_id = s.query_id AND p.shard = s.shard AND p.ident = s.ident
WHERE p.ident IS NULL AND (a.tail_score IS NULL OR (-s.score, s.ident) < (-a.tail_score, a.tail_ident))""")
def v14_token_violations(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    heads, rows = _advanced(i)
    state = log.state_at(i.initial, i.changes, i.lag().select("shard", F.col("hi").alias("at")))
    return receipts.token_violations(heads, rows.where(number() % 4 != 0), rank.rank_state(state, i.scores())).select("query_id", *_long("shard"), "ident", "why")


# ---- audit tables

_BYTES = "strlen(CAST(to_json({'body': body, 'ident': ident, 'score': score}) AS VARCHAR)) + 1"
_COSTED = _OBS + f""", costs AS (SELECT policy, cut_id, query_id, sum({_BYTES}) AS bytes FROM answers GROUP BY ALL),
costed AS (SELECT a.*, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes, CAST(CASE policy WHEN 'exact' THEN 6 WHEN 'local' THEN 2 ELSE 0 END AS BIGINT) AS messages FROM assessed a LEFT JOIN costs USING (policy, cut_id, query_id))
"""


def _all_answers(i: Inputs) -> DataFrame:
    made = [a.withColumn("policy", F.lit(p)) for p, (a, _) in policy_answers(i).items()]
    return made[0].unionByName(made[1]).unionByName(made[2])


def _costed(i: Inputs) -> DataFrame:
    """Assessed answers with the bytes of their rows as JSON lines and the messages that a policy takes."""
    keys = ["policy", "cut_id", "query_id"]
    costs = _all_answers(i).groupBy(*keys).agg(F.sum(audit.wire_bytes("body", "ident", "score")).alias("bytes"))
    sent = F.when(F.col("policy") == "exact", 6).when(F.col("policy") == "local", 2).otherwise(0).cast("long")
    return _observations(i).join(costs, keys, "left").withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("messages", sent)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type", "")
def a1_nearest_rank(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").groupBy("event_type").agg(audit.nearest_rank("value", 0.5).alias("p50"), audit.nearest_rank("value", 0.95).alias("p95"))


@query("""SELECT policy, count(*) AS n, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE NOT claimed) AS not_complete, count(*) FILTER (WHERE false_complete) AS false_complete, CAST(sum(bytes) AS BIGINT) AS bytes,
round(avg(bytes), 9) AS mean_bytes, CAST(sum(messages) AS BIGINT) AS messages, max(returned) AS peak_state, CAST(median(returned) AS DOUBLE) AS median_state FROM costed GROUP BY policy""", _COSTED)
def a4_policy_totals(spark, sf_dir):
    return audit.policy_totals(_costed(Inputs(spark, sf_dir)), ["policy"], "returned")


@query("""SELECT policy, CAST(sum(n) AS BIGINT) AS n, round(sum(body_recall * n) / sum(n), 9) AS body_recall FROM (SELECT policy, cut_id, count(*) AS n, round(avg(body_recall), 9) AS body_recall FROM assessed GROUP BY ALL) GROUP BY policy""", _OBS)
def a6_case_aggregate(spark, sf_dir):
    return audit.case_aggregate(audit.summarize(_observations(Inputs(spark, sf_dir)), ["policy", "cut_id"]), ["policy"], "body_recall")


@query("SELECT (SELECT count(DISTINCT query_id) FROM terms) AS queries, count(DISTINCT query_id) AS repaired_queries, count(*) AS repaired_shards, round(count(DISTINCT query_id)::DOUBLE / (SELECT count(DISTINCT query_id) FROM terms), 9) AS rate FROM own", _REFILL)
def a7_repair_report(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return audit.repair_report(tokens.own_blockers(*(staged(t, "token") for t in _advanced(i)), K), i.terms().select("query_id"))


@query("""SELECT policy, CAST(cut_id AS BIGINT) AS cut_id, n, complete_pct, exact_pct FROM (SELECT cut_id, unnest(['exact', 'stale', 'mirror']) AS policy FROM (SELECT DISTINCT cut_id FROM cuts))
LEFT JOIN (SELECT policy, cut_id, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE claimed) / count(*), 9) AS complete_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE exact) / count(*), 9) AS exact_pct FROM assessed GROUP BY ALL) USING (policy, cut_id)""", _OBS)
def a8_sensitivity(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    grid = i.cuts.select("cut_id").distinct().withColumn("policy", F.explode(F.array(*map(F.lit, ("exact", "stale", "mirror")))))
    return audit.sensitivity(_observations(i), grid, ["policy", "cut_id"]).select("policy", *_long("cut_id"), "n", "complete_pct", "exact_pct")


@query("""SELECT policy, CAST(sum(bytes) AS BIGINT) AS bytes, round(100.0::DOUBLE * (1 - sum(bytes)::DOUBLE / (SELECT sum(bytes) FROM costed WHERE policy = 'exact')), 9) AS reduction FROM costed GROUP BY policy""", _COSTED)
def a9_relative_to(spark, sf_dir):
    return audit.relative_to(audit.policy_totals(_costed(Inputs(spark, sf_dir)), ["policy"]).select("policy", "bytes"), "exact", "bytes")


@query("""SELECT CAST(cut_id AS BIGINT) AS cut_id, round(avg(diff), 9) AS mean, round(min(diff), 9) AS least, round(max(diff), 9) AS most FROM (SELECT e.cut_id, e.id_recall - s.id_recall AS diff FROM assessed e JOIN assessed s
ON s.cut_id = e.cut_id AND s.query_id = e.query_id WHERE e.policy = 'exact' AND s.policy = 'stale') GROUP BY cut_id""", _OBS)
def a10_paired_diff(spark, sf_dir):
    d = audit.paired_diff(_observations(Inputs(spark, sf_dir)), ["cut_id", "query_id"], "exact", "stale", "id_recall")
    return d.groupBy(*_long("cut_id")).agg(F.round(F.avg("diff"), 9).alias("mean"), F.round(F.min("diff"), 9).alias("least"), F.round(F.max("diff"), 9).alias("most"))


_POISSON = " + ".join(f"(u >= {x})::INT" for x in audit._poisson_steps())


@query(f"""SELECT CAST(cut_id AS BIGINT) AS cut_id, round(mean, 9) AS mean, round(low, 9) AS low, round(high, 9) AS high FROM (
 SELECT cut_id, quantile_disc(m, 0.025) AS low, quantile_disc(m, 0.975) AS high FROM (SELECT cut_id, b, sum(w * v)::BIGINT / sum(w)::BIGINT / 1e9::DOUBLE AS m FROM (SELECT cut_id, b, v, {_POISSON} AS w FROM (
  SELECT cut_id, v, b, ('0x' || substr(md5('1:' || cut_id || ':' || query_id || ':' || b), 1, 8))::BIGINT AS u FROM diffs, (SELECT unnest(range(0, 1000)) AS b))) GROUP BY cut_id, b HAVING sum(w) > 0) GROUP BY cut_id)
JOIN (SELECT cut_id, sum(v)::BIGINT / count(*) / 1e9::DOUBLE AS mean FROM diffs GROUP BY cut_id) USING (cut_id)""", _OBS + """, diffs AS (SELECT e.cut_id, e.query_id, round((e.id_recall - s.id_recall) * 1e9::DOUBLE)::BIGINT AS v
FROM assessed e JOIN assessed s ON s.cut_id = e.cut_id AND s.query_id = e.query_id WHERE e.policy = 'exact' AND s.policy = 'stale')""")
def a10_bootstrap(spark, sf_dir):
    """Of each cut the interval of the mean difference of two policies over 1,000 resamples of its queries."""
    d = audit.paired_diff(_observations(Inputs(spark, sf_dir)), ["cut_id", "query_id"], "exact", "stale", "id_recall")
    b = audit.bootstrap_mean(d, "diff", "query_id", ("cut_id",), n=1000)
    return b.select(*_long("cut_id"), *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query(r"""SELECT doc_id, strlen(regexp_replace(regexp_replace(CAST(to_json({'lang': lang, 'note': NULL, 'source': source || substr(text, 1, 0) || regexp_replace(text, '[\x00-\x1f\x7f"\\/]', '', 'g')}) AS VARCHAR), '[\x{10000}-\x{10FFFF}]', 'xxxxxxxxxxxx', 'g'), '[^\x00-\x7F]', 'xxxxxx', 'g')) + 1 AS bytes
FROM documents WHERE text IS NOT NULL AND source IS NOT NULL""", "")
def a11_wire_bytes(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").where("text is not null and source is not null")
    plain = F.concat("source", F.regexp_replace("text", r'[\x00-\x1f\x7f"\\/]', ""))
    return d.select("doc_id", "lang", F.lit(None).cast("string").alias("note"), plain.alias("source")).select("doc_id", audit.wire_bytes("source", "lang", "note").cast("long").alias("bytes"))


@query(f"""SELECT trial, phase, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(returned_rows) AS BIGINT) AS returned_rows FROM (
 SELECT CAST(shard AS BIGINT) AS trial, 'acquisition' AS phase, 2 AS messages, {_BYTES} AS bytes, 1 AS returned_rows FROM idx_ranked WHERE rank <= {LENGTH}
 UNION ALL SELECT shard, 'feed', 1, {_BYTES.replace("'score': score", "'score': 0")}, 0 FROM changes UNION ALL SELECT shard, 'refill', 2, {_BYTES}, 1 FROM refetched) GROUP BY GROUPING SETS ((trial, phase), (trial))""", _REFILL)
def a12_phase_costs(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    _, rows, pick = _refilled(i)
    cost = lambda df, phase, sent, back: df.select(F.col("shard").cast("long").alias("trial"), F.lit(phase).alias("phase"), F.lit(sent).alias("messages"), audit.wire_bytes("body", "ident", "score").alias("bytes"), F.lit(back).alias("returned_rows"))
    first = rank.top_n(rank.rank_state(i.index(), i.scores()), tokens.KEYS, LENGTH)
    r = cost(first, "acquisition", 2, 1).unionByName(cost(i.changes.withColumn("score", F.lit(0)), "feed", 1, 0)).unionByName(cost(rows.join(pick, list(tokens.KEYS), "left_semi"), "refill", 2, 1))
    return audit.phase_costs(r, ["trial"])


@query(f"""SELECT g.query_id, CAST(sum(f.n) AS BIGINT) AS assignments, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS buffer_rows, CAST(sum(f.live) AS BIGINT) AS score_evaluations, CAST(sum(coalesce(p.n, 0)) AS BIGINT) AS sort_rows FROM grid g
JOIN (SELECT shard, count(*) AS n, count(*) FILTER (WHERE body <> '') AS live FROM finals GROUP BY shard) f ON f.shard = g.shard
LEFT JOIN (SELECT query_id, shard, count(*) AS n FROM idx_ranked WHERE rank <= {LENGTH} GROUP BY ALL) b ON b.query_id = g.query_id AND b.shard = g.shard
LEFT JOIN (SELECT query_id, shard, count(*) AS n FROM pool GROUP BY ALL) p ON p.query_id = g.query_id AND p.shard = g.shard GROUP BY g.query_id""")
def a14_token_work(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    scores = i.scores()
    heads, rows = (staged(t, "token") for t in tokens.acquire_tokens(i.index(), scores, i.grid(), LENGTH))
    return audit.token_work(heads, rows, staged(i.final(), "final"), scores)


@query("SELECT CAST(cut_id AS BIGINT) AS cut_id, query_id, count(DISTINCT coalesce(CAST(mine AS VARCHAR), '')) AS variants FROM j GROUP BY ALL HAVING variants > 1", _OBS)
def a15_matched_answers(spark, sf_dir):
    return audit.matched_answers(_all_answers(Inputs(spark, sf_dir)), ["cut_id", "query_id"]).select(*_long("cut_id"), "query_id", "variants")


@query(f"""SELECT policy, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT cut_id) AS trials, count(DISTINCT cut_id) = 5 AS whole, policy <> 'stale' AS balanced FROM (SELECT policy, cut_id, {_BYTES} AS bytes FROM answers WHERE NOT (policy = 'local' AND cut_id = 3)) GROUP BY policy""", _OBS)
def a16_matched_table(spark, sf_dir):
    rows = _all_answers(Inputs(spark, sf_dir)).where("not (policy = 'local' and cut_id = 3)").select("policy", F.col("cut_id").cast("string").alias("trial"), (F.col("rank") > 2).alias("phase"), audit.wire_bytes("body", "ident", "score").alias("bytes"))
    costs = rows.groupBy("policy", "trial", "phase").agg(F.sum("bytes").alias("bytes"))
    total = rows.groupBy("policy").agg(F.sum(F.col("bytes") + (F.col("policy") == "stale").cast("int")).alias("bytes"))
    return audit.matched_table(costs, total, list("01234")).withColumn("trials", F.col("trials").cast("long"))


@query("SELECT CAST(shard AS BIGINT) AS shard, CAST(cut_id AS BIGINT) AS cut_id, cutp - coalesce(lag(cutp) OVER (PARTITION BY shard ORDER BY cut_id), 0) AS delta FROM cuts")
def a17_counter_deltas(spark, sf_dir):
    return audit.counter_deltas(Inputs(spark, sf_dir).cuts, ["shard"], "cut_id", "at").select(*_long("shard", "cut_id"), "delta")


@query("""SELECT CAST(shard AS BIGINT) AS shard, CAST(max(b) AS BIGINT) AS peak, CAST(arg_max(cut_id, b * 10 - cut_id) AS BIGINT) AS "at" FROM (SELECT shard, cut_id, sum(strlen(CAST(to_json({'body': body, 'ident': ident}) AS VARCHAR)) + 1) AS b FROM state_cuts GROUP BY ALL) GROUP BY shard""")
def a18_peak_state(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    s = log.state_as_of(log.versions(i.initial, i.changes), i.cuts).withColumn("bytes", audit.wire_bytes("body", "ident"))
    return audit.peak_state(s, ["shard"], "cut_id").select(*_long("shard", "peak", "at"))


@query("""SELECT event_type, count(*) AS commands, count(*) FILTER (WHERE user_id % 7 = 0) AS failed, round(sum(value), 6) AS wall_seconds, round(sum(value * 2), 6) AS cpu_seconds, max(user_id) AS maximum_rss_kib FROM events GROUP BY event_type""", "")
def a19_resource_ledger(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    c = e.select("event_type", (F.col("user_id") % 7 == 0).cast("int").alias("exit_code"), F.col("value").alias("wall_seconds"), (F.col("value") * 2).alias("cpu_seconds"), F.col("user_id").alias("maximum_rss_kib"))
    return audit.resource_ledger(c, "event_type")


@query("SELECT event_type AS kind, count(*) AS receipts FROM events GROUP BY event_type", "")
def a20_count_kinds(spark, sf_dir):
    return audit.count_kinds(fx.table(spark, sf_dir, "events").withColumnRenamed("event_type", "kind"))


@query("SELECT CAST(shard AS BIGINT) AS shard, count(*) AS events, CAST(sum(n) AS BIGINT) AS assignments, max(n) AS largest FROM (SELECT shard, (seq - 1) // 4 AS b, count(DISTINCT ident) AS n FROM changes GROUP BY ALL) GROUP BY shard")
def a20_history_totals(spark, sf_dir):
    return audit.history_totals(fx.batches(fx.changes(spark, sf_dir))).select(*_long("shard"), "events", "assignments", "largest")


# ---- table checks

_LINKS = "regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1)"


@query(f"""SELECT page_id, trim(ref) AS ref FROM (SELECT page_id, unnest(string_split(array_to_string({_LINKS}, ';'), ';')) AS ref FROM pages) WHERE trim(ref) <> '' AND trim(ref) NOT IN (SELECT unnest({_LINKS}) FROM pages WHERE page_id % 2 = 0)""", "")
def d7_missing_refs(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    return tables.missing_refs(p.select("page_id", F.array_join(links, ";").alias("refs")), "page_id", "refs", p.where("page_id % 2 = 0").select(F.explode(links).alias("path")).distinct())


@query("""SELECT doc_id, unnest(CASE WHEN doc_id % 90 = 0 THEN ['lang', 'size'] WHEN doc_id % 50 = 0 AND doc_id % 70 = 0 THEN ['lang', 'size'] WHEN doc_id % 50 = 0 THEN ['size'] WHEN doc_id % 70 = 0 THEN ['lang'] ELSE [] END) AS field FROM documents""", "")
def d9_golden_diff(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    want = d.select("doc_id", F.coalesce(F.col("n_chars"), F.lit(0)).cast("double").alias("size"), F.coalesce("lang", F.lit("")).alias("lang"))
    got = want.where("doc_id % 90 <> 0").select("doc_id", (F.col("size") + F.when(F.col("doc_id") % 50 == 0, 1.0).otherwise(1e-12)).alias("size"), F.when(F.col("doc_id") % 70 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")).alias("lang"))
    return tables.golden_diff(want, got, "doc_id").select("doc_id", "field")


@query("""SELECT source, count(*) FILTER (WHERE doc_id % 97 <> 0) AS files, count(*) AS found_files, CAST(coalesce(sum(n_chars) FILTER (WHERE doc_id % 97 <> 0), 0) AS BIGINT) AS bytes, CAST(sum(n_chars) AS BIGINT) AS found_bytes FROM documents WHERE source IS NOT NULL GROUP BY source HAVING files <> found_files""", "")
def d10_inventory_check(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").where("source is not null")
    declared = d.where("doc_id % 97 <> 0").groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))
    return tables.inventory_check(declared, d, "source", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id % 13 = 0 OR sha256(coalesce(text, '')) <> sha256(rtrim(coalesce(text, ''), ' .'))", "")
def d10_digest_mismatches(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    declared = d.where("doc_id % 13 <> 0").select("doc_id", F.sha2(F.rtrim("text", F.lit(" .")), 256).alias("sha256"))
    return tables.digest_mismatches(d, declared, "doc_id", "text")


@query(r"SELECT page_id FROM pages WHERE list_extract(string_split(url, '/'), -1) IN ('de', 'fr') OR regexp_matches(list_extract(string_split(url, '/'), -1), '[05]$')", "")
def d11_forbidden_paths(spark, sf_dir):
    p = fx.table(spark, sf_dir, "pages").withColumn("path", F.col("url"))
    return tables.forbidden_paths(p, ["de", "fr"], "[05]$").select("page_id")


# ---- streams


def _feed_root(spark) -> str:
    return f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"


def _feed(spark, root: str) -> DataFrame:
    return spark.readStream.schema("shard int, seq long, pos int, ident string, body string").parquet(f"{root}/feed")


@query("SELECT CAST(shard AS BIGINT) AS shard, ident, body, CAST(len(labels) AS BIGINT) AS postings FROM state_cuts JOIN bodies USING (body) WHERE cut_id = 4")
def t4_stream_state(spark, sf_dir):
    """The log arrives in three parts, the middle one last, and each is folded in by a micro-batch."""
    i, root = Inputs(spark, sf_dir), _feed_root(spark)
    changes, bodies = staged(i.changes, "log"), staged(i.bodies, "bodies")
    for part in (0, 2, 1):
        changes.where(f"seq div 100 % 3 = {part}").write.mode("append").parquet(f"{root}/feed")
        state, postings = streams.stream_state(_feed(spark, root), i.initial, bodies, root)
    n = postings.groupBy("shard", "ident").agg(F.count("*").alias("postings"))
    return state.join(n, ["shard", "ident"], "left").select(*_long("shard"), "ident", "body", F.coalesce("postings", F.lit(0)).alias("postings"))


def _streamed(spark, sf_dir, ticks: int = 8, size: int = 16):
    """Answers and repairs of the standing run of k10, its ticks coming as micro-batches; half of them after a restart."""
    i, root = Inputs(spark, sf_dir), _feed_root(spark)
    changes, scores = staged(i.changes, "log"), i.scores()
    top = staged(changes.groupBy("shard").agg(F.max("seq").alias("top")), "tops")
    start = top.select("shard", (F.col("top") - size * ticks).alias("at"))
    state = staged(log.state_at(i.initial, changes, start), "state")
    grid = i.terms().select("query_id").distinct().crossJoin(start)
    heads, rows = (staged(t, "token") for t in tokens.acquire_tokens(state, scores, grid, LENGTH, K))
    late = staged(changes.join(top, "shard").withColumn("tick", F.expr(f"{ticks} - (top - seq) div {size}")).where("tick > 0"), "late")
    for half in (range(1, ticks // 2 + 1), range(ticks // 2 + 1, ticks + 1)):
        for tick in half:
            late.where(F.col("tick") == tick).select("shard", "seq", "pos", "ident", "body").coalesce(1).write.mode("append").parquet(f"{root}/feed")
        feed = spark.readStream.schema("shard int, seq long, pos int, ident string, body string").option("maxFilesPerTrigger", 1).parquet(f"{root}/feed")
        answers, repairs = streams.stream_standing(feed, state, heads, rows, scores, root, 3, K)
    return answers, repairs


@query(_STANDING.replace("CAST(tick AS BIGINT) AS tick", "CAST(tick AS BIGINT) - 1 AS version"))
def t2_stream_standing(spark, sf_dir):
    """Eight micro-batches advance, merge and repair; their answers are those of the batch job, exact at each one's cut."""
    out = _streamed(spark, sf_dir)[0]
    return out.where("rank is not null").select("version", "query_id", "rank", "ident", "body", "score", "status")


def _stepwise(ticks: int = 8, size: int = 16, rounds: int = 3) -> str:
    """The standing run in SQL, tick by tick and round by round: which tokens are repaired when."""
    at = lambda t: f"(top - {size * (ticks - t)})"
    state = lambda t: f"SELECT v.shard, ident, body FROM versions v JOIN tops t ON t.shard = v.shard WHERE body IS NOT NULL AND from_seq <= {at(t)} AND (to_seq IS NULL OR {at(t)} < to_seq)"
    ctes = [f"""sc AS MATERIALIZED (SELECT * FROM scores), qs AS MATERIALIZED (SELECT DISTINCT query_id FROM terms),
r0 AS MATERIALIZED (SELECT query_id, shard, ident, score, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, ident) AS rank FROM ({state(0)}) JOIN sc USING (body)),
h_0 AS MATERIALIZED (SELECT q.query_id, t.shard, {LENGTH} AS cap, r.score AS tail_score, r.ident AS tail_ident FROM qs q CROSS JOIN tops t LEFT JOIN r0 r ON r.query_id = q.query_id AND r.shard = t.shard AND r.rank = {LENGTH} + 1),
w_0 AS MATERIALIZED (SELECT query_id, shard, ident, score FROM r0 WHERE rank <= {LENGTH})"""]
    picks = []
    for t in range(1, ticks + 1):
        ctes.append(f"""f{t} AS MATERIALIZED (SELECT c.shard, ident, nullif(arg_max(coalesce(body, ''), seq), '') AS body FROM changes c JOIN tops t ON t.shard = c.shard WHERE seq > {at(t - 1)} AND seq <= {at(t)} GROUP BY c.shard, ident),
s{t} AS MATERIALIZED ({state(t)}), n{t} AS MATERIALIZED (SELECT shard, greatest({LENGTH}, least(64, {K} + count(*))) AS length FROM f{t} GROUP BY shard),
p{t} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, ident) AS rank FROM (
 SELECT w.* FROM w_{t - 1} w WHERE NOT EXISTS (SELECT 1 FROM f{t} f WHERE f.shard = w.shard AND f.ident = w.ident) UNION ALL SELECT query_id, shard, ident, score FROM f{t} JOIN sc USING (body))),
h{t}_0 AS MATERIALIZED (SELECT h.query_id, h.shard, cap,
  CASE WHEN p.score IS NULL OR (tail_score IS NOT NULL AND (-tail_score, tail_ident) <= (-p.score, p.ident)) THEN tail_score ELSE p.score END AS tail_score,
  CASE WHEN p.score IS NULL OR (tail_score IS NOT NULL AND (-tail_score, tail_ident) <= (-p.score, p.ident)) THEN tail_ident ELSE p.ident END AS tail_ident
  FROM h_{t - 1} h LEFT JOIN p{t} p ON p.query_id = h.query_id AND p.shard = h.shard AND p.rank = cap + 1),
w{t}_0 AS MATERIALIZED (SELECT p.query_id, p.shard, ident, score FROM p{t} p JOIN h{t}_0 h USING (query_id, shard) WHERE rank <= cap)""")
        for r in range(1, rounds + 1):
            done = " UNION ALL ".join(f"SELECT query_id, shard FROM k{t}_{x}" for x in range(1, r)) or "SELECT '', -1"
            ctes.append(f"""m{t}_{r} AS MATERIALIZED (SELECT query_id, count(*) AS n, max((-score, ident)) AS last FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ident) AS rank FROM w{t}_{r - 1}) WHERE rank <= {K} GROUP BY query_id),
k{t}_{r} AS MATERIALIZED (SELECT query_id, shard FROM h{t}_{r - 1} LEFT JOIN m{t}_{r} USING (query_id) WHERE tail_score IS NOT NULL AND (coalesce(n, 0) < {K} OR last >= (-tail_score, tail_ident)) AND (query_id, shard) NOT IN (SELECT (query_id, shard) FROM ({done}) d(query_id, shard))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY tail_score DESC, tail_ident) = 1),
g{t}_{r} AS MATERIALIZED (SELECT query_id, s.shard, s.ident, score, length, row_number() OVER (PARTITION BY query_id, s.shard ORDER BY score DESC, s.ident) AS rank FROM k{t}_{r} k JOIN s{t} s ON s.shard = k.shard JOIN sc USING (query_id, body) JOIN n{t} n ON n.shard = s.shard),
h{t}_{r} AS MATERIALIZED (SELECT h.query_id, h.shard, CASE WHEN k.query_id IS NULL THEN cap ELSE (SELECT coalesce(max(length), {LENGTH}) FROM n{t} n WHERE n.shard = h.shard) END AS cap, CASE WHEN k.query_id IS NULL THEN tail_score ELSE g.score END AS tail_score, CASE WHEN k.query_id IS NULL THEN tail_ident ELSE g.ident END AS tail_ident
  FROM h{t}_{r - 1} h LEFT JOIN k{t}_{r} k ON k.query_id = h.query_id AND k.shard = h.shard LEFT JOIN g{t}_{r} g ON g.query_id = h.query_id AND g.shard = h.shard AND g.rank = g.length + 1),
w{t}_{r} AS MATERIALIZED (SELECT * FROM w{t}_{r - 1} WHERE (query_id, shard) NOT IN (SELECT (query_id, shard) FROM k{t}_{r}) UNION ALL SELECT query_id, shard, ident, score FROM g{t}_{r} WHERE rank <= length)""")
            picks.append(f"SELECT {t} AS tick, query_id, shard FROM k{t}_{r}")
        ctes.append(f"h_{t} AS MATERIALIZED (SELECT * FROM h{t}_{rounds}), w_{t} AS MATERIALIZED (SELECT * FROM w{t}_{rounds})")
    return BASE + ", " + ",\n".join(ctes) + ", picks AS (" + " UNION ALL ".join(picks) + ")\n"


@query("SELECT CAST(tick AS BIGINT) AS tick, query_id, CAST(shard AS BIGINT) AS shard FROM picks", _stepwise())
def k10_repairs(spark, sf_dir):
    """The tokens that the standing run repairs, by tick."""
    return standing(spark, sf_dir, staged)[1].select(*_long("tick"), "query_id", *_long("shard"))


@query("SELECT CAST(tick AS BIGINT) - 1 AS version, query_id, CAST(shard AS BIGINT) AS shard FROM picks", _stepwise())
def t2_repairs(spark, sf_dir):
    return _streamed(spark, sf_dir)[1].select("version", "query_id", *_long("shard"))
