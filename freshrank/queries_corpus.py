"""Queries of code labels, stable plans, seeds, convergence and rank flips; registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import log, policies, rank
from .plans import corpus
from .queries import BASE, K, Inputs, _long, query
from .sources import files
from .sources import fixtures as fx
from .sources.scratch import staged

#: The files of fixtures.code_files and what their two functions hold.
CODE = BASE + """, code AS (SELECT coalesce(source, 'none') AS project, body || '.py' AS path, labels, len(labels) AS n, CAST(substr(body, 2) AS BIGINT) % 10 = 7 AS broken,
  coalesce(list_sum(list_transform(labels, lambda x: 18 + 3 * len(x))), 0) AS extra FROM bodies),
code_fn AS (SELECT project || '/' || path || ':Doc.body:1' AS ident, 33 + extra AS bytes, 2 AS line_start, 3 + n AS line_end, 1 AS nth,
  list_sort(flatten(list_transform(labels, lambda x: ['attr:a_' || x, 'call:a_' || x, 'name:n_' || x, 'name:w_' || x]))) AS labels FROM code WHERE NOT broken
  UNION ALL SELECT project || '/' || path || ':Doc.body:2', 42, 4 + n, 5 + n, 2, ['name:w_last'] FROM code WHERE NOT broken),
code_terms AS (SELECT ident, unnest(labels) AS label FROM code_fn),
code_df AS (SELECT label, count(*) AS df FROM code_terms GROUP BY label)"""


@query("""SELECT ident, 'Doc.body' AS qual, CAST(nth AS BIGINT) AS n, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end, CAST(bytes AS BIGINT) AS bytes, CAST(NULL AS VARCHAR) AS reason FROM code_fn
UNION ALL SELECT project || '/' || path, NULL, NULL, NULL, NULL, NULL, 'SyntaxError' FROM code WHERE broken""", CODE)
def c1_extract_fragments(spark, sf_dir):
    f = corpus.extract_fragments(fx.code_files(spark, sf_dir))
    return f.select("ident", "qual", *_long("n", "line_start", "line_end"), F.octet_length("source").cast("long").alias("bytes"), "reason")


def _code_bodies(spark, sf_dir):
    return corpus.labelled_fragments(fx.code_files(spark, sf_dir))


@query("""SELECT ident, CAST(len(labels) AS BIGINT) AS n_labels, md5(list_aggregate(labels, 'string_agg', ' ')) AS digest,
 CASE WHEN bytes > 20000 THEN 'fragment-byte-bound' WHEN len(labels) < 2 THEN 'fewer-than-two-labels' END AS outcome FROM code_fn WHERE len(labels) > 0""", CODE)
def c2_code_labels(spark, sf_dir):
    b = _code_bodies(spark, sf_dir).where(F.size("labels") > 0)
    return b.select("ident", F.size("labels").cast("long").alias("n_labels"), F.md5(F.array_join("labels", " ")).alias("digest"), corpus.admission(F.col("size"), F.col("labels")).alias("outcome"))


@query("""SELECT ident, pos, label FROM (SELECT ident, label, row_number() OVER (PARTITION BY ident ORDER BY NOT starts_with(label, 'call:'), df, label) AS pos FROM code_terms JOIN code_df USING (label)) WHERE pos <= 4""", CODE)
def c8_plan_calls_first(spark, sf_dir):
    return corpus.plan_calls_first(_code_bodies(spark, sf_dir), "ident").select("ident", *_long("pos"), "label")


@query("""SELECT CAST(shard AS BIGINT) AS shard, ident, body FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ident) - 1 AS nth, count(*) OVER (PARTITION BY shard) AS len FROM initial)
WHERE NOT (len > 1 AND list_contains(list_transform(range(1, least(8, len // 2) + 1), lambda j: (j * len) // (least(8, len // 2) + 1)), nth))""")
def c10b_drop_seeds(spark, sf_dir):
    start = fx.initial(spark, sf_dir)
    return corpus.drop_seeds(start, corpus.split_seeds(start, "shard", "ident", staged).where("is_seed")).select(*_long("shard"), "ident", "body")


#: Every 5th ident is not in the base. pos 0: the pool is too small for a plan.
@query("""SELECT ident, pos, label FROM (SELECT ident, label, row_number() OVER (PARTITION BY ident ORDER BY coalesce(df, 0), label) AS pos FROM fits LEFT JOIN label_df USING (label)) WHERE pos <= 4 AND ident NOT IN (SELECT ident FROM few)
UNION ALL SELECT ident, 0, NULL FROM few""", BASE + """, seen AS (SELECT ident, from_seq, labels, CAST(substr(ident, 2) AS BIGINT) % 5 <> 0 AS at_base FROM versions JOIN bodies USING (body) WHERE from_seq > 0 OR CAST(substr(ident, 2) AS BIGINT) % 5 <> 0),
totals AS (SELECT ident, count(DISTINCT from_seq) AS n, bool_or(at_base) AS at_base FROM seen GROUP BY ident),
held AS (SELECT ident, label, count(DISTINCT from_seq) AS c FROM (SELECT ident, from_seq, unnest(labels) AS label FROM seen) GROUP BY ident, label),
fits AS (SELECT ident, label FROM held JOIN totals USING (ident) WHERE NOT at_base OR c = n),
few AS (SELECT t.ident FROM totals t LEFT JOIN fits f ON f.ident = t.ident GROUP BY t.ident HAVING count(f.label) < 2)""")
def c11_plan_stable_labels(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    base = i.initial.where(F.substring("ident", 2, 20).cast("long") % 5 != 0)
    seen = log.versions(base, i.changes).where("body is not null").select("ident", F.col("from_seq").alias("version"), "body")
    plans, few = corpus.plan_stable_labels(seen, base, staged(corpus.label_df(i.stored), "df"), "ident", bodies=i.stored)
    return plans.select("ident", *_long("pos"), "label").unionByName(few.select("ident", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("label")))


@query("""SELECT body, CAST(substr(body, 2) AS BIGINT) % 50 <> 0 AND (CAST(substr(body, 2) AS BIGINT) % 7 <> 0 OR len(labels) = 0) AS agree FROM bodies""")
def c15_labels_agree(spark, sf_dir):
    """Against a copy that lacks every 50th body and the first label of every 7th."""
    b = fx.bodies(spark, sf_dir)
    number = F.substring("body", 2, 20).cast("long")
    other = b.where(number % 50 != 0).withColumn("labels", F.when(number % 7 == 0, F.expr("slice(labels, 2, size(labels))")).otherwise(F.col("labels")))
    return corpus.labels_agree(b, other)


@query("""SELECT replica, CAST(t.shard AS BIGINT) AS shard, CASE WHEN replica = 'replayed' THEN 0 ELSE coalesce(n, 0) END AS differences FROM tops t, (SELECT unnest(['replayed', 'lagging']) AS replica)
LEFT JOIN (SELECT coalesce(a.shard, b.shard) AS shard, count(*) AS n FROM (SELECT * FROM state_cuts WHERE cut_id = 3) a FULL JOIN (SELECT * FROM state_cuts WHERE cut_id = 4) b ON a.shard = b.shard AND a.ident = b.ident
 WHERE a.body IS DISTINCT FROM b.body GROUP BY 1) d ON d.shard = t.shard""")
def l9_convergence(spark, sf_dir):
    """A replica replayed from a checkpoint has converged; one that stopped at 75 % has not."""
    i = Inputs(spark, sf_dir)
    at = {c: i.cuts.where(F.col("cut_id") == c).drop("cut_id") for c in (2, 3, 4)}
    base, rest = log.compact(i.initial, i.changes, at[2])
    replicas = log.state_at(base, rest, at[4]).withColumn("replica", F.lit("replayed")).unionByName(log.state_at(i.initial, i.changes, at[3]).withColumn("replica", F.lit("lagging")))
    members = at[4].select("shard", F.explode(F.array(F.lit("replayed"), F.lit("lagging"))).alias("replica"))
    return log.convergence(replicas, members, log.state_at(i.initial, i.changes, at[4])).select("replica", *_long("shard", "differences"))


@query(f"""SELECT * FROM (SELECT query_id, CAST(shard AS BIGINT) AS shard, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, ident) AS rank, ident, score
FROM state_cuts JOIN scores USING (body) WHERE cut_id = 4) WHERE rank <= {K}""")
def r6_top_n(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    state = log.state_at(i.initial, i.changes, i.cuts.where("cut_id = 4").drop("cut_id"))
    return rank.top_n(rank.rank_state(state, i.scores()), ("query_id", "shard"), K).select("query_id", *_long("shard", "rank"), "ident", "score")


@query("SELECT query_id, rank, ident, score FROM exact WHERE cut_id = 4 AND rank <= 3")
def r9_merge_topk(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    state = log.state_at(i.initial, i.changes, i.cuts.where("cut_id = 4").drop("cut_id"))
    return rank.merge_topk(rank.rank_state(state, i.scores()), ("query_id",), 3).select("query_id", *_long("rank"), "ident", "score")


@query("""SELECT a.query_id, a.ident, b.ident AS other FROM best a JOIN best b ON a.query_id = b.query_id AND a.rank < b.rank AND a.weight > b.weight AND a.now < b.now""",
       BASE + f""", corpora AS (SELECT stage, body FROM bodies, (SELECT unnest([1, 2]) AS stage) WHERE stage = 2 OR CAST(substr(body, 2) AS BIGINT) % 2 = 0),
post AS (SELECT stage, body AS ident, label FROM corpora JOIN body_labels USING (body)),
sizes AS (SELECT stage, count(*)::DOUBLE AS n FROM corpora GROUP BY stage),
idf AS (SELECT stage, label, ln(any_value(n) / count(*)) AS idf FROM post JOIN sizes USING (stage) GROUP BY stage, label),
norms AS (SELECT stage, ident, sqrt(sum(idf * idf)) AS norm FROM post JOIN idf USING (stage, label) GROUP BY stage, ident),
dots AS (SELECT stage, query_id, ident, sum(idf * idf) AS dot FROM post JOIN terms USING (label) JOIN idf USING (stage, label) WHERE alt = 0 GROUP BY ALL),
weights AS (SELECT stage, query_id, ident, round(dot / norm, 9) AS weight FROM dots JOIN norms USING (stage, ident) WHERE norm > 0),
best AS (SELECT w.query_id, w.ident, w.weight, w.rank, coalesce(x.weight, 0) AS now FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, ident) AS rank FROM weights WHERE stage = 1) w
 LEFT JOIN weights x ON x.stage = 2 AND x.query_id = w.query_id AND x.ident = w.ident WHERE rank <= {4 * K})""")
def r11_rank_flips(spark, sf_dir):
    """The even documents alone, and after the odd ones have come: none of the even ones changes, their order does."""
    i = Inputs(spark, sf_dir)
    every = i.bodies.select(F.lit(0).alias("shard"), F.col("body").alias("ident"), "body")
    even = every.where(F.substring("body", 2, 20).cast("long") % 2 == 0)
    before, after = (rank.tfidf_rank(s, i.bodies, i.terms()).withColumn("weight", F.round("weight", 9)) for s in (even, every))
    return rank.rank_flips(before, after, even, 4 * K)


#: Of a query's shards one in seven does not reply.
_REPLIED = "(CAST(substr(query_id, 2) AS INT) + shard) % 7 <> 0"


@query(f"""SELECT query_id, rank, ident, score, covered, covered = 3 AS claim FROM (SELECT query_id, ident, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ident) AS rank FROM idx_ranked WHERE {_REPLIED})
JOIN (SELECT query_id, count(*) AS covered FROM grid WHERE {_REPLIED} GROUP BY query_id) USING (query_id) WHERE rank <= {K}""")
def p7_unverified(spark, sf_dir):
    """All shards asked at their lagging indexes, completeness claimed where all replied."""
    i = Inputs(spark, sf_dir)
    rows, heads = policies.unverified_topk(rank.rank_state(i.index(), i.scores()), i.grid().where(_REPLIED), 3, K)
    return rows.join(heads, "query_id").select("query_id", *_long("rank"), "ident", "score", "covered", "claim")


@query("""SELECT l_orderkey AS run, CAST(l_linenumber AS BIGINT) AS line, policy, CASE WHEN policy = 'gross' THEN l_extendedprice ELSE l_quantity END AS amount FROM lineitem, (SELECT unnest(['gross', 'count']) AS policy)""", "")
def s7_flatten_observations(spark, sf_dir):
    """Orders as nested runs, flattened to a row for each (run, line, policy)."""
    one = [F.lit("gross"), F.struct(F.col("l_extendedprice").cast("double").alias("amount")), F.lit("count"), F.struct(F.col("l_quantity").cast("double").alias("amount"))]
    record = F.struct(F.col("l_linenumber").cast("long").alias("line"), F.create_map(*one).alias("observations"))
    runs = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.collect_list(record).alias("records"))
    return files.flatten_observations(runs, ["run"])
