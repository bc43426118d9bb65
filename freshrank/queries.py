"""The registered queries and the SQL that says the same on the driver's tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import audit, log, rank, tables, tokens
from .plans import corpus
from .sources import fixtures as fx
from .sources.scratch import bucketed, staged

#: Answers, rows of a token; an index lags by one part in LAG of its log.
K, LENGTH, LAG = 5, 5, 100
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_MAP = ", ".join(f"('{a}', '{b}')" for a, b in fx.ALTERNATES.items())
#: Common table expressions of the oracles: the adapters of sources/fixtures.py and what most queries begin with.
BASE = rf"""
WITH RECURSIVE nd AS (SELECT count(*) AS n_docs FROM documents),
bodies AS (SELECT printf('b%06d', doc_id) AS body, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> ''))) AS labels, source FROM documents),
body_labels AS (SELECT body, unnest(labels) AS label FROM bodies),
label_df AS (SELECT label, count(*) AS df FROM body_labels GROUP BY label),
changes AS (SELECT CAST(user_id % 3 AS INT) AS shard, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS seq, printf('u%06d', user_id) AS ident,
  CASE WHEN event_type = 'error' THEN NULL ELSE printf('b%06d', event_id % n_docs) END AS body FROM events, nd),
initial AS (SELECT DISTINCT CAST(user_id % 3 AS INT) AS shard, printf('u%06d', user_id) AS ident, printf('b%06d', user_id % n_docs) AS body FROM events, nd),
tops AS (SELECT shard, max(seq) AS top FROM changes GROUP BY shard),
cuts AS (SELECT c AS cut_id, shard, top * c // 4 AS cutp FROM tops, (SELECT unnest([0, 1, 2, 3, 4]) AS c)),
items AS (SELECT printf('q%03d', item_id) AS query_id, item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS label FROM benchmark),
base_terms AS (SELECT query_id, item_id, pos, label FROM (SELECT query_id, item_id, label, row_number() OVER (PARTITION BY query_id ORDER BY df, label) AS pos
  FROM items JOIN label_df USING (label), nd WHERE df * 50 >= n_docs) WHERE pos <= 4),
subst(src, dest) AS (VALUES {_MAP}),
mapped AS (SELECT query_id, pos, label, coalesce(dest, label) AS dest FROM base_terms LEFT JOIN subst ON label = src WHERE item_id % 2 = 0),
alt_terms AS (SELECT query_id, dest, min(pos) AS pos FROM mapped WHERE query_id IN (SELECT query_id FROM mapped WHERE dest <> label) GROUP BY query_id, dest),
terms AS (SELECT query_id, 0 AS alt, CAST(pos AS INT) AS pos, label FROM base_terms
  UNION ALL SELECT query_id, 1, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INT), dest FROM alt_terms),
scores AS (SELECT query_id, body, max(c) AS score FROM (SELECT query_id, alt, body, count(*) AS c FROM terms JOIN body_labels USING (label) GROUP BY query_id, alt, body) GROUP BY query_id, body),
versions AS (SELECT shard, ident, body, seq AS from_seq, lead(seq) OVER (PARTITION BY shard, ident ORDER BY seq) AS to_seq
  FROM (SELECT shard, ident, body, 0 AS seq FROM initial UNION ALL SELECT shard, ident, body, seq FROM changes)),
state_cuts AS (SELECT cut_id, v.shard, ident, body FROM versions v JOIN cuts c ON v.shard = c.shard AND from_seq <= cutp AND (to_seq IS NULL OR cutp < to_seq) WHERE body IS NOT NULL),
exact AS (SELECT * FROM (SELECT cut_id, query_id, row_number() OVER (PARTITION BY cut_id, query_id ORDER BY score DESC, ident) AS rank, shard, ident, body, score
  FROM state_cuts JOIN scores USING (body)) WHERE rank <= {K}),
lag_at AS (SELECT shard, top - top // {LAG} AS lo, top AS hi FROM tops),
idx AS (SELECT v.shard, ident, body FROM versions v JOIN lag_at l ON v.shard = l.shard AND from_seq <= lo AND (to_seq IS NULL OR lo < to_seq) WHERE body IS NOT NULL),
finals AS (SELECT c.shard, ident, arg_max(coalesce(body, ''), seq) AS body FROM changes c JOIN lag_at l ON c.shard = l.shard WHERE seq > lo AND seq <= hi GROUP BY c.shard, ident),
idx_ranked AS (SELECT query_id, shard, ident, body, score, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, ident) AS rank FROM idx JOIN scores USING (body)),
grid AS (SELECT query_id, shard, lo, hi FROM (SELECT DISTINCT query_id FROM terms), lag_at),
heads AS (SELECT g.query_id, g.shard, g.lo, r.score AS tail_score, r.ident AS tail_ident FROM grid g LEFT JOIN idx_ranked r ON r.query_id = g.query_id AND r.shard = g.shard AND r.rank = {LENGTH} + 1),
fresh AS (SELECT query_id, shard, ident, body, score FROM finals JOIN scores USING (body)),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, ident) AS rank FROM (
  SELECT query_id, shard, ident, body, score FROM idx_ranked r WHERE rank <= {LENGTH} AND NOT EXISTS (SELECT 1 FROM finals f WHERE f.shard = r.shard AND f.ident = r.ident)
  UNION ALL SELECT * FROM fresh)),
advanced AS (SELECT h.query_id, h.shard,
    CASE WHEN p.score IS NULL OR (h.tail_score IS NOT NULL AND (-h.tail_score, h.tail_ident) <= (-p.score, p.ident)) THEN h.tail_score ELSE p.score END AS tail_score,
    CASE WHEN p.score IS NULL OR (h.tail_score IS NOT NULL AND (-h.tail_score, h.tail_ident) <= (-p.score, p.ident)) THEN h.tail_ident ELSE p.ident END AS tail_ident
  FROM heads h LEFT JOIN pool p ON p.query_id = h.query_id AND p.shard = h.shard AND p.rank = {LENGTH} + 1),
merged AS (SELECT * FROM (SELECT query_id, shard, ident, body, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ident) AS rank FROM pool WHERE rank <= {LENGTH}) WHERE rank <= {K}),
lasts AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = {K} THEN score END) AS l_score, max(CASE WHEN rank = {K} THEN ident END) AS l_ident FROM merged GROUP BY query_id),
merge_heads AS (SELECT a.query_id, count(*) FILTER (WHERE a.tail_score IS NOT NULL AND (coalesce(n, 0) < {K} OR (-l_score, l_ident) >= (-a.tail_score, a.tail_ident))) AS blockers
  FROM advanced a LEFT JOIN lasts USING (query_id) GROUP BY a.query_id),
obs AS (SELECT p.policy, c.cut_id, q.query_id FROM (SELECT unnest(['exact', 'stale', 'local']) AS policy) p, (SELECT DISTINCT cut_id FROM cuts) c, (SELECT DISTINCT query_id FROM terms) q)
"""

#: Certificates of a prefix and a delta.
CERT = BASE + f""", cert_pool AS (
  SELECT query_id, shard, ident, score FROM idx_ranked r WHERE rank <= {LENGTH} AND NOT EXISTS (SELECT 1 FROM finals f WHERE f.shard = r.shard AND f.ident = r.ident)
  UNION ALL SELECT query_id, shard, ident, score FROM fresh QUALIFY row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, ident) <= {K}),
cert_rows AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ident) AS rank FROM cert_pool),
cert_last AS (SELECT query_id, score AS l_score, ident AS l_ident FROM cert_rows WHERE rank = {K}),
cert_heads AS (SELECT h.query_id, count(*) FILTER (WHERE h.tail_score IS NOT NULL AND (l_score IS NULL OR (-l_score, l_ident) >= (-h.tail_score, h.tail_ident))) AS blockers FROM heads h LEFT JOIN cert_last USING (query_id) GROUP BY h.query_id)"""


def query(sql: str | None = None, base: str = BASE):
    """Registers a query under its function's name, with its oracle."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = base + sql
        return f

    return put


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


class Inputs:
    """The adapted tables of one folder. Query terms, scores and exact answers, which a query may use many times, are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.bodies, self.changes, self.initial = fx.bodies(spark, sf_dir), fx.changes(spark, sf_dir), fx.initial(spark, sf_dir)
        self.cuts = fx.cuts(self.changes)

    @cached_property
    def posted(self) -> rank.PostingIndex:
        """The bodies' labels, read once from the texts and stored."""
        return rank.PostingIndex(fx.body_labels(self.spark, self.dir), "body", "postings")

    @cached_property
    def stored(self) -> DataFrame:
        """The bodies with their labels, tokenized once and bucketed by body."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return bucketed(self.bodies.repartition(parts, "body"), ("body",), parts, "bodies")

    @cached_property
    def _terms(self) -> DataFrame:
        return staged(fx.query_terms(self.spark, self.dir, self.posted.labels), "terms")

    @cached_property
    def _scores(self) -> DataFrame:
        return staged(rank.score_bodies(self.posted.lookup(self.terms()), self.terms()), "scores")

    @cached_property
    def _exact(self) -> DataFrame:
        return staged(rank.exact_topk(self.initial, self.changes, self.bodies, self.terms(), self.cuts, K, self.scores()), "exact")

    def terms(self) -> DataFrame:
        return self._terms

    def scores(self) -> DataFrame:
        return self._scores

    def exact(self) -> DataFrame:
        return self._exact

    def lag(self) -> DataFrame:
        return self.changes.groupBy("shard").agg(F.max("seq").alias("hi")).select("shard", F.expr(f"hi - hi div {LAG}").alias("lo"), "hi")

    def index(self) -> DataFrame:
        return log.state_at(self.initial, self.changes, self.lag().select("shard", F.col("lo").alias("at")))

    def final(self) -> DataFrame:
        return log.final_assignments(log.suffix(self.changes, self.lag()))

    def grid(self) -> DataFrame:
        return self.terms().select("query_id").distinct().crossJoin(self.lag().select("shard", F.col("lo").alias("at")))


# ---- labels and plans


@query("SELECT body, CAST(len(labels) AS BIGINT) AS n_labels, md5(list_aggregate(labels, 'string_agg', ' ')) AS digest FROM bodies WHERE len(labels) > 0")
def c2b_token_labels(spark, sf_dir):
    b = fx.bodies(spark, sf_dir)
    return b.where(F.size("labels") > 0).select("body", F.size("labels").cast("long").alias("n_labels"), F.md5(F.array_join("labels", " ")).alias("digest"))


@query("""SELECT CASE WHEN octet_length(encode(coalesce(text, ''))) > 5000 THEN 'fragment-byte-bound' WHEN len(b.labels) < 2 THEN 'fewer-than-two-labels' ELSE 'kept' END AS outcome, count(*) AS n
FROM documents JOIN bodies b ON b.body = printf('b%06d', doc_id) GROUP BY 1""")
def c3_admission(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    why = corpus.admission(F.octet_length(F.coalesce("text", F.lit(""))), corpus.token_labels(F.col("text")), 5000)
    return d.select(F.coalesce(why, F.lit("kept")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS bodies, count(*) FILTER (WHERE len(labels) >= 2) AS indexed FROM bodies GROUP BY source")
def c4_corpus_report(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("source", corpus.token_labels(F.col("text")).alias("labels"))
    return d.groupBy("source").agg(F.count("*").alias("bodies"), F.count_if(F.size("labels") >= 2).alias("indexed"))


@query("SELECT source, CAST((dense_rank() OVER (ORDER BY source) - 1) % 3 AS BIGINT) AS shard FROM (SELECT DISTINCT source FROM documents)")
def c5_assign_shards(spark, sf_dir):
    return corpus.assign_shards(fx.table(spark, sf_dir, "documents"), "source", 3).select("source", *_long("shard"))


@query("""SELECT doc_id, source, len > 1 AND list_contains(list_transform(range(1, least(8, len // 2) + 1), lambda j: (j * len) // (least(8, len // 2) + 1)), nth) AS is_seed
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth, count(*) OVER (PARTITION BY source) AS len FROM documents)""")
def c6_split_seeds(spark, sf_dir):
    return corpus.split_seeds(fx.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", staged)


@query("SELECT label, df FROM label_df")
def c7_label_df(spark, sf_dir):
    return corpus.label_df(fx.bodies(spark, sf_dir))


@query("SELECT query_id, CAST(alt AS BIGINT) AS alt, CAST(pos AS BIGINT) AS pos, label FROM terms")
def c9_query_plans(spark, sf_dir):
    return fx.query_terms(spark, sf_dir).select("query_id", *_long("alt", "pos"), "label")


@query("""SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s1:' || CAST(doc_id AS VARCHAR))) AS place FROM documents) WHERE place <= 8""")
def c10_hash_sample(spark, sf_dir):
    d = corpus.hash_sample_per_group(fx.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "s1:", 8)
    return d.select("source", "doc_id", *_long("place"))


@query("""SELECT source, doc_id, n = 3 AS "full" FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) WHERE p <= 3)""")
def c12_top_n_per_stratum(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source")
    return corpus.top_n_per_stratum(d, "source", "doc_id", 3).select("source", "doc_id", "full")


@query("""SELECT tick, query_id FROM (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM terms)),
(SELECT unnest(range(1, 9)) AS tick) WHERE ((place - (tick - 1) * 4) % n + n) % n < 4""")
def c13_activation_schedule(spark, sf_dir):
    return corpus.activation_schedule(fx.query_terms(spark, sf_dir), 8, 4).select(*_long("tick"), "query_id")


@query("SELECT 'b' || substr(sha256(coalesce(text, '')), 1, 16) AS body, count(*) AS holders FROM documents GROUP BY 1")
def c14_body_ids(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.groupBy(corpus.body_id(F.coalesce("text", F.lit(""))).alias("body")).agg(F.count("*").alias("holders"))


# ---- the log


@query("""SELECT b.shard, b.seq, CASE WHEN max(CASE WHEN b.body IS NOT NULL AND k.body IS NULL THEN 1 ELSE 0 END) = 1 THEN 'unknown-body' END AS reason
FROM (SELECT shard, (seq - 1) // 4 + 1 AS seq, ident, nullif(arg_max(coalesce(body, ''), seq), '') AS body FROM changes GROUP BY 1, 2, 3) b
LEFT JOIN (SELECT body FROM bodies WHERE len(labels) >= 50) k ON k.body = b.body GROUP BY b.shard, b.seq""")
def l1_validate_batches(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return log.validate_batches(fx.batches(i.changes), i.bodies.where(F.size("labels") >= 50))


@query("""SELECT CAST(shard AS BIGINT) AS shard, outcome, count(*) AS n FROM (
 SELECT shard, CASE WHEN bad IS NOT NULL THEN bad WHEN seq <= 10 THEN 'old' WHEN seq > 138 THEN 'retention-window' WHEN arrival = min(arrival) FILTER (WHERE bad IS NULL) OVER w THEN 'ok'
   WHEN content = arg_min(content, arrival) FILTER (WHERE bad IS NULL) OVER w THEN 'duplicate' ELSE 'conflicting-sequence' END AS outcome
 FROM (SELECT shard, seq, arrival, list_sort(list(ident || coalesce(body, '-'))) AS content,
   CASE WHEN seq < 1 THEN 'event-schema' WHEN count(*) > count(DISTINCT ident) THEN 'batch-schema' WHEN bool_or(body IS NOT NULL AND body NOT IN (SELECT body FROM bodies)) THEN 'unknown-body' END AS bad
  FROM (SELECT shard, seq, ident, body, seq * 10 + seq * 7 % 5 * 10 AS arrival FROM changes
   UNION ALL SELECT shard, seq, ident, CASE WHEN seq % 5 = 0 THEN 'b000000' ELSE body END, seq * 10 + 55 FROM changes WHERE seq % 17 = 0
   UNION ALL SELECT shard, seq, ident, 'b00000x', seq * 10 - 3 FROM changes WHERE seq % 53 = 0
   UNION ALL SELECT shard, seq, ident, unnest([body, 'b000000']), seq * 10 - 4 FROM changes WHERE seq % 59 = 0
   UNION ALL SELECT shard, -seq, ident, body, seq * 10 - 5 FROM changes WHERE seq % 1000 = 0) GROUP BY shard, seq, arrival)
 WINDOW w AS (PARTITION BY shard, seq)) GROUP BY shard, outcome""")
def l2_classify_deliveries(spark, sf_dir):
    d = log.classify_deliveries(fx.deliveries(fx.changes(spark, sf_dir)), fx.bodies(spark, sf_dir), shards=3, floor=10)
    return d.groupBy("shard", "outcome").agg(F.count("*").alias("n")).select(*_long("shard"), "outcome", "n")


@query("""SELECT CAST(t.shard AS BIGINT) AS shard, coalesce(min(s.seq) - 1, any_value(t.top)) AS frontier FROM tops t LEFT JOIN changes s ON s.shard = t.shard AND s.seq > 5 AND s.seq % 211 = 0 GROUP BY t.shard""")
def l3_frontiers(spark, sf_dir):
    return log.frontiers(fx.changes(spark, sf_dir).where("seq <= 5 or seq % 211 <> 0")).select(*_long("shard"), "frontier")


@query("""SELECT CAST(cut_id AS BIGINT) AS range_id, CAST(c.shard AS BIGINT) AS shard, cutp AS lo, top AS hi, (SELECT count(*) FROM changes x WHERE x.shard = c.shard AND seq > cutp AND seq <= top AND seq % 211 <> 0) = top - cutp AS covered
FROM cuts c JOIN tops t ON c.shard = t.shard""")
def l4_coverage(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    r = i.cuts.join(i.changes.groupBy("shard").agg(F.max("seq").alias("hi")), "shard").select(F.col("cut_id").alias("range_id"), "shard", F.col("at").alias("lo"), "hi")
    return log.coverage(i.changes.where("seq % 211 <> 0"), r).select(*_long("range_id", "shard"), "lo", "hi", "covered")


@query("""SELECT c.seq AS range_id, CAST(c.shard AS BIGINT) AS shard, c.seq AS lo, least(c.seq + c.seq % 300, top) AS hi, (SELECT count(*) FROM changes x WHERE x.shard = c.shard AND x.seq > c.seq AND x.seq <= least(c.seq + c.seq % 300, top) AND x.seq % 211 <> 0) = least(c.seq + c.seq % 300, top) - c.seq AS covered
FROM changes c JOIN tops t ON c.shard = t.shard""")
def l4_many_ranges(spark, sf_dir):
    """A range from every position of the log, of up to 299 positions."""
    i = Inputs(spark, sf_dir)
    r = i.changes.join(i.changes.groupBy("shard").agg(F.max("seq").alias("top")), "shard").select(F.col("seq").alias("range_id"), "shard", F.col("seq").alias("lo"), F.least(F.col("seq") + F.col("seq") % 300, "top").alias("hi"))
    return log.coverage(i.changes.where("seq % 211 <> 0"), r).select("range_id", *_long("shard"), "lo", "hi", "covered")


@query("SELECT CAST(shard AS BIGINT) AS shard, ident, nullif(arg_max(coalesce(body, ''), seq), '') AS body FROM changes GROUP BY shard, ident")
def l5_final_assignments(spark, sf_dir):
    return log.final_assignments(fx.changes(spark, sf_dir)).select(*_long("shard"), "ident", "body")


@query("SELECT CAST(shard AS BIGINT) AS shard, count(DISTINCT ident) AS dirty FROM changes GROUP BY shard")
def l6_dirty(spark, sf_dir):
    return log.dirty_count(fx.changes(spark, sf_dir)).select(*_long("shard"), "dirty")


@query("SELECT CAST(shard AS BIGINT) AS shard, ident, body FROM state_cuts WHERE cut_id = 2")
def l7_state_at(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return log.state_at(i.initial, i.changes, i.cuts.where("cut_id = 2").drop("cut_id")).select(*_long("shard"), "ident", "body")


@query("SELECT CAST(cut_id AS BIGINT) AS cut_id, CAST(shard AS BIGINT) AS shard, ident, body FROM state_cuts")
def l8_state_as_of(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return log.state_as_of(log.versions(i.initial, i.changes), i.cuts).select(*_long("cut_id", "shard"), "ident", "body")


#: A thousand cuts of each shard, evenly spaced.
_MANY = BASE + ", many AS (SELECT t AS cut_id, shard, top * t // 1000 AS p FROM tops, (SELECT unnest(range(1, 1001)) AS t))"


@query("""SELECT c.cut_id, CAST(c.shard AS BIGINT) AS shard, count(v.ident) AS live, CAST(sum(CAST(substr(body, 2) AS BIGINT)) AS BIGINT) AS bodies FROM many c LEFT JOIN versions v ON v.shard = c.shard AND from_seq <= p AND (to_seq IS NULL OR p < to_seq) AND body IS NOT NULL
GROUP BY c.cut_id, c.shard HAVING count(v.ident) > 0""", _MANY)
def l8_many_cuts(spark, sf_dir):
    """The states at 1,000 cuts of each shard, summed up."""
    i = Inputs(spark, sf_dir)
    top = i.changes.groupBy("shard").agg(F.max("seq").alias("top"))
    many = top.withColumn("cut_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(1000).cast("long")))).select("cut_id", "shard", F.expr("top * cut_id div 1000").alias("at"))
    state = log.state_as_of(log.versions(i.initial, i.changes), many)
    return state.groupBy("cut_id", *_long("shard")).agg(F.count("*").alias("live"), F.sum(F.substring("body", 2, 20).cast("long")).alias("bodies"))


@query("""SELECT CAST(coalesce(a.shard, b.shard) AS BIGINT) AS shard, coalesce(a.ident, b.ident) AS ident, a.body AS before, b.body AS after
FROM (SELECT * FROM state_cuts WHERE cut_id = 1) a FULL JOIN (SELECT * FROM state_cuts WHERE cut_id = 3) b ON a.shard = b.shard AND a.ident = b.ident WHERE a.body IS DISTINCT FROM b.body""")
def l12_snapshot_diff(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    s = log.state_as_of(log.versions(i.initial, i.changes), i.cuts)
    return log.diff_states(s.where("cut_id = 1"), s.where("cut_id = 3")).select(*_long("shard"), "ident", "before", "after")


#: The log between the snapshots at the cuts.
_SNAPS = BASE + """, snaps AS (SELECT cut_id AS seq, shard, ident, body FROM (
 SELECT coalesce(a.cut_id, b.cut_id + 1) AS cut_id, coalesce(a.shard, b.shard) AS shard, coalesce(a.ident, b.ident) AS ident, a.body AS body, b.body AS was
 FROM state_cuts a FULL JOIN state_cuts b ON a.cut_id = b.cut_id + 1 AND a.shard = b.shard AND a.ident = b.ident) WHERE cut_id BETWEEN 1 AND 4 AND body IS DISTINCT FROM was),
meant AS (SELECT seq, CASE WHEN seq = 3 AND ident LIKE '%25' THEN ident || 'x' ELSE ident END AS ident FROM snaps WHERE NOT (seq = 2 AND ident LIKE '%7'))"""


def _snapshot_log(i: Inputs) -> DataFrame:
    return log.snapshots_to_log(log.state_as_of(log.versions(i.initial, i.changes), i.cuts).withColumnRenamed("cut_id", "version"))


@query("SELECT CAST(shard AS BIGINT) AS shard, CAST(seq AS BIGINT) AS seq, row_number() OVER (PARTITION BY shard, seq ORDER BY ident) - 1 AS pos, ident, body FROM snaps", _SNAPS)
def l13_snapshots_to_log(spark, sf_dir):
    return log.numbered_changes(_snapshot_log(Inputs(spark, sf_dir)), staged).select(*_long("shard"), "seq", *_long("pos"), "ident", "body")


def _expected(made: DataFrame) -> DataFrame:
    """What the versions were meant to change: version 2 less than it did, version 3 something else."""
    ident = F.when((F.col("seq") == 3) & F.col("ident").like("%25"), F.concat("ident", F.lit("x"))).otherwise(F.col("ident"))
    return made.where("not (seq = 2 and ident like '%7')").select("seq", ident.alias("ident"))


@query("""SELECT CAST(seq AS BIGINT) AS seq, (SELECT count(*) FROM snaps x WHERE x.seq = s.seq) AS found, (SELECT count(*) FROM meant x WHERE x.seq = s.seq) AS expected,
NOT EXISTS (SELECT ident FROM snaps x WHERE x.seq = s.seq EXCEPT SELECT ident FROM meant x WHERE x.seq = s.seq) AND NOT EXISTS (SELECT ident FROM meant x WHERE x.seq = s.seq EXCEPT SELECT ident FROM snaps x WHERE x.seq = s.seq) AS fits
FROM (SELECT DISTINCT seq FROM snaps) s""", _SNAPS)
def l13_expected_changes(spark, sf_dir):
    made = staged(_snapshot_log(Inputs(spark, sf_dir)), "snapshots")
    return log.check_expected_changes(made, _expected(made))[0].select("seq", *_long("found", "expected"), "fits")


@query("""SELECT CAST(seq AS BIGINT) AS seq, ident, 'unexpected' AS why FROM (SELECT seq, ident FROM snaps EXCEPT SELECT seq, ident FROM meant)
UNION ALL SELECT CAST(seq AS BIGINT), ident, 'lacking' FROM (SELECT seq, ident FROM meant EXCEPT SELECT seq, ident FROM snaps)""", _SNAPS)
def l13_misfits(spark, sf_dir):
    made = staged(_snapshot_log(Inputs(spark, sf_dir)), "snapshots")
    return log.check_expected_changes(made, _expected(made))[1]


@query("SELECT CAST(shard AS BIGINT) AS shard, ident, body FROM state_cuts WHERE cut_id = 4")
def l10_replay_from_checkpoint(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    base, rest = log.compact(i.initial, i.changes, i.cuts.where("cut_id = 2").drop("cut_id"))
    return log.state_at(base, rest, i.cuts.where("cut_id = 4").drop("cut_id")).select(*_long("shard"), "ident", "body")


@query("SELECT CAST(t.shard AS BIGINT) AS shard, least(c.cutp, greatest(0, t.top - 128)) AS floor FROM tops t JOIN cuts c ON c.shard = t.shard AND c.cut_id = 3")
def l11_safe_floors(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    bounds = i.changes.groupBy("shard").agg(F.max("seq").alias("frontier")).withColumn("base", F.lit(0).cast("long"))
    return log.safe_floors(i.cuts.where("cut_id >= 3").select("shard", "at"), bounds).select(*_long("shard"), "floor")


#: Every 50th ident has a second owner, which the check must find.
_OWNED = "SELECT shard, ident FROM state_cuts WHERE cut_id = 4"


@query(f"""SELECT ident, count(DISTINCT shard) AS shards FROM ({_OWNED} UNION ALL
SELECT (shard + 1) % 3, ident FROM ({_OWNED}) WHERE CAST(substr(ident, 2) AS BIGINT) % 50 = 0) GROUP BY ident HAVING count(DISTINCT shard) > 1""")
def l14_ownership(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    s = log.state_as_of(log.versions(i.initial, i.changes), i.cuts.where("cut_id = 4")).select("shard", "ident")
    twice = s.where(F.substring("ident", 2, 20).cast("long") % 50 == 0).select(F.expr("(shard + 1) % 3").alias("shard"), "ident")
    return log.ownership_violations(s.unionByName(twice))


# ---- ranking


@query("SELECT query_id, body, score FROM scores")
def r1_scores(spark, sf_dir):
    return Inputs(spark, sf_dir).scores()


@query("SELECT CAST(shard AS BIGINT) AS shard, label, count(*) AS n FROM state_cuts JOIN body_labels USING (body) WHERE cut_id = 4 GROUP BY shard, label")
def r2_postings(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    s = log.state_at(i.initial, i.changes, i.cuts.where("cut_id = 4").drop("cut_id"))
    return rank.build_postings(s, i.bodies).groupBy("shard", "label").agg(F.count("*").alias("n")).select(*_long("shard"), "label", "n")


@query("SELECT CAST(shard AS BIGINT) AS shard, label, count(*) AS n FROM state_cuts JOIN body_labels USING (body) WHERE cut_id = 4 GROUP BY shard, label")
def r3_maintained_postings(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    half = i.cuts.where("cut_id = 2").drop("cut_id")
    base, rest = log.compact(i.initial, i.changes, half)
    kept = rank.apply_to_postings(rank.build_postings(base, i.bodies), rest, i.bodies)
    return kept.groupBy("shard", "label").agg(F.count("*").alias("n")).select(*_long("shard"), "label", "n")


@query(f"""SELECT query_id, rank, ident, body, score FROM exact WHERE cut_id = 4""")
def r4_rank_postings(spark, sf_dir):
    """Postings of the start, maintained over the whole log, answer as the state at its end does."""
    i = Inputs(spark, sf_dir)
    start = log.state_at(i.initial, i.changes, i.cuts.where("cut_id = 0"))
    labels = staged(i.posted.lookup(i.terms()), "queried")  # only queried labels are ranked by
    posts = rank.apply_to_postings(rank.build_postings(start, labels), i.changes, labels)
    return rank.top_n(rank.rank_postings(posts, i.terms()), ("query_id",), K).select("query_id", *_long("rank"), "ident", "body", "score")


@query("SELECT query_id, CAST(shard AS BIGINT) AS shard, ident, score FROM idx JOIN scores USING (body) WHERE NOT EXISTS (SELECT 1 FROM finals f WHERE f.shard = idx.shard AND f.ident = idx.ident)")
def r5_rank_excluding(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return rank.rank_state(i.index(), i.scores(), exclude=i.final()).select("query_id", *_long("shard"), "ident", "score")


@query(f"""SELECT r.query_id, CAST(r.shard AS BIGINT) AS shard, rank, r.ident, score, tail_score, tail_ident FROM idx_ranked r JOIN heads h ON h.query_id = r.query_id AND h.shard = r.shard WHERE rank <= {LENGTH}""")
def r7_prefix(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    p = rank.prefix(rank.rank_state(i.index(), i.scores()), tokens.KEYS, LENGTH)
    return p.select("query_id", *_long("shard", "rank"), "ident", "score", "tail_score", "tail_ident")


@query(f"""SELECT query_id, CAST(shard AS BIGINT) AS shard, rank, ident, body, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, shard ORDER BY score DESC, ident) AS rank FROM fresh) WHERE rank <= {K}""")
def r8_delta(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return rank.delta(i.changes, i.scores(), i.lag(), K)[1].select("query_id", *_long("shard", "rank"), "ident", "body", "score")


@query("SELECT CAST(cut_id AS BIGINT) AS cut_id, query_id, rank, CAST(shard AS BIGINT) AS shard, ident, body, score FROM exact")
def r10_exact_topk(spark, sf_dir):
    return Inputs(spark, sf_dir).exact().select(*_long("cut_id"), "query_id", "rank", *_long("shard"), "ident", "body", "score")


@query("""SELECT query_id, ident, round(dot / norm, 9) AS weight FROM (
 SELECT t.query_id, p.ident, sum(idf * idf) AS dot FROM (SELECT s.ident, label FROM state_cuts s JOIN body_labels USING (body) WHERE cut_id = 4) p JOIN terms t USING (label) JOIN idf USING (label) WHERE alt = 0 GROUP BY 1, 2)
JOIN (SELECT ident, sqrt(sum(idf * idf)) AS norm FROM (SELECT s.ident, label FROM state_cuts s JOIN body_labels USING (body) WHERE cut_id = 4) JOIN idf USING (label) GROUP BY ident) USING (ident) WHERE norm > 0""",
       BASE + ", idf AS (SELECT label, ln((SELECT count(*) FROM state_cuts WHERE cut_id = 4)::DOUBLE / count(*)) AS idf FROM state_cuts JOIN body_labels USING (body) WHERE cut_id = 4 GROUP BY label)")
def r11_tfidf_rank(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    s = log.state_at(i.initial, i.changes, i.cuts.where("cut_id = 4").drop("cut_id"))
    return rank.tfidf_rank(s, i.bodies, i.terms()).withColumn("weight", F.round("weight", 9))


@query("""SELECT CAST(e.cut_id AS BIGINT) AS cut_id, e.query_id, round(count(b.ident)::DOUBLE / count(*), 9) AS stability FROM exact e
LEFT JOIN (SELECT query_id, ident FROM exact WHERE cut_id = 0) b ON b.query_id = e.query_id AND b.ident = e.ident GROUP BY e.cut_id, e.query_id""")
def r12_rank_stability(spark, sf_dir):
    e = Inputs(spark, sf_dir).exact()
    return rank.rank_stability(e.where("cut_id = 0"), e).select(*_long("cut_id"), "query_id", F.round("stability", 9).alias("stability"))


# ---- policies and tokens


@query("SELECT query_id, rank, CAST(shard AS BIGINT) AS shard, ident, body, score FROM exact WHERE cut_id = 4")
def p1_overlay_topk(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return tokens.overlay_topk(i.index(), i.final(), i.scores(), K).select("query_id", *_long("rank", "shard"), "ident", "body", "score")


@query("SELECT query_id, CASE WHEN blockers > 0 THEN 'rank-underdetermined' ELSE 'complete' END AS status, blockers FROM cert_heads", CERT)
def p2_certify(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    scores = i.scores()
    heads, rows = tokens.acquire_tokens(i.index(), scores, i.grid(), LENGTH)
    return tokens.certify(rows, heads, i.final(), scores, 3, K)[1].select("query_id", "status", *_long("blockers"))


@query("""SELECT CAST(c.cut_id AS BIGINT) AS cut_id, e.query_id, e.rank, e.ident, e.body, e.score FROM exact e, (SELECT DISTINCT cut_id FROM cuts) c WHERE e.cut_id = 0""")
def p6_stale_topk(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.exact().where("cut_id = 0").drop("cut_id").crossJoin(i.cuts.select("cut_id").distinct()).select(*_long("cut_id"), "query_id", "rank", "ident", "body", "score")


@query(f"""SELECT query_id, rank, ident, score FROM (SELECT query_id, ident, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ident) AS rank FROM idx_ranked WHERE shard = CAST(substr(query_id, 2) AS INT) % 3) WHERE rank <= {K}""")
def p7_chosen_shard(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    r = rank.rank_state(i.index(), i.scores()).where(F.substring("query_id", 2, 9).cast("int") % 3 == F.col("shard"))
    return rank.top_n(r, ("query_id",), K).select("query_id", *_long("rank"), "ident", "score")


@query("SELECT query_id, CAST(shard AS BIGINT) AS shard, tail_score, tail_ident FROM heads")
def k1_acquire_tokens(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return tokens.acquire_tokens(i.index(), i.scores(), i.grid(), LENGTH)[0].select("query_id", *_long("shard"), "tail_score", "tail_ident")


def _advanced(i: Inputs):
    """Tokens of the lagging index carried to the log's end. The scores and the tokens at the start are written once, as several branches read them."""
    scores = i.scores()
    heads, rows = tokens.keep_tokens(*tokens.acquire_tokens(i.index(), scores, i.grid(), LENGTH), staged)
    return tokens.advance_tokens(heads, rows, i.final(), i.lag().select("shard", "hi"), scores)


@query("SELECT query_id, CAST(shard AS BIGINT) AS shard, tail_score, tail_ident FROM advanced")
def k2_advance_heads(spark, sf_dir):
    return _advanced(Inputs(spark, sf_dir))[0].select("query_id", *_long("shard"), "tail_score", "tail_ident")


@query(f"SELECT query_id, CAST(shard AS BIGINT) AS shard, ident, body, score FROM pool WHERE rank <= {LENGTH}")
def k2_advance_rows(spark, sf_dir):
    return _advanced(Inputs(spark, sf_dir))[1].select("query_id", *_long("shard"), "ident", "body", "score")


@query("SELECT query_id, CASE WHEN blockers > 0 THEN 'rank-underdetermined' ELSE 'complete' END AS status, blockers FROM merge_heads")
def k3_merge_tokens(spark, sf_dir):
    return tokens.merge_tokens(*_advanced(Inputs(spark, sf_dir)), 3, K)[1].select("query_id", "status", *_long("blockers"))


@query(f"""SELECT query_id, CAST(g.shard AS BIGINT) AS shard, greatest({LENGTH}, least(64, {K} + dirty)) AS length, {K} + dirty <= 64 AS guaranteed FROM grid g
JOIN (SELECT shard, count(*) AS dirty FROM finals GROUP BY shard) f ON f.shard = g.shard""")
def k4_repair_lengths(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    dirty = log.dirty_count(log.suffix(i.changes, i.lag()))
    return tokens.repair_lengths(i.grid(), dirty, K, LENGTH).select("query_id", *_long("shard", "length"), "guaranteed")


def standing(spark: SparkSession, sf_dir: str, keep, ticks: int = 8, size: int = 16, active: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A standing run over the last ticks * size changes of each shard; with `active`, only so many queries a tick, in turn."""
    i = Inputs(spark, sf_dir)
    changes, initial, scores = keep(i.changes, "log"), keep(i.initial, "initial"), i.scores()
    queries = keep(i.terms().select("query_id").distinct(), "queries")
    top = keep(changes.groupBy("shard").agg(F.max("seq").alias("top")), "tops")
    cuts = [top.select("shard", (F.col("top") - size * (ticks - t)).alias("at")) for t in range(ticks + 1)]
    schedule = None
    if active:
        turn = F.floor((F.row_number().over(Window.orderBy("query_id")) - 1) / active)  # one row a query
        turns = queries.withColumn("turn", turn).crossJoin(spark.range(1, ticks + 1).select(F.col("id").alias("tick"), (F.col("id") - 1).alias("now")))
        n_turns = F.ceil(F.lit(queries.count()) / active)
        schedule = keep(turns.where(F.col("turn") == F.pmod("now", n_turns)).select("tick", "query_id"), "schedule")
    return tokens.run_standing(initial, changes, scores, queries, cuts, keep, LENGTH, K, schedule)


_STANDING = f"""SELECT CAST(tick AS BIGINT) AS tick, query_id, rank, ident, body, score, 'complete' AS status FROM (
 SELECT tick, query_id, row_number() OVER (PARTITION BY tick, query_id ORDER BY score DESC, ident) AS rank, ident, body, score
 FROM (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS tick), tops t JOIN versions v ON v.shard = t.shard JOIN scores USING (body)
 WHERE from_seq <= top - 16 * (8 - tick) AND (to_seq IS NULL OR top - 16 * (8 - tick) < to_seq)) WHERE rank <= {K}"""


@query(_STANDING)
def k10_run_standing(spark, sf_dir):
    out = standing(spark, sf_dir, staged)[0]
    return out.where("rank is not null").select(*_long("tick"), "query_id", "rank", "ident", "body", "score", "status")


@query(f"""SELECT r.* FROM ({_STANDING}) r JOIN (
  SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1) // 4 AS turn, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM terms)) q
ON q.query_id = r.query_id AND q.turn = (r.tick - 1) % CAST(ceil(n / 4.0) AS BIGINT)""")
def k10_run_scheduled(spark, sf_dir):
    out = standing(spark, sf_dir, staged, active=4)[0]
    return out.where("rank is not null").select(*_long("tick"), "query_id", "rank", "ident", "body", "score", "status")


# ---- audit


def policy_answers(i: Inputs) -> dict[str, tuple[DataFrame, bool]]:
    """Answers of three policies and whether they claim to be complete: the exact one, the stale one that claims it, and shard 0 alone, which claims nothing."""
    exact = i.exact()
    cut_ids = i.cuts.select("cut_id").distinct()
    cols = ["cut_id", "query_id", "rank", "ident", "body", "score"]
    stale = exact.where("cut_id = 0").drop("cut_id").crossJoin(cut_ids).select(cols)
    state = log.state_as_of(log.versions(i.initial, i.changes), i.cuts)
    local = rank.top_n(rank.rank_state(state.where("shard = 0"), i.scores()), ("cut_id", "query_id"), K).select(cols)
    return {"exact": (exact.select(cols), True), "stale": (stale, True), "local": (local, False)}


def _observations(i: Inputs) -> DataFrame:
    grid = i.terms().select("query_id").distinct().crossJoin(i.cuts.select("cut_id").distinct())
    made = policy_answers(i)
    parts = [audit.assess(a, made["exact"][0], grid.withColumn("claimed", F.lit(c))).withColumn("policy", F.lit(p)) for p, (a, c) in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_OBS = BASE + f""", answers AS (SELECT 'exact' AS policy, cut_id, query_id, rank, ident, body, score FROM exact
  UNION ALL SELECT 'stale', c.cut_id, query_id, rank, ident, body, score FROM exact e, (SELECT DISTINCT cut_id FROM cuts) c WHERE e.cut_id = 0
  UNION ALL SELECT 'local', cut_id, query_id, row_number() OVER (PARTITION BY cut_id, query_id ORDER BY score DESC, ident) AS rank, ident, body, score FROM state_cuts JOIN scores USING (body) WHERE shard = 0 QUALIFY rank <= {K}),
j AS (SELECT o.policy, o.cut_id, o.query_id, list((a.ident, a.body, a.score) ORDER BY a.rank) FILTER (WHERE a.ident IS NOT NULL) AS mine, count(a.ident) AS returned FROM obs o LEFT JOIN answers a ON a.policy = o.policy AND a.cut_id = o.cut_id AND a.query_id = o.query_id GROUP BY ALL),
e AS (SELECT cut_id, query_id, list((ident, body, score) ORDER BY rank) AS truth, count(*) AS n FROM exact GROUP BY ALL),
h AS (SELECT a.policy, a.cut_id, a.query_id, count(*) AS id_hits, count(*) FILTER (WHERE a.body = x.body) AS body_hits FROM answers a JOIN exact x ON x.cut_id = a.cut_id AND x.query_id = a.query_id AND x.ident = a.ident GROUP BY ALL),
assessed AS (SELECT j.policy AS policy, j.cut_id, j.query_id, j.policy <> 'local' AS claimed, mine IS NOT DISTINCT FROM truth AS exact, j.policy <> 'local' AND mine IS DISTINCT FROM truth AS false_complete, returned,
  CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE coalesce(body_hits, 0)::DOUBLE / n END AS body_recall, CASE WHEN n IS NULL THEN 1.0::DOUBLE ELSE coalesce(id_hits, 0)::DOUBLE / n END AS id_recall
  FROM j LEFT JOIN e ON e.cut_id = j.cut_id AND e.query_id = j.query_id LEFT JOIN h ON h.policy = j.policy AND h.cut_id = j.cut_id AND h.query_id = j.query_id)
"""


@query("""SELECT CAST(a.cut_id AS BIGINT) AS cut_id, a.query_id, a.ident, a.body, a.score FROM answers a LEFT JOIN state_cuts s ON s.cut_id = a.cut_id AND s.ident = a.ident
LEFT JOIN scores v ON v.query_id = a.query_id AND v.body = s.body WHERE policy = 'exact' AND (a.body IS DISTINCT FROM s.body OR a.score IS DISTINCT FROM v.score)""", _OBS)
def v11_unsound_exact_rows(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    state = log.state_as_of(log.versions(i.initial, i.changes), i.cuts)
    e = i.exact().select("cut_id", "query_id", "ident", "body", "score")
    return audit.unsound_rows(e, state, i.scores()).select(*_long("cut_id"), "query_id", "ident", "body", "score")


@query("""SELECT CAST(a.cut_id AS BIGINT) AS cut_id, a.query_id, a.ident, a.body, a.score FROM answers a LEFT JOIN state_cuts s ON s.cut_id = a.cut_id AND s.ident = a.ident
LEFT JOIN scores v ON v.query_id = a.query_id AND v.body = s.body WHERE policy = 'stale' AND (a.body IS DISTINCT FROM s.body OR a.score IS DISTINCT FROM v.score)""", _OBS)
def v11_unsound_stale_rows(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    state = log.state_as_of(log.versions(i.initial, i.changes), i.cuts)
    old = i.exact().where("cut_id = 0").drop("cut_id").crossJoin(i.cuts.select("cut_id").distinct()).select("cut_id", "query_id", "ident", "body", "score")
    return audit.unsound_rows(old, state, i.scores()).select(*_long("cut_id"), "query_id", "ident", "body", "score")


@query("SELECT policy, CAST(cut_id AS BIGINT) AS cut_id, query_id, claimed, exact, false_complete, returned, round(body_recall, 9) AS body_recall, round(id_recall, 9) AS id_recall FROM assessed", _OBS)
def v12_assess(spark, sf_dir):
    o = _observations(Inputs(spark, sf_dir))
    return o.select("policy", *_long("cut_id"), "query_id", "claimed", "exact", "false_complete", *_long("returned"), F.round("body_recall", 9).alias("body_recall"), F.round("id_recall", 9).alias("id_recall"))


@query("""SELECT query_id, CAST(cut_id AS BIGINT) AS cut_id, cut_id > 0 AND truth IS DISTINCT FROM lag(truth) OVER (PARTITION BY query_id ORDER BY cut_id) AS changed
FROM (SELECT DISTINCT cut_id, query_id FROM obs) LEFT JOIN e USING (cut_id, query_id)""", _OBS)
def v13_changed_answers(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return audit.changed_answers(i.exact(), i.terms(), i.cuts).select("query_id", *_long("cut_id"), "changed")


@query("""SELECT policy, count(*) AS n, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE claimed) AS complete, count(*) FILTER (WHERE false_complete) AS false_complete, CAST(sum(returned) AS BIGINT) AS returned,
round(avg(body_recall), 9) AS body_recall, round(avg(id_recall), 9) AS id_recall, CAST(quantile_disc(returned, 0.5) AS DOUBLE) AS p50_returned, CAST(quantile_disc(returned, 0.95) AS DOUBLE) AS p95_returned FROM assessed GROUP BY policy""", _OBS)
def a2_policy_summary(spark, sf_dir):
    s = audit.summarize(_observations(Inputs(spark, sf_dir)), ["policy"])
    return s.withColumns({"p50_returned": F.col("p50_returned").cast("double"), "p95_returned": F.col("p95_returned").cast("double")})


@query("""SELECT policy, CAST(cut_id AS BIGINT) AS cut_id, count(*) AS n, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE claimed) AS complete FROM assessed GROUP BY ROLLUP (policy, cut_id)""", _OBS)
def a3_summary_levels(spark, sf_dir):
    return audit.summarize_levels(_observations(Inputs(spark, sf_dir)), ["policy", "cut_id"]).select("policy", *_long("cut_id"), "n", "exact", "complete")


@query("""SELECT CAST(cut_id AS BIGINT) AS cut_id, CAST(sum(returned) FILTER (WHERE policy = 'exact') AS BIGINT) AS exact, CAST(sum(returned) FILTER (WHERE policy = 'stale') AS BIGINT) AS stale,
CAST(sum(returned) FILTER (WHERE policy = 'local') AS BIGINT) AS local FROM assessed GROUP BY cut_id""", _OBS)
def a5_case_table(spark, sf_dir):
    t = audit.case_table(_observations(Inputs(spark, sf_dir)), ["cut_id"], ["exact", "stale", "local"], "returned")
    return t.select(*_long("cut_id"), "exact", "stale", "local")


@query("""SELECT CAST(shard AS BIGINT) AS shard, count(*) AS assignments, CAST(sum(coalesce(len(b.labels), 0) + coalesce(o.n, 0)) AS BIGINT) AS updates FROM (
 SELECT shard, body, lag(body) OVER (PARTITION BY shard, ident ORDER BY from_seq) AS old, from_seq FROM versions) v LEFT JOIN bodies b ON b.body = v.body
LEFT JOIN (SELECT body, len(labels) AS n FROM bodies) o ON o.body = v.old WHERE from_seq > 0 GROUP BY shard""")
def a13_work_census(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return audit.work_census(i.initial, i.changes, i.bodies.select("body", F.size("labels").alias("n"))).select(*_long("shard", "assignments", "updates"))


# ---- table checks


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS key, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1", "")
def d1_duplicate_keys(spark, sf_dir):
    return tables.duplicate_keys(fx.table(spark, sf_dir, "pages"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)", "")
def d2_key_set_diff(spark, sf_dir):
    return tables.key_set_diff(fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, 'size' AS field, CAST(n_chars AS VARCHAR) AS left_value, CAST(octet_length(encode(text)) AS VARCHAR) AS right_value FROM documents WHERE n_chars <> octet_length(encode(text))", "")
def d3_field_disagreements(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return tables.field_disagreements(d.select("doc_id", F.col("n_chars").alias("size")), d.select("doc_id", F.octet_length("text").cast("long").alias("size")), "doc_id", ["size"])


@query("SELECT c_mktsegment AS category, CAST(500 AS BIGINT) AS expected, count(*) AS found FROM customer GROUP BY c_mktsegment HAVING count(*) <> 500", "")
def d4_category_check(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    return tables.category_check(c, "c_mktsegment", c.select(F.col("c_mktsegment").alias("category"), F.lit(500).cast("long").alias("expected")).distinct())


@query(r"""SELECT page_id, 'scheme' AS rule FROM pages WHERE NOT coalesce(regexp_matches(url, '^https://'), false)
UNION ALL SELECT page_id, 'host' FROM pages WHERE NOT coalesce(regexp_matches(url, '^[a-z]+://[^/?#]*\.example\.(com|org)([/?#]|$)'), false)""", "")
def d5_rule_violations(spark, sf_dir):
    return tables.rule_violations(fx.table(spark, sf_dir, "pages"), "page_id", {"scheme": F.col("url").rlike("^https://"), "host": F.col("url").rlike(r"^[a-z]+://[^/?#]*\.example\.(com|org)([/?#]|$)")})


@query(r"""SELECT t AS key, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\\[a-z]+|[{}]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS t FROM pages) GROUP BY t HAVING count(*) > 1""", "")
def d6_duplicate_titles(spark, sf_dir):
    title = tables.normalize_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return tables.duplicate_keys(fx.table(spark, sf_dir, "pages"), title)


@query("""SELECT trim(unnest(string_split(m, ','))) AS key, count(*) AS occurrences FROM (SELECT unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS m FROM pages) GROUP BY 1 HAVING key <> ''""", "")
def d8_extract_keys(spark, sf_dir):
    return tables.extract_keys(fx.table(spark, sf_dir, "pages"), "html", '<a href="/([^"]*)"')


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return r10_exact_topk(spark, sf_dir)

