import ast
import io

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from freshrank import queries, queries_checks, queries_corpus, queries_receipts  # noqa: F401 -- they register themselves
from freshrank.operators import audit, log, policies, rank, receipts, tables, tokens
from freshrank.plans import corpus
from freshrank.sources import files
from freshrank.sources.scratch import staged
from freshrank.streaming.feed import stream_admit

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BODIES = [("b0", ["a"]), ("b1", ["x"]), ("b2", ["x", "y"]), ("b3", ["x", "y", "z"]), ("b4", ["w", "x", "y", "z"])]
TERMS = [("q", 0, i + 1, x) for i, x in enumerate("xyzw")]


def bodies(spark):
    return spark.createDataFrame(BODIES, "body string, labels array<string>")


def terms(spark):
    return spark.createDataFrame(TERMS, "query_id string, alt int, pos int, label string")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).values.tolist()
    return sorted([[repr(round(float(v), 9)) if isinstance(v, float | int) and not isinstance(v, bool) else str(v) for v in r] for r in rows])


@pytest.mark.parametrize("name", ["r10_exact_topk", "p1_overlay_topk", "k2_advance_rows", "k3_merge_tokens", "l2_classify_deliveries", "c9_query_plans", "d5_rule_violations", "p4_cut_cache", "p8_pick_owner", "k6_missing_shards",
                                  "v1_check_rows", "v6_check_event_receipts", "v7_check_prefix_receipts", "a14_token_work", "t4_stream_state",
                                  "c1_extract_fragments", "c2_code_labels", "c8_plan_calls_first", "c10b_drop_seeds", "c11_plan_stable_labels", "c11_stable_snapshots", "c15_labels_agree", "l9_convergence", "l4_many_ranges", "l8_many_cuts", "l13_misfits", "a10_bootstrap", "v10_all_receipts", "v4_certificate_rules", "p3_status_lists", "s1_read_sources", "r11_rank_flips", "p7_unverified", "s7_flatten_observations"])
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    assert plain(queries.QUERIES[name](spark, sf_dir).toPandas()) == plain(con.execute(queries.ORACLES[name]).df())


def test_scores(spark):
    got = {r.body: r.score for r in rank.score_bodies(bodies(spark), terms(spark)).collect()}
    assert got == {"b1": 1, "b2": 2, "b3": 3, "b4": 4}


def test_gap_duplicate_conflict(spark):
    d = spark.createDataFrame([(0, 2, "a", "b1", 1), (0, 1, "a", "b2", 2), (0, 2, "a", "b1", 3), (0, 2, "a", "b9", 4)], "shard int, seq long, ident string, body string, arrival long")
    assert [r.outcome for r in log.classify_deliveries(d).orderBy("arrival").collect()] == ["ok", "ok", "duplicate", "conflicting-sequence"]
    assert log.frontiers(d.where("seq = 2")).first().frontier == 0 and log.frontiers(d).first().frontier == 2


def test_tombstones_stay(spark):
    start = spark.createDataFrame([(0, "a", "b1"), (0, "b", "b2")], "shard int, ident string, body string")
    ch = spark.createDataFrame([(0, 1, 0, "a", "b4"), (0, 2, 0, "a", None)], "shard int, seq long, pos int, ident string, body string")
    cut = spark.createDataFrame([(0, 2)], "shard int, at long")
    assert [(r.ident, r.body) for r in log.state_at(start, ch, cut).collect()] == [("b", "b2")]


def test_tail_is_kept(spark):
    """k = L = 1: the row a goes, b of score 1 comes; the tail stays and blocks."""
    heads = spark.createDataFrame([("q", 0, 0, 1, 0, 1, "b")], "query_id string, shard int, at long, capacity int, generation int, tail_score long, tail_ident string")
    rows = spark.createDataFrame([("q", 0, "a", "b1", 1)], "query_id string, shard int, ident string, body string, score long")
    final = spark.createDataFrame([(0, "a", None), (0, "b", "b1")], "shard int, ident string, body string")
    hi = spark.createDataFrame([(0, 2)], "shard int, hi long")
    h, r = tokens.advance_tokens(heads, rows, final, hi, rank.score_bodies(bodies(spark), terms(spark)))
    assert [(x.tail_score, x.tail_ident, x.generation) for x in h.collect()] == [(1, "b", 1)] and [x.ident for x in r.collect()] == ["b"]
    answer = tokens.merge_tokens(h, r, 1, 1)[1].first()
    assert (answer.status, answer.blockers) == ("rank-underdetermined", 1)
    assert tokens.merge_tokens(h, r, 2, 1)[1].first().status == "partial"


def test_complete_answers_of_a_standing_run_are_exact(spark, sf_dir):
    got = queries.standing(spark, sf_dir, staged, ticks=2, size=8)[0].where("rank is not null and status = 'complete'").toPandas()
    i = queries.Inputs(spark, sf_dir)
    top = i.changes.groupBy("shard").agg(F.max("seq").alias("top")).withColumn("cut_id", F.explode(F.sequence(F.lit(1), F.lit(2))))
    want = rank.exact_topk(i.initial, i.changes, i.bodies, i.terms(), top.select("cut_id", "shard", (F.col("top") - 8 * (2 - F.col("cut_id"))).alias("at")), 5).toPandas()
    both = got.merge(want, left_on=["tick", "query_id", "rank"], right_on=["cut_id", "query_id", "rank"], how="left")
    assert len(got) and (both.ident_x == both.ident_y).all() and (both.score_x == both.score_y).all()


def test_code(spark):
    src = "class A:\n    @deco\n    def f(self, x):\n        return x.Load(y)\n    def f(self):\n        pass\n"
    df = spark.createDataFrame([("p", "a.py", src), ("p", "b.py", "def (:")], "project string, path string, text string")
    got = corpus.extract_fragments(df).orderBy("ident").collect()
    assert [(r.ident, r.line_start, r.reason) for r in got] == [("p/a.py:A.f:1", 2, None), ("p/a.py:A.f:2", 5, None), ("p/b.py", None, "SyntaxError")]
    labels = spark.createDataFrame([(got[0].source,), ("def",), (None,)], "s string").select(corpus.code_labels("s").alias("l")).collect()
    assert labels[0].l == ["attr:load", "call:load", "name:deco", "name:x", "name:y"] and labels[1].l is None and labels[2].l is None


def test_known_lines_give_what_whole_parses_give(spark):
    """Labels and bytes of each function, from lines known by themselves or not: strings and brackets over lines, comments to the left, decorators, tabs, form feeds, nesting, faults."""
    plain = "class A:\n    @deco\n    def f(self, x):\n        a.b(c)\n        a.b(c)\n        if x: return d.e\n        else:\n            raise g(h)\n        def inner(): i = j; k()\n    def f(self):\n        é.ö(x)\n"
    texts = [plain, plain.rstrip("\n"), plain.replace("a.b(c)", "a.b(\n c)", 1), plain.replace("a.b(c)", "s = \"\"\"\nq.r(t)\n\"\"\"", 1), plain.replace("a.b(c)", "# note", 1), plain.replace("        a.b(c)", "# note: (", 1),
             plain.replace("a.b(c)", "x = \\\n  y", 1), plain.replace("        ", "\t"), plain.replace("a.b(c)", "a.b(c)\f", 1), plain.replace("        a.b(c)\n", "\f\n        a.b(c)\n", 1), plain.replace("\n", "\r\n"),
             plain.replace("        a.b(c)", "         a.b(c)", 1), plain + "def (", plain + ")", "x = (\ndef f(): pass\n)", "@a(b)\n@c\nasync def f():\n  await d\n  match e:\n    case g: h\n", "def f():\n    a\n  b\n", "", "a\u2028b()\ndef f(): c.d\n"]

    def ask(f, text):
        try:
            return f(text)
        except SyntaxError as e:
            return type(e)

    def whole(text):
        lines = io.StringIO(text, newline="").readlines()
        each = [(q, n, "".join(lines[a - 1:b])) for q, n, a, b, _ in corpus._functions(ast.parse(text))]
        return [(q, n, len(x.encode()), corpus._labels(x)) for q, n, x in each]

    for known in (corpus.Statements(), corpus.Statements(most=3)):
        for text in texts * 2:
            assert ask(known.fragments, text) == ask(whole, text), text
    assert corpus.Statements()._brief(plain) == whole(plain)
    df = spark.createDataFrame([("p", f"{i}.py", x) for i, x in enumerate(texts)], "project string, path string, text string")
    want = corpus.extract_fragments(df).where("reason is null").select("ident", F.octet_length("source").alias("size"), corpus.code_labels("source").alias("labels"))
    assert sorted(map(str, corpus.labelled_fragments(df).collect())) == sorted(map(str, want.collect()))
    calls, parse = [], ast.parse
    try:
        corpus.ast.parse = lambda text, *a, **k: calls.append(len(text)) or parse(text, *a, **k)
        known = corpus.Statements()
        for _ in range(50):
            known.fragments("def f():\n" + "".join(f"    a{i}.b(c)\n" for i in range(500)))
    finally:
        corpus.ast.parse = parse
    assert sum(calls) < 60_000  # 50 whole parses of the file and its function: 650,000


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.py").write_text("x = 1")
    (tmp_path / "t" / "b.py").write_bytes(b"\xff\xfe")
    good, bad = files.read_sources(spark, str(tmp_path / "t"))
    assert [r.text for r in good.collect()] == ["x = 1"] and bad.count() == 1
    files.write_rows_csv([spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3.5)], "a int, c double")], str(tmp_path / "csv"))
    assert set(files.read_table_csv(spark, str(tmp_path / "csv")).columns) == {"a", "b", "c"}
    files.write_json(spark.range(3), str(tmp_path / "j"), gzip=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "l.txt").write_text("Ran 3 tests\nRan 12 tests\n")
    assert files.last_match_per_file(spark, str(tmp_path / "log"), r"Ran (\d+) tests").first().found == "12"


def test_packed_tree(spark, tmp_path):
    """As loose files, and files without bytes too: only names that fit, UTF-8 or excluded, an empty file, the last match; many files in few."""
    rows = [("p/a.py", b"x = 1\n"), ("p/b.py", b"\xff\xfe"), ("p/q/c.py", b""), ("p/a.py.txt", b"no"), ("p/d.py", "é\r\n".encode())]
    rows += [(f"m/{i}.py", b"Ran %d tests\nRan %d tests\n" % (i, i + 1)) for i in range(2000)]
    for path, content in rows:
        (tmp_path / "loose" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "loose" / path).write_bytes(content)
    files.pack(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("*.parquet"))) < 20
    cut = F.regexp_replace("path", "^.*/loose/", "").alias("path")
    some = [files.read_sources(spark, str(tmp_path / x), "*.py", packed=x == "packed") for x in ("packed", "loose")]
    (good, bad), (good2, bad2) = some
    assert sorted(map(tuple, good.where("text <> ''").collect())) == sorted(map(tuple, good2.select(cut, "text").collect()))  # Spark skips loose files without bytes
    assert sorted(map(tuple, bad.collect())) == sorted(map(tuple, bad2.select(cut, "reason").collect()))
    assert good.count() == 2003 and [r.path for r in bad.collect()] == ["p/b.py"]
    found = {r.path: r.found for r in files.last_match_per_file(spark, str(tmp_path / "packed"), r"Ran (\d+) tests", packed=True).collect()}
    assert len(found) == 2005 and found["m/7.py"] == "8" and found["p/a.py"] is None


@pytest.mark.parametrize("name", ["s1_read_sources", "s4_last_match"])
def test_trees_of_customers_are_few_files(spark, sf_dir, tmp_path, name):
    """Orders without a customer too, and none at all."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    for at, df in (("some", orders.unionByName(orders.limit(3).withColumn("o_custkey", F.lit(None).cast(orders.schema["o_custkey"].dataType)))), ("none", orders.limit(0))):
        df.coalesce(1).write.parquet(str(tmp_path / at / "orders.parquet"))
        con = duckdb.connect()
        con.execute(f"create view orders as select * from read_parquet('{tmp_path}/{at}/orders.parquet/*.parquet')")
        assert plain(queries.QUERIES[name](spark, str(tmp_path / at)).toPandas()) == plain(con.execute(queries.ORACLES[name]).df())


def test_golden_diff(spark):
    a = spark.createDataFrame([(1, 0.5, "x"), (2, 1.0, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 0.5 + 1e-12, "x"), (3, 1.0, "y")], "k int, v double, s string")
    assert sorted({r.k for r in tables.golden_diff(a, b, "k").collect()}) == [2, 3]


def test_bootstrap(spark):
    r = audit.bootstrap_mean(spark.createDataFrame([(float(i),) for i in range(20)], "d double"), "d", "d", n=500).first()
    assert r.low < r.mean == 9.5 < r.high


def test_stream_admission(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(0, 2, "a", "b1"), (0, 1, "a", None), (0, 2, "a", "b1"), (0, 4, "c", "b2"), (0, 4, "c", "b3"), (0, 400, "d", "b1")]
    pd.DataFrame(rows, columns=["shard", "seq", "ident", "body"]).astype({"shard": "int32"}).to_parquet(tmp_path / "x.parquet")
    feed = spark.readStream.schema("shard int, seq long, ident string, body string").parquet(str(tmp_path / "x.parquet").replace("x.parquet", "*.parquet"))
    q = stream_admit(feed).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [(r.seq, r.outcome) for r in spark.sql("select * from admitted").collect()]
    assert [s for s, o in got if o == "admitted"] == [1, 2]
    assert sorted(o for _, o in got if o != "admitted") == ["conflicting-sequence", "ok", "ok", "ok", "old", "retention-window"]


def test_cache_serves_only_its_own_cut(spark):
    """Available at tick 1, then an outage at the same cut (hit), then one at another cut (missing), then back (fetched)."""
    rows = [(1, "q", 0, 5, True), (2, "q", 0, 5, False), (3, "q", 0, 6, False), (4, "q", 0, 6, True)]
    got = policies.cut_cache(spark.createDataFrame(rows, "tick int, query_id string, shard int, cut int, available boolean"))
    assert [r.outcome for r in got.orderBy("tick").collect()] == ["fetched", "hit", "missing", "fetched"]


def test_owner_falls_over(spark):
    replies = spark.createDataFrame([("q", 0, 1, 9, True), ("q", 0, 2, 4, False), ("q", 0, 3, 5, True)], "query_id string, shard int, owner int, at long, covered boolean")
    owners = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2)], "shard int, owner int, place int")
    cut = spark.createDataFrame([(0, 5)], "shard int, cut long")
    assert [policies.pick_owner(replies, owners, cut, rule).first().owner for rule in ("acquire", "repair")] == [3, 3]
    assert policies.pick_owner(replies.where("owner < 3"), owners, cut, "repair").count() == 0


def refill_case(spark):
    """Shard 0 holds global: b3, shard 1 a: b2 and b: b1; a is deleted; k = L = 1."""
    shape = "query_id string, shard int, at long, capacity int, generation int, tail_score long, tail_ident string"
    heads = spark.createDataFrame([("q", 0, 1, 1, 0, None, None), ("q", 1, 1, 1, 1, 1, "b")], shape)
    rows = spark.createDataFrame([("q", 0, "global", "b3", 3)], "query_id string, shard int, ident string, body string, score long")
    state = spark.createDataFrame([(0, "global", "b3"), (1, "b", "b1")], "shard int, ident string, body string")
    hi = spark.createDataFrame([(0, 1), (1, 1)], "shard int, hi long")
    lengths = spark.createDataFrame([("q", 0, 1), ("q", 1, 2)], "query_id string, shard int, length int")
    return heads, rows, state, rank.score_bodies(bodies(spark), terms(spark)), hi, lengths


def test_refill_local_and_global(spark):
    case = refill_case(spark)
    heads, rows, pick = tokens.refill_local(*case, 1)
    assert [r.shard for r in pick.collect()] == [1] and {r.ident for r in rows.collect()} == {"global", "b"}
    heads, rows, pick = tokens.refill_global(*case, 2, 1, staged)
    assert pick.count() == 0 and tokens.merge_tokens(heads, rows, 2, 1)[1].first().status == "complete"


def test_rebind(spark):
    heads = refill_case(spark)[0].withColumn("epoch", F.lit(3))
    later = spark.createDataFrame([(0, 4)], "shard int, new_epoch int")
    assert {(r.shard, r.epoch, r.generation) for r in tokens.rebind_tokens(heads, later).collect()} == {(0, 4, 1), (1, 3, 1)}
    with pytest.raises(Exception, match="new epoch required"):
        tokens.rebind_tokens(heads, later.withColumn("new_epoch", F.lit(3))).collect()


def test_row_and_tail_schemas(spark):
    rows = {'{"score":1,"id":"a","body":"b"}': None, '{"id":"a","body":"b","score":1.0}': "row-schema", '{"id":"a","body":"b","score":true}': "row-schema",
            '{"id":"a","body":"b","score":"1"}': "row-schema", '{"id":"a","body":"b","score":-1}': "score-not-positive", '{"id":"a"}': "row-schema", "{": "not-json", "[]": "row-schema"}
    got = spark.createDataFrame([(x,) for x in rows], "j string").select("j", receipts.check_row(F.col("j")).alias("why")).collect()
    assert {r.j: r.why for r in got} == rows
    tails = {"null": None, '[-2,"a"]': None, '[2,"a"]': "tail-schema", '[-2.5,"a"]': "tail-schema", "[-2]": "tail-schema", '[-2,"a",1]': "tail-schema", '{"a":1}': "tail-schema", "[": "not-json"}
    got = spark.createDataFrame([(x,) for x in tails], "j string").select("j", receipts.check_tail(F.col("j")).alias("why")).collect()
    assert {r.j: r.why for r in got} == tails


def test_same_json(spark):
    pairs = [('{"a":1,"b":[1]}', '{"b":[1],"a":1}', True), ("1", "true", False), ("1", "1.0", False), ("null", "null", True), ("x", "x", False), (None, None, False), ('{"a":null}', "{}", False)]
    got = spark.createDataFrame(pairs, "a string, b string, want boolean").select(receipts.same_json("a", "b").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_requests(spark):
    fine = ([["a", "b"]], 5, [0, 0, 0], 0)
    cases = [(*fine, None), ([], *fine[1:], "plan"), ([["a", "a"]], *fine[1:], "plan-alternate"), ([list("abcde")], *fine[1:], "plan-alternate"),
             (fine[0], 21, [0, 0, 0], 0, "k"), (fine[0], 5, [0, -1, 0], 0, "cut"), (fine[0], 5, [0, 0], 0, "cut"), (fine[0], 5, [0, 0, 0], -1, "epoch"), (fine[0], None, [0, 0, 0], 0, "k")]
    df = spark.createDataFrame(cases, "plan array<array<string>>, k int, cut array<long>, epoch int, want string")
    got = df.select("want", receipts.check_request(F.col("plan"), F.col("k"), F.col("cut"), F.col("epoch"), 3).alias("why")).collect()
    assert all(r.why == r.want for r in got)


def test_commit_is_all_or_nothing(spark):
    heads = refill_case(spark)[0]
    new = heads.withColumn("generation", F.col("generation") + 10)
    bad = spark.createDataFrame([("q", 0, None), ("q", 1, "rows")], "query_id string, shard int, reason string")
    assert {r.generation for r in receipts.commit_checked(heads, new, bad).collect()} == {0, 1}
    assert {r.generation for r in receipts.commit_checked(heads, new, bad.withColumn("reason", F.lit(None).cast("string"))).collect()} == {10, 11}


def test_advance_agrees_with_its_second_derivation(spark, sf_dir):
    i = queries.Inputs(spark, sf_dir)
    scores = staged(i.scores(), "scores")
    old = tokens.acquire_tokens(i.index(), scores, i.grid(), 5)
    new = tokens.advance_tokens(*old, i.final(), i.lag().select("shard", "hi"), scores)
    verdicts = receipts.check_results(*new, *receipts.recompute_advance(*old, i.final(), scores))
    assert verdicts.count() > 0 and verdicts.where("reason is not null").count() == 0
    state = log.state_at(i.initial, i.changes, i.lag().select("shard", F.col("hi").alias("at")))
    assert receipts.token_violations(*new, rank.rank_state(state, scores)).count() == 0


def test_wire_bytes(spark):
    import json
    rows = [("a", "ä中"), ("b", "\U0001f600x"), ("c", None), ("d", 'q"\n')]
    got = spark.createDataFrame(rows, "k string, a string").select("k", "a", audit.wire_bytes("k", "a").alias("n")).collect()
    assert all(r.n == len(json.dumps({"a": r.a, "k": r.k}, separators=(",", ":"))) + 1 for r in got)


def test_nearest_rank(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 8)], "v int")
    assert [df.agg(audit.nearest_rank("v", p).alias("x")).first().x for p in (0.0, 0.5, 0.95, 1.0)] == [1, 4, 7, 7]


def test_policy_case_without_answers(spark):
    answers = spark.createDataFrame([("p", 1, 1, "a", "b1", 1)], "policy string, t int, rank int, ident string, body string, score long")
    other = answers.withColumn("policy", F.lit("r")).withColumn("t", F.lit(2))
    assert {r.t for r in audit.matched_answers(answers.unionByName(other), ["t"]).collect()} == {1, 2}


def test_delivery_outcomes(spark):
    """The first well-formed delivery counts: what was refused before it is no conflict."""
    rows = [(0, 1, "a", "b9", 1), (0, 1, "a", "b1", 2), (0, 1, "a", "b1", 3), (0, 1, "a", None, 4), (0, 0, "a", "b1", 5), (7, 1, "a", "b1", 6), (None, 1, "a", "b1", 7),
            (0, 2, "a", "b1", 8), (0, 2, "a", "b2", 8), (0, 3, "a", "b1", 9), (0, 3, "b", None, 9), (0, 3, "b", None, 10), (0, 3, "a", "b1", 10), (0, 300, "a", "b1", 11)]
    d = spark.createDataFrame(rows, "shard int, seq long, ident string, body string, arrival long")
    got = [r.outcome for r in log.classify_deliveries(d, bodies(spark), shards=3).orderBy("arrival").collect()]
    assert got == ["unknown-body", "ok", "duplicate", "conflicting-sequence", "event-schema", "event-schema", "event-schema", "batch-schema", "ok", "duplicate", "retention-window"]


def test_stable_plans(spark):
    """f was there at the base: labels of both versions only; g came later: any; h: one stable label, no plan; i: no labels at all."""
    rows = [("f", 0, ["a", "b", "c"]), ("f", 1, ["b", "c", "d"]), ("g", 1, ["call:z", "a"]), ("g", 2, ["name:z", "b"]), ("h", 0, ["a", "b"]), ("h", 1, ["a", "c"]), ("i", 0, [])]
    df = spark.createDataFrame([("a", 9), ("b", 2), ("c", 1), ("call:z", 2)], "label string, df long")
    versions = spark.createDataFrame(rows, "ident string, version int, labels array<string>")
    plans, rejected = corpus.plan_stable_labels(versions, spark.createDataFrame([("f",), ("h",), ("i",)], "ident string"), df, "ident", 3)
    got = [(r.ident, r.label) for r in plans.orderBy("ident", "pos").collect()]
    assert got == [("f", "c"), ("f", "b"), ("g", "name:z"), ("g", "call:z"), ("g", "b")]
    assert {(r.ident, r.pool) for r in rejected.collect()} == {("h", 1), ("i", 0)}


def test_shortlist_keeps_the_first(spark):
    """More labels than `known`, ties at its edge, labels that df lacks, sets of frequent labels alone, calls before others."""
    sets = {"k1": ["a", "b", "call:c", "d"], "k2": ["a", "b"], "k3": ["x", "a", "b"], "k4": ["call:c", "call:e", "call:f", "x"], "k5": [], "k6": ["b", "call:b", "d"]}
    df = {"a": 9, "b": 7, "call:c": 7, "call:b": 7, "d": 5, "call:e": 5, "call:f": 1}
    d, f = spark.createDataFrame(list(sets.items()), "k string, labels array<string>"), spark.createDataFrame(list(df.items()), "label string, df long")
    for known in (1, 2, 4, 5, 99):
        for n in (1, 2, 3):
            for calls in (False, True):
                got = {r.k: r.labels for r in corpus.shortlist(d, f, "k", n, calls, known).collect()}
                for k, labels in sets.items():
                    order = lambda x: (not x.startswith("call:") if calls else False, df.get(x, 0), not x.startswith("call:"), x)
                    assert set(got[k]) <= set(labels) and sorted(got[k], key=order)[:n] == sorted(labels, key=order)[:n]
    assert {r.k: len(r.labels) for r in corpus.shortlist(d, f, "k", 2).collect()}["k1"] == 2


def test_plans_with_calls_first(spark):
    """As plan_rare with all labels joined: seeds with more calls than places, as many, fewer, none, no labels, null."""
    sets = [(f"k{i:02d}", [f"call:c{j}" for j in range(9) if (i * 7 + j * j) % 5 < i % 4] + [f"name:n{j}" for j in range(6) if (i + j) % 3]) for i in range(40)] + [("none", []), ("null", None)]
    seeds = spark.createDataFrame(sets, "k string, labels array<string>")
    for n in (1, 3, 4):
        got, want = corpus.plan_calls_first(seeds, "k", n), corpus.plan_rare(seeds, corpus.label_df(seeds), "k", n, call_first=True)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 40 * n - 40


def test_stable_plans_of_bodies(spark):
    """Versions of bodies that many share give the plans that sets of labels give."""
    held = [(f"f{i:02d}", v, f"b{(i * 7 + v * v) % 13}") for i in range(20) for v in range(1 + i % 6)]
    labels = {f"b{j}": [x for k, x in enumerate("abcdefgh") if (j >> k) % 2 or k < j % 5] + ["name:z"] * (j % 3 > 0) for j in range(13)}
    v, b = spark.createDataFrame(held, "ident string, version int, body string"), spark.createDataFrame(list(labels.items()), "body string, labels array<string>")
    base, df = spark.createDataFrame([(f"f{i:02d}",) for i in range(0, 20, 2)], "ident string"), corpus.label_df(b)
    plans, few = corpus.plan_stable_labels(v, base, df, "ident", 3, b)
    n = {r.label: r.df for r in df.collect()}
    want, none = set(), set()
    for i in range(20):
        each = [set(labels[x]) for k, _, x in held if k == f"f{i:02d}"]
        pool = set.union(*each) if i % 2 else set.intersection(*each)
        if len(pool) < 2:
            none.add((f"f{i:02d}", len(pool)))
        else:
            want |= {(f"f{i:02d}", p, x) for p, x in enumerate(sorted(pool, key=lambda x: (n[x], x))[:3], 1)}
    assert {(r.ident, r.pos, r.label) for r in plans.collect()} == want and {(r.ident, r.pool) for r in few.collect()} == none and want and none


def test_rank_flip(spark):
    """Neither a nor b changes; documents that share a's label make it cheap."""
    few = [("a", ["x"]), ("b", ["y"]), ("c", ["y"])]
    d = spark.createDataFrame([*few, ("d", ["x"]), ("e", ["x"])], "body string, labels array<string>")
    d = d.withColumn("labels", F.concat("labels", F.array("body")))  # own labels, so that norms differ
    every = d.select(F.lit(0).alias("shard"), F.col("body").alias("ident"), "body")
    few = every.where("body < 'd'")
    t = spark.createDataFrame([("q", 0, 1, "x"), ("q", 0, 2, "y")], "query_id string, alt int, pos int, label string")
    before, after = rank.tfidf_rank(few, d, t), rank.tfidf_rank(every, d, t)
    assert {(r.ident, r.other) for r in rank.rank_flips(before, after, few, 5).collect()} == {("a", "b"), ("a", "c")}
    assert rank.rank_flips(before, after, few, 1).count() == 0 and rank.rank_flips(before, after, few.where("ident = 'a'"), 5).count() == 0


def test_top_of_nothing(spark):
    rows = spark.createDataFrame([("q", 0, "a", 2), ("q", 1, "b", 2), ("q", 1, "c", 3)], "query_id string, shard int, ident string, score long")
    assert rank.top_n(rows, ("query_id",), 0).count() == 0
    assert [r.ident for r in rank.merge_topk(rows, ("query_id",), 2).orderBy("rank").collect()] == ["c", "a"]


def test_unverified_claims_what_replied(spark):
    ranked = spark.createDataFrame([("q", 0, "a", "b1", 1), ("q", 1, "b", "b2", 2)], "query_id string, shard int, ident string, body string, score long")
    for shards, claim, want in (([0, 1], True, ["b", "a"]), ([0], False, ["a"])):
        rows, heads = policies.unverified_topk(ranked, spark.createDataFrame([("q", s) for s in shards], "query_id string, shard int"), 2, 5)
        assert [r.ident for r in rows.orderBy("rank").collect()] == want and heads.first().claim == claim


def test_convergence(spark):
    state = spark.createDataFrame([(0, "a", "b1"), (0, "b", "b2")], "shard int, ident string, body string")
    replicas = spark.createDataFrame([("r", 0, "a", "b1"), ("r", 0, "b", "b2"), ("s", 0, "a", "b3"), ("s", 0, "c", "b1")], "replica string, shard int, ident string, body string")
    members = spark.createDataFrame([("r", 0), ("s", 0), ("empty", 0), ("r", 1)], "replica string, shard int")
    assert {(r.replica, r.shard, r.differences) for r in log.convergence(replicas, members, state).collect()} == {("r", 0, 0), ("s", 0, 3), ("empty", 0, 2), ("r", 1, 0)}


def test_traces(spark, tmp_path):
    import gzip
    import json
    trace = {"case": "c", "records": [{"tick": 1, "observations": {"exact": {"rows": 2}, "stale": {"rows": 1}}}, {"tick": 2, "observations": {}}]}
    with gzip.open(tmp_path / "t.json.gz", "wt") as f:
        json.dump(trace, f, indent=1)
    schema = "case string, records array<struct<tick: int, observations: map<string, struct<rows: int>>>>"
    got = files.flatten_observations(files.read_traces(spark, str(tmp_path), schema), ["case"])
    assert sorted(tuple(r) for r in got.collect()) == [("c", 1, "exact", 2), ("c", 1, "stale", 1)]


def test_states_at_many_cuts(spark):
    """Against all versions and cuts one by one; cuts beyond the log, before it, and none."""
    import random
    rng = random.Random(3)
    start = [(s, f"i{i}", "b0") for s in range(2) for i in range(6)]
    log_ = [(s, n, 0, f"i{rng.randrange(8)}", rng.choice([None, "b1", "b2"])) for s in range(2) for n in range(1, 70)]
    v = log.versions(spark.createDataFrame(start, "shard int, ident string, body string"), spark.createDataFrame(log_, "shard int, seq long, pos int, ident string, body string"))
    points = [(c, s, at) for s in range(2) for c, at in enumerate([*range(0, 70, 3), 69, 1000, -1])]
    got = {tuple(r) for r in log.state_as_of(v, spark.createDataFrame(points, "cut_id int, shard int, at long")).collect()}
    want = {(c, s, r.ident, r.body) for c, s, at in points for r in v.collect() if r.shard == s and r.body and r.from_seq <= at and (r.to_seq is None or at < r.to_seq)}
    assert got == want
    assert log.state_as_of(v, spark.createDataFrame([], "cut_id int, shard int, at long")).count() == 0


def test_coverage(spark):
    events = spark.createDataFrame([(0, s) for s in [1, 2, 3, 5, 6, 5000, 5001]] + [(0, 2), (1, 4)], "shard int, seq long")
    ranges = [(0, 0, 3), (0, 0, 4), (0, 3, 3), (0, 4, 6), (0, 3, 6), (0, 4999, 5001), (0, 6, 5001), (1, 0, 4), (1, 3, 4), (2, 0, 1), (2, 1, 1), (0, 5, 2)]
    got = log.coverage(events, spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "range_id int, shard int, lo long, hi long"))
    assert [r.covered for r in got.orderBy("range_id").collect()] == [True, False, True, True, False, True, False, False, True, False, True, False]


def test_places_of_a_large_group(spark):
    rows = spark.createDataFrame([("g" if i % 10 else None, f"k{i * 7919 % 1000:04}") for i in range(1000)], "g string, k string")
    got = log.placed(rows, ("g",), "k", "at", staged, ranges=5).collect()
    for g in ("g", None):
        own = sorted((r.k, r.at, r.at_of) for r in got if r.g == g)
        assert [a for _, a, _ in own] == list(range(len(own))) and {n for *_, n in own} == {len(own)}


def test_stored_postings(spark):
    """A label of more postings than a part should have lies in several parts, and is found whole."""
    rows = [("common", f"b{i}") for i in range(500)] + [("rare", "b1"), ("rare", "b2"), ("other", "b3")]
    index = rank.PostingIndex(spark.createDataFrame(rows, "label string, body string"), "body", "test_postings", most=64, every=2)
    assert {(r.label, r.df, r.parts > 4) for r in index.labels.collect()} == {("common", 500, True), ("rare", 2, False), ("other", 1, False)}
    asked = spark.createDataFrame([("common",), ("rare",), ("rare",), ("none",)], "label string")
    assert sorted(tuple(r) for r in index.lookup(asked).collect()) == sorted(x for x in rows if x[0] != "other")


def test_tokens_of_several_places(spark, sf_dir):
    """Tokens of one shard that stand at different positions advance over suffixes of their own."""
    i = queries.Inputs(spark, sf_dir)
    changes, scores = staged(i.changes, "log"), staged(i.scores(), "scores")
    top = changes.groupBy("shard").agg(F.max("seq").alias("hi"))
    got = []
    for back in (40, 9, 0):
        at = top.select("shard", (F.col("hi") - back).alias("at"))
        some = i.terms().where(F.crc32(F.col("query_id").cast("binary")) % 3 == {40: 0, 9: 1, 0: 2}[back]).select("query_id").distinct()
        got.append(tokens.acquire_tokens(log.state_at(i.initial, changes, at), scores, some.crossJoin(at), 5))
    heads, rows = (staged(got[0][n].unionByName(got[1][n]).unionByName(got[2][n]), "token") for n in (0, 1))
    heads2, rows2 = tokens.advance_tokens(heads, rows, tokens.fold_suffixes(changes, heads, top), top, scores)
    state = rank.rank_state(log.state_at(i.initial, changes, top.withColumnRenamed("hi", "at")), scores)
    assert rows2.count() and receipts.token_violations(heads2, rows2, state.join(heads2.select("query_id").distinct(), "query_id", "left_semi")).count() == 0
    assert {r.generation for r in heads2.collect()} == {0, 1}


def test_capacity_bounds(spark):
    heads = refill_case(spark)[0]
    for capacity in (4, 65):
        with pytest.raises(ValueError, match="capacity"):
            tokens.acquire_tokens(heads, heads, heads, capacity, k=5)


def test_expected_changes(spark):
    made = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 4)], "ident string, seq long").withColumn("shard", F.lit(0))
    meant = spark.createDataFrame([("b", 1), ("a", 1), ("b", 2), ("a", 3)], "ident string, seq long")
    verdicts, misfits = log.check_expected_changes(made, meant)
    assert {tuple(r) for r in verdicts.collect()} == {(1, 2, 2, True), (2, 1, 1, False), (3, 0, 1, False), (4, 1, 0, False)}
    assert {tuple(r) for r in misfits.collect()} == {(2, "a", "unexpected"), (2, "b", "lacking"), (3, "a", "lacking"), (4, "c", "unexpected")}


def test_receipts_in_order(spark):
    true = spark.createDataFrame([("p", "r1", 1, "a"), ("p", "r1", 2, "b"), ("s", "r2", 0, "a"), ("s", "r2", 0, "b")], "kind string, receipt string, place long, ident string")
    swapped = true.withColumn("place", F.when(F.col("kind") == "p", 3 - F.col("place")).otherwise(F.col("place")))
    got = {r.kind: (r.receipts, r.wrong) for r in receipts.compare_receipts(swapped, true, ["ident"]).collect()}
    assert got == {"p": (1, 1), "s": (1, 0)}
    assert {r.wrong for r in receipts.compare_receipts(true.where("receipt = 'r1' or ident = 'a'"), true, ["ident"]).collect()} == {0, 1}


def test_state_by_deltas_survives_a_failed_batch(spark, tmp_path):
    """The second batch fails after it has written its deltas; run again, it leaves what one run leaves. Folds happen on the way."""
    from freshrank.streaming import standing as streams
    shape = "shard int, seq long, pos int, ident string, body string"
    start = spark.createDataFrame([(0, f"i{n}", "b1") for n in range(6)], "shard int, ident string, body string")
    parts = [[(0, 3, 0, "i0", None), (0, 4, 0, "x", "b2")], [(0, 1, 0, "i0", "b3"), (0, 5, 0, "x", None)], [(0, 6, 0, "i1", "b4"), (0, 7, 0, "y", "b2"), (0, 8, 0, "i2", "b0")]]
    root, real, failed = str(tmp_path / "root"), streams.Deltas.add, []

    def add(self, df, version):
        real(self, df, version)
        if version == 1 and self.path.endswith("postings") and not failed:
            failed.append(1)
            raise RuntimeError("lost")

    streams.Deltas.add = add
    try:
        for n, rows in enumerate(parts):
            spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{root}/feed")
            feed = spark.readStream.schema(shape).parquet(f"{root}/feed")
            if n == 1:
                with pytest.raises(Exception, match="lost"):
                    streams.stream_state(feed, start, bodies(spark), root, share=0.4)
            state, postings = streams.stream_state(feed, start, bodies(spark), root, share=0.4)
    finally:
        streams.Deltas.add = real
    assert {(r.ident, r.body) for r in state.collect()} == {("i1", "b4"), ("i2", "b0"), ("i3", "b1"), ("i4", "b1"), ("i5", "b1"), ("y", "b2")}
    want = {(0, label, ident) for ident, labels in {"i1": "wxyz", "i2": "a", "i3": "x", "i4": "x", "i5": "x", "y": "xy"}.items() for label in labels}
    assert sorted(tuple(r) for r in postings.collect()) == sorted(want)
    journal = spark.read.parquet(f"{root}/state/journal").where("kind = 'base'")
    assert failed and journal.count() > 1


def test_feed_with_a_gap_is_an_error(spark, tmp_path):
    from freshrank.streaming import standing as streams
    heads, rows, state, scores, _, _ = refill_case(spark)
    spark.createDataFrame([(0, 3, 0, "a", "b1")], "shard int, seq long, pos int, ident string, body string").write.parquet(f"{tmp_path}/feed")
    feed = spark.readStream.schema("shard int, seq long, pos int, ident string, body string").parquet(f"{tmp_path}/feed")
    with pytest.raises(Exception, match="the feed has a gap"):
        streams.stream_standing(feed, state, heads, rows, scores, str(tmp_path), 2, 1)
