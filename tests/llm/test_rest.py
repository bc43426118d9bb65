import math
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import pytest

from freshrank.llm import lm, mixing, packing, toxicity, url_filter
from freshrank.llm.queries import tokenizer_path

from .helpers import documents, empty, fixture


@pytest.fixture(scope="module", params=["fixture", "table"])
def docs(request, spark, sf_dir):
    return (fixture(spark) if request.param == "fixture" else documents(spark, sf_dir)).cache()


def test_mix(docs):
    got = mixing.mix(docs).collect()
    sizes, words, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        words[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want, open_, left = {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > 2 * sizes[s]]
        if not full:
            want |= {s: level * w for s, w in open_.items()}
            break
        for s in full:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            del open_[s]
    for s in names:
        assert target[s] == pytest.approx(want[s], rel=1e-9) and words[s] == math.floor(target[s] + 1e-9)
    assert sum(len((r.text or "").encode().split()) for r in mixing.mixed(docs).collect()) == sum(words.values())


def test_buckets_of_unlike_weights(spark):
    """Half the rows have a twentieth of the weight, and one source nearly all rows: buckets stay even, and rise with the key."""
    from pyspark.sql import functions as F
    d = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, 2).otherwise(1).alias("sid"), F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("text_hash"),
                                   (-F.ln((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) + 0.5) / (1 << 20)) / F.when(F.col("id") % 2 == 0, 0.05).otherwise(1.0)).alias("key"))
    got = mixing.in_buckets(d).groupBy("sid", "bucket").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).orderBy("sid", "bucket").collect()
    assert max(r.n for r in got) < 3 * 20_000 / 8
    assert all(x.z <= y.a for x, y in zip(got, got[1:], strict=False) if x.sid == y.sid)


def test_pack(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    want, ids = Counter(), defaultdict(list)
    for r in docs.collect():
        own = np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want[(r.doc_id, len(own))] += len(own)
        ids[(r.doc_id, len(own))].append(own)
    pieces = packing.pack(docs, tokenizer_path()).collect()
    got, rows, spans = Counter(), defaultdict(list), defaultdict(list)
    for p in pieces:
        got[(p.doc_id, p.doc_tokens)] += p.length
        rows[p.sequence_id].append((p.offset, p.length))
        spans[(p.doc_id, p.doc_tokens)].append((p.start, p.length))
        assert any(crc32(own[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for own in ids[(p.doc_id, p.doc_tokens)])
    assert got == want
    for k, some in spans.items():  # each id of each of the equal documents lies in one piece
        held = np.zeros(k[1], int)
        for start, n in some:
            held[start:start + n] += 1
        assert (held == len(ids[k])).all()
    for some in rows.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    assert sum(sum(n for _, n in some) < 2048 for some in rows.values()) <= 11  # stubs of one group of partitions


def test_encoder():
    """Words with marks, special tokens and broken bytes, learnt together and anew, against the tokenizer."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    made = packing.Encoder(tokenizer_path(), most=8)
    for data in (["a b \x01 c", "<|endoftext|> A\x01b <|EndOfText|>"], ["", "don't é e\u0301 \u0301x 1234 ñ,", "\u2028x\u00a0y Ω… 你好"], ["a b c d e f g h i j"]):
        ids, sizes = made.ids([x.encode() for x in data])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [whole.encode(x, add_special_tokens=False).ids for x in data]


@pytest.mark.parametrize("block_bytes", [1 << 23, 3000])
def test_lm(docs, block_bytes):
    k2, k3 = lm.WEIGHTS
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.select("doc_id", "text").collect()]
    train = [t for d, t in texts if crc32(b"" if d is None else str(d).encode()) % 5 != 1]
    c, context = Counter(), Counter()
    for t in train:
        full = [b"\n", *t, None]
        for i in range(1, len(full)):
            c.update([(full[i],), (full[i - 1], full[i])])
            context.update([(full[i - 1],)])
            if i > 1:
                c.update([tuple(full[i - 2:i + 1])])
                context.update([(full[i - 2], full[i - 1])])
    n, v = sum(k for g, k in c.items() if len(g) == 1), sum(len(g) == 1 for g in c)
    want = Counter()
    for d, t in texts:
        full = [b"\n", *t, None]
        base = score = 0.0
        for i in range(1, len(full)):
            p = (c[full[i],] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for size, k in ((1, k2), (2, k3)):
                if i >= size and context[tuple(full[i - size:i])]:
                    p = (c[tuple(full[i - size:i + 1])] + k * p) / (context[tuple(full[i - size:i])] + k)
            score += math.log10(p)
        want[(d, len(full) - 1, sum(c[w,] > 0 for w in full[1:]), n, round(base, 4), round(score, 4))] += 1
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in lm.lm_scores(docs, block_bytes=block_bytes).collect())
    assert got == want


def test_lm_tells_held_out_texts_better_than_single_words(spark):
    held = lm.lm_scores(documents(spark, "/root/testdata/sf0.01")).where("held_out").selectExpr("sum(score) / sum(n_tokens)", "sum(base_score) / sum(n_tokens)").first()
    assert held[0] > -3.4 and held[1] < -4


def test_automaton_sums_to_one():
    """Each state's arcs and failures together give all tokens of a closed vocabulary, the unseen one included, a probability of one."""
    sizes, ids, words = lm.encoded([b"a b a b c", b"b a c c a b", b""])
    block = lm.Block([1, 2, 3], sizes, ids, words)
    counts = [np.unique(g, return_counts=True) for g in block.grams(2)]
    c1 = counts[0][1][np.searchsorted(counts[0][0], words)]
    triples = np.unique(block.grams(3)[2][~block.first], return_counts=True)[1]
    n, v = int(c1.sum()), len(c1)
    made = lm.Automaton(block, [c1, counts[1][1], triples], n, v)
    rest = 0.5 / (n + 0.5 * (v + 1))
    for state in [0, *np.unique(made.keys // made.words).tolist()]:
        total = 0.0
        for token in range(len(words)):
            at, cost = state, 0.0
            while at and at * made.words + token not in made.keys:
                cost, at = cost + made.failing[at], made.failure[at]
            total += 10 ** (cost + (made.cost[np.searchsorted(made.keys, at * made.words + token)] if at else made.root[token]))
        at, cost = state, 0.0
        while at:
            cost, at = cost + made.failing[at], made.failure[at]
        assert total + 10 ** cost * rest == pytest.approx(1)


def test_toxicity_learns():
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 110, 5))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        ws = [words[j] for j in rng.integers(0, 300, rng.integers(5, 200))]
        if i % 4 == 0:
            ws[rng.integers(0, len(ws))] = ["wretch", "vermin,", "WRETCH!"][i % 3]
        texts.append(" ".join(ws).encode())
        labels.append(int(i % 4 == 0))
    net = toxicity.train(texts[:300], np.array(labels[:300]))
    score = toxicity.scorer(net)(texts[300:])
    assert ((score >= 0.3) == np.array(labels[300:])).mean() > 0.9
    assert 0 <= toxicity.scorer(net)([b""])[0] < 0.3
    assert toxicity.train(texts[:4], np.zeros(4, np.int64)) is None and toxicity.scorer(None)([b"x"])[0] == 0


def test_toxicity_forward_pass():
    """Against the recurrences written out for one window at a time."""
    net = toxicity.Net()
    rng = np.random.default_rng(4)
    g, s, w = rng.normal(size=(9, 6 * toxicity.STATE)).astype(np.float32), toxicity.STATE, net.w
    idx, mask = rng.integers(0, 9, (5, 7)), np.arange(7) < np.array([7, 1, 3, 7, 5])[:, None]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for row, m, got in zip(idx, mask, net.forward(g, idx, mask.astype(np.float32)), strict=True):
        row = row[m]
        sides = []
        for way, off, order in (("f", 0, range(len(row))), ("b", 3 * s, reversed(range(len(row))))):
            h, out = np.zeros(s), np.zeros((len(row), s))
            for i in order:
                x, y = g[row[i], off:off + 3 * s], h @ w[f"h{way}"]
                z, r = sigmoid(x[:s] + y[:s]), sigmoid(x[s:2 * s] + y[s:2 * s])
                h = (1 - z) * h + z * np.tanh(x[2 * s:] + r * y[2 * s:])
                out[i] = h
            sides.append(out)
        both = np.hstack(sides)
        a = np.exp(both @ w["look"])
        assert got == pytest.approx((a / a.sum()) @ both @ w["out"] * 4 + w["bias"][0], abs=1e-4)


def test_toxicity_windows_and_worst():
    """All windows over a text, every passage of half a window in one of them whole, and a score that is the worst of them by the plain forward pass."""
    for n in (0, 1, 47, 48, 49, 72, 73, 500):
        starts = toxicity.windows(n).tolist()
        assert starts == sorted({*range(0, max(1, n - 48), 24), max(0, n - 48)})
        assert all(any(s <= p and p + 25 <= s + 48 for s in starts) for p in range(n - 24))
    rng = np.random.default_rng(8)
    net, data = toxicity.Net(), [" ".join(f"w{j}" for j in rng.integers(0, 90, n)).encode() for n in (0, 1, 30, 48, 49, 200, 1300)]
    want = []
    for x in data:
        words = x.split()
        values = []
        for s in toxicity.windows(len(words)).tolist():
            some = words[s:s + 48]
            g = net.gates(net.inputs([toxicity.clean(w) for w in some] or [b"x"]))
            values.append(net.forward(g, np.arange(len(some) or 1)[None], np.full((1, len(some) or 1), float(bool(some)), np.float32))[0])
        want.append(1 / (1 + np.exp(-max(values))))
    assert toxicity.scorer(net)(data) == pytest.approx(want, abs=1e-5)


def test_toxicity_sample_and_folds(spark):
    """Labels without a usable text take no places; folds and predictions as stated; repeated rows, no labels, no rows."""
    docs = spark.createDataFrame([(i, f"text {i}" if i % 3 else "x" * 70_000) for i in range(1, 200)] + [(1, "again"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 600)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, most=(20, 10))
    assert sorted(r.toxic for r in got) == [0] * 20 + [1] * 10 and all(len(r.text) < 100 for r in got)
    fold = {i: crc32(str(i).encode()) % 4 == 2 for i in range(1, 200)} | {None: False}
    assert all(not fold[int(r.text.split()[1])] for r in got if r.text != "again")
    rows = toxicity.judged(docs, labels).collect()
    assert len(rows) == 201 and all(r.held_out == fold[r.doc_id] and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.score for r in toxicity.judged(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.judged(docs.limit(0), labels).count() == 0


def test_toxicity_gradient_is_that_of_finite_differences():
    net, idx, mask = toxicity.Net(), np.array([[0, 1, 2], [2, 1, 0]]), np.array([[1, 1, 1], [1, 1, 0]], np.float32)
    words, y, weight = [b"abc", b"wretch", b"x"], np.array([1.0, 0.0], np.float32), np.array([1.0, 2.0], np.float32)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    moments: dict = {}
    net.step(words, idx, mask, y, weight, 0.0, moments)
    rng = np.random.default_rng(6)
    for name, value in net.w.items():
        grad = moments[name][0] / 0.1
        some = np.argwhere(np.abs(grad) > 1e-4)
        for at in map(tuple, some[rng.permutation(len(some))[:6]]):
            loss = []
            for e in (1e-3, -1e-3):
                value[at] += e
                loss.append(net.step(words, idx, mask, y, weight, 0.0, {}))
                value[at] -= e
            assert grad[at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=0.05, abs=2e-4), (name, at)


def test_toxicity_gradient():
    net, idx, mask = toxicity.Net(), np.array([[0, 1, 2], [2, 1, 0]]), np.array([[1, 1, 1], [1, 1, 0]], np.float32)
    words, y, weight = [b"abc", b"wretch", b"x"], np.array([1.0, 0.0], np.float32), np.ones(2, np.float32)
    before = net.step(words, idx, mask, y, weight, 0.0, {})
    for _ in range(30):
        after = net.step(words, idx, mask, y, weight, 0.003, {})
    assert after < before


def test_toxicity_scores_every_row(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity.judged(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_url_filter(spark):
    pages = [(1, "http://A.Net/x", None), (2, "https://b.example.net/en/1", ""), (3, "http://c.org/de/1", '<link rel="canonical" href="http://d.org/2">'),
             (4, "http://d.org/2#top", '<meta http-equiv="refresh" content="0; url=//e.net/z">'), (5, "http://f.org/fr/1", "<link href='/de/9' rel=canonical>"), (6, "http://f.org/de/9", ""),
             (7, None, None), (8, "no scheme", "x"), (9, "http://net/", ""), (9, "http://net/", ""), (10, "http://x.net", ""), (11, "http://g.org/a/b", '<link rel=canonical href="c">'), (12, "http://g.org/a/c", ""),
             (13, "http://example.com/de/q", '<link rel=canonical href="http://f.org/fr/1">'),
             (14, "http://h.org/1", '<link rel=canonical><link rel="canonical" href="http://h.org/2"><LINK rel=canonical href="//e.net/z">'),
             (15, "http://i.org/1", '<meta http-equiv=refresh content="5"><meta http-equiv="refresh" content="0; url=http://A.Net/x">')]
    df = spark.createDataFrame([(*p, "h", "r") for p in pages], "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    assert got == {
        1: ("a.net", "/x", "net/", "block"), 2: ("b.example.net", "/en/1", "example.net/en/", "allow"), 3: ("c.org", "/de/1", None, "block"), 4: ("d.org", "/2", None, "block"),
        5: ("f.org", "/fr/1", "org/fr/", "allow"), 6: ("f.org", "/de/9", None, "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("net", "/", "net/", "block"),
        10: ("x.net", "", None, "allow"), 11: ("g.org", "/a/b", None, "allow"), 12: ("g.org", "/a/c", None, "allow"), 13: ("example.com", "/de/q", "example.com/de/", "block"),
        14: ("h.org", "/1", None, "block"), 15: ("i.org", "/1", None, "block")}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert {r[0]: r[1:] for r in con.execute(url_filter.SQL).fetchall()} == got
    assert url_filter.filter_urls(df).count() == len(pages) and url_filter.filter_urls(df.limit(0)).count() == 0


def test_empty_tables(spark):
    none = empty(spark)
    assert mixing.mix(none).count() == 0 and packing.pack(none, tokenizer_path()).count() == 0 and lm.lm_scores(none).count() == 0
    assert toxicity.toxicity(none, None).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert docs.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    """Nulls, ties, repeated rows and clashing names through every stage, against the same decisions made row by row."""
    import corpus_pipeline

    docs = fixture(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    once = stages["exact_dedup"](spark, docs, sf_dir)
    groups = {}
    for r in docs.collect():
        key = "".join((r.text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
        groups[key] = min(groups.get(key, (1, True, 0)), (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert once.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in once.collect()) == sorted(g[1:] for g in groups.values())
    near_ = stages["near_dedup"](spark, once, sf_dir)
    assert near_.columns == docs.columns and {r.doc_id for r in near_.collect()} == {2, 5, 6, 8, 9, 10, 11} and near_.where("doc_id = 10").count() + near_.where("doc_id is null").count() == 2
    mixed = stages["mix_sources"](spark, docs, sf_dir)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
    words = {k: 0 for k in taken}
    for r in mixed.collect():
        words[r.doc_id, r.source] += len((r.text or "").encode().split())
        assert (r.score, r._h, r._n, r._part, r._hash, r.doc) == tuple("012345")
    assert mixed.columns == docs.columns and words == taken
    packed = stages["pack"](spark, mixed, sf_dir).collect()
    starts = Counter(r.doc_id for r in packed if r.start == 0)
    assert starts == Counter(r.doc_id for r in mixed.collect())
