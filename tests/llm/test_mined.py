"""HTML extraction, phrase collocations and conversation repair against brute force and SQL."""

import hashlib
import html as markup
import itertools
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest

from freshrank.llm import collocations, conversations
from freshrank.llm import html as pages

from .helpers import LONG, documents, empty, fixture

LOOSE = """<html><head><title>x</title></head><body><div id="top"><a href=/>Home</a> <a href=/a>About</a></div><div class="content"><h1>Big title</h1>
<p>First long paragraph with a lot of words in it, more than enough to be seen as content.</p><p>Short.</p><div class="ad-slot">Buy now this product, a very good
product</div><p>Another long paragraph &amp; <a href=x>a link</a>,\n more than enough text.</p></div><div id="comments"><p>I like this article very much, said a reader.</p></div>
<div class="site-footer">Copyright 2020 all rights reserved by the company of things</div></body></html>"""
CASES = [
    (LOOSE, "Big title\nFirst long paragraph with a lot of words in it, more than enough to be seen as content.\nShort.\nAnother long paragraph & a link, more than enough text."),
    ("""<body><header><h1>Site</h1></header><main><article class="post"><header><h1>Title</h1></header><p>Text one&nbsp;two</p><p>Text <b>two</b>three<aside>note</aside><ul><li>one<li>two</ul>
<article class="comment"><p>a reply</p></article><footer>tags</footer></article><section class="related"><article><h3>More</h3></article></section></main></body>""", "Title\nText one two\nText twothree\none\ntwo"),
    (None, ""), ("", ""), ("just text &lt;here", "just text <here"), ("<nav><a>menu</a></nav><footer>end</footer>", ""), ("<article><p>abc <b>def</b> ghi <p cla", "abc def ghi"),
    ("<article><p>a<button>press</button>b</p><script>if (a<b) {}</p></script>z<style>p</style><![CDATA[x]]><![odd[y]></article>", "ab\nz"),
    ("<p><b>line<br>break<p>next</p>", "line break\nnext"), ("<article><table><tr><td>a<td>b</tr><tr><td>c</table></article>", "a b\nc"),
    ("<div>" * 3000 + "deep" + "</p>" * 3000, "deep"), ("<article><p>" + "word " * 50_000 + "</p></article>", ("word " * 50_000).strip()),
]


def test_pages(spark, sf_dir):
    rows = [(i, f"u{i}", h, "t", 1) for i, (h, _) in enumerate(CASES)] + [(None, None, CASES[4][0], None, None), (4, "u4", CASES[4][0], "t", 1)]
    schema = "page_id long, url string, html string, text string, n_chars int"
    got = pages.extract(spark.createDataFrame(rows, schema)).collect()
    want = [(r[0], r[1], t, len(t)) for r, t in zip(rows, [t for _, t in CASES] + [CASES[4][1]] * 2, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert pages.extract(spark.createDataFrame([], schema)).collect() == []
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r.text for r in pages.extract(table).collect()}
    for r in table.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1])
        lines = [" ".join(markup.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
        assert found[r.page_id] == "\n".join(x for x in lines if x)


def test_ratios():
    x = np.array([0.0, 0.0, 10.0, 0.0, 0.0])
    y = pages.smoothed(x)
    assert y.argmax() == 2 and y[1] == y[3] and y.sum() < 10.01 and y[0] > 0


def _phrases(rows, least, most=5, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, most + 1):
                f[lang or "und"].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in f.items():
        often, found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        longer = {q[i:j] for q, a in often.items() for i, j in itertools.combinations(range(len(q) + 1), 2) if 1 < j - i < len(q) and c[q[i:j]] == a}
        for p, a in often.items():
            score, _, l, r = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if p not in longer:
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:first])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["fixture", "table"])
def test_collocations(spark, sf_dir, kind, monkeypatch):
    if kind == "fixture":
        odd = ["a b\tc. A B C\x0ba b c", "über Ü über Ü! über ü", "x" * 5000 + " x", "the the the the the the the", " . ,;  ", "a b c d e f"] * 2
        docs = spark.createDataFrame([(i, t, lang, "z") for i, (t, lang) in enumerate([(t, None) for t in odd] + [(t, "und") for t in odd[:2]] + [(LONG, "en")] * 3 + [(None, "fr")])],
                                     "doc_id long, text string, lang string, phrase string")
        least, first = 2, 7
        monkeypatch.setattr(collocations, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(collocations, "OWNED", 5)  # pairs of words are dealt to several owners
    else:
        docs, least, first = documents(spark, sf_dir), 8, 2000
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    got = sorted(map(tuple, collocations.collocations(docs, least, first=first).collect()))
    assert got == _phrases(rows, least, first=first) and got


def test_no_collocations(spark):
    for docs in (empty(spark), fixture(spark, [(1, "a b", None)])):
        assert collocations.collocations(docs.selectExpr("*", "cast(null as string) as lang"), 2).collect() == []


def test_three_way():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, (500, 5)).astype(np.int32)
    for row, n in zip(words, rng.integers(1, 6, 500), strict=True):
        row[n:] = -1
    weights, want = rng.integers(1, 9, 500), Counter()
    for row, w in zip(words.tolist(), weights.tolist(), strict=True):
        p = [x for x in row if x >= 0]
        want.update({tuple(p[:m]): w for m in range(2, len(p) + 1)})
    got = {tuple(words[row, :n].tolist()): w for n, row, w in collocations.three_way(words, weights, 60)}
    assert got == {p: w for p, w in want.items() if len(p) == 2 or w >= 60}


def _cheapest(rows):
    """(cost, audit) by all paths through the grammar's states, row after row."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}

    def with_inserts(best):
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                best[step[s]] = min(best.get(step[s], (1 << 60, "")), (c + 2, a + "I"))
        return best

    best = with_inserts({"": (0, "")})
    for row in rows:
        now = {}
        for s, (c, a) in best.items():
            ways = [(s, c + 3, a + "D")]
            if not row.gone:
                if row.initial == step[s] or s == "" and row.initial == "s":
                    ways.append((row.initial, c + row.cut, a + "K"))
                ways.append((step[s], c + 2 + row.cut, a + "R"))
            for t, *x in ways:
                now[t] = min(now.get(t, (1 << 60, "")), tuple(x))
        best = with_inserts(now)
    return min(best[s] for s in ("", "a") if s in best)


@pytest.mark.parametrize("segment", [1, 3, 64])
def test_alignment(segment, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rng = random.Random(segment)
    for _ in range(400):
        rows = [conversations.Row(rng.choice("suuaaax"), rng.random() < 0.2, False) for _ in range(rng.randrange(12))]
        now = conversations.Conversation(1)
        for row in rows:
            row.cut = not row.gone and rng.random() < 0.3
            now.rows.append(row)
            if len(now.rows) == segment:
                now.advance()
        assert now.result()[6:8] == _cheapest(rows)


def _by_sql(rows):
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"})
    con.register("conversations", frame)
    return sorted(map(tuple, con.execute(conversations.SQL).fetchall()), key=repr)


def test_repair(spark, sf_dir):
    rng = random.Random(5)
    said = ["Yes.", "No!", "why", "  ", "", "Well...?\n", "é. ", None]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(said)) for c in [*range(60), None] for _ in range(rng.randrange(9))]
    rows += [(100, 0, "system", "Be good."), (100, 1, "user", LONG + ".")] + [(100, 2, "assistant", "Same.")] * 200 + [(100, t, "ua"[t % 2] + "x", f"t{t}.") for t in range(3, 150)]
    rows += [(101, 1, None, None)] * 3
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, digest string, times int")
    got = sorted(map(tuple, conversations.repair(conversations.damaged(docs)).collect()), key=repr)
    assert got == _by_sql(rows)
    assert conversations.repair(conversations.damaged(docs.where("conv_id = -1"))).collect() == []
    dropped = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    gone = conversations.repair(conversations.damaged(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"))).collect()
    assert tuple(gone[0]) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
