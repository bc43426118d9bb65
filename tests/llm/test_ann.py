import math

import numpy as np
import pytest

from freshrank.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, members string"


def brute(rows, every=20, k=20):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            out[q] = sorted((-float((v * x).sum()), i) for i, v in good if i != q and len(v) == len(x))[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hit = total = 0
    assert set(found) <= set(want)
    for q, true in want.items():
        mine = sorted(found.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(true) + 1))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        worst = true[-1][0] if true else 0
        hit += sum(-r.score <= worst + 1e-12 for r in mine)
        total += len(true)
    return hit / max(1, total)


@pytest.mark.parametrize("shard", [32768, 120])
def test_recall_on_a_table(spark, sf_dir, shard):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert recall(ann.search(df, shard=shard, block=7).collect(), want) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 5)]) for i in range(1, 300)]
    rows += [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(200)]  # a hot vector
    rows += [(0, None), (20000, []), (40000, [0.0] * 8), (60000, [float("nan")] * 8), (80000, [1.0, None] + [0.0] * 6), (100000, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, "s", "m") for i, v in rows], SCHEMA)
    got = ann.search(df).collect()
    want = brute(rows)
    assert recall(got, want) >= 0.9
    hot = sorted((r.rank, r.vec_id) for r in got if r.query_id == 1100)
    assert [v for _, v in hot] == [i for _, i in want[1100]]


@pytest.mark.parametrize("spread", [0.0, 0.7])
def test_recall_of_full_shards(spark, spread):
    """16,000 Gaussian vectors in two shards of about 8,000 (beams are measured), with norms alike and with norms that vary by a log-normal factor."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(16_000, 64)) * rng.lognormal(0, spread, (16_000, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, every=160, shard=8192).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in range(0, 16_000, 160):
        true = np.argsort(-(x @ x[q]))
        hits.append(len(got[q] & set(true[true != q][:20].tolist())) / 20)
    assert len(hits) == 100 and np.mean(hits) >= 0.9


def test_huge_components_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1e30 if i in (20, 3, 5, 7, 9) else 1.0)]) for i in range(1, 40)]
    rows += [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(5)] + [(200, [1e200, 1.0, 0.0, 0.0]), (300, [1e-200, 0.0])]
    want = brute(rows)
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert recall(got, want) == 1 and {q for q, v in want.items() if v} == {r.query_id for r in got}


def test_few_and_none(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0], 0, "", ""), (1, [0.5, 0.5], 0, "", "")], SCHEMA)
    assert [tuple(r) for r in ann.search(df).collect()] == [(20, 1, 1, 0.5)]
    assert ann.search(df.limit(0)).count() == 0


def test_beams_and_graphs():
    """A beam is as wide as its sample asks for; the graph keeps to its degree, holds no node twice and reaches all points from the entry."""
    rng = np.random.default_rng(4)
    like = rng.normal(size=(2000, 16))
    unlike = like * rng.lognormal(0, 1.2, (2000, 1))
    beams = []
    for v in (like, unlike):
        graph, entry = ann.build_graph(ann._unit(v).astype(np.float32))
        assert graph.shape == (2000, ann.DEGREE)
        rows = [[i for i in r if i >= 0] for r in graph.tolist()]
        assert all(len(set(r)) == len(r) and n not in r for n, r in enumerate(rows))
        met, todo = {entry}, [entry]
        while todo:
            new = set(rows[todo.pop()]) - met
            met |= new
            todo += new
        assert len(met) >= 1990
        beam = ann.fitting_beam(v, graph, entry, 21)
        ids = ann.nearest(v, graph, entry, v[:300], beam)[:, :21]
        true = np.argsort(-(v[:300] @ v.T), axis=1)[:, :21]
        assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 21 for a, b in zip(ids, true, strict=True)]) >= 0.95
        beams.append(beam)
    assert beams[0] <= beams[1]
