import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from freshrank.llm import exact, lines, near, repeats, simhash

from .helpers import ROWS, documents, empty, fixture

WS = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module", params=["fixture", "table"])
def docs(request, spark, sf_dir):
    return fixture(spark) if request.param == "fixture" else documents(spark, sf_dir)


def rows_of(docs):
    return [(r.doc_id, (r.text or "")) for r in docs.select("doc_id", "text").collect()]


def test_golomb_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        gaps = np.diff(values, prepend=np.uint64(0))
        k, unary, rest = exact.golomb_encode(gaps)
        assert (np.cumsum(exact.golomb_decode(k, len(gaps), unary, rest), dtype=np.uint64) == values).all()


def test_exact_dedup_is_grouping_by_bytes(docs):
    data = rows_of(docs)
    groups = defaultdict(list)
    for doc_id, text in data:
        groups[text.encode().translate(None, WS)].append((-len(text), doc_id is None, doc_id))
    want = Counter()
    for norm, members in groups.items():
        keep = min(members)[2]
        for _, _, doc_id in members:
            want[(doc_id, keep, len(members), hashlib.sha256(norm).hexdigest())] += 1
    got = exact.exact_dedup(docs)[1].collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    fps = np.array([f for _, f in items], np.uint64)
    label = np.arange(len(items))
    while True:
        new = label.copy()
        for i in range(len(items)):
            near = np.bitwise_count(fps ^ fps[i]) <= 4
            new[near] = np.minimum(new[near], new[near].min())
        if (new == label).all():
            break
        label = new
    least = defaultdict(list)
    for (d, _), c in zip(items, label.tolist(), strict=True):
        least[c] += [d] if d is not None else []
    return [(d, f"{f:016x}", min(least[c])) for (d, f), c in zip(items, label.tolist(), strict=True)]


def test_simhash_components(docs):
    want = Counter(brute_components([(d, brute_fingerprint(t)) for d, t in rows_of(docs)]))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_dedup(docs).collect()) == want


@pytest.mark.parametrize("n", [1, 3, 700])
def test_linked_fingerprints(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    near = [base] + [base ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)) for _ in range(2)]
    fps = np.unique(np.concatenate([*near, np.arange(2000 if n > 3 else 0, dtype=np.uint64)]))
    rng.shuffle(fps)
    want = brute_components(list(enumerate(fps.tolist())))
    assert simhash.linked(fps).tolist() == [c for _, _, c in want]


def test_links_by_more_blocks_and_by_parts(spark, monkeypatch):
    """As for a table of more fingerprints: keys of several blocks, groups that are dealt out."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 60, dtype=np.int64)
    fps = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 60, (8, 2))})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {f: fps[int(c)] for f, c in zip(fps, simhash.linked(np.array(fps, np.uint64)).tolist(), strict=True)}
    monkeypatch.setattr(simhash, "MOST", 7)
    from freshrank.llm.common import components
    for count in (len(fps), 1 << 28, 1 << 40):
        roots = {r.node: r.root for r in components(simhash.near_links(df, count), "t").collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[roots.get(f, f)].add(f)
        expected = defaultdict(set)
        for f, c in want.items():
            expected[c].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def shingle_set(text, width=5):
    words = text.encode().lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_near(data, similarity=0.8):
    """doc_ids that stay, of (doc_id, text): all pairs of sets of shingles; and how many pairs are just below."""
    sets = [shingle_set(t or "") for _, t in data]
    label, below = list(range(len(data))), 0
    for i, s in enumerate(sets):
        for j in range(i):
            alike = len(s & sets[j]) / len(s | sets[j]) if s or sets[j] else 1.0
            below += 0.7 <= alike < similarity
            if alike >= similarity and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    groups = defaultdict(list)
    for (d, _), c in zip(data, label, strict=True):
        groups[c].append((d is None, d))
    return Counter(min(g)[1] for g in groups.values()), below


@pytest.mark.parametrize("most", [32, 3])
def test_near_copies_are_all_pairs_of_sets(spark, monkeypatch, most):
    """Pairs, chains and groups close to the similarity asked for on both sides, short texts, and lines that many texts hold."""
    monkeypatch.setattr(near, "MOST", most)
    rng = np.random.default_rng(11)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 50_000, n)]
    common, texts_ = draw(30), []
    for n in (5, 9, 14, 24, 44, 60, 104, 204):
        for _ in range(12):
            words = draw(n)
            texts_.append(words)
            for share in rng.uniform(0.05, 0.3, 3):
                texts_.append([*words, *draw(max(1, round(share * n)))])
                texts_.append([*words[max(1, round(share * n)):]])
    for _ in range(40):
        texts_.append([*common, *draw(int(rng.integers(1, 12)))])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts_)] + [(None, " ".join(texts_[0])), (9000, None), (9001, " ")]
    want, below = brute_near(rows)
    assert below > 30 and sum(want.values()) < len(rows) - 100
    got = near.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(r.doc_id for r in got.collect()) == want


def test_near_copies_of_a_table(docs):
    got = near.without_near_copies(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == brute_near([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])[0]
    assert near.without_near_copies(docs.limit(0)).count() == 0


def brute_repeats(data, window=400):
    where = Counter(x[i:i + window] for x in data for i in range(len(x) - window + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if where[x[i:i + window]] > 1:
                gone[i:i + window] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_rows():
    rng = np.random.default_rng(3)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(2, 9))))
    some = [" ".join(word() for _ in range(300)) for _ in range(6)]
    passage = " ".join(word() for _ in range(90))[:520]
    rows = [(i, s) for i, s in enumerate(some)]
    rows += [(10 + i, some[i][:700] + passage + some[i][900:]) for i in range(5)]  # overlapping edges
    rows += [(20, passage[:399]), (21, passage[:400]), (22, "ab" * 1000), (23, "x" * 401), (24, passage + passage), (25, ""), (26, None), (27, some[0]), (27, some[0]), (28, "ä" * 500)]
    rows += [(40 + i, some[5][i * 7:600 + i * 7] + word() * 3 + passage[i:480]) for i in range(12)]
    return rows


@pytest.mark.parametrize("sizes", [(100, 10, 1), (1,), (37, 1)])
def test_repeated_passages(spark, sizes):
    rows = repeat_rows()
    got = Counter(tuple(r) for r in repeats.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"), sizes=sizes).collect())
    want = brute_repeats([(t or "").encode() for _, t in rows])
    assert got == Counter((d, *w) for (d, _), w in zip(rows, want, strict=True))


def test_repeated_passages_of_a_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    data = rows_of(docs)
    want = brute_repeats([t.encode() for _, t in data])
    got = Counter(tuple(r) for r in repeats.strip_repeats(docs).collect())
    assert got == Counter((d, *w) for (d, _), w in zip(data, want, strict=True))


def test_runs_and_classes_hold_each_window_once(monkeypatch):
    """Whatever the bytes hashed at once and the size of classes; and equal windows have their anchor at the same place."""
    data = [(t or "").encode() for _, t in repeat_rows()]
    for chunk in (1 << 20, 3000):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        of, start, n, anchor, _, place = repeats.runs(data, 400)
        places: dict[bytes, int] = {}
        seen = Counter()
        for d, s, k, a, p in zip(*(c.tolist() for c in (of, start, n, anchor, place)), strict=True):
            for size in (100, 1):
                parts = list(repeats.classes(data[d], s, k, p, a, 400, size))
                assert sorted(w for t, m, _, _, _ in parts for w in range(t, t + m)) == list(range(s, s + k))
                assert all(far + t == s + p for t, _, far, _, _ in parts)
            for i in range(k):
                assert places.setdefault(data[d][s + i:s + i + 400], p - i) == p - i
                seen[d, s + i] += 1
        assert seen == Counter((d, i) for d, x in enumerate(data) for i in range(len(x) - 399))


def brute_boundaries(some, mean=2):
    """Window by window in plain integers."""
    mix, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    hashes = [xxhash.xxh3_64_intdigest(x.encode()) for x in some]
    values = []
    for one, two in zip(hashes, hashes[1:]):
        x = two + one * mix & mask
        x = (x ^ x >> 32) * mix & mask
        values.append((x ^ x >> 29) * mix & mask)
    return [i for i, x in enumerate(values)
            if x >> 33 < (1 << 31) // mean or i == 0 or i == len(values) - 1 or not (values[i - 1] < x > values[i + 1])]


def brute_lines(data):
    where = defaultdict(list)
    some = [t.split("\n") for _, t in data]
    for i, ((d, _), x) in enumerate(zip(data, some, strict=True)):
        for a in brute_boundaries(x):
            where[x[a], x[a + 1]].append((d is None, d, i, a))
    firsts = {pair: min(places) for pair, places in where.items()}
    out = Counter()
    for i, ((d, _), x) in enumerate(zip(data, some, strict=True)):
        dead, chunks = set(), 0
        for a in brute_boundaries(x):
            *_, j, b = firsts[x[a], x[a + 1]]
            if (j, b) == (i, a):
                continue
            y, chunks = some[j], chunks + 1
            dead |= {a, a + 1}
            for step, edge in ((-1, 0), (1, 1)):
                for k in (1, 2):
                    p, q = a + edge + step * k, b + edge + step * k
                    if not (0 <= p < len(x) and 0 <= q < len(y)) or x[p] != y[q]:
                        break
                    dead.add(p)
        kept = [line for at, line in enumerate(x) if at not in dead]
        out[(d, len(x), len(x) - len(kept), chunks, hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_line_chunks(docs):
    assert Counter(tuple(r) for r in lines.line_dedup(docs).collect()) == brute_lines(rows_of(docs))


def test_line_boundaries_move_with_their_lines():
    body = [f"line {i * i % 101} {i // 50}".encode() for i in range(200)]
    a, b = (lines.boundaries(x) for x in (body, [b"new", b"head", *body]))
    assert len({*a} & {*(b - 2)}) >= len({*a} | {*(b - 2)}) - 3
    assert lines.boundaries([b""]).tolist() == [] and lines.boundaries([b"a", b"b"]).tolist() == [0]
    assert len(lines.boundaries([b""] * 5000)) == 4999  # windows of one value: all of them


def test_line_boundaries_are_a_choice():
    """About 71 % of the places of a long text, and one of any two neighbours."""
    some = lines.boundaries([b"%d" % i for i in range(20_000)])
    assert 0.69 < len(some) / 19_999 < 0.73 and np.diff(some).max() == 2


def test_long_line_runs_go_whole(spark):
    """Runs of 2 to 12 lines in the midst of unlike texts: those of three or more lines go whole, of all lines 95 % at least."""
    data, sizes = [], {}
    for k in range(220):
        run = [f"shared {k} {j}" for j in range(2 + k % 11)]
        sizes[k] = len(run)
        for copy in (0, 1):
            own = [f"own {k} {copy} {j}" for j in range(9)]
            data.append((1000 * copy + k, "\n".join(own[:4] + run + own[4:])))
    got = {r.doc_id: r.n_removed for r in lines.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 and got[1000 + k] in ((n,) if n > 2 else (0, n)) for k, n in sizes.items())
    assert sum(got.values()) >= 0.95 * sum(sizes.values())


def test_line_runs_inside_other_texts(spark):
    """Runs of 2 to 6 lines in two texts that are otherwise unlike: at least 0.95 of their lines go once, and nothing else goes."""
    data, planted = [], 0
    for k in range(200):
        run = [f"shared {k} {j}" for j in range(2 + k % 5)]
        planted += len(run)
        for copy in (0, 1):
            own = [f"own {k} {copy} {j}" for j in range(7)]
            data.append((1000 * copy + k, "\n".join(own[:k % 4] + run + own[k % 4:])))
    got = {r.doc_id: r.n_removed for r in lines.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[d] == 0 for d in range(200))
    assert all(got[1000 + k] <= 2 + k % 5 for k in range(200))
    assert sum(got.values()) >= 0.95 * planted


def test_empty_tables(spark):
    none = empty(spark)
    assert exact.exact_dedup(none)[1].count() == 0
    assert simhash.near_dedup(none).count() == 0
    assert repeats.strip_repeats(none).count() == 0
    assert lines.line_dedup(none).count() == 0


def test_repeats_of_the_fixture(spark):
    got = {r.doc_id: r for r in repeats.strip_repeats(fixture(spark)).collect()}
    assert got[6].n_removed == got[6].n_bytes and got[3].n_bytes == 0 and got[9].n_removed == 3000
    assert got[7].n_removed >= got[6].n_bytes and len(ROWS) == repeats.strip_repeats(fixture(spark)).count()


@pytest.mark.parametrize("keys", [1, 3, 2048])
def test_common_keys_are_counted_in_stretches(monkeypatch, keys):
    monkeypatch.setattr(near, "KEYS", keys)
    rng = np.random.default_rng(1)
    held = [sorted(set(rng.integers(-9, 9, rng.integers(0, 12)).tolist())) for _ in range(40)]
    some = np.array([0, 3, 39])
    assert near.both_hold(held, some).tolist() == [[len({*held[a]} & {*b} & {k for k in held[a] if sum(k in c for c in held) > 1}) for b in held] for a in some]
    assert near.both_hold([[], []], np.array([1])).tolist() == [[0, 0]]


def test_direct_links_of_the_index(spark, monkeypatch):
    """Pairs of the index differ in 4 bits at most and join what all such pairs join, in one group, in dealt parts, and with ids of one fingerprint."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 60, dtype=np.int64)
    fps = sorted({int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 60, (8, 2))} | set(range(300)))
    fps += fps[::7]
    want = [c for _, _, c in brute_components(list(enumerate(fps)))]
    found = []
    simhash.linked(np.array(fps[:len(set(fps))], np.uint64), found=found)
    some = [(np.concatenate(found) if found else np.zeros((0, 2))).tolist()]
    for most in (simhash.MOST, 7):
        monkeypatch.setattr(simhash, "MOST", most)
        got = simhash.linked_ids(spark.createDataFrame(list(enumerate(fps)), "id long, fp long"))
        some.append([(r.src, r.dst) for r in got.collect()])
    for n, pairs in zip((len(set(fps)), len(fps), len(fps)), some, strict=True):
        assert all((fps[a] ^ fps[b]).bit_count() <= 4 and a != b for a, b in pairs)
        label = list(range(n))
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        assert label == want[:n]


def test_near_stage_asks_the_index(spark, monkeypatch):
    """The pipeline's stage gets one fingerprint for each set of shingles into op4's index, and links of unlike sets, were it to return all pairs, join nothing."""
    import corpus_pipeline

    asked, index = [], near.linked_ids

    def linked_ids(prints):
        asked.append((prints, links := index(prints)))
        x, y = (prints.select(prints.id.alias(c)) for c in ("src", "dst"))
        return links.unionByName(x.crossJoin(y).where("src > dst"))

    monkeypatch.setattr(near, "linked_ids", linked_ids)
    rng = np.random.default_rng(2)
    one, two = ([f"w{x}" for x in rng.integers(0, 50_000, 400)] for _ in range(2))
    same = " ".join(one[:5] * 40)  # a longer text of the same shingles has the same set
    rows = [(1, " ".join(one)), (2, " ".join([*one, "end"])), (3, same), (4, same + " " + " ".join(one[:5])), (5, "a b c"), (6, None), (7, " ".join(two)), (8, " ".join([*two, "end"]))]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter(r.doc_id for r in got.collect()) == brute_near(rows)[0] == Counter([1, 3, 5, 6, 7])
    (prints, links), = asked
    sets = {frozenset(shingle_set(t or "")) for _, t in rows}
    want = Counter(sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(b" ".join(s), 42) >> b & 1 for s in x) > len(x)) for x in sets)
    assert Counter(r.fp % (1 << 64) for r in prints.collect()) == want and links.count() == 2
