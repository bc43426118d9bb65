"""SimHash near-dedup: a Gray-order hierarchical index over 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged, texts

LEAF, FAN = 16, 8
#: Fingerprints that one group should hold, and beyond which a group is dealt out in pairs of parts.
GROUP, MOST = 4096, 16384


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of the lower-cased (A-Z) words, repeats included; of fewer words, of all as one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - width + 1)
    h = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[width - 1:].tolist() if len(words) >= width else [len(line)], strict=True)
    return np.array([h(line[a:b], 42) for a, b in spans], "<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes. No hashes: 0."""
    last = len(hashes)
    votes = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        part = hashes[at:at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > last, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 4) -> int:
    """The majority of the shingles' hashes."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fp (long, the bits as they are). Null text: as an empty one."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, width) for x in texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in Gray order: neighbours in it differ in one bit where all values are there."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels with the classes of each a and b made one; labels are least members."""
    while True:
        la, lb = labels[a], labels[b]
        if (open_ := la != lb).sum() == 0:
            return labels
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _ones(x: np.ndarray) -> np.ndarray:
    count = np.bitwise_count(x)
    return count if count.ndim == 1 else count.sum(axis=1, dtype=np.int64)


def linked(fps: np.ndarray, most: int = 4, budget: int = 1 << 21, found: list | None = None) -> np.ndarray:
    """Distinct fingerprints (uint64, or a row of them each) -> for each the least index of its class; classes link fingerprints that differ in at most `most` bits.

    Sorted by Gray rank, runs of LEAF fingerprints are leaves and runs of FAN nodes upper nodes. A node holds the
    bits that all below it share and their pattern. Pairs of nodes go from the root down; a pair whose shared bits differ too often
    already is dropped with all below it, one whose members can't differ more is joined as a whole, and one
    whose members are all in one class needs no look. budget bounds the pairs that are held at once.
    found: gets arrays of pairs (indices of fps) that differ in at most `most` bits and were in two classes, enough to join each class.
    """
    n = len(fps)
    order = np.argsort(gray_rank(fps), kind="stable") if fps.ndim == 1 else np.lexsort(gray_rank(fps).T[::-1])
    budget //= fps.size // n if n else 1
    v = fps[order]
    labels = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if found is not None and len(a):
            la, lb = labels[a], labels[b]
            _, one = np.unique(np.minimum(la, lb) * n + np.maximum(la, lb), return_index=True)  # of two classes one pair
            one = one[la[one] != lb[one]]
            found.append(np.stack([order[a[one]], order[b[one]]], axis=1))
        return _union(labels, a, b)

    near = np.flatnonzero(_ones(v[1:] ^ v[:-1]) <= most)
    labels = join(near, near + 1)
    levels = []  # from the leaves up: start of each node's members, shared bits, their pattern
    starts = np.arange(0, n, LEAF)
    ands, ors = np.bitwise_and.reduceat(v, starts, axis=0), np.bitwise_or.reduceat(v, starts, axis=0)
    while True:
        levels.append((starts, ands | ~ors, ands))
        if len(starts) == 1:
            break
        at = np.arange(0, len(starts), FAN)
        starts, ands, ors = starts[at], np.bitwise_and.reduceat(ands, at, axis=0), np.bitwise_or.reduceat(ors, at, axis=0)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > budget // (LEAF * LEAF):
            half = len(a) // 2
            stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        starts, mask, bits = levels[level]
        ends = np.append(starts[1:], n)
        both = mask[a] & mask[b]
        apart = _ones((bits[a] ^ bits[b]) & both)
        keep = apart <= most
        sure = keep & (apart + _ones(~both) <= most)
        if sure.any():
            labels = join(starts[a[sure]], starts[b[sure]])
            for x in np.unique(np.concatenate([a[sure], b[sure]])).tolist():  # their own members are as near
                labels = join(np.full(ends[x] - starts[x], starts[x]), np.arange(starts[x], ends[x]))
        low, high = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        one = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        a, b = a[keep & ~sure & ~one], b[keep & ~sure & ~one]
        if not len(a):
            continue
        if level:
            ca, cb = (a[:, None] * FAN + np.arange(FAN)), (b[:, None] * FAN + np.arange(FAN))
            x, y = np.repeat(ca, FAN, axis=1).ravel(), np.tile(cb, (1, FAN)).ravel()
            ok = (x <= y) & (y < len(levels[level - 1][0]))
            stack.append((level - 1, x[ok], y[ok]))
        else:
            ia, ib = starts[a][:, None] + np.arange(LEAF), starts[b][:, None] + np.arange(LEAF)
            x, y = np.repeat(ia, LEAF, axis=1).ravel(), np.tile(ib, (1, LEAF)).ravel()
            ok = (x < y) & (y < n)
            x, y = x[ok], y[ok]
            ok = _ones(v[x] ^ v[y]) <= most
            labels = join(x[ok], y[ok])
    out = np.empty(n, np.int64)
    least = np.full(n, n)
    np.minimum.at(least, labels, order)
    out[order] = least[labels]
    return out


def _cuts(count: int, most: int) -> tuple[int, int]:
    """Into how many blocks to cut 64 bits and how many bits of a key to use, so that a key has about GROUP of count fingerprints."""
    want = max(1, int(np.ceil(np.log2(max(2, count / GROUP)))))
    for m in range(most + 1, most + 5):
        have = 64 // m * (m - most)
        if have >= want:
            return m, want
    return m, have


def _dealt(keyed: DataFrame, most: int) -> DataFrame:
    """keyed (fp, choice, key) -> the same with p: groups of one key over `most` rows are dealt out as pairs of parts."""
    counts = keyed.groupBy("choice", "key").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    keyed = keyed.join(counts, ["choice", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, own).alias("a"), F.greatest(i, own).alias("b")))
    return keyed.select("fp", "choice", "key", F.explode(pairs).alias("p"))


def near_links(fps: DataFrame, count: int, most: int = 4, direct: bool = False) -> DataFrame:
    """fps (fp, distinct) -> (src, dst), enough links between fingerprints of at most `most` differing bits to join all that any such links join.

    Of m blocks of bits, m - most are equal in any two such fingerprints; each choice of that many blocks is a key, cut to
    the bits that count needs. Groups of one key over MOST rows are dealt out as pairs of parts, so none meets in one task whole.
    direct: the links are pairs that differ so little themselves; else each of a group is linked to the first of its class.
    """
    m, used = _cuts(count, most)
    size = 64 // m
    keys = []
    for i, some in enumerate(combinations(range(m), m - most)):
        key = F.lit(0).cast("long")
        for block in some:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", block * size).bitwiseAND(F.lit((1 << size) - 1)), size * some.index(block)))
        # the upper bits of the key, or all of the first block's and some of the next's
        key = key.bitwiseAND(F.lit((1 << used) - 1))
        keys.append(F.struct(F.lit(i).alias("choice"), key.alias("key")))
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.choice", "k.key")
    dealt = _dealt(dealt, MOST)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy()
        if direct:
            linked(fp.view(np.uint64), most, found=(found := [np.zeros((0, 2), np.int64)]))
            a, b = fp[np.concatenate(found)].T
            return pd.DataFrame({"src": np.maximum(a, b), "dst": np.minimum(a, b)})
        root = linked(fp.view(np.uint64), most)
        far = root != np.arange(len(fp))
        return pd.DataFrame({"src": fp[far], "dst": fp[root[far]]})

    return dealt.groupBy("choice", "key", "p").applyInPandas(solve, "src long, dst long").distinct()


def near_dedup(docs: DataFrame, most: int = 4, width: int = 4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach, itself included).

    Equal fingerprints are made one before they are linked, so groups of copies cost one row. Null and empty texts have fingerprint
    zero and link like any other. Rows with one doc_id are judged one by one. No rows: no rows; other columns, of whatever names, are not read.
    """
    base = staged(fingerprints(docs, width), "simhash_fps")
    distinct = staged(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash_distinct")
    roots = components(near_links(distinct.select("fp"), distinct.count(), most), "simhash_rounds")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return base.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def linked_ids(prints: DataFrame, most: int = 4) -> DataFrame:
    """prints (id, fp) -> (src, dst), src > dst: pairs of ids whose fingerprints differ in at most `most` bits, enough to join all that any such pairs join.

    Of equal fingerprints the ids are linked to the least of them, which stands for the fingerprint in the index.
    """
    base = staged(prints, "simhash_ids")
    distinct = staged(base.groupBy("fp").agg(F.min("id").alias("least")), "simhash_leaders")
    equal = base.join(distinct, "fp").where("id > least").select(F.col("id").alias("src"), F.col("least").alias("dst"))
    links = near_links(distinct.select("fp"), distinct.count(), most, direct=True)
    x, y = (distinct.select(F.col("fp").alias(c), F.col("least").alias(i)) for c, i in (("src", "x"), ("dst", "y")))
    links = links.join(x, "src").join(y, "dst").select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst"))
    return equal.unionByName(links)
