"""Exact dedup: a Golomb-coded exchange of fingerprints, then byte comparison of the suspects."""

from __future__ import annotations

import hashlib
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, packed, staged, texts

#: Fingerprints that an owner of a range should get.
OWNED = 1 << 20
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def golomb_encode(gaps: np.ndarray) -> tuple[int, bytes, bytes]:
    """Gaps (uint64) in Golomb-Rice code: the parameter, the quotients in unary, the remainders in so many bits each."""
    k = max(0, int(log2(max(1.0, float(gaps.astype(np.float64).mean())))) - 1) if len(gaps) else 0
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]) if len(gaps) else 0, np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def golomb_decode(k: int, n: int, unary: bytes, rest: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[:n * k].reshape(n, k).astype(np.uint64)
    return (quotients.astype(np.uint64) << np.uint64(k)) + (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _fingerprints(data: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in data), np.uint64, len(data))


def _by_owner(hashes: np.ndarray, bits: int):
    """Sorted distinct hashes, cut where the owner (the upper bits) changes."""
    distinct = np.unique(hashes)
    owners = (distinct >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(owners, prepend=-1))
    return [(int(owners[a]), distinct[a:b]) for a, b in zip(at, [*at[1:], len(distinct)], strict=True)]


def exact_dedup(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, ...) -> (rows, decisions).

    rows: docs as packed, with (block, row). decisions, one for each of them: doc_id, keep_id, group_size, kept, text_sha256, block, row.
    Texts are equal when their UTF-8 bytes without ASCII white space are; null counts as empty. Of a group the row with the most
    code points stays, then the smallest doc_id (null last), then the first of repeated rows: exactly one row.

    Every block sends its sorted distinct 64-bit fingerprints to the owners of their ranges, as Golomb-Rice coded gaps;
    an owner answers each block with a bitmap of those that another block has sent too. Only rows so marked, or repeated
    within their block, are suspects. Suspects are grouped by their digest and their whole bytes; equal texts
    of a task become one row before the shuffle, so a group of any size sends one row a task.
    """
    rows = blocks(packed(docs), "exact_rows")
    bits = max(2, (rows.count() // OWNED).bit_length())

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        norm = [x.translate(None, SPACE_BYTES) for x in texts(table.column("text"))]
        out = []
        for owner, own in _by_owner(_fingerprints(norm), bits):
            k, unary, rest = golomb_encode(np.diff(own, prepend=np.uint64(owner << (64 - bits))))
            out.append((owner, block, len(own), k, unary, rest))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                        names=["owner", "block", "n", "k", "unary", "rest"])

    sent = rows.select("block", "text").groupBy("block").applyInArrow(send, "owner long, block long, n long, k int, unary binary, rest binary")

    def answer(table: pa.Table) -> pa.Table:
        parts = [(r["block"], np.cumsum(golomb_decode(r["k"], r["n"], r["unary"], r["rest"]), dtype=np.uint64)) for r in table.to_pylist()]
        owner = table.column("owner")[0].as_py()
        every = np.sort(np.concatenate([p for _, p in parts]))
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        out = [(b, owner, np.packbits(hit).tobytes()) for b, p in parts if (hit := np.isin(p, shared)).any()]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["block", "owner", "bitmap"])

    answers = sent.groupBy("owner").applyInArrow(answer, "block long, owner long, bitmap binary")

    def tag(table: pa.Table, replies: pa.Table) -> pa.Table:
        norm = [x.translate(None, SPACE_BYTES) for x in texts(table.column("text"))]
        hashes = _fingerprints(norm)
        bitmaps = dict(zip(replies.column("owner").to_pylist(), replies.column("bitmap").to_pylist(), strict=True))
        shared = [own[np.unpackbits(np.frombuffer(bitmaps[o], np.uint8))[:len(own)] == 1] for o, own in _by_owner(hashes, bits) if o in bitmaps]
        distinct, times = np.unique(hashes, return_counts=True)
        suspects = np.isin(hashes, np.concatenate([*shared, distinct[times > 1]]))
        return pa.table({
            "doc_id": table.column("doc_id"), "block": table.column("block"), "row": table.column("row"),
            "n_cp": pc.fill_null(pc.utf8_length(table.column("text")), 0).cast(pa.int64()),
            "text_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in norm]),
            "norm": pa.array([x if s else None for x, s in zip(norm, suspects.tolist(), strict=True)], pa.binary())})

    tagged = rows.select("block", "row", "doc_id", "text").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        tag, "doc_id long, block long, row int, n_cp long, text_sha256 string, norm binary")
    tagged = staged(tagged, "exact_tagged")

    single = tagged.where(F.col("norm").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "block", "row")
    suspects = tagged.where(F.col("norm").isNotNull())
    best = F.min(F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "block", "row")).alias("best")
    groups = suspects.groupBy("text_sha256", "norm").agg(F.count("*").alias("group_size"), best).drop("norm")
    grouped = suspects.drop("norm").join(groups, "text_sha256").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        ((F.col("block") == F.col("best.block")) & (F.col("row") == F.col("best.row"))).alias("kept"), "text_sha256", "block", "row")
    return rows, single.unionByName(grouped)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n_cp, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
