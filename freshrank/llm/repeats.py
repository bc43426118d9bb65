"""Repeated passages by a depth-limited radix sort of suffixes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, joined_all, staged, texts

#: Bytes of the first digit, and bytes that are hashed at once.
DIGIT, CHUNK = 100, 1 << 20
#: A run of windows: its document, first window, windows, the anchor's place in the first and its value; what classes are told by.
SPAN = "block long, row int, start long, n int, place int, anchor long, core long, h1 long, h2 long"
_ALL = (1 << 64) - 1
_PLACE = np.uint64((1 << 24) - 1)
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def digits(data: np.ndarray, size: int = DIGIT) -> np.ndarray:
    """A 64-bit value of the `size` bytes from each place on; equal bytes have equal values."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(n + 1)
    s = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[:n])])
    g = (s[size:] - s[:-size]) * down[:n - size + 1]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return g


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    pad = -len(x) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    head = np.minimum.accumulate(y, axis=1).ravel()
    tail = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:len(x) - w + 1], head[w - 1:len(x)])


def runs(data: list[bytes], window: int) -> tuple:
    """Runs of windows with one anchor: document, first start, windows, the anchor's digit, a digest of the run's bytes, the anchor's place in the first.

    A window's anchor is the digit inside it of the least value (of equal ones the last), so equal windows have equal
    anchors at equal places. Texts are hashed CHUNK bytes at a time; longer ones in parts that overlap by a window less one.
    """
    pieces = []  # document, first byte, bytes
    for i, x in enumerate(data):
        pieces += [(i, at, x[at:at + CHUNK + window - 1]) for at in range(0, max(0, len(x) - window + 1), CHUNK)]
    out, group, held = [], [], 0
    for p in [*pieces, None]:
        if group and (p is None or held + len(p[2]) > CHUNK):
            out.append(_runs_of(group, window))
            group, held = [], 0
        if p:
            group.append(p)
            held += len(p[2])
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)
    return tuple(np.concatenate([np.asarray(o[c], k) for o in out]) if out else np.zeros((0, 2) if c == 4 else 0, k) for c, k in enumerate(kinds))


def _runs_of(group: list[tuple], window: int) -> tuple:
    raw = b"".join(p[2] for p in group)
    buf = np.frombuffer(raw, np.uint8)
    lengths = np.array([len(p[2]) for p in group])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    g = digits(buf)
    least = _sliding_min((g & ~_PLACE) | (_PLACE - np.arange(len(g), dtype=np.uint64)), window - DIGIT + 1)
    anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
    fine = np.zeros(len(anchor), bool)
    for b, n in zip(begins.tolist(), lengths.tolist(), strict=True):
        fine[b:b + n - window + 1] = True
    at = np.flatnonzero(fine)
    first = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    start = at[first]
    count = np.diff(np.append(np.flatnonzero(first), len(at)))
    of = np.searchsorted(begins, start, "right") - 1
    h, place = xxhash.xxh3_128_digest, anchor[start] - start
    spans = b"".join([h(raw[a:a + n], p) for a, n, p in zip(start.tolist(), (count + window - 1).tolist(), place.tolist(), strict=True)])
    doc, skip = np.array([p[0] for p in group]), np.array([p[1] for p in group])
    return doc[of], start - begins[of] + skip[of], count, g[anchor[start]], np.frombuffer(spans, "<u8").reshape(-1, 2), place


def classes(x: bytes, start: int, n: int, place: int, anchor: int, window: int, size: int):
    """The n windows from start on, whose anchor lies `place` bytes into the first, in classes of `size` windows by the anchor's place.

    Of each class: its first window, windows, the anchor's place in the first, a value of the bytes that all windows with such places share,
    and a digest of all bytes of its own windows.
    """
    at, least = start + place, place - n + 1
    for c in range(least // size, place // size + 1):
        far, near = min((c + 1) * size - 1, place), max(c * size, least)
        shared = xxhash.xxh3_64_intdigest(x[at - c * size:at - (c + 1) * size + 1 + window], c)
        yield at - far, far - near + 1, far, (shared ^ anchor) & _ALL, xxhash.xxh3_128_digest(x[at - far:at - near + window], far)


def _stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def _passed(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """One pass over rows (SPAN): (settled, deeper).

    Rows whose core no other row has are done. settled: rows with the same digest as another row of their core, all of whose
    windows are repeated. deeper: of each core with more than one digest, one row for each digest. Both sides of each join are tables or
    fresh shuffles, so that Spark can split the rows of a frequent core.
    """
    cores = rows.groupBy("core").agg(F.count("*").alias("times"), F.min("h1").alias("a"), F.max("h1").alias("z"), F.min("h2").alias("b"), F.max("h2").alias("y"))
    cores = staged(cores.where("times > 1").select("core", F.expr("a != z or b != y").alias("mixed")), f"{name}_cores")
    hits = staged(rows.join(cores, "core"), f"{name}_hits")
    kinds = hits.where("mixed").groupBy("core", "h1", "h2").agg(F.count("*").alias("times"), F.min(F.struct("block", "row", "start", "n", "place", "anchor")).alias("r"))
    kinds = staged(kinds.select("core", "h1", "h2", "times", "r.*"), f"{name}_kinds")
    often = kinds.where("times > 1").select("core", "h1", "h2")
    settled = hits.where("not mixed").drop("mixed").unionByName(hits.where("mixed").drop("mixed").join(often, ["core", "h1", "h2"], "left_semi"))
    return settled, kinds


def strip_repeats(docs: DataFrame, window: int = 400, sizes: tuple = (100, 10, 1)) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removes every byte that is covered by a window-byte string which starts anywhere else too, the same document included;
    overlapping ones count. Texts are UTF-8 bytes, null is empty; texts shorter than a window lose nothing. Repeated rows repeat
    each other. An empty table gives no rows; other columns, of whatever names, are not read. window is at least twice DIGIT bytes. sizes: windows of a class in the passes after the first; the last is 1.

    Suffixes are sorted from their most significant digit on, to the window's length. That digit is the window's anchor (see runs). The suffixes
    of one anchor are one row at first; each pass then takes more of their bytes into account and smaller classes of them:
    all with one anchor; up to 100, 10 and 1 with neighbouring places of the anchor, with all the bytes that these share. A class that comes once is
    done. Classes with equal bytes are settled, all their suffixes being repeated. What remains, once for each content,
    goes on to the next pass, the last of which looks at single suffixes and all their bytes. No pass gathers a class in a task: rows
    are counted map-side and joined with the counts. Documents lie in blocks that never move.

    Equal bytes: the same anchor value (64 bits) or shared bytes' value, and the same 128-bit digest, length and place.
    """
    assert window >= 2 * DIGIT and sizes[-1] == 1
    rows = blocks(docs.select("doc_id", "text"), "repeats_rows")
    names = [x.split()[0] for x in SPAN.split(", ")]
    schema = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("start", pa.int64()), ("n", pa.int32()), ("place", pa.int32()),
                        ("anchor", pa.int64()), ("core", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])

    def signed(x: np.ndarray) -> pa.Array:
        return pa.array(x.view(np.int64))

    def scan(batches):
        for batch in batches:
            block, row = batch.column("block"), batch.column("row")
            data = texts(batch.column("text"))
            for at in range(0, len(data), 512):
                of, start, n, anchor, content, place = runs(data[at:at + 512], window)
                of = pa.array(of + at)
                yield pa.RecordBatch.from_arrays(
                    [block.take(of), row.take(of), pa.array(start), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)),
                     signed(anchor), signed(anchor), signed(content[:, 0].copy()), signed(content[:, 1].copy())], schema=schema)

    def finer(size: int):
        def split(table: pa.Table, wanted: pa.Table) -> pa.Table:
            if not len(wanted):
                return schema.empty_table()
            data = dict(zip(table.column("row").to_pylist(), texts(table.column("text")), strict=True))
            out = []
            for r, start, n, place, anchor in zip(*(wanted.column(c).to_pylist() for c in ("row", "start", "n", "place", "anchor")), strict=True):
                out += [(r, anchor, *c) for c in classes(data[r], start, n, place, anchor, window, size)]
            r, anchor, start, n, place, core, digest = zip(*out, strict=True)
            digest = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            columns = [np.full(len(r), table.column("block")[0].as_py()), r, start, n, place, anchor, np.array(core, np.uint64).view(np.int64), digest[:, 0].copy(), digest[:, 1].copy()]
            return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        return split

    settled, deeper = _passed(staged(rows.select("block", "row", "text").mapInArrow(scan, SPAN), "repeats_runs"), "repeats")
    cols = ["block", "row", "start", "n"]
    covers = [settled.select(cols)]
    for size in sizes:
        asked = deeper.select("block", "row", "start", "n", "place", "anchor").groupBy("block")
        found = rows.select("block", "row", "text").groupBy("block").cogroup(asked).applyInArrow(finer(size), SPAN)
        settled, deeper = _passed(staged(found, f"repeats_{size}"), f"repeats_{size}")
        covers.append(settled.select(cols))
    cover = joined_all(covers)

    def remove(table: pa.Table, covers: pa.Table) -> pa.Table:
        order = np.argsort(covers.column("row").to_numpy(), kind="stable")
        row, start, n = (covers.column(c).to_numpy()[order] for c in ("row", "start", "n"))
        out = []
        for doc_id, r, x in zip(table.column("doc_id").to_pylist(), table.column("row").to_pylist(), texts(table.column("text")), strict=True):
            a, b = np.searchsorted(row, [r, r + 1])
            if a == b:
                out.append((doc_id, len(x), 0, 0, hashlib.sha256(x).hexdigest()))
                continue
            step = np.zeros(len(x) + 1, np.int64)
            np.add.at(step, start[a:b], 1)
            np.add.at(step, start[a:b] + n[a:b] + window - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
            out.append((doc_id, len(x), int(gone.sum()), len(_stretches(gone)[0]), hashlib.sha256(kept).hexdigest()))
        kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds_)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.groupBy("block").cogroup(cover.groupBy("block")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
