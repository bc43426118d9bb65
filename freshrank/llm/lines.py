"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, staged, texts

#: Lines that the rolling hash spans; one place in so many is a boundary whatever its neighbours are.
REACH, MEAN = 2, 2.0
#: Lines on each side of a boundary that are compared one by one. Of two neighbouring places one is a boundary, so that a repeated run never begins further from one.
SIDE = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def boundaries(lines: list[bytes], reach: int = REACH, mean: float = MEAN) -> np.ndarray:
    """The first lines of the windows of `reach` lines that are boundaries, ascending.

    A window is a boundary if its rolling hash over the hashes of its lines is among the least 1 / mean of all values, or not above that of the window
    before or not above that of the one after: only its own lines and the two beside it decide, so boundaries move with their lines. Fewer lines: none.
    """
    n = len(lines) - reach + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))
    x, power = np.zeros(n, np.uint64), 1
    for back in range(reach):
        x += h[reach - 1 - back:len(h) - back] * np.uint64(power)
        power = power * int(_MIX) % (1 << 64)
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * _MIX
    above = np.zeros(n, np.int64)
    above[1:] += x[1:] > x[:-1]
    above[:-1] += x[:-1] > x[1:]
    return np.flatnonzero((above < 2) | (x >> np.uint64(33) < np.uint64(int((1 << 31) / mean))))


def line_dedup(docs: DataFrame, reach: int = REACH, mean: float = MEAN) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_lines, n_removed (lines), n_chunks (removed, they may overlap), kept_text_sha256.

    Lines end at LF. A chunk is a boundary window (see boundaries), `reach` lines, with the lines beside it, SIDE on each side at most, that equal those beside
    the first of its kind: the first by doc_id (null last), then by place. All chunks but the first go; they are taken from the input, not from what is
    left. A repeated run of three lines or more always has a boundary in common, and goes as a whole if its chunks have their first in one place; of those of
    two lines in the midst of longer texts about 61 % have one. A line goes only where it and one beside it stand earlier too, and stays
    where it comes first. Null text: one empty line, as an empty text. Boundaries meet by a 128-bit hash; before
    anything goes, the bytes of all windows of one hash are grouped, equal ones of a task first, and a hash with two contents
    removes nothing; the lines beside them are compared as bytes too. Rows with equal doc_id are documents of their own. A long text lies in a block of its
    own and is cut as any other. An empty table gives no rows; other columns are not read.
    """
    rows = blocks(docs.select("doc_id", "text"), "lines_rows")
    schema = "block long, row int, doc_id long, line int, h1 long, h2 long"
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def scan(batches):
        for batch in batches:
            out = []
            for block, row, doc_id, x in zip(*(batch.column(c).to_pylist() for c in ("block", "row", "doc_id")), texts(batch.column("text")), strict=True):
                lines = x.split(b"\n")
                for at in boundaries(lines, reach, mean).tolist():
                    out.append((block, row, doc_id, at, *np.frombuffer(xxhash.xxh3_128_digest(b"\n".join(lines[at:at + reach])), "<i8").tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(arrow)], names=names)

    found = staged(rows.mapInArrow(scan, schema), "lines_chunks")
    again = staged(found.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "lines_again")  # apart, so that a skewed join can split a hot chunk
    hits = found.join(again, ["h1", "h2"])

    def fetch(table: pa.Table, wanted: pa.Table) -> pa.Table:
        data = dict(zip(table.column("row").to_pylist(), texts(table.column("text")), strict=True)) if len(wanted) else {}
        lines: dict[int, list[bytes]] = {}
        bodies, before, after = [], [], []
        for r, at in zip(wanted.column("row").to_pylist(), wanted.column("line").to_pylist(), strict=True):
            if r not in lines:
                lines[r] = data[r].split(b"\n")
            bodies.append(b"\n".join(lines[r][at:at + reach]))
            before.append(lines[r][max(0, at - SIDE):at][::-1])
            after.append(lines[r][at + reach:at + reach + SIDE])
        some = pa.list_(pa.binary())
        return wanted.select(names).append_column("body", pa.array(bodies, pa.binary())).append_column("before", pa.array(before, some)).append_column("after", pa.array(after, some))

    sides = "before array<binary>, after array<binary>"
    bodies = staged(rows.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(fetch, f"{schema}, body binary, {sides}"), "lines_bodies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "block", "row", "line", "before", "after")).alias("first")
    same = bodies.groupBy("h1", "h2", "body").agg(F.count("*").alias("times"), first).drop("body")
    kept = same.groupBy("h1", "h2").agg(F.count("*").alias("contents"), F.min("first").alias("first")).where("contents = 1").select("h1", "h2", "first")

    def equal(side: str):
        """How many lines beside the window, from it on, equal those beside the first."""
        count = F.lit(0)
        for i in reversed(range(SIDE)):
            count = F.when(F.get(side, F.lit(i)) == F.get(f"first.{side}", F.lit(i)), count + 1).otherwise(0)
        return count

    others = bodies.drop("body").join(staged(kept, "lines_kept"), ["h1", "h2"]).where(
        (F.col("block") != F.col("first.block")) | (F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
    gone = others.select("block", "row", (F.col("line") - equal("before")).alias("line"), (reach + equal("before") + equal("after")).alias("n"))

    def remove(table: pa.Table, covers: pa.Table) -> pa.Table:
        cut: dict[int, list] = {}
        for r, at, n in zip(*(covers.column(c).to_pylist() for c in ("row", "line", "n")), strict=True):
            cut.setdefault(r, []).append((at, n))
        out = []
        for doc_id, r, x in zip(table.column("doc_id").to_pylist(), table.column("row").to_pylist(), texts(table.column("text")), strict=True):
            lines = x.split(b"\n")
            dead = np.zeros(len(lines), bool)
            for at, n in cut.get(r, ()):
                dead[at:at + n] = True
            kept_ = b"\n".join(y for y, d in zip(lines, dead.tolist(), strict=True) if not d)
            out.append((doc_id, len(lines), int(dead.sum()), len(cut.get(r, ())), hashlib.sha256(kept_).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["doc_id", "n_lines", "n_removed", "n_chunks", "kept_text_sha256"])

    return rows.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(remove, "doc_id long, n_lines long, n_removed long, n_chunks long, kept_text_sha256 string")
