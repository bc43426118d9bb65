"""Packing token sequences into windows: bounded-space online best fit."""

from __future__ import annotations

import os
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Partitions whose leftovers meet in one group: at most so many times most_open windows.
MERGED = 64
#: Of words of these characters alone the parts that the tokenizer takes apart are known: letters, single digits, marks, and endings after an apostrophe.
LETTERS, SIGNS = "a-zß-öø-ÿ", r"!-/:-@\[-`{-~"
PLAIN = re.compile(f"[{LETTERS}0-9{SIGNS}]+")
PARTS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[0-9]|[{SIGNS}]+")
SPECIAL = b"<|"
#: The characters that stand for bytes in the model: themselves where they can be seen, others from 256 on in turn.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
STANDS = dict(zip([b for b in range(256) if b not in _SEEN], range(256, 512), strict=False))


class _Numbers(dict):
    """Words to numbers in the order in which they come; fresh: those not encoded yet."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Encoder:
    """Texts to ids, by way of words: white space always ends a token, so the ids of a text are those of its words in turn.

    Each distinct word is encoded once, and so is each distinct part of plain words; a word's ids lie in one array, from starts[n] on, sizes[n] of
    them, for the n-th word. Other words go to the tokenizer as a whole. most: words that are kept before all begins anew.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole, self.most = Tokenizer.from_file(path), most
        self.tokenize = self.whole.model.tokenize
        self._new()

    def _new(self) -> None:
        self.known, self.parts = _Numbers(), {}
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _keep(self, first: int, ids: list[int], sizes: list[int]) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used:self.used + len(ids)] = ids
        self.sizes[first:first + len(sizes)] = sizes
        self.starts[first:first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _learn(self, words: list[bytes]) -> None:
        """New words, in the order of their numbers."""
        ids, sizes, odd, parts, tokenize = [], [], [], self.parts, self.tokenize
        for w in words:
            before = len(ids)
            text = w.decode("utf-8", "replace")
            if w.isalpha() and w.islower():  # ASCII letters
                ids += [t.id for t in tokenize(text)]
            elif SPECIAL in w or not PLAIN.fullmatch(text):
                odd.append((len(sizes), text))
            elif text.isalpha():
                ids += [t.id for t in tokenize(w.decode("latin-1").translate(STANDS))]
            else:
                for part in PARTS.findall(text):
                    if (own := parts.get(part)) is None:
                        stands = part if part.isascii() else part.encode().decode("latin-1").translate(STANDS)
                        own = parts[part] = [t.id for t in tokenize(stands)]
                    ids += own
            sizes.append(len(ids) - before)
        first = len(self.known) - len(words)
        self._keep(first, ids, sizes)
        if odd:  # their ids stand after those of the others
            got = self.whole.encode_batch_fast([text for _, text in odd], add_special_tokens=False)
            for (i, _), own in zip(odd, got, strict=True):
                self._keep(first + i, own.ids, [len(own.ids)])

    def ids(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has. A-Z are lower-cased first, as the tokenizer would, but where a special token may stand."""
        if len(self.known) > self.most:
            self._new()
        get = self.known.__getitem__
        numbers = [np.zeros(0, np.int64)]
        for x in data:
            words = (x if SPECIAL in x else x.lower()).split()
            numbers.append(np.fromiter(map(get, words), np.int64, len(words)))
        of = np.concatenate(numbers)
        if self.known.fresh:
            self._learn(self.known.fresh)
            self.known.fresh = []
        sizes = self.sizes[of]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[of] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
        cuts = np.cumsum([*map(len, numbers)])
        return self.pool[at], np.diff(np.concatenate([[0], ends])[cuts])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Windows that are open in one partition, and the pieces that have left them.

    A piece goes to the open window where the least room stays. Where none has room and no more may be opened, the fullest
    leaves, filled up with the head of the piece, so it needs no padding; nor do the leftovers, which are merged at the end.
    """

    def __init__(self, window: int, most_open: int, first_id: int):
        self.window, self.most_open, self.next_id = window, most_open, first_id
        self.open: list[list] = []  # [room, pieces]
        self.out: list[tuple] = []

    def _leave(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids) // 4, crc32(ids), total, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id, view: memoryview) -> None:
        total, start = len(view) // 4, 0
        while total - start >= self.window:
            self._leave([(doc_id, start, view[4 * start:4 * (start + self.window)], total)])
            start += self.window
        while start < total:
            left = total - start
            best = min((w for w in self.open if w[0] >= left), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.most_open:
                self.open.append(best := [self.window, []])
            best = best or min(self.open, key=lambda w: w[0])
            n = min(left, best[0])
            best[1].append((doc_id, start, bytes(view[4 * start:4 * (start + n)]), total))
            best[0] -= n
            start += n
            if not best[0]:
                self.open.remove(best)
                self._leave(best[1])

    def leftovers(self) -> list[tuple]:
        """The pieces of the windows that are still open, the fullest first; none is open then."""
        rest = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open = []
        return rest

    def merge(self, rest: list[tuple]) -> None:
        """Pieces in one row, cut into full windows and, for what is left, powers of two."""
        rest = rest[::-1]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            n = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            left -= n
            pieces = []
            while n:
                doc_id, start, ids, total = rest.pop()
                if len(ids) > 4 * n:
                    rest.append((doc_id, start + n, ids[4 * n:], total))
                    ids = ids[:4 * n]
                pieces.append((doc_id, start, ids, total))
                n -= len(ids) // 4
            self._leave(pieces)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, most_open: int = 16, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each partition packs what it reads, in one pass and without a shuffle; it holds most_open windows and a batch of rows. Its
    leftovers, at most most_open windows, meet those of MERGED - 1 other partitions and are merged there, so stubs come once in MERGED partitions.
    A document's ids end with end_id; a null or empty text has only that. Texts of any length are cut at windows. Rows with
    equal doc_id are documents of their own; other columns play no part. No documents: no rows. Repeating a task gives the same rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([*((n, pa.int64()) for n in names), ("ids", pa.binary())])

    def table(packer: Packer, rest: list[tuple]) -> list[pa.RecordBatch]:
        """What has left its window, and pieces that have not, with their ids."""
        rows = [*((*p, None) for p in packer.out), *((d, start, len(ids) // 4, None, total, None, None, ids) for d, start, ids, total in rest)]
        packer.out = []
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)] if rows else []

    def run(batches):
        made = encoder(tokenizer_path)
        packer = Packer(window, most_open, TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(doc_ids), 512):
                ids, sizes = made.ids(texts(batch.column("text").slice(at, 512)))
                ends = np.cumsum(sizes)
                ids = memoryview(np.insert(ids, ends, end_id).astype("<u4").tobytes())
                ends += np.arange(1, len(ends) + 1)
                for doc_id, a, b in zip(doc_ids[at:at + 512], [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    packer.add(doc_id, ids[4 * a:4 * b])
            yield from table(packer, [])
        yield from table(packer, packer.leftovers())

    def merge(key: tuple, some: pa.Table) -> pa.Table:
        packer = Packer(window, most_open, (1 << 62) + (key[0].as_py() << 20))
        some = some.sort_by([("part", "ascending"), ("nth", "ascending")])
        packer.merge(list(zip(*(some.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)))
        return pa.Table.from_batches(table(packer, []), schema=schema).select(names)

    # a task's rows come with its number and theirs, which a table keeps
    out = docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids binary")
    out = staged(out.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "pack_pieces")
    rest = out.where(F.col("ids").isNotNull()).withColumn("merged", F.floor(F.col("part") / MERGED))
    return out.where(F.col("ids").isNull()).select(names).unionByName(rest.groupBy("merged").applyInArrow(merge, SCHEMA))
