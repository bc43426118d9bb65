"""Language-model scores by a weighted backoff automaton."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, bucketed, staged, texts

#: Values of a text's end and of what stands before its first word.
END, BEGIN = np.uint64(0x51ED270B8A7C3F19), np.uint64(0xC2B2AE3D27D4EB4F)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: n-grams that an owner of a range should hold; tokens of a piece that is walked by itself.
OWNED, PIECE = 1 << 20, 512
#: What a context's count is weighed against, for contexts of one token and of two.
WEIGHTS = (1000.0, 5.0)


def is_training(doc_id, folds: int, held: int) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % folds != held


class _Vocabulary(dict):
    """Words to numbers in the order in which they come; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Block:
    """Texts as numbers of the block's own words: ids, each text with its end; begins, where each text begins; words, the words' 64-bit values."""

    def __init__(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray, words: np.ndarray):
        self.doc_ids, self.ids, self.words = doc_ids, ids.astype(np.int64), words
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.first = np.zeros(len(ids), bool)
        self.first[self.begins[:-1]] = True

    def train(self, folds: int, held: int) -> np.ndarray:
        return np.repeat(np.array([is_training(i, folds, held) for i in self.doc_ids], bool), np.diff(self.begins))

    def grams(self, order: int) -> list[np.ndarray]:
        """For each length up to order the value of the n-gram that ends at each token, with BEGIN before a text's first."""
        h = self.words[self.ids]
        out = [h]
        for _ in range(order - 1):
            before = np.roll(out[-1], 1)
            before[self.first] = BEGIN
            g = (before ^ (before >> np.uint64(31))) * _A + h * _B
            out.append(g ^ (g >> np.uint64(29)))
        return out


def encoded(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, ids and words of a block of texts."""
    known = _Vocabulary()
    parts = []
    for x in data:
        words = x.lower().split()
        words = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
        parts.append(np.append(words, np.uint32(0)))
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    return np.array([len(p) for p in parts], np.int64), np.concatenate([np.zeros(0, np.uint32), *parts]), np.append(END, values)


class Automaton:
    """A block's part of the model: states, arcs and failure arcs.

    A state is a context that training has seen: none (the root), one token, or two. A state's arc for a token that training has seen after it
    costs log10((c + k * p') / (c(context) + k)), where p' is what the context without its first token gives, and leads to the longest context that
    ends with that token. Its failure arc costs log10(k / (c(context) + k)) and leads to the context without its first token. The root has an arc for each token:
    log10((c + 0.5) / (N + 0.5 * (V + 1))), with c = 0 for those not seen. So the probabilities of a state sum to one.

    State 0 is the root, 1 + w the token w, 1 + len(words) what stands before a text; pairs follow. Arcs are sorted by (state, token).
    """

    def __init__(self, block: Block, counts: list[np.ndarray], n_all: int, types: int, weights: tuple = WEIGHTS):
        """counts: of each word, of the distinct pairs and of the distinct triples (both in the order of their values) in training."""
        ids, first, words = block.ids, block.first, len(block.words)
        self.words = words
        k2, k3 = weights
        _, values, triples = block.grams(3)
        _, at, self.pair = np.unique(values, return_index=True, return_inverse=True)  # a place of each distinct pair; the pair at each place
        c1, c2 = counts[0].astype(np.float64), counts[1].astype(np.float64)
        before, token = np.where(first[at], words, ids[at - 1]), ids[at]
        seen = np.append(c1, c1[0])  # as a context: each text has one beginning and one end
        seen[0] = 0
        p1 = (c1 + 0.5) / (n_all + 0.5 * (types + 1))
        p2 = (c2 + k2 * p1[token]) / (seen[before] + k2)
        p2 = np.where(seen[before] > 0, p2, p1[token])
        self.start = words + 1 if seen[words] > 0 else 0
        pairs = words + 2 + np.arange(len(at))
        single = np.where((seen[:words] > 0), 1 + np.arange(words), 0)
        longest = np.where((c2 > 0) & (token > 0), pairs, single[token])  # the state after a pair
        self.failure = np.concatenate([np.zeros(words + 2, np.int64), single[token]])
        with np.errstate(divide="ignore"):
            self.failing = np.log10(np.concatenate([[1.0], k2 / (seen + k2), k3 / (c2 + k3)]))
        self.root, self.after = np.log10(p1), single

        where = np.flatnonzero(~first)
        _, some = np.unique(triples[where], return_index=True)
        some = where[some]
        c3 = counts[2].astype(np.float64)
        context, token3, suffix = self.pair[some - 1], ids[some], self.pair[some]
        p3 = (c3 + k3 * p2[suffix]) / (c2[context] + k3)
        have2, have3 = c2 > 0, c3 > 0
        keys = np.concatenate([((1 + before) * words + token)[have2], ((words + 2 + context) * words + token3)[have3]])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.cost = np.log10(np.concatenate([p2[have2], p3[have3]]))[order]
        self.next = np.concatenate([longest[have2], longest[suffix][have3]])[order]

    def walk(self, block: Block) -> np.ndarray:
        """The log10 probability of each token: one traversal from left to right that carries the state.

        All texts go on in step, long ones in pieces of PIECE tokens; a piece begins with the two tokens before it, which tell
        its state; what it notes for them, the piece before writes anew, some steps later.
        """
        ids = block.ids
        begin, size = block.begins[:-1], np.diff(block.begins)
        pieces = np.maximum(1, -(-size // PIECE))
        text = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.minimum(begin[text] + (nth + 1) * PIECE, block.begins[1:][text])
        at = np.where(nth > 0, begin[text] + nth * PIECE - 2, begin[text])
        state = np.where(nth > 0, 0, self.start)
        out = np.zeros(len(ids))
        order = np.argsort(at - end, kind="stable")  # the longest first, so that those still on their way stand together
        at, end, state = at[order], end[order], state[order]
        left = end - at
        for step in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -step, "left"))
            token = ids[at[:n] + step]
            now, cost, to = state[:n].copy(), np.zeros(n), np.zeros(n, np.int64)
            going = np.flatnonzero(now)
            while len(going):
                key = now[going] * self.words + token[going]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(going), np.int64)
                hit = self.keys[arc] == key if len(self.keys) else np.zeros(len(going), bool)
                done, miss = going[hit], going[~hit]
                cost[done] += self.cost[arc[hit]]
                to[done] = self.next[arc[hit]]
                now[done] = -1
                cost[miss] += self.failing[now[miss]]
                now[miss] = self.failure[now[miss]]
                going = miss[now[miss] > 0]
            root = np.flatnonzero(now == 0)
            cost[root] += self.root[token[root]]
            to[root] = self.after[token[root]]
            out[at[:n] + step] = cost
            state[:n] = to
        return out


def lm_scores(docs: DataFrame, folds: int = 5, held: int = 1, weights: tuple = WEIGHTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32(doc_id as text) is not `held` modulo `folds` train the model (null doc_id: as an empty text). Null text: only its
    end. Rows with equal doc_id are texts of their own; no rows: no rows. Words are told apart by 64-bit hashes.

    Texts are read once and kept as blocks of word numbers. Each block sends its distinct words and pairs, sorted, with its training counts, to the owners of their ranges.
    An owner adds up and answers each block with the totals of what it has asked. Then the same for triples, but for those with a pair
    that training does not have or no other block holds. So a block gets just the states and arcs its own texts can reach, builds the automaton and walks it. No task or driver holds the model,
    and there are as many owners as the number of tokens asks for.
    """
    stored = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("ids", pa.binary()), ("words", pa.binary()), ("tokens", pa.int64())])

    def gather(batches):
        block = TaskContext.get().partitionId() << 32
        ids, data, size = [], [], 0

        def row():
            sizes, numbers, words = encoded(data)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (block, ids, sizes.tobytes(), numbers.tobytes(), words.tobytes(), len(numbers)), stored.types, strict=True)], schema=stored)

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                if data and size + len(x) > block_bytes:
                    yield row()
                    block, ids, data, size = block + 1, [], [], 0
                ids.append(doc_id)
                data.append(x)
                size += len(x) + 64
        if data:
            yield row()

    kept = bucketed(docs.select("doc_id", "text").mapInArrow(gather, "block long, doc_ids array<long>, sizes binary, ids binary, words binary, tokens long"), "block", "lm_blocks")
    most = kept.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = max(2, int(most // OWNED).bit_length())

    def opened(table: pa.Table) -> Block:
        get = lambda c, t: np.frombuffer(table.column(c)[0].as_py(), t)
        return Block(table.column("doc_ids")[0].as_py(), get("sizes", np.int64), get("ids", np.uint32), get("words", np.uint64))

    asks = "owner long, n int, block long, keys binary, counts binary"

    def dealt(block: int, n: int, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
        """Sorted keys and their counts, cut where the owner changes."""
        owners = (keys >> np.uint64(64 - bits)).astype(np.int64)
        at = np.flatnonzero(np.diff(owners, prepend=-1))
        return [(int(owners[a]), n, block, keys[a:b].tobytes(), counts[a:b].astype("<u4").tobytes()) for a, b in zip(at, [*at[1:], len(keys)], strict=len(keys) > 0)]

    def rows_of(out: list[tuple]) -> pa.Table:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["owner", "n", "block", "keys", "counts"])

    def counted(g: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, of = np.unique(g, return_inverse=True)
        return keys, np.bincount(of[train], minlength=len(keys))

    def ask(table: pa.Table) -> pa.Table:
        block = opened(table)
        train = block.train(folds, held)
        out = []
        for n, g in enumerate(block.grams(2)):
            out += dealt(table.column("block")[0].as_py(), n, *counted(g, train))
        return rows_of(out)

    def answer(table: pa.Table) -> pa.Table:
        owner, n = table.column("owner")[0].as_py(), table.column("n")[0].as_py()
        keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype("<u8")
        out, at = [(-1, owner, n, int(totals.sum()), int((totals > 0).sum()), b"", 8)], 0
        replies = 2 * totals + (np.bincount(inverse) > 1).astype("<u8")  # the lowest bit: other blocks hold it too
        kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if k == "<u8" or replies.max(initial=0) < 1 << 8 * int(k[2]))
        for block, own in zip(table.column("block").to_pylist(), keys, strict=True):
            out.append((block, owner, n, 0, 0, replies[inverse[at:at + len(own)]].astype(kind).tobytes(), int(kind[2])))
            at += len(own)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["block", "owner", "n", "tokens", "types", "totals", "width"])

    def told(replies: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The totals from all owners in a row, and so in the order of the keys; and which keys other blocks hold too."""
        got = sorted((r["owner"], np.frombuffer(r["totals"], f"<u{r['width']}")) for r in replies.select(["owner", "n", "totals", "width"]).to_pylist() if r["n"] == n)
        got = np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64) for _, x in got)])
        return got >> 1, got & 1 == 1

    def open_triples(block: Block, train: np.ndarray, pairs: np.ndarray, shared: np.ndarray):
        """Distinct triples, which of them must be asked for, and their counts in the block: those with an unseen pair or one that no other block holds are known."""
        _, two, three = block.grams(3)
        of = np.unique(two, return_inverse=True)[1]
        where = np.flatnonzero(~block.first)
        keys, at, inverse = np.unique(three[where], return_index=True, return_inverse=True)
        own = np.bincount(inverse[train[where]], minlength=len(keys))
        a, b = of[where[at] - 1], of[where[at]]
        return keys, shared[a] & shared[b] & (pairs[a] > 0) & (pairs[b] > 0), own

    def ask_more(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = opened(table)
        train = block.train(folds, held)
        keys, unknown, own = open_triples(block, train, *told(replies, 1))
        return rows_of(dealt(table.column("block")[0].as_py(), 2, keys[unknown], own[unknown]))

    shape = "block long, owner long, n int, tokens long, types long, totals binary, width int"
    numbers = kept.drop("tokens")
    one = staged(numbers.groupBy("block").applyInArrow(ask, asks).groupBy("owner", "n").applyInArrow(answer, shape), "lm_answers")
    n_all, types = one.where("block = -1 and n = 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    one = one.where("block >= 0")
    more = numbers.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(ask_more, asks)
    two = more.groupBy("owner", "n").applyInArrow(answer, shape).where("block >= 0")

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = opened(table)
        singles, (pairs, shared) = told(replies, 0)[0], told(replies, 1)
        c1 = singles[np.searchsorted(np.unique(block.words), block.words)]
        _, unknown, c3 = open_triples(block, block.train(folds, held), pairs, shared)
        c3[unknown] = told(replies, 2)[0]
        logp = Automaton(block, [c1, pairs, c3], n_all, types, weights).walk(block)
        c = c1[block.ids]
        base = np.log10((c + 0.5) / (n_all + 0.5 * (types + 1)))
        total = lambda x: np.add.reduceat(x, block.begins[:-1])
        return pa.table({
            "doc_id": pa.array(block.doc_ids, pa.int64()), "held_out": pa.array([not is_training(i, folds, held) for i in block.doc_ids], pa.bool_()),
            "n_tokens": pa.array(np.diff(block.begins)), "n_known": pa.array(total((c > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(block.doc_ids), n_all, np.int64)), "base_score": pa.array(total(base)), "score": pa.array(total(logp))})

    return numbers.groupBy("block").cogroup(one.unionByName(two).groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
