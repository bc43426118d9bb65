"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and their characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Words of a window and between two windows' starts, so that no passage of half a window is cut by all; windows scored at once.
WINDOW, STEP, AT_ONCE = 48, 24, 1024
#: Buckets of words and of character triples, sizes of their vectors and of a direction's state.
WORDS, TRIPLES, WIDE, NARROW, STATE = 1 << 15, 1 << 13, 12, 8, 12
#: Bytes of the beginnings of words that are looked up like words.
HEADS = (5, 8)
#: Labelled rows that training uses at most, of label 0 and 1: those of the least hash of doc_id. Longer texts than so many bytes are not among them.
SAMPLE, SAMPLE_BYTES = (3000, 1500), 1 << 16
#: The sigmoids of a step are taken as 0.5 + 0.5 tanh of half their input: what halves the gates z and r, but not the candidates, of both directions.
_HALF = np.tile(np.repeat(np.array([0.5, 1], np.float32), (2 * STATE, STATE)), 2)
_STRIP = b" .,;:!?\"'()[]{}<>|*#$%&-_=+/\\~^`@"
_A = np.uint64(0x9E3779B97F4A7C15)


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' character triples (of bytes, with marks at both ends) in a row, and where each word's begin."""
    raw = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words) + b"\0\0", np.uint8).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    key = raw[:-2] | raw[1:-1] << np.uint64(8) | raw[2:] << np.uint64(16)
    ends = np.cumsum(n)
    last = np.concatenate([ends - 1, np.where(n > 2, ends - 2, ends - 1)])  # triples that would reach into the next word
    key[last] = raw[last] | np.uint64(1 << 24)
    return ((key * _A) >> np.uint64(51)).astype(np.int64) % TRIPLES, ends - n


def clean(word: bytes) -> bytes:
    return word.strip(_STRIP) or word


def buckets(words: list[bytes]) -> np.ndarray:
    """Of each word, and of its beginnings: the bucket."""
    h = xxhash.xxh3_64_intdigest
    return np.array([[h(w) % WORDS, *(h(w[:n], n) % WORDS for n in HEADS)] for w in words], np.int64).reshape(-1, 1 + len(HEADS))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Net:
    """The weights, the walk over windows and its gradient. Inputs are rows of `inputs`, one for each distinct word."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, s = WIDE * (1 + len(HEADS)) + NARROW, STATE
        self.w = {"words": r.normal(0, 0.1, (WORDS, WIDE)), "triples": r.normal(0, 0.1, (TRIPLES, NARROW)), "out": r.normal(0, 0.3, 2 * s), "look": r.normal(0, 0.3, 2 * s), "bias": np.array([-1.0])}
        for way in "fb":
            self.w |= {f"x{way}": r.normal(0, d ** -0.5, (d, 3 * s)), f"h{way}": r.normal(0, s ** -0.5, (s, 3 * s)), f"b{way}": np.zeros(3 * s)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Of each word its vector, those of its beginnings, and the mean of those of its character triples."""
        t, at = triples(words)
        chars = np.add.reduceat(self.w["triples"][t], at, axis=0) / np.diff(np.append(at, len(t)))[:, None]
        return np.hstack([self.w["words"][buckets(words)].reshape(len(words), -1), chars]).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What an input adds to the gates of both directions."""
        return np.hstack([x @ self.w["xf"] + self.w["bf"], x @ self.w["xb"] + self.w["bb"]])

    def _direction(self, way: str, g: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: list | None):
        s, w = STATE, self.w[f"h{way}"]
        n, t = idx.shape
        h = np.zeros((n, s), np.float32)
        out = np.zeros((n, t, s), np.float32)
        off = 0 if way == "f" else 3 * s
        g = np.ascontiguousarray(g[:, off:off + 3 * s])
        for i in range(t) if way == "f" else range(t - 1, -1, -1):
            x, y = g[idx[:, i]], h @ w
            zr = _sigmoid(x[:, :2 * s] + y[:, :2 * s])
            z, r = zr[:, :s], zr[:, s:]
            c = np.tanh(x[:, 2 * s:] + r * y[:, 2 * s:])
            m = mask[:, i, None]
            new = h + m * z * (c - h)
            if keep is not None:
                keep.append((i, h, y, z, r, c, m))
            h = new
            out[:, i] = h
        return out

    def forward(self, g: np.ndarray, idx: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit for each window: idx (windows x words) are rows of g, mask tells words from padding."""
        steps = {way: [] if keep is not None else None for way in "fb"}
        h = np.concatenate([self._direction(way, g, idx, mask, steps[way]) for way in "fb"], axis=2)
        e = np.where(mask > 0, h @ self.w["look"], np.float32(-1e9))
        a = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        pooled = (a[:, :, None] * h).sum(axis=1)
        if keep is not None:
            keep |= {"steps": steps, "h": h, "a": a, "pooled": pooled}
        return pooled @ self.w["out"] * 4 + self.w["bias"][0]

    def logits(self, g: np.ndarray, idx: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """As forward, of any number of windows, where g has been multiplied by _HALF: laid out step by step, no state kept but the outputs of AT_ONCE windows."""
        s, w = STATE, self.w
        out = np.zeros(len(idx), np.float32)
        for a in range(0, len(idx), AT_ONCE):
            ix, m = np.ascontiguousarray(idx[a:a + AT_ONCE].T), np.ascontiguousarray(mask[a:a + AT_ONCE].T)
            full, states = m.all(axis=1), []
            for way, off in (("f", 0), ("b", 3 * s)):
                h, all_h, weights = np.zeros((ix.shape[1], s), np.float32), np.empty((*ix.shape, s), np.float32), w[f"h{way}"] * _HALF[:3 * s]
                for i in range(len(ix)) if way == "f" else range(len(ix) - 1, -1, -1):
                    x, y = g[ix[i], off:off + 3 * s], h @ weights
                    zr = np.tanh(x[:, :2 * s] + y[:, :2 * s])
                    zr += 1
                    zr *= np.float32(0.5)
                    c = np.tanh(x[:, 2 * s:] + zr[:, s:] * y[:, 2 * s:])
                    c -= h
                    c *= zr[:, :s]
                    if not full[i]:
                        c *= m[i][:, None]
                    h = np.add(h, c, out=all_h[i])
                states.append(all_h)
            e = np.where(m > 0, states[0] @ w["look"][:s] + states[1] @ w["look"][s:], np.float32(-1e9))
            p = np.exp(e - e.max(axis=0)) * m
            p /= np.maximum(p.sum(axis=0), 1e-9)
            out[a:a + AT_ONCE] = (p * (states[0] @ w["out"][:s] + states[1] @ w["out"][s:])).sum(axis=0) * 4 + w["bias"][0]
        return out

    def step(self, words: list[bytes], idx: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float, moments: dict) -> float:
        """One step of Adam on the logistic loss of some windows; returns the loss."""
        x = self.inputs(words)
        g = self.gates(x)
        keep: dict = {}
        logit = self.forward(g, idx, mask, keep)
        p = _sigmoid(logit)
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        h, a, s = keep["h"], keep["a"], STATE
        grad = {"out": 4 * (d[:, None] * keep["pooled"]).sum(0), "bias": np.array([d.sum()])}
        dpool = 4 * d[:, None] * self.w["out"]
        da = (h * dpool[:, None, :]).sum(2)
        de = a * (da - (a * da).sum(1, keepdims=True))
        dh_all = a[:, :, None] * dpool[:, None, :] + de[:, :, None] * self.w["look"]
        grad["look"] = (de[:, :, None] * h).sum((0, 1))
        dg = np.zeros_like(g)
        for side, way in enumerate("fb"):
            w = self.w[f"h{way}"]
            dw, carry, off = np.zeros_like(w), np.zeros((len(idx), s), np.float32), side * 3 * s
            for i, before, y_, z, r, c, m in reversed(keep["steps"][way]):
                dh = dh_all[:, i, side * s:(side + 1) * s] + carry
                dn = dh * m
                dz, dc = dn * (c - before) * z * (1 - z), dn * z * (1 - c * c)
                dr = dc * y_[:, 2 * s:] * r * (1 - r)
                dy = np.hstack([dz, dr, dc * r])
                carry = dh - dn * z + dy @ w.T
                dw += before.T @ dy
                np.add.at(dg[:, off:off + 3 * s], idx[:, i], np.hstack([dz, dr, dc]))
            grad[f"h{way}"] = dw
            grad[f"x{way}"], grad[f"b{way}"] = x.T @ dg[:, off:off + 3 * s], dg[:, off:off + 3 * s].sum(0)
        dx = dg[:, :3 * s] @ self.w["xf"].T + dg[:, 3 * s:] @ self.w["xb"].T
        grad["words"] = np.zeros_like(self.w["words"])
        wide = WIDE * (1 + len(HEADS))
        np.add.at(grad["words"], buckets(words).ravel(), dx[:, :wide].reshape(-1, WIDE))
        t, at = triples(words)
        n = np.diff(np.append(at, len(t)))
        grad["triples"] = np.zeros_like(self.w["triples"])
        np.add.at(grad["triples"], t, np.repeat(dx[:, wide:] / n[:, None], n, axis=0))
        moments["t"] = moments.get("t", 0) + 1
        for k, v in grad.items():
            m, u = moments.setdefault(k, [np.zeros_like(self.w[k]), np.zeros_like(self.w[k])])
            m += 0.1 * (v - m)
            u += 0.01 * (v * v - u)
            self.w[k] -= (rate * (m / (1 - 0.9 ** moments["t"])) / (np.sqrt(u / (1 - 0.99 ** moments["t"])) + 1e-7)).astype(np.float32)
        return float(-(weight * np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum() / weight.sum())


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows over n words; the last ends with the text. No words: one window of padding."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW)


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents as word numbers -> windows (word numbers), their mask, the document of each."""
    starts = [windows(len(d)) for d in docs]
    of = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
    n = np.array([len(d) for d in docs])
    flat = np.concatenate([*docs, np.zeros(1, np.int32)])
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(docs) else n
    at = np.concatenate(starts)[:, None] + np.arange(WINDOW) if len(docs) else np.zeros((0, WINDOW), np.int64)
    mask = at < n[of][:, None]
    return np.where(mask, flat[np.minimum(at + begin[of][:, None], len(flat) - 1)], 0), mask.astype(np.float32), of


class Coder:
    """Words of texts to numbers, and the gates of each word; starts anew beyond most words."""

    def __init__(self, net: Net, most: int = 200_000):
        self.net, self.most = net, most
        self._new()

    def _new(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = np.zeros((1024, 6 * STATE), np.float32)

    def docs(self, data: list[bytes]) -> list[np.ndarray]:
        split = [x.lower().split() for x in data]
        if len(self.known) > self.most:
            self._new()
        known = self.known
        fresh: dict[bytes, None] = {}
        for ws in split:
            fresh |= dict.fromkeys(set(ws).difference(known))
        if fresh:
            words = list(fresh)
            at, end = len(known), len(known) + len(words)
            known |= zip(words, range(at, end), strict=True)
            if end > len(self.held):
                self.held = np.vstack([self.held, np.zeros((end, 6 * STATE), np.float32)])
            for a in range(0, len(words), 20_000):
                some = [clean(w) for w in words[a:a + 20_000]]
                self.held[at + a:at + a + len(some)] = self.net.gates(self.net.inputs(some)) * _HALF
        return [np.fromiter(map(known.__getitem__, ws), np.int32, len(ws)) for ws in split]


def train(data: list[bytes], labels: np.ndarray, rounds: int = 6, steps: int = 200, seed: int = 5) -> Net | None:
    """A net for whole texts and their labels; None where there are not both labels.

    A text is as toxic as its worst window. The word vectors' first component begins as the word's log odds among the labels. Then
    rounds step on the worst window of each text, with toxic ones weighted to a fourth of all; every second round finds it anew. There are
    at least `rounds` rounds and as many more as a small sample needs for `steps` steps.
    """
    if not 0 < labels.sum() < len(labels):
        return None
    net = Net()
    rounds = max(rounds, -(-steps * 128 // len(data)))
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(clean(w), len(vocabulary)) for w in x.lower().split()], np.int32) for x in data]
    words = np.array(list(vocabulary), object)
    lots = buckets(list(vocabulary))
    odds = np.zeros((2, WORDS))
    for d, y in zip(docs, labels.tolist(), strict=True):
        odds[y, np.unique(lots[np.unique(d)])] += 1
    ratio = np.log((odds[1] + 0.3) / (labels.sum() + 1)) - np.log((odds[0] + 0.3) / (len(labels) - labels.sum() + 1))
    ratio[odds.sum(0) < 4] = 0
    net.w["words"][:, 0] = np.clip(ratio, -1, 3)
    idx, mask, of = laid_out(docs)
    rng, moments = np.random.default_rng(seed), {}
    share = labels.mean()
    weight = np.where(labels == 1, 0.25 / 0.75 * (1 - share) / share, 1.0)
    ends = np.searchsorted(of, np.arange(len(docs)), "right")
    begins = np.searchsorted(of, np.arange(len(docs)), "left")
    for turn in range(rounds):
        if turn == 0:  # the windows of the largest log odds
            value = (ratio[lots].max(axis=1).astype(np.float32)[idx] * mask).max(axis=1)
        elif turn % 2 == 0:
            g = np.vstack([net.gates(net.inputs(words[a:a + 20_000].tolist())) * _HALF for a in range(0, len(words), 20_000)])
            value = net.logits(g, idx, mask)
        worst = np.array([b + value[b:e].argmax() for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])
        order = rng.permutation(len(docs))
        for a in range(0, len(order), 128):
            some = order[a:a + 128]
            used, local = np.unique(idx[worst[some]], return_inverse=True)
            net.step(words[used].tolist(), local.reshape(len(some), -1), mask[worst[some]], labels[some].astype(np.float32), weight[some].astype(np.float32), 0.01 if 3 * turn < 2 * rounds else 0.003, moments)
    return net


def labelled(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most: tuple = SAMPLE) -> list:
    """At most `most` (text, label) of label 0 and of label 1 whose crc32(doc_id as text) is not `held` modulo `folds`.

    Only doc_ids with a text of up to SAMPLE_BYTES take a place; of rows with one doc_id the least such text is taken. The sample's bound, for
    which SAMPLE and SAMPLE_BYTES are parameters, is all that reaches the driver; to find it, no texts move.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    known = known.join(short.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    return short.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "toxic").collect()


def fit(docs: DataFrame, labels: DataFrame, **options) -> Net | None:
    rows = labelled(docs, labels, **options)
    toxic = np.array([r.toxic for r in rows], np.int64)
    data = [(r.text or "").encode() for r in rows]
    del rows
    return train(data, toxic)


def scorer(net: Net | None):
    """A function from texts to scores from 0 to 1; 0 without a net."""
    if net is None:
        return lambda data: np.zeros(len(data))
    coder = Coder(net)

    def score(data: list[bytes]) -> np.ndarray:
        out = np.full(len(data), -np.inf)
        docs = coder.docs(data)
        idx, mask, of = laid_out(docs)
        np.maximum.at(out, of, net.logits(coder.held, idx, mask))
        return _sigmoid(out)

    return score


def _groups(sizes: list[int], most: int = 1 << 20):
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if sizes:
        yield at, len(sizes)


def toxicity(docs: DataFrame, net: Net | None) -> DataFrame:
    """docs (doc_id, text, ...) -> docs with score (double): that of the worst of all overlapping windows over the whole text.

    One pass, no shuffle. Null and empty texts: one window of padding. With no net (no labels of both kinds): 0. docs must not have a column score (common.packed sets clashing names apart). An empty table gives no rows.
    """
    from pyspark.sql.types import StructType

    schema = StructType(list(docs.schema)).add("score", "double")

    def run(batches):
        score = scorer(net)
        for batch in batches:
            data = texts(batch.column("text"))
            got = [score(data[a:b]) for a, b in _groups([len(x) for x in data])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0))], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold) for each row of docs.

    Null and empty texts are scored as a window of padding; null doc_id counts as an empty one for its fold. Repeated rows each give their row, with one score; a doc_id with
    several labels is toxic if one says so. Labels of one kind only, or none, make no net: all scores are 0. An empty table gives no rows; other columns are not read.
    """
    net = fit(docs, labels, folds=folds, held=held)
    out = toxicity(docs.select("doc_id", "text"), net)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds))
    return out.select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
