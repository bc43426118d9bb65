"""Phrase collocations: suffixes routed by their leading words and sorted word by word (multikey three-way quicksort); groups of equal words are the counts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucketed, staged, texts

#: Bytes of text that are encoded together; phrases, or suffixes, that an owner should get; lengths of phrases whose rare ones are told beforehand.
BLOCK_BYTES, OWNED, TOLD = 16 << 20, 1 << 20, 3
#: What ends a piece becomes LF, a tab a space.
_ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ENCODED = "block long, lang string, tokens long, words binary, ids binary"


def three_way(words: np.ndarray, weights: np.ndarray, least: int, shared: int = 2):
    """(length, a row, weight) of every prefix of more than `shared` words that weighs `least` or more, and of every one of `shared` words.

    words: one row for each suffix, its words as numbers, -1 beyond its end; weights: how often each stands. Multikey quicksort: the rows at hand are parted by
    their word at one depth in less than, equal to and greater than a pivot's; the equal ones share a prefix, their weight is its count, and they go on at the next depth.
    Parts that weigh less than `least` are abandoned, as all their prefixes do too; but not before `shared` words, whose rows other owners hold as well.
    """
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        column = words[rows, depth]
        rows, column = rows[column >= 0], column[column >= 0]
        if not len(rows) or depth >= shared and weights[rows].sum() < least:
            continue
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        stack += [(part, depth) for part in (rows[column < pivot], rows[column > pivot]) if len(part)]
        same = rows[column == pivot]
        weight = int(weights[same].sum())
        if depth + 1 == shared or depth >= shared and weight >= least:
            yield depth + 1, int(same[0]), weight
        if depth + 1 < words.shape[1]:
            stack.append((same, depth + 1))


def _encode(data: dict[str, list[bytes]]):
    """Of each language the number of words, its distinct words a line, and the texts as places of these words; -1 where a piece ends."""
    for lang, some in data.items():
        tokens = b" \n ".join(some).lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ")
        number: dict[bytes, int] = {b"": -2, b"\n": -1}
        ids = np.fromiter((number.setdefault(t, len(number) - 2) for t in tokens), np.int32, len(tokens))
        ids = ids[ids > -2]
        yield lang, int(np.count_nonzero(ids >= 0)), b"\n".join(list(number)[2:]), ids.tobytes()


def _packed(keys: np.ndarray) -> bytes:
    """The lower 40 bits of each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :5] = raw
    return out.view("<u8").ravel()


def _keys(values: np.ndarray, owners: int) -> np.ndarray:
    """Of 64-bit values the owner above bit 40, and 40 bits of the value below."""
    return ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32) << np.uint64(40)) | (values & np.uint64((1 << 40) - 1))


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    own = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh3_64_intdigest(own + w) for w in words), np.uint64, len(words))


class Texts:
    """A block's texts of one language, as ids of its words; and for each length m the places where phrases of m words begin whose parts of m - 1 words are frequent, with their
    keys; of lengths that are told, the frequent ones alone. frequent: sorted keys of the block's frequent phrases of one word, two words, ... as far as they are known."""

    def __init__(self, lang: str, words: bytes, ids: bytes, owners: int, frequent: list[np.ndarray]):
        self.lang, self.ids = lang, np.frombuffer(ids, np.int32)
        self.words = words.split(b"\n") if words else []
        h = _hashes(lang, self.words)
        self.word_keys = _keys(h, owners)
        word = h[self.ids] if len(h) else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.ids >= 0)
        value = word[at]
        self.places, self.keys = [at], [_keys(value, owners)]
        for m, known in enumerate(frequent, 1):
            keys = self.keys[-1]
            kept = known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(at), bool)
            at, value, self.keys[-1] = at[kept], value[kept], keys[kept]
            self.places[-1] = at
            goes = np.zeros(len(self.ids) + 1, bool)
            goes[at] = True
            at, value = at[goes[at + 1]], value[goes[at + 1]]
            value = (value ^ (value >> np.uint64(31))) * _A + word[at + m] * _B
            value ^= value >> np.uint64(29)
            self.places.append(at)
            self.keys.append(_keys(value, owners))


def _dealt(keys: np.ndarray, owners: int):
    """(owner, slice) of sorted keys."""
    cuts = np.searchsorted(keys, np.arange(owners + 1, dtype=np.uint64) << np.uint64(40))
    return [(int(i), slice(int(cuts[i]), int(cuts[i + 1]))) for i in np.flatnonzero(np.diff(cuts))]


def phrase_counts(docs: DataFrame, least: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """docs (text, lang, ...) -> (counts, sizes): counts (lang, phrase, f), each phrase of up to `most` words that its lang has `least` times or more; sizes (lang, n).

    Tasks encode texts by blocks, so no text moves. In a round each for words, pairs and triples a block sends its phrases whose parts are frequent, with their counts, to the owners of ranges of
    hashes: words as they are, so that their owners count them; longer ones as keys of 40 bits, since the owners only abandon what all blocks together have too seldom and tell the block the
    rest (by a collision a rare phrase may pass, which is found out later). A suffix begins with a frequent pair and goes on as long as the next triple is frequent; what is cut off can't be counted often.
    Equal suffixes of a block become one with a weight, and go to the owners of their first two words; there they are sorted and counted. A pair that occurs more often than an owner should hold rows
    is dealt to as many owners as that takes, by its third word, and its own count is summed. So a frequent word or phrase sends one entry a block, and no owner gathers all that begins with a frequent pair.
    """
    spark, levels = docs.sparkSession, min(TOLD, most)
    arrow = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("tokens", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())])

    def encode(batches):
        block, held, data = TaskContext.get().partitionId() << 32, 0, {}

        def out():
            rows_ = [(block, *x) for x in _encode(data)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], t) for i, t in enumerate(arrow.types)], schema=arrow)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), strict=True):
                if held and held + len(text) > BLOCK_BYTES:
                    yield out()
                    block, held, data = block + 1, 0, {}
                data.setdefault(lang, []).append(text)
                held += len(text) + 1
        yield out()

    rows = bucketed(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(encode, ENCODED), "block", "phrases_rows")
    sizes = staged(rows.groupBy("lang").agg(F.sum("tokens").alias("n")).where("n > 0"), "phrases_sizes")
    owners = max(2, (sizes.agg(F.sum("n")).first()[0] or 0) // OWNED)

    def views(table: pa.Table, told: pa.Table, known: int):
        frequent = []
        for level in range(1, known + 1):
            own = told.filter(pc.equal(told.column("level"), level))
            keys = [_unpacked([p]) | np.uint64(owner << 40) for owner, p in zip(own.column("owner").to_pylist(), own.column("phrases").to_pylist(), strict=True)]
            frequent.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *keys])))
        for lang, words, ids in zip(*(table.column(c).to_pylist() for c in ("lang", "words", "ids")), strict=True):
            yield Texts(lang, words, ids, owners, frequent)

    def entries(found: list[tuple], columns: str) -> pa.Table:
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        names = [c.split() for c in columns.split(", ")]
        return pa.table({n: pa.array([r[i] for r in found], kinds[k]) for i, (n, k) in enumerate(names)})

    asked_columns = "block long, owner int, lang string, phrases binary, times binary"
    told_columns = "block long, level int, owner int, phrases binary, parts binary, lang string, word string, f long"

    def ask(level: int):
        def run(table: pa.Table, told: pa.Table) -> pa.Table:
            out, seen, block = [], list(views(table, told, level - 1)), table.column("block")[0].as_py() if len(table) else 0
            if level == 1:
                for t in seen:
                    order = np.argsort(t.word_keys)
                    times = np.bincount(t.ids[t.ids >= 0], minlength=len(order)).astype("<u8")[order]
                    out += [(block, o, t.lang, b"\n".join([t.words[i] for i in order[w]]), times[w].tobytes()) for o, w in _dealt(t.word_keys[order], owners)]
            else:
                keys, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.keys[-1] for t in seen)]), return_counts=True)
                out += [(block, o, None, _packed(keys[w]), times[w].astype("<u4").tobytes()) for o, w in _dealt(keys, owners)]
            return entries(out, asked_columns)
        return run

    def count_words(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("block", "owner", "lang", "phrases", "times")]
        total: dict[str, Counter] = {}
        for _, _, lang, words, times in zip(*columns, strict=True):
            own = total.setdefault(lang, Counter())
            for w, n in zip(words.split(b"\n"), np.frombuffer(times, "<u8").tolist(), strict=True):
                own[w] += n
        often = {lang: {w: f for w, f in own.items() if f >= least} for lang, own in total.items()}
        out = [(None, 1, None, None, None, lang, w.decode(), f) for lang, own in often.items() for w, f in own.items()]
        key = {lang: dict(zip(own, _keys(_hashes(lang, list(own)), owners).tolist(), strict=True)) for lang, own in often.items()}
        for block, owner, lang, words, _ in zip(*columns, strict=True):
            kept = np.array([key[lang][w] for w in words.split(b"\n") if w in key[lang]], np.uint64)
            if len(kept):
                out.append((block, 1, owner, _packed(kept), None, None, None, None))
        return entries(out, told_columns)

    def answer(level: int):
        def run(table: pa.Table) -> pa.Table:
            parts = table.column("phrases").to_pylist()
            keys, inverse = np.unique(_unpacked(parts), return_inverse=True)
            times = np.bincount(inverse, weights=np.frombuffer(b"".join(table.column("times").to_pylist()), "<u4"))[inverse]
            cuts = np.cumsum([0, *(len(p) // 5 for p in parts)])
            out = []
            for block, owner, a, b in zip(table.column("block").to_pylist(), table.column("owner").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                kept = times[a:b] >= least
                if kept.any():
                    dealt = np.ceil(times[a:b][kept] / OWNED).astype("<u4") if level == 2 else np.zeros(0, "<u4")
                    out.append((block, level, owner, _packed(keys[inverse[a:b][kept]]), dealt.tobytes() if (dealt > 1).any() else None, None, None, None))
            return entries(out, told_columns)
        return run

    told, counts = spark.createDataFrame([], told_columns), None
    for level in range(1, levels + 1):
        asked = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(ask(level), asked_columns)
        answers = staged(asked.groupBy("owner").applyInArrow(count_words if level == 1 else answer(level), told_columns), f"phrases_told{level}")
        counts = answers.where("word is not null").select("lang", F.col("word").alias("phrase"), "f") if level == 1 else counts
        told = told.unionByName(answers.where("word is null"))

    def suffixes(table: pa.Table, told_: pa.Table) -> pa.Table:
        large = {}
        some = told_.filter(pc.is_valid(told_.column("parts")))
        for owner, keys, dealt in zip(*(some.column(c).to_pylist() for c in ("owner", "phrases", "parts")), strict=True):
            large |= {k: n for k, n in zip((_unpacked([keys]) | np.uint64(owner << 40)).tolist(), np.frombuffer(dealt, "<u4").tolist(), strict=True) if n > 1}
        out = []
        for t in views(table, told_, levels) if levels > 1 else ():
            begin = t.places[1]
            if not len(begin):
                continue
            goes = [np.zeros(len(t.ids) + most, bool) for _ in range(levels)]
            for m in range(levels):
                goes[m][t.places[m]] = True
            found = np.full((len(begin), most), -1, np.int32)
            on = np.ones(len(begin), bool)
            for d in range(most):  # a word belongs to the suffix if the longest phrase told that ends with it is frequent
                m = min(d + 1, levels)
                on = on & (goes[m - 1][begin + d - m + 1] if d > 1 else True)
                found[on, d] = t.ids[begin[on] + d]
            order = np.lexsort(found.T[::-1])
            found = found[order]
            first = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]).any(axis=1)]))
            pair, times, found = t.keys[1][order][first], np.diff(np.append(first, len(found))), found[first]
            owner = (pair >> np.uint64(40)).astype(np.int64)
            if large:
                split = np.array([large.get(k, 1) for k in pair.tolist()], np.int64)
                third = np.where(found[:, 2] >= 0, (t.word_keys[found[:, 2]] & np.uint64((1 << 40) - 1)).astype(np.int64), 0)
                owner = (owner + third % split) % owners
            order = np.argsort(owner, kind="stable")
            for rows_ in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                phrases = b"\n".join([b" ".join([t.words[i] for i in row if i >= 0]) for row in found[rows_].tolist()])
                out.append((int(owner[rows_[0]]), t.lang, phrases, times[rows_].astype("<u8").tobytes()))
        return entries(out, "owner int, lang string, phrases binary, times binary")

    def sort(table: pa.Table) -> pa.Table:
        total: dict[str, Counter] = {}
        for lang, phrases, times in zip(*(table.column(c).to_pylist() for c in ("lang", "phrases", "times")), strict=True):
            own = total.setdefault(lang, Counter())
            for p, n in zip(phrases.split(b"\n"), np.frombuffer(times, "<u8").tolist(), strict=True):
                own[p] += n
        out = []
        for lang, own in total.items():
            split = [p.split(b" ") for p in own]
            number = {w: i for i, w in enumerate(dict.fromkeys(w for p in split for w in p))}
            matrix = np.full((len(split), most), -1, np.int32)
            for i, p in enumerate(split):
                matrix[i, :len(p)] = [number[w] for w in p]
            out += [(lang, b" ".join(split[row][:length]).decode(), f) for length, row, f in three_way(matrix, np.fromiter(own.values(), np.int64, len(own)), least)]
        return entries(out, "lang string, phrase string, f long")

    found = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(suffixes, "owner int, lang string, phrases binary, times binary")
    longer = found.groupBy("owner").applyInArrow(sort, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return staged(counts.unionByName(longer.where(F.col("f") >= least)), "phrases_counts"), sizes


def collocations(docs: DataFrame, least: int = 100, most: int = 5, first: int = 2000) -> DataFrame:
    """docs (text, lang, ...) -> lang, rank, phrase, a, l, r, n, score: of each lang the `first` phrases of two to `most` words by their weakest cut.

    A-Z are lower-cased; pieces end at .,;:!? and LF, VT, FF, CR; words are apart by spaces and tabs. Null text is empty, null lang `und`. a: how often the lang has the phrase, at least
    `least` times; a cut leaves l of its first words and r of the rest, and scores floor(1000 * a * n / (l * r)), n being all words of the lang; of equal scores the shorter first part counts.
    Phrases that a longer one of as many occurrences holds are left out. Order: score and a descending, phrase by its bytes. Products are decimals
    of 38 digits, exact up to 10^35. An empty table, or one of rare phrases only, gives no rows; repeated rows count again; other columns are not read.
    """
    counts, sizes = phrase_counts(docs, least, most)
    split = F.split("phrase", " ")
    candidates = counts.select("lang", "phrase", F.size(split).alias("words"), F.col("f").alias("a")).where("words > 1")
    part = lambda start, n: F.array_join(F.slice(split, start, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    heads, tails = (counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(v)) for c, v in (("head", "l"), ("tail", "r")))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(sizes, "lang")
    score = F.expr("CAST(1000 AS DECIMAL(19,0)) * CAST(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) AS DECIMAL(34,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    scored = scored.withColumn("score", score.cast("long"))
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice(split, i, m), " "))))
    held = candidates.where("words > 2").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) AS s(m) WHERE len(words) >= m),
c AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
a AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM c WHERE m > 1 AND f >= 100),
k AS (SELECT a.*, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:m], ' ') AS tail FROM a, range(1, 5) AS s(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, a, n, list_min(list({'score': (1000 * a::HUGEINT * n) // (h.f::HUGEINT * t.f), 'k': k, 'l': h.f, 'r': t.f})) AS cut
  FROM k JOIN c h ON h.lang = k.lang AND h.phrase = head JOIN c t ON t.lang = k.lang AND t.phrase = tail JOIN n ON n.lang = k.lang GROUP BY ALL),
i AS (SELECT DISTINCT lang, a, array_to_string(words[b:b + z - 1], ' ') AS phrase FROM a, range(1, 5) AS x(b), range(2, 5) AS y(z) WHERE z < m AND b + z - 1 <= m),
o AS (SELECT s.lang, s.phrase, s.a, cut.l AS l, cut.r AS r, n, cut.score::BIGINT AS score FROM s WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = s.lang AND i.phrase = s.phrase AND i.a >= s.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""
