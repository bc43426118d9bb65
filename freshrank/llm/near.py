"""Near copies by Jaccard similarity of sets of shingles: links of op4's index, told by the sets themselves; then complete candidates for those that fingerprints miss."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, components, joined_all, only, packed, partitions, staged, texts, unpacked
from .simhash import linked_ids, majority, shingle_hashes

#: Sets with one key beyond which they are first compared with some of them, with how many, and how often; sets of a part in which such a key is dealt out.
MOST, SLOTS, ROUNDS, PART = 32, 8, 2, 1024
#: Keys that are counted at once between the sets of two parts.
KEYS = 2048


def both_hold(held: list[list[int]], some: np.ndarray) -> np.ndarray:
    """How many keys each of some sets has in common with each set; held: the keys of each set. Memory grows with the square of the sets, not with their keys."""
    flat, which = np.concatenate([np.zeros(0, np.int64), *(np.asarray(k, np.int64) for k in held)]), np.repeat(np.arange(len(held)), [len(k) for k in held])
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times > 1  # a key that one set has joins none
    number, which = (np.cumsum(many) - 1)[number[many[number]]], which[many[number]]
    order = np.argsort(number, kind="stable")
    number, which = number[order], which[order]
    out = np.zeros((len(some), len(held)), np.float32)
    for at in range(0, int(many.sum()), KEYS):
        lo, hi = np.searchsorted(number, (at, at + KEYS))
        has = np.zeros((len(held), KEYS), np.float32)
        has[which[lo:hi], number[lo:hi] - at] = 1
        out += has[some] @ has.T
    return out


def set_links(rows: DataFrame, wanted: DataFrame, similarity: float, width: int) -> DataFrame:
    """rows: blocks of texts; wanted (block, row, id, simhash): one for each set of shingles -> (src, dst), enough links between ids of Jaccard similarity at least this to join all that any such links join.

    The fingerprints that op4's Gray-order index links come first, and those links stay whose sets are so similar. Sets of similarity 0.8 may differ
    in more bits than any fingerprint tells, so the pairs that no such link joins are looked for by two bounds. A set needs so large a share of its shingles in other sets, else it has no partner; and if each
    set is put in one order for all, two such sets share one of their first shingles (as many as may be missing, and one). That order is by the number
    of sets that hold a shingle, rare ones first, so what is common is hardly ever a key. Blocks ask the owners of ranges of hashes for
    these numbers. Pairs with a common key are told by the sets themselves, as 64-bit hashes.
    Sets that share a key with over MOST others are first compared with SLOTS of them, ROUNDS times. Then all pairs that no links join yet are looked at: those
    of rare keys by a join; those of others in groups of two parts of up to PART sets, which return only pairs that share keys enough.
    """
    spark = rows.sparkSession
    owners = 4 * partitions(spark)
    low = np.uint64((1 << 40) - 1)
    asked_rows = wanted.select("block", (-1 - F.col("row")).alias("owner"), F.lit(None).cast("binary").alias("levels"), "id")

    def block_sets(table: pa.Table, told: pa.Table):
        """Ids and sets of the rows that are wanted, their distinct hashes and how many sets hold each."""
        told = told.filter(pc.less(told.column("owner"), 0))
        ids = dict(zip([-1 - r for r in told.column("owner").to_pylist()], told.column("id").to_pylist(), strict=True))
        table = table.filter(pc.is_in(table.column("row"), pa.array(list(ids), pa.int32())))
        sets = [np.unique(shingle_hashes(x, width)) for x in texts(table.column("text"))]
        return [ids[r] for r in table.column("row").to_pylist()], sets, *np.unique(np.concatenate([*sets, np.zeros(0, "<u8")]), return_counts=True)

    def ask(table: pa.Table, told: pa.Table) -> pa.Table:
        _, _, h, times = block_sets(table, told)
        owner = (h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        rest, few = (h & low).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], np.minimum(times, 255).astype(np.uint8)
        return pa.table({"block": pa.array(np.full(len(some), (table if len(table) else told).column("block")[0].as_py(), np.int64)), "owner": pa.array(some.astype(np.int32)),
                         "hashes": pa.array([rest[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary()), "times": pa.array([few[cuts[i]:cuts[i + 1]].tobytes() for i in some], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        parts = table.column("hashes").to_pylist()
        raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 5)
        h = np.zeros((len(raw), 8), np.uint8)
        h[:, :5] = raw
        _, inverse = np.unique(h.view("<u8").ravel(), return_inverse=True)
        held = np.bincount(inverse, weights=np.frombuffer(b"".join(table.column("times").to_pylist()), np.uint8))[inverse]
        level = np.minimum(255, np.floor(8 * np.log2(held))).astype(np.uint8)  # 0: in one set only; hashes that share 40 bits only seem more common
        cuts = np.cumsum([0, *(len(x) // 5 for x in parts)])
        return pa.table({"block": table.column("block"), "owner": table.column("owner"), "levels": pa.array([level[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    rows = rows.select("block", "row", "text")
    asked = rows.groupBy("block").cogroup(asked_rows.groupBy("block")).applyInArrow(ask, "block long, owner int, hashes binary, times binary")
    levels = asked.groupBy("owner").applyInArrow(answer, "block long, owner int, levels binary").withColumn("id", F.lit(None).cast("long"))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("hashes", pa.binary())])

    def pick(table: pa.Table, told: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if not len(told):
            return pa.table(out, schema=schema)
        ids, sets, h, _ = block_sets(table, told)
        level = told.filter(pc.greater_equal(told.column("owner"), 0)).sort_by("owner").column("levels").to_pylist()
        level = np.frombuffer(b"".join(level), np.uint8)
        for i, s in zip(ids, sets, strict=True):
            lv = level[np.searchsorted(h, s)]
            need = ceil(similarity * len(s) - 1e-9)
            if not len(s) or np.count_nonzero(lv) < need:
                continue
            first = np.lexsort((s, lv))[:len(s) - need + 1]
            at = np.flatnonzero(lv[first])
            for c, v in zip(out, (i, len(s), s[first[at]].view(np.int64), at.astype(np.int32), s.tobytes()), strict=True):
                c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    sets = staged(rows.groupBy("block").cogroup(levels.unionByName(asked_rows).groupBy("block")).applyInArrow(pick, "id long, n int, keys array<long>, at array<int>, hashes binary"), "near_sets")
    keyed = sets.select("id", "n", F.explode(F.arrays_zip("keys", "at")).alias("k")).select("id", "n", F.col("k.keys").alias("key"), F.col("k.at").alias("at"))
    counts = staged(keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "near_keys")
    keyed = staged(keyed.join(counts, "key"), "near_keyed")

    def open_(a: str, b: str):
        """Of rows with one key: no link joins them yet, and their sizes and what follows the key leave room for the similarity."""
        room = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
        return (F.col(f"{a}.comp") != F.col(f"{b}.comp")) & (room + 1e-6 >= similarity / (1 + similarity) * (F.col(f"{a}.n") + F.col(f"{b}.n")))

    def told(pairs: DataFrame) -> DataFrame:
        def compare(batches):
            for batch in batches:
                near = []
                for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                    near.append(both / ((len(x) + len(y)) // 8 - both) >= similarity)
                yield batch.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

        pairs = staged(pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "near_pairs")
        x, y = (sets.select(F.col("id").alias(i), F.col("hashes").alias(c)) for i, c in (("src", "x"), ("dst", "y")))
        return staged(pairs.join(x, "src").join(y, "dst").select("src", "dst", "x", "y").mapInArrow(compare, "src long, dst long"), "near_links")

    def with_comp(some: DataFrame, links: list[DataFrame]) -> DataFrame:
        roots = components(joined_all(links), "near_rounds")
        return some.join(roots, some.id == roots.node, "left").select(*some.columns, F.coalesce("root", "id").alias("comp"))

    links = [told(linked_ids(wanted.select("id", F.col("simhash").alias("fp"))))]
    hot = keyed.where(F.col("held") > MOST)
    for r in range(ROUNDS if hot.limit(1).count() else 0):
        now = staged(with_comp(hot, links), "near_hot")
        one = now.groupBy("key", F.pmod(F.xxhash64("id", F.lit(-1 - r)), F.lit(SLOTS))).agg(F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("o"), "id", "n", "at", "comp")).alias("b")).select("key", "b.*")
        links.append(told(now.alias("a").join(one.alias("b"), "key").where(open_("a", "b")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))))
    now = staged(with_comp(keyed, links), "near_now")
    comps = now.groupBy("key", "comp").agg(F.count("*").alias("times"))
    main = comps.groupBy("key").agg(F.max(F.struct("times", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("main"))
    mixed = staged(now.join(main, "key"), "near_mixed")
    # of two with no link yet at least one is outside the key's largest component; of the shingles that two near copies share, the first ones are keys of both
    rare = mixed.where(F.col("held") <= MOST)
    pairs = rare.where("comp != main").alias("a").join(rare.alias("b"), "key").where(
        (F.col("a.comp") != F.col("b.comp")) & (F.col("a.n") + 1e-6 >= similarity * F.col("b.n")) & (F.col("b.n") + 1e-6 >= similarity * F.col("a.n"))
        & (F.expr("b.comp = b.main") | F.expr("a.id < b.id")))
    most, both = F.greatest("a.n", "b.n"), F.col("a.n") + F.col("b.n")
    shared = F.ceil(similarity / (1 + similarity) * both - 1e-6) - F.ceil(similarity * most - 1e-9) + 1
    pairs = pairs.select(F.greatest("a.id", "b.id").alias("src"), F.least("a.id", "b.id").alias("dst"), shared.alias("least"))
    pairs = pairs.groupBy("src", "dst").agg(F.count("*").alias("keys"), F.max("least").alias("least")).where(F.col("keys") >= F.col("least"))

    def candidates(table: pa.Table) -> pa.Table:
        """Pairs of one key (with one set outside its largest component, at least) that may be near copies, by sizes and by how many keys they share.

        A pair comes once: from the frequent key of least value that both sets have, and of pairs of parts from the one it lies in.
        """
        ids, n, comp, main = (table.column(c).to_numpy() for c in ("id", "n", "comp", "main"))
        key, part, crossed = table.column("key")[0].as_py(), table.column("own").to_numpy(), table.column("p")[0].as_py()
        stray = np.flatnonzero(comp != main)
        shared = both_hold(table.column("keys").to_pylist(), stray)
        before = both_hold([[k for k in often if k < key] for often in table.column("often").to_pylist()], stray)
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(stray), 256):
            a = stray[at:at + 256]
            na, nb = n[a, None].astype(np.float64), n[None].astype(np.float64)
            need = np.ceil(similarity / (1 + similarity) * (na + nb) - 1e-6) - np.ceil(similarity * np.maximum(na, nb) - 1e-9) + 1
            fits = (shared[at:at + 256] >= np.maximum(1, need)) & (comp[a, None] != comp[None]) & (na + 1e-6 >= similarity * nb) & (nb + 1e-6 >= similarity * na)
            fits &= before[at:at + 256] == 0
            if crossed["a"] != crossed["b"]:
                fits &= part[a, None] != part[None]
            x, y = np.nonzero(fits)
            out[0].append(np.maximum(ids[a[x]], ids[y]))
            out[1].append(np.minimum(ids[a[x]], ids[y]))
        found = np.unique(np.stack([np.concatenate(o) for o in out], axis=1), axis=0)
        return pa.table({"src": found[:, 0].copy(), "dst": found[:, 1].copy()})

    frequent = mixed.where(F.col("held") > MOST)
    often = staged(frequent.groupBy("id").agg(F.collect_list("key").alias("often")).join(sets.select("id", "keys"), "id"), "near_often")
    frequent = frequent.join(often, "id").withColumn("parts", F.ceil(F.col("held") / PART).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    two = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, own).alias("a"), F.greatest(i, own).alias("b")))
    frequent = frequent.withColumn("own", own).withColumn("p", F.explode(two)).select("key", "p", "own", "id", "n", "comp", "main", "keys", "often")
    more = staged(frequent.groupBy("key", "p").applyInArrow(candidates, "src long, dst long"), "near_frequent")
    links.append(told(pairs.select("src", "dst").unionByName(more)))
    return joined_all(links)


def without_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) without all but one row of each group that near copies join: the one of the least doc_id (null last), then of the least text hash.

    Near copies: Jaccard similarity of their sets of shingles (five words) at least 0.8, all pairs: by op4's fingerprints and index, and an exact way for the rest (see set_links). Texts without words
    are copies of each other, null among them. Rows of one doc_id are judged one by one. No rows: no rows.
    """
    rows = blocks(packed(docs), "near_rows")

    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(x, width)) for x in texts(batch.column("text"))]
            fps, bits = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "row", "doc_id", "hash")), fps, bits], names=["block", "row", "doc_id", "hash", "fp", "simhash"])

    prints = rows.select("block", "row", "doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "block long, row int, doc_id long, hash long, fp binary, simhash long")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "block", "row")).alias("first")
    # a block has the reader's partition above bit 32 and a number below it; it holds less than 2^20 rows
    pid, nth = F.shiftright("first.block", 32), F.col("first.block").bitwiseAND(F.lit((1 << 20) - 1))
    distinct = prints.groupBy("fp").agg(first, F.min("simhash").alias("simhash")).select("first", "simhash", (F.shiftleft(pid, 40) + F.shiftleft(nth, 20) + F.col("first.row")).alias("id"))
    distinct = staged(distinct, "near_distinct")
    links = set_links(rows, distinct.select("first.block", "first.row", "id", "simhash"), similarity, width)
    roots = components(links, "near_rounds")
    rooted = distinct.join(roots, distinct.id == roots.node, "left").select("first", F.coalesce("root", "id").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.block", "first.row")
    return unpacked(only(rows, chosen), docs.columns)
