"""The change log: admission, gaps, last assignments, states at cuts, snapshots, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def validate_batches(events: DataFrame, bodies: DataFrame, most: int = 16) -> DataFrame:
    """events (shard, seq, ident, body) -> (shard, seq, reason): of each batch the first rule it breaks, or null."""
    known = bodies.select("body", F.lit(1).alias("known"))
    e = events.join(known, "body", "left")
    g = e.groupBy("shard", "seq").agg(F.count("*").alias("n"), F.count_distinct("ident").alias("d"), F.max(F.col("body").isNotNull() & F.col("known").isNull()).alias("unknown"))
    return g.select("shard", "seq", F.when((F.col("n") > most) | (F.col("n") != F.col("d")), "batch-schema").when(F.col("unknown"), "unknown-body").alias("reason"))


def classify_deliveries(deliveries: DataFrame, bodies: DataFrame | None = None, shards: int | None = None, floor: int = 0, window: int = 128, most: int = 16) -> DataFrame:
    """deliveries (shard, seq, ident, body, arrival), the rows of one (shard, seq, arrival) being one delivery -> (shard, seq, arrival, outcome):
    event-schema, batch-schema, unknown-body, old, retention-window, ok, duplicate or conflicting-sequence, the first that holds.

    A repeat is a duplicate if the first well-formed delivery of its (shard, seq) has the same changes. Without bodies or shards these are not
    checked. How many deliveries may wait depends on all that came before; that rule, pending-window, is the stream's (streaming/feed.py).
    """
    change = F.xxhash64("ident", F.coalesce("body", F.lit("")), F.col("body").isNull())
    strange = F.lit(False)
    if bodies is not None:
        deliveries = deliveries.join(bodies.select("body", F.lit(True).alias("known")), "body", "left")
        strange = F.col("body").isNotNull() & F.col("known").isNull()
    d = deliveries.groupBy("shard", "seq", "arrival").agg(
        F.count("*").alias("n"), F.count_distinct("ident").alias("idents"), F.max(strange).alias("strange"),
        F.struct(F.count("*"), F.bit_xor(change), F.bit_xor(F.xxhash64(change, F.lit(1)))).alias("content"))
    schema = F.col("seq").isNull() | (F.col("seq") < 1) | F.col("shard").isNull()
    if shards is not None:
        schema = schema | ~F.col("shard").between(0, shards - 1)
    bad = F.when(schema, "event-schema").when((F.col("n") > most) | (F.col("n") != F.col("idents")), "batch-schema").when(F.col("strange"), "unknown-body")
    d = d.withColumn("bad", bad)
    first = F.min(F.when(F.col("bad").isNull(), F.struct("arrival", "content"))).over(W.partitionBy("shard", "seq"))
    out = F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.col("seq") <= floor, "old").when(F.col("seq") > floor + window, "retention-window")
    out = out.when(F.col("arrival") == F.col("first.arrival"), "ok").when(F.col("content") == F.col("first.content"), "duplicate").otherwise("conflicting-sequence")
    return d.withColumn("first", first).select("shard", "seq", "arrival", out.alias("outcome"))


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = 4096) -> DataFrame:
    """df with name: the place of each row (from 1) in the order of an integer column within key.

    Counts by stretches of the order column give each stretch its first number, so that no task sorts all rows of a key.
    """
    part = F.floor(F.col(order) / width)
    d = df.withColumn("_part", part)
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = d.groupBy(key, "_part").count().select(key, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(key, "_part").orderBy(order))
    return d.join(starts, [key, "_part"]).withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_before")


def placed(df: DataFrame, keys: tuple, order: str, name: str, keep, ranges: int | None = None) -> DataFrame:
    """df with name, the place of each row (from 0) by a column of any type within keys, and name_of, the rows of its keys.

    Splitters from a sample cut all rows into ranges by (keys, order), so that a group of any size lies in as many tasks as it fills; counts by range
    say where each range begins in its group. keep(df, name) ends a table's lineage: both passes must see the same ranges.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = keep(df.repartitionByRange(n, *keys, order).withColumn("_range", F.spark_partition_id()), f"{name}_ranges")
    sizes = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys)
    sizes = sizes.select(*keys, "_range", F.sum("_n").over(w).alias(f"{name}_of"), (F.sum("_n").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order)) - 1
    c, z = cut.withColumn("_inside", inside).alias("c"), sizes.alias("z")
    same = F.col("c._range") == F.col("z._range")
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"z.{k}"))
    return c.join(z, same).select(*[f"c.{x}" for x in df.columns], (F.col("_before") + F.col("_inside")).cast("long").alias(name), F.col(f"{name}_of"))


def frontiers(events: DataFrame, floor: int = 0) -> DataFrame:
    """(shard, frontier): the last position up to which the log has no gap above floor.

    A seq with no successor ends a stretch; the least such end of the stretch at floor is the frontier, found by a join, not by a sort of a shard.
    """
    s = events.where(F.col("seq") > floor).select("shard", "seq").distinct()
    shards = events.select("shard").distinct()
    s = s.unionByName(shards.withColumn("seq", F.lit(floor).cast("long")))
    after = s.select("shard", (F.col("seq") - 1).alias("seq"))
    return s.join(after, ["shard", "seq"], "left_anti").groupBy("shard").agg(F.min("seq").alias("frontier"))


def coverage(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (range_id, shard, lo, hi) with covered: every position of (lo, hi] is in the log.

    The log's positions are numbered once; a range is whole if its first and its last position are there and as far apart in number as in
    position. So a range of any length costs two lookups, and an empty one none.
    """
    places = numbered(events.select("shard", "seq").distinct(), "shard", "seq", "place")
    r = ranges.select("range_id", "shard", "lo", "hi")
    first, last = (places.select("shard", F.col("seq").alias(f"{c}_seq"), F.col("place").alias(c)) for c in ("a", "z"))
    j = r.withColumn("a_seq", F.col("lo") + 1).withColumn("z_seq", F.col("hi")).join(first, ["shard", "a_seq"], "left").join(last, ["shard", "z_seq"], "left")
    whole = F.coalesce(F.col("z") - F.col("a") == F.col("hi") - F.col("lo") - 1, F.lit(False))
    return j.select("range_id", "shard", "lo", "hi", ((F.col("hi") == F.col("lo")) | (F.col("hi") > F.col("lo")) & whole).alias("covered"))


def suffix(changes: DataFrame, bounds: DataFrame) -> DataFrame:
    """The changes in each shard's (lo, hi]; bounds (shard, lo, hi, ...) has a row a shard or more."""
    return changes.join(bounds, "shard").where((F.col("seq") > F.col("lo")) & (F.col("seq") <= F.col("hi")))


def final_assignments(changes: DataFrame, keys: tuple = ("shard",)) -> DataFrame:
    """(keys, ident, body): the last assignment of each ident; a tombstone stays as null."""
    last = F.max(F.struct("seq", "pos", "body")).alias("last")
    return changes.groupBy(*keys, "ident").agg(last).select(*keys, "ident", F.col("last.body").alias("body"))


def dirty_count(changes: DataFrame, keys: tuple = ("shard",)) -> DataFrame:
    return changes.groupBy(*keys).agg(F.count_distinct("ident").alias("dirty"))


def state_at(initial: DataFrame, changes: DataFrame, cut: DataFrame) -> DataFrame:
    """(shard, ident, body) at cut (shard, at): what was there and not touched since, and the live last assignments."""
    final = final_assignments(changes.join(cut, "shard").where("seq <= at"))
    return initial.join(final, ["shard", "ident"], "left_anti").select("shard", "ident", "body").unionByName(final.where("body is not null"))


def versions(initial: DataFrame, changes: DataFrame) -> DataFrame:
    """(shard, ident, body, from_seq, to_seq): every value an ident ever had and the positions [from, to) where it held; null to: still."""
    every = initial.select("shard", "ident", "body", F.lit(0).cast("long").alias("seq"), F.lit(-1).alias("pos")).unionByName(changes.select("shard", "ident", "body", "seq", "pos"))
    w = W.partitionBy("shard", "ident").orderBy("seq", "pos")
    return every.select("shard", "ident", "body", F.col("seq").alias("from_seq"), F.lead("seq").over(w).alias("to_seq"))


def _blocks(begin: str, end: str, levels: int):
    """The fewest aligned blocks (level, block), of 2 ** level positions each, that make up [begin, end)."""
    low, high = f"shiftright({begin} + shiftleft(1L, k) - 1, k)", f"shiftright({end}, k)"
    one = lambda test, at: f"CASE WHEN {low} < {high} AND {test} % 2 = 1 THEN struct(k AS level, {at} AS block) END"
    return F.expr(f"filter(flatten(transform(sequence(0, {levels}), k -> array({one(low, low)}, {one(high, f'{high} - 1')}))), x -> x IS NOT NULL)")


def state_as_of(versions: DataFrame, cuts: DataFrame) -> DataFrame:
    """(cut_id, shard, ident, body) for many cuts (cut_id, shard, at) at once.

    A version's interval is made of aligned blocks of 1, 2, 4, ... positions, two of each size at most, and a cut lies in one block of each size:
    the two meet in exactly one block or in none. So the join is one of equal keys, and a version meets only the cuts at which it held.
    """
    cuts = cuts.select("cut_id", "shard", F.col("at").cast("long").alias("at"))
    top = cuts.agg(F.max("at")).first()[0]
    levels = max(0, top if top is not None else 0).bit_length()
    v = versions.where(F.col("body").isNotNull() & (F.col("from_seq") <= max(0, top or 0)))
    v = v.withColumn("_end", F.least(F.coalesce("to_seq", F.lit(1 << levels)), F.lit(1 << levels)).cast("long"))
    v = v.select("shard", "ident", "body", F.explode(_blocks("from_seq", "_end", levels)).alias("_b")).select("shard", "ident", "body", "_b.level", "_b.block")
    c = cuts.where("at >= 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("block", F.expr("shiftright(at, level)"))
    return v.join(c, ["shard", "level", "block"]).select("cut_id", "shard", "ident", "body")


def diff_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shard, ident, before, after) where two states differ: changed, added (null before) or deleted (null after)."""
    x, y = a.select("shard", "ident", F.col("body").alias("before")), b.select("shard", "ident", F.col("body").alias("after"))
    return x.join(y, ["shard", "ident"], "full").where(~F.col("before").eqNullSafe(F.col("after")))


def convergence(replicas: DataFrame, members: DataFrame, state: DataFrame) -> DataFrame:
    """replicas (replica, shard, ident, body), members (replica, shard) and the state they should hold -> (replica, shard, differences):
    entries that a replica lacks, has besides or holds with another body; 0: it has converged."""
    keys = ["replica", "shard", "ident"]
    want = members.select("replica", "shard").join(state.select("shard", "ident", F.col("body").alias("want")), "shard")
    off = replicas.select(*keys, "body").join(want, keys, "full").where(~F.col("body").eqNullSafe(F.col("want"))).groupBy("replica", "shard").agg(F.count("*").alias("n"))
    return members.select("replica", "shard").join(off, ["replica", "shard"], "left").select("replica", "shard", F.coalesce("n", F.lit(0)).alias("differences"))


def snapshots_to_log(snapshots: DataFrame) -> DataFrame:
    """snapshots (version, shard, ident, body), versions from 0 without gaps -> the log that leads from each to the next:
    (shard, seq = version, ident, body), deletions as null. An ident changes once in a version, so its name orders a batch; numbered_changes adds places."""
    s = snapshots.select("version", "shard", "ident", "body")
    now, then = s.alias("n"), s.withColumn("version", F.col("version") + 1).alias("t")
    last = s.agg(F.max("version")).first()[0] or 0
    keys = ["version", "shard", "ident"]
    j = now.join(then, keys, "full").select(*keys, F.col("n.body").alias("body"), F.col("t.body").alias("was"))
    j = j.where((F.col("version") > 0) & (F.col("version") <= last) & ~F.col("body").eqNullSafe(F.col("was")))
    return j.select("shard", F.col("version").cast("long").alias("seq"), "ident", "body")


def numbered_changes(log: DataFrame, keep) -> DataFrame:
    """log (shard, seq, ident, body) with pos, each change's place in its batch by ident, from 0; a batch may be as large as a snapshot, so ranges of it are counted."""
    return placed(log, ("shard", "seq"), "ident", "pos", keep).select("shard", "seq", "pos", "ident", "body")


def set_digest(*columns: str):
    """A digest of a set of rows that needs no order: their number, and the sums and exclusive-ors of two 64-bit hashes."""
    h, g = F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1))
    return F.struct(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(g).alias("y"), F.sum(F.shiftright(h, 20)).alias("s"))


def check_expected_changes(log: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes of log (shard, seq, ident, ...) against those that each version was meant to make, expected (seq, ident) -> (verdicts, misfits).

    verdicts (seq, found, expected, fits): digests of the two sets are compared, so only two rows a version meet. misfits (seq, ident, why), why being unexpected or
    lacking, are looked for in versions that do not fit alone.
    """
    have, want = (d.select("seq", "ident").distinct() for d in (log, expected))
    a, b = (d.groupBy("seq").agg(set_digest("ident").alias(c)) for d, c in ((have, "a"), (want, "b")))
    verdicts = a.join(b, "seq", "full").select("seq", F.coalesce("a.n", F.lit(0)).alias("found"), F.coalesce("b.n", F.lit(0)).alias("expected"), F.col("a").eqNullSafe(F.col("b")).alias("fits"))
    off = verdicts.where("not fits").select("seq")
    x, y = have.join(off, "seq", "left_semi").withColumn("x", F.lit(True)), want.join(off, "seq", "left_semi").withColumn("y", F.lit(True))
    misfits = x.join(y, ["seq", "ident"], "full").where("x is null or y is null")
    return verdicts, misfits.select("seq", "ident", F.when(F.col("y").isNull(), "unexpected").otherwise("lacking").alias("why"))


def compact(initial: DataFrame, changes: DataFrame, floors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state folded up to floors (shard, at), and the log above."""
    return state_at(initial, changes, floors), changes.join(floors, "shard").where("seq > at").drop("at")


def safe_floors(consumed: DataFrame, bounds: DataFrame, window: int = 128) -> DataFrame:
    """consumed (shard, at), a row a token, and bounds (shard, base, frontier) -> (shard, floor): nothing that a token still
    needs goes, and no more than window positions stay for those without."""
    low = consumed.groupBy("shard").agg(F.min("at").alias("at"))
    return bounds.join(low, "shard", "left").select("shard", F.least(
        F.coalesce("at", "frontier"), F.greatest("base", F.col("frontier") - window)).alias("floor"))


def ownership_violations(state: DataFrame) -> DataFrame:
    """Idents that live in more than one shard."""
    return state.groupBy("ident").agg(F.count_distinct("shard").alias("shards")).where("shards > 1")


def install_epoch(state: DataFrame, epoch: int, at: int) -> DataFrame:
    """A state as the base of a new epoch, whose log begins after `at`."""
    return state.withColumn("epoch", F.lit(epoch)).withColumn("base", F.lit(at).cast("long"))


def of_epoch(requests: DataFrame, epochs: DataFrame) -> DataFrame:
    """requests with accepted: theirs is their shard's epoch."""
    return requests.join(epochs.select("shard", F.col("epoch").alias("now")), "shard", "left").withColumn("accepted", F.col("epoch").eqNullSafe(F.col("now"))).drop("now")
