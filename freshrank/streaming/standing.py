"""State, postings and standing queries kept by micro-batches of the admitted feed.

What a batch changes is written under the batch's number, so that a batch that runs again, after a failure or a restart, writes the same in the same place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.log import final_assignments
from ..operators.rank import build_postings
from ..operators.tokens import KEYS, advance_tokens, keep_tokens, merge_tokens, refill_global, repair_lengths
from ..sources.scratch import staged

STATE = "shard int, ident string, body string, seq long, pos int"


class Versions:
    """Numbered versions of named tables below a shared folder; version -1 is the start."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def put(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")

    def get(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v{version}")


class Deltas:
    """A table as a base and the numbered deltas since: rows that a batch adds, tombstones among them, merged when it is read.

    A journal has, for each base and each delta that is whole, its version and its rows, so no reader lists folders or sees half a write. A fold makes a new base at a version; older
    ones stay readable. Versions are batch numbers; the start is -1.
    """

    def __init__(self, spark, root: str, name: str, schema: str):
        self.spark, self.path, self.schema = spark, f"{root.rstrip('/')}/{name}", schema
        spark.createDataFrame([], "kind string, version long, rows long").write.mode("append").parquet(f"{self.path}/journal")

    def _journal(self) -> list[tuple[str, int, int]]:
        """(kind, version, rows): one row for each table written, of which there are few."""
        rows = self.spark.read.schema("kind string, version long, rows long").parquet(f"{self.path}/journal").distinct().collect()
        return [tuple(r) for r in rows]

    def _write(self, df: DataFrame, kind: str, version: int) -> None:
        at = f"{self.path}/{kind}/v{version}"
        df.write.mode("overwrite").parquet(at)
        n = self.spark.read.schema(self.schema).parquet(at).count()
        self.spark.createDataFrame([(kind, version, n)], "kind string, version long, rows long").coalesce(1).write.mode("append").parquet(f"{self.path}/journal")

    def start(self, df: DataFrame) -> None:
        """The base, unless there is one from a run before."""
        if not any(kind == "base" for kind, _, _ in self._journal()):
            self._write(df, "base", -1)

    def add(self, df: DataFrame, version: int) -> None:
        self._write(df, "delta", version)

    def _parts(self, version: int) -> tuple[int, dict[int, int], int]:
        """The base's version, the deltas since with their rows, and the base's rows, as of a version."""
        journal = self._journal()
        base = max(v for kind, v, _ in journal if kind == "base" and v <= version)
        rows = next(n for kind, v, n in journal if kind == "base" and v == base)
        return base, {v: n for kind, v, n in journal if kind == "delta" and base < v <= version}, rows

    def raw(self, version: int) -> DataFrame:
        """All rows of the base and the deltas, replaced ones too."""
        base, deltas, _ = self._parts(version)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/base/v{base}", *[f"{self.path}/delta/v{v}" for v in sorted(deltas)])

    def due(self, version: int, share: float) -> bool:
        """Whether the deltas have more rows than so much of the base: then a fold costs no more than a constant for each row added since the last one."""
        _, deltas, rows = self._parts(version)
        return sum(deltas.values()) > share * max(1, rows)

    def fold(self, merged: DataFrame, version: int) -> None:
        self._write(merged, "base", version)


def latest(rows: DataFrame) -> DataFrame:
    """Of rows (shard, ident, body, seq, pos) the last by position of each ident; tombstones stay."""
    last = rows.groupBy("shard", "ident").agg(F.max(F.struct("seq", "pos", "body")).alias("v"))
    return last.select("shard", "ident", "v.body", "v.seq", "v.pos")


def at_start(initial: DataFrame) -> DataFrame:
    return initial.select(F.col("shard").cast("int").alias("shard"), "ident", "body", F.lit(0).cast("long").alias("seq"), F.lit(-1).alias("pos"))


def _run(feed: DataFrame, root: str, each) -> int:
    """Runs each(batch, version) over all that is there now; returns the last version, of this run or of one before it."""
    spark = feed.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        each(batch, n)
        spark.range(n, n + 1).coalesce(1).write.mode("append").parquet(f"{root}/done")

    spark.range(-1, 0).coalesce(1).write.mode("append").parquet(f"{root}/done")
    q = feed.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("id long").parquet(f"{root}/done").agg(F.max("id")).first()[0]


def stream_state(feed: DataFrame, initial: DataFrame, bodies: DataFrame, root: str, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(state, postings) after all of a streaming feed (shard, seq, pos, ident, body).

    A batch writes the last assignments it brings and their postings, and reads nothing of the state; so its cost follows its own size (bodies are joined by key). Positions decide what holds: a
    late batch cannot bring a deleted ident back, and postings count where their position is that of the ident's state. When the deltas outgrow `share` of the base, both tables are folded.
    """
    spark = feed.sparkSession
    state, postings = Deltas(spark, root, "state", STATE), Deltas(spark, root, "postings", "shard int, ident string, label string, seq long, pos int")
    place = ["shard", "ident", "seq", "pos"]

    def posted(rows: DataFrame) -> DataFrame:
        made = build_postings(rows.where("body is not null"), bodies).select("shard", "ident", "label")
        return made.join(rows.select(*place), ["shard", "ident"]).select("shard", "ident", "label", "seq", "pos")

    def current(n: int) -> tuple[DataFrame, DataFrame]:
        now = latest(state.raw(n))
        return now, postings.raw(n).join(now.where("body is not null").select(*place), place, "left_semi")

    start = at_start(initial)
    state.start(start)
    postings.start(posted(start))

    def each(batch: DataFrame, n: int) -> None:
        last = staged(latest(batch.select("shard", "ident", "body", "seq", "pos")), "batch")
        state.add(last, n)
        postings.add(posted(last), n)
        if state.due(n, share):
            now, then = current(n)
            state.fold(now, n)
            postings.fold(then, n)

    n = _run(feed, root, each)
    now, then = current(n)
    return now.where("body is not null").select("shard", "ident", "body"), then.select("shard", "label", "ident")


def stream_standing(feed: DataFrame, initial: DataFrame, heads: DataFrame, rows: DataFrame, scores: DataFrame, root: str, shards: int, k: int, base: int = 5,
                    most: int = 64, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Standing queries over an ordered feed (shard, seq, pos, ident, body), from tokens and a state (shard, ident, body) of the place where it begins.

    Every micro-batch adds its changes to the state (as stream_state does), advances all tokens in one step, repairs those that block an answer by
    prefixes of the state, in up to as many rounds as there are shards, and writes tokens, answers and repairs under its number. A run that begins anew in the same root goes on from there. A batch
    that does not begin right after the tokens' places, or has a gap, is an error. Returns (answers (version, query_id, rank, ident, body, score, status, repairs), repairs
    (version, query_id, shard)) of all batches so far.
    """
    spark = feed.sparkSession
    kept, state = Versions(spark, root), Deltas(spark, root, "state", STATE)
    state.start(at_start(initial))
    spark.range(-1, 0).coalesce(1).write.mode("append").parquet(f"{root}/done")
    if spark.read.schema("id long").parquet(f"{root}/done").agg(F.max("id")).first()[0] < 0:
        kept.put(heads, "heads", -1)
        kept.put(rows, "rows", -1)

    def each(batch: DataFrame, n: int) -> None:
        batch = staged(batch.select("shard", "ident", "body", "seq", "pos"), "batch")
        state.add(latest(batch), n)
        heads, rows = kept.get("heads", n - 1), kept.get("rows", n - 1)
        came = batch.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("top"), F.count_distinct("seq").alias("n"), F.count_distinct("ident").alias("dirty"))
        whole = (F.col("first") == F.col("at") + 1) & (F.col("n") == F.col("top") - F.col("at"))
        hi = heads.groupBy("shard").agg(F.max("at").alias("at")).join(came, "shard", "left")
        hi = hi.select("shard", F.when(F.col("top").isNull(), F.col("at")).when(whole, F.col("top")).otherwise(F.raise_error(F.lit("the feed has a gap"))).cast("long").alias("hi"), "dirty")
        hi = staged(hi, "hi")
        lengths = repair_lengths(heads.select(*KEYS), hi.where("dirty is not null").select("shard", "dirty"), k, base, most=most)
        new_heads, new_rows = keep_tokens(*advance_tokens(heads, rows, final_assignments(batch), hi.select("shard", "hi"), scores, most), staged)
        now = latest(state.raw(n))
        if state.due(n, share):
            state.fold(now, n)
            now = latest(state.raw(n))
        live = now.where("body is not null").select("shard", "ident", "body")
        new_heads, new_rows, done = refill_global(new_heads, new_rows, live, scores, hi.select("shard", "hi"), lengths, shards, k, staged, most)
        kept.put(new_heads, "heads", n)
        kept.put(new_rows.select(*KEYS, "ident", "body", "score"), "rows", n)
        kept.put(done.select(F.lit(n).cast("long").alias("version"), *KEYS), "repairs", n)
        best, answer = merge_tokens(kept.get("heads", n), kept.get("rows", n), shards, k)
        per_query = done.groupBy("query_id").agg(F.count("*").alias("repairs"))
        kept.put(answer.join(best, "query_id", "left").join(per_query, "query_id", "left").select(
            F.lit(n).cast("long").alias("version"), "query_id", F.col("rank").cast("long").alias("rank"), "ident", "body", "score", "status", F.coalesce("repairs", F.lit(0)).cast("long").alias("repairs")), "answers", n)

    n = _run(feed, root, each)
    return tuple(reduce(DataFrame.unionByName, [kept.get(name, v) for v in range(n + 1)]) for name in ("answers", "repairs"))
