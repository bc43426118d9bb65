"""Labels, corpora and query plans."""

from __future__ import annotations

import ast
import gc
import heapq
import keyword
import re
import textwrap
from collections import Counter
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..operators.log import placed
from ..sources.scratch import staged


def token_labels(text: Column) -> Column:
    """The sorted distinct tokens of a text: runs of a-z and 0-9 after lower-casing. Null text: none."""
    return F.sort_array(distinct_tokens(text))


def distinct_tokens(text: Column) -> Column:
    """As token_labels, in no order."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")), "")


def _terms(*trees: ast.AST) -> list[str]:
    """Names, attributes and called names of syntax trees, typed and lower-cased."""
    return sorted(_gathered(trees))


def _gathered(trees) -> set[str]:
    out, todo = set(), [*trees]
    while todo:
        node = todo.pop()
        kind = type(node)
        if kind is ast.Name:
            out.add(f"name:{node.id.lower()}")
        elif kind is ast.Attribute:
            out.add(f"attr:{node.attr.lower()}")
            todo.append(node.value)
        elif kind is ast.Call:
            if type(node.func) is ast.Name:
                out.add(f"call:{node.func.id.lower()}")
            elif type(node.func) is ast.Attribute:
                out.add(f"call:{node.func.attr.lower()}")
            todo.append(node.func)
            todo += node.args
            todo += node.keywords
        elif kind is ast.Expr:
            todo.append(node.value)
        elif kind is not ast.Constant:
            todo += ast.iter_child_nodes(node)
    return out


_BROKEN = (SyntaxError, RecursionError, ValueError, MemoryError)


def _labels(text: str) -> list[str] | None:
    try:
        return _terms(ast.parse(textwrap.dedent(text)))
    except _BROKEN:
        return None


@F.pandas_udf(ArrayType(StringType()))
def code_labels(source: pd.Series) -> pd.Series:
    """The label set of a piece of code; null where it can't be parsed."""
    return source.map(_labels, na_action="ignore")


#: Lines as Python's grammar has them; str.splitlines also splits at form feeds and the like.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def _functions(tree: ast.AST) -> list[tuple[str, int, int, int, ast.AST]]:
    """(qualified name, which of that name, first line, last line, node) of each function."""
    out: list = []
    seen: Counter = Counter()

    def visit(node, parents):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.expr):  # holds no definitions
                continue
            inner = parents
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                inner = [*parents, child.name]
                if not isinstance(child, ast.ClassDef):
                    qual = ".".join(inner)
                    seen[qual] += 1
                    out.append((qual, seen[qual], min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno, child))
            visit(child, inner)

    visit(tree, [])
    return out


def extract_fragments(files: DataFrame) -> DataFrame:
    """files (project, path, text) -> (project, path, qual, n, ident, source, line_start, line_end, reason): a row for each function, or
    one with a reason for a file that can't be parsed. n counts functions of one qualified name in a file."""

    def run(frames):
        for pdf in frames:
            rows = []
            for project, path, text in zip(pdf["project"], pdf["path"], pdf["text"], strict=True):
                try:
                    found = _functions(ast.parse(text))
                except _BROKEN as e:
                    rows.append((project, path, None, None, f"{project}/{path}", None, None, None, type(e).__name__))
                    continue
                lines = _LINE.findall(text)
                for qual, n, a, b, _ in found:
                    rows.append((project, path, qual, n, f"{project}/{path}:{qual}:{n}", "".join(lines[a - 1:b]), a, b, None))
            yield pd.DataFrame(rows, columns=["project", "path", "qual", "n", "ident", "source", "line_start", "line_end", "reason"]).astype({"n": "Int32", "line_start": "Int32", "line_end": "Int32"})

    return files.select("project", "path", "text").mapInPandas(
        run, "project string, path string, qual string, n int, ident string, source string, line_start int, line_end int, reason string")


_NAME = re.compile(r"([A-Za-z_][A-Za-z_0-9]*)")
_PLAIN = frozenset(" .,:;()[]{}=+-*/%@&|^~<>!")
_KEYWORDS = frozenset([*keyword.kwlist, *keyword.softkwlist])


class Statements:
    """Lines of code whose terms are known, so that a line which many files hold is parsed once.

    A line that parses by itself, as simple statements, means the same wherever a statement may stand, and in a file none of whose lines opens what another closes
    a statement may stand at each line. There all such lines with equal indents in a row are put as one `0` at the last one's place: what is left has the same functions
    at the same lines, and a fraction of the nodes. Any other file is parsed whole.
    """

    _SIMPLE = (ast.Expr, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Return, ast.Delete, ast.Raise, ast.Assert, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.Pass, ast.Break, ast.Continue)

    def __init__(self, most: int = 1 << 17):
        self.most = most
        #: Terms of a line of simple statements; None for other lines that end what they begin; False for those that may not.
        self.known: dict[str, tuple | bool | None] = {}
        #: What stands around a line's names -> the kind of each term and the number of its name; None and False as above.
        self.shapes: dict[tuple, tuple | bool | None] = {}

    @staticmethod
    def _other(line: str) -> bool | None:
        code = line.partition("#")[0]
        closed = not any(x in line for x in "'\"\\") and all(code.count(a) == code.count(b) for a, b in ("()", "[]", "{}"))
        return None if closed else False

    def _learn(self, lines) -> None:
        """Lines that differ in nothing but names that are no keywords parse alike: one of each such shape is parsed, with names that tell their places."""
        for line in lines:
            parts = _NAME.split(line)
            names, rest = parts[1::2], tuple(parts[::2])
            if not line.isascii() or not _PLAIN.issuperset("".join(rest)) or not _KEYWORDS.isdisjoint(names):
                self.known[line] = self._parsed(line)
                continue
            if rest not in self.shapes:
                got = self._parsed("".join(f"{x}q{i}q" for i, x in enumerate(rest[:-1])) + rest[-1])
                self.shapes[rest] = got and tuple((x[:x.index(":") + 1], int(x[x.index(":") + 2:-1])) for x in got)
            shape = self.shapes[rest]
            self.known[line] = shape and tuple(kind + names[i].lower() for kind, i in shape)

    def _parsed(self, line: str) -> tuple | bool | None:
        try:
            body = ast.parse(line).body
        except _BROKEN:
            return self._other(line)
        return tuple(_gathered(body)) if body and all(isinstance(x, self._SIMPLE) for x in body) else self._other(line)

    def fragments(self, text: str) -> list[tuple[str, int, int, list[str] | None]]:
        """(qualified name, which of that name, bytes, labels) of each function; raises one of _BROKEN where ast.parse does."""
        found = None if any(x in text for x in "\r\f\t\0") else self._brief(text)
        if found is None:
            lines, found = _LINE.findall(text), []
            for qual, n, a, b, _ in _functions(ast.parse(text)):
                source = "".join(lines[a - 1:b])
                found.append((qual, n, len(source.encode()), _labels(source)))
        return found

    def _brief(self, text: str):
        lines = text.split("\n")
        keys = [x.lstrip(" ") for x in lines]
        if len(self.known) > self.most:
            self.known.clear()
        if len(self.shapes) > self.most:
            self.shapes.clear()
        if new := {x for x in keys if x not in self.known}:
            self._learn(new)
        terms = [*map(self.known.__getitem__, keys)]
        stop = terms.index(False) if False in terms else len(terms)  # what follows is left as it is: a fault there or before shows without a whole parse
        terms[stop:] = [None] * (len(terms) - stop)
        indents = [len(x) - len(k) for x, k in zip(lines, keys, strict=True)]
        left = [x if t is None else "" if t2 is not None and i == i2 else " " * i + "0" for x, t, i, t2, i2 in zip(lines, terms, indents, [*terms[1:], None], [*indents[1:], -1], strict=True)]
        tree = ast.parse("\n".join(left))
        if stop < len(terms):
            return None
        functions = _functions(tree)
        others = [i for i, x in enumerate(terms) if x is None and keys[i]]
        out, plain = [], text.isascii()
        for qual, n, a, b, node in functions:
            own = terms[a - 1:b]
            if any(i < indents[a - 1] for i in (indents[x] for x in others if a <= x < b)):
                return None  # a comment to the left of its function
            size = sum(map(len, lines[a - 1:b])) if plain else sum(len(x.encode()) for x in lines[a - 1:b])
            out.append((qual, n, size + b - a + (b < len(lines)), sorted(_gathered([node]).union(*filter(None, own)))))
        return out


def labelled_fragments(files: DataFrame) -> DataFrame:
    """files (project, path, text) -> (ident, size, labels) of each function in the files that can be parsed: extract_fragments's ident, its source's bytes and code_labels, without the source."""

    def run(batches):
        known, out, n_labels = Statements(), [], 0
        def block():
            ident, size, labels = zip(*out, strict=True)
            ends = pa.array([None if x is None else y for x, y in zip([*labels, ()], [0, *accumulate(len(x or ()) for x in labels)], strict=True)], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array([*chain.from_iterable(x for x in labels if x)], pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(ident, pa.string()), pa.array(size, pa.int64()), lists], names=["ident", "size", "labels"])

        gc.disable()  # syntax trees hold no cycles
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for project, path, text in zip(*(batch.column(k).slice(at, 64).to_pylist() for k in range(3)), strict=True):
                    try:
                        found = known.fragments(text)
                    except _BROKEN:
                        continue
                    for qual, n, size, labels in found:
                        out.append((f"{project}/{path}:{qual}:{n}", size, labels))
                        n_labels += len(labels or ())
                if n_labels > 200_000:
                    yield block()
                    out, n_labels = [], 0
        if out:
            yield block()
        gc.enable()

    return files.select("project", "path", "text").mapInArrow(run, "ident string, size long, labels array<string>")


def admission(size: Column, labels: Column, most_bytes: int = 20_000, least_labels: int = 2) -> Column:
    """Null for a fragment that is admitted, else the reason."""
    return (F.when(size > most_bytes, "fragment-byte-bound").when(labels.isNull(), "unreadable").when(F.size(labels) < least_labels, "fewer-than-two-labels"))


def assign_shards(df: DataFrame, group: str, shards: int) -> DataFrame:
    """(group, shard): the ordinal of each distinct group name modulo shards."""
    names = df.select(group).distinct()
    return names.select(group, ((F.dense_rank().over(W.orderBy(group)) - 1) % shards).cast("int").alias("shard"))


def split_seeds(df: DataFrame, group: str, order: str, keep, per_group: int = 8) -> DataFrame:
    """df with is_seed: n = min(per_group, rows div 2) rows of each group at places (j + 1) * rows div (n + 1).

    Places come from counts by range (log.placed), so a group of any size is not sorted in one task. keep(df, name) ends a table's lineage.
    """
    d = placed(df, (group,), order, "_at", keep).withColumn("_n", F.least(F.lit(per_group).cast("long"), F.expr("_at_of div 2")))
    places = F.expr("transform(sequence(1, greatest(_n, 1)), j -> (j * _at_of) div (_n + 1))")
    return d.withColumn("is_seed", (F.col("_n") > 0) & F.array_contains(places, F.col("_at"))).drop("_at", "_at_of", "_n")


def label_df(bodies: DataFrame) -> DataFrame:
    """(label, df): how many bodies hold each label."""
    return bodies.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("df"))


def plan_rare(seeds: DataFrame, df: DataFrame, key: str, n: int = 4, call_first: bool = False) -> DataFrame:
    """(key, alt 0, pos, label): the n first labels of each seed by (calls first, if so asked, df, label)."""
    order = [F.when(F.col("label").startswith("call:"), 0).otherwise(1)] if call_first else []
    w = W.partitionBy(key).orderBy(*order, "df", "label")
    terms = seeds.select(key, F.explode("labels").alias("label")).join(df, "label")
    return terms.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n).select(key, F.lit(0).alias("alt"), F.col("pos").cast("int").alias("pos"), "label")


def shortlist(sets: DataFrame, df: DataFrame, key: str, n: int, call_first: bool = False, known: int = 1 << 16) -> DataFrame:
    """sets (key, labels) with fewer labels, among them still the n first of each set by (df, calls first, label), or by (calls first, df, label) if so asked.

    The frequencies of up to `known` labels, those above all the others', go to each task. Of a set that has n labels besides these, these are left out,
    and else only their first ones stay. So most pairs of set and label need not be joined with df. Labels that df lacks count as 0.
    """
    floor, above = 0, 0
    for x, labels in sorted(df.groupBy("df").agg(F.count("*")).collect(), reverse=True):  # far fewer values than labels: k values need k * k / 2 pairs
        above += labels
        if above > known:
            floor = x
            break
    often = df.sparkSession.sparkContext.broadcast(dict(map(tuple, df.where(F.col("df") > floor).select("label", "df").collect())))

    def first(labels, n):
        of = often.value
        rare = [x for x in labels if x not in of]
        if len(rare) >= n:
            return rare
        return rare + heapq.nsmallest(n - len(rare), (x for x in labels if x in of), key=lambda x: (of[x], not x.startswith("call:"), x))

    def one(labels):
        calls = [x for x in labels if x.startswith("call:")] if call_first else []
        if len(calls) >= n > 0:
            return first(calls, n)
        return calls + first([x for x in labels if not x.startswith("call:")] if call_first else labels, n - len(calls))

    def some(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few sets at once as Python's strings
                few = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([x if x is None else one(x) for x in few.column(1).to_pylist()], pa.list_(pa.string()))], names=[key, "labels"])

    return sets.select(key, "labels").mapInArrow(some, StructType([sets.schema[key], StructField("labels", ArrayType(StringType()))]))


def plan_calls_first(seeds: DataFrame, key: str, n: int = 4) -> DataFrame:
    """plan_rare of seeds (key, labels) with calls first, by how many of the seeds hold each label.

    Where a seed has n calls, no other label of it can come first. So there only calls are joined with frequencies, and other labels are counted only if a seed with
    fewer calls holds them.
    """
    is_call = lambda x: x.startswith("call:")
    split = staged(seeds.select(key, F.filter("labels", is_call).alias("calls"), F.filter("labels", lambda x: ~is_call(x)).alias("others")), "calls")
    enough = F.size("calls") >= n
    needed = staged(split.where(~enough).select(F.explode("others").alias("label")).distinct(), "needed")
    others = split.select(F.explode("others").alias("label"))
    others = others.join(F.broadcast(needed) if needed.count() <= 1 << 17 else needed, "label", "left_semi").groupBy("label").agg(F.count("*").alias("df"))
    df = staged(label_df(split.select(F.col("calls").alias("labels"))).unionByName(others), "df")
    first = split.select(key, F.when(enough, F.col("calls")).otherwise(F.concat("calls", "others")).alias("labels"))
    return plan_rare(shortlist(first, df, key, n, call_first=True), df, key, n, call_first=True)


def plan_stable_labels(versions: DataFrame, base: DataFrame, df: DataFrame, key: str, n: int = 4, bodies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """versions (key, version, body) of bodies (body, labels), or versions (key, version, labels), base (key) and df (label, df) -> (plans (key, alt 0, pos, label), rejected (key, pool)).

    The pool of a key in base is the labels in all its versions; of a key that came later, those in any. Pools of fewer than two
    labels are rejected, none is planned for them. Labels go by (df, calls first, label); one that df lacks counts as 0. A version whose body bodies lacks is none.

    The labels of all versions are never listed. What all versions share is in the one with the fewest labels; another confirms those, and all the rest what is
    left then. Of a pool of all labels in any version the first ones are among the first of some body, so each body is asked once for those. versions, bodies and df are read several times.
    """
    if bodies is None:
        versions = versions.select(key, "version", F.coalesce("labels", F.array()).alias("body"))
        bodies = versions.select("body", F.col("body").alias("labels")).distinct()
    bodies = bodies.select("body", F.array_compact("labels").alias("labels"))
    held = versions.select(key, "version", "body").join(bodies.select("body", F.size("labels").alias("size")), "body")
    held = staged(held.join(base.select(key).distinct().withColumn("at_base", F.lit(True)), key, "left"), "held")
    keys = held.groupBy(key, "version").agg(F.sum("size").alias("size"), F.max("at_base").alias("at_base"))
    keys = staged(keys.groupBy(key).agg(F.count("*").alias("all"), F.max("at_base").alias("at_base"), F.min(F.struct("size", "version")).alias("least")), "held_keys")

    old = held.where("at_base").join(keys.where("least.size > 0").select(key, F.col("least.version").alias("least")), key)
    near = old.where("version <> least").groupBy(key).agg(F.min(F.struct("size", "version")).alias("near"))
    old = old.join(near.select(key, F.col("near.version").alias("near")), key, "left")
    few = old.where("version = least").join(bodies, "body").select(key, "near", F.explode("labels").alias("label")).groupBy(key, "near").agg(F.collect_set("label").alias("few"))
    some = old.where("version = near").select(key, "body").join(few.select(key, "few"), key).join(bodies, "body").select(key, F.explode(F.array_intersect("few", "labels")).alias("label"))
    few = staged(few.where("near is null").select(key, "few").unionByName(some.groupBy(key).agg(F.collect_set("label").alias("few"))), "held_few")
    others = old.where("version <> least and version <> near").select(key, "version", "body").join(few, key).join(bodies, "body")
    seen = others.select(key, "version", F.explode(F.array_intersect("few", "labels")).alias("label")).groupBy(key, "label").agg(F.count_distinct("version").alias("in"))
    stable = few.join(keys.select(key, "all"), key).select(key, "all", F.explode("few").alias("label")).join(seen, [key, "label"], "left").where("all <= 2 + coalesce(in, 0)")

    later = held.where("at_base is null").select(key, "body").distinct()
    asked = bodies.join(later.select("body").distinct(), "body", "left_semi")
    order = [F.coalesce("df", F.lit(0)), F.when(F.col("label").startswith("call:"), 0).otherwise(1), "label"]
    most = max(n, 2)
    firsts = shortlist(asked, df, "body", most).select("body", F.explode(F.array_distinct("labels")).alias("label")).join(df, "label", "left")
    firsts = firsts.withColumn("place", F.row_number().over(W.partitionBy("body").orderBy(*order))).where(F.col("place") <= most)
    some = later.join(firsts.select("body", "label", "df"), "body").select(key, "label", "df").distinct()

    pool = stable.select(key, "label").join(df, "label", "left").select(key, "label", "df").unionByName(some)
    pool = pool.withColumn("pool", F.count("*").over(W.partitionBy(key)))
    plans = pool.where("pool >= 2").withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("pos") <= n)
    sizes = keys.select(key).join(pool.select(key, "pool").distinct(), key, "left").select(key, F.coalesce("pool", F.lit(0)).alias("pool"))
    return plans.select(key, F.lit(0).alias("alt"), F.col("pos").cast("int").alias("pos"), "label"), sizes.where("pool < 2")


def add_alternates(plans: DataFrame, mapping: dict[str, str], only: DataFrame | None = None) -> DataFrame:
    """plans (query_id, 0, pos, label) and, where mapping changes one, a second alternative: mapped, the first of equal labels kept."""
    pairs = F.create_map(*[F.lit(x) for p in mapping.items() for x in p])
    some = plans.join(only, "query_id", "left_semi") if only is not None else plans
    other = some.withColumn("to", F.coalesce(pairs[F.col("label")], F.col("label")))
    other = other.withColumn("changed", F.max(F.col("to") != F.col("label")).over(W.partitionBy("query_id"))).where("changed")
    other = other.groupBy("query_id", "to").agg(F.min("pos").alias("first"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("first"))
    return plans.unionByName(other.select("query_id", F.lit(1).alias("alt"), place.cast("int").alias("pos"), F.col("to").alias("label")))


def hash_sample_per_group(df: DataFrame, group: str, key: str, salt: str, n: int) -> DataFrame:
    """The n rows of each group with the least SHA-256 of salt and key."""
    order = F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("place") <= n)


def drop_seeds(initial: DataFrame, seeds: DataFrame) -> DataFrame:
    return initial.join(seeds.select("ident"), "ident", "left_anti")


def top_n_per_stratum(queries: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """The first n of each stratum by key, with full: whether it has n."""
    w = W.partitionBy(stratum)
    d = queries.withColumn("place", F.row_number().over(w.orderBy(key))).where(F.col("place") <= n)
    return d.withColumn("full", F.count("*").over(w) == n)


def activation_schedule(queries: DataFrame, ticks: int, active: int) -> DataFrame:
    """(tick, query_id): at tick t the `active` queries from place (t - 1) * active modulo their number, wrapping."""
    q = queries.select("query_id").distinct()
    q = q.withColumn("place", (F.row_number().over(W.orderBy("query_id")) - 1).cast("long")).withColumn("n", F.count("*").over(W.partitionBy()))
    ticks_ = F.expr(f"filter(sequence(1, {ticks}), t -> pmod(place - (t - 1) * {active}, n) < {active})")
    return q.select(F.explode(ticks_).alias("tick"), "query_id")


def body_id(source: Column, prefix: str = "b") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(source, 256), 1, 16))


def check_collisions(bodies: DataFrame) -> DataFrame:
    """Body ids that stand for more than one source."""
    return bodies.groupBy("body").agg(F.count_distinct("source").alias("sources")).where("sources > 1")


def labels_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """(body, agree) of two (body, labels), as sets; false where one of them lacks a body."""
    j = a.select("body", F.array_sort(F.array_distinct("labels")).alias("x")).join(b.select("body", F.array_sort(F.array_distinct("labels")).alias("y")), "body", "full")
    return j.select("body", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("agree"))
