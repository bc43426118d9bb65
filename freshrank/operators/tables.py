"""Checks of tables: keys, differences, categories, domains, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def key_set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one table has, left or right."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def field_disagreements(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, left_value, right_value) of rows of one key whose fields differ."""
    j = a.alias("a").join(b.alias("b"), key)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").cast("string").alias("left_value"), F.col(f"b.{c}").cast("string").alias("right_value")) for c in columns]))
    return j.select(key, each.alias("f")).select(key, "f.*").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def category_check(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """expected (category, expected) with found: categories whose counts differ."""
    got = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("found"))
    j = got.join(expected, "category", "full").select("category", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found"))
    return j.where("expected <> found")


def rule_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that is not true of a row; null counts as not true."""
    bad = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(bad).alias("rule"))


def normalize_title(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(title), r"\\[a-z]+|[{}]", " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def missing_refs(df: DataFrame, key: str, refs: str, files: DataFrame) -> DataFrame:
    """(key, ref): parts of a `;`-separated column that files (path) has not."""
    r = df.select(key, F.explode(F.split(refs, ";")).alias("ref")).withColumn("ref", F.trim("ref")).where("ref <> ''")
    return r.join(files.select(F.col("path").alias("ref")), "ref", "left_anti").select(key, "ref")


def extract_keys(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """(key, occurrences): comma-separated keys in group 1 of every match."""
    hit = df.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("m"))
    return hit.select(F.explode(F.split("m", ",")).alias("key")).select(F.trim("key").alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("occurrences"))


def golden_diff(expected: DataFrame, actual: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """(key, field, expected, actual) where values differ: numbers beyond tolerance, others at all, rows that one side lacks too."""
    def long(df, name):
        cols = [c for c in df.columns if c != key]
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in cols])).alias("f")).select(key, "f.*")
    j = long(expected, "expected").join(long(actual, "actual"), [key, "field"], "full")
    near = F.abs(F.expr("try_cast(expected as double)") - F.expr("try_cast(actual as double)")) <= tolerance
    return j.where(~(F.col("expected").eqNullSafe(F.col("actual")) | F.coalesce(near, F.lit(False))))


def inventory_check(declared: DataFrame, files: DataFrame, group: str, size: str) -> DataFrame:
    """declared (group, files, bytes) against files (group, size): (group, files, found_files, bytes, found_bytes) of groups that differ."""
    got = files.groupBy(group).agg(F.count("*").alias("found_files"), F.sum(size).cast("long").alias("found_bytes"))
    j = declared.join(got, group, "full").fillna(0, ["files", "bytes", "found_files", "found_bytes"])
    return j.where("files <> found_files or bytes <> found_bytes").select(group, "files", "found_files", "bytes", "found_bytes")


def digest_mismatches(files: DataFrame, declared: DataFrame, key: str, content: str) -> DataFrame:
    """Keys whose content's SHA-256 is not the one declared (key, sha256), or that only one side has."""
    got = files.select(key, F.sha2(content, 256).alias("found"))
    return got.join(declared.select(key, "sha256"), key, "full").where(~F.col("found").eqNullSafe(F.col("sha256"))).select(key)


def forbidden_paths(df: DataFrame, names: list[str], suffix_pattern: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return df.where(name.isin(names) | name.rlike(suffix_pattern))
