"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, partitions, staged

#: Neither a letter nor ASCII white space.
MARKS = r"[^\p{L}\x20\x09-\x0D]"


def quality_weight() -> Column:
    """A weight from 0.0125 to 1 by the text's own shape: less the more of its characters are neither letters nor white space, and a fourth where
    a word has not 3 to 11 characters in the mean. Uses columns text and size (words); no text: as with neither."""
    n = F.greatest(F.coalesce(F.char_length("text"), F.lit(0)), F.lit(1))
    marks = F.coalesce(F.regexp_count("text", F.lit(MARKS)), F.lit(0)) / n
    mean = F.coalesce(F.char_length("text"), F.lit(0)) / F.greatest(F.col("size"), F.lit(1))
    return F.greatest(F.lit(0.05), 1.0 - 2.0 * marks) * F.when((mean >= 3.0) & (mean <= 11.0), F.lit(1.0)).otherwise(F.lit(0.25))


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = (5, 2, 1)) -> DataFrame:
    """sizes (source, source_size, ...) -> the same with sid (int, by code point, null last) and target (double).

    Weights repeat along sid. The targets sum to share times all sizes and stop at cap times their
    source's size; what stands above is shared again by weight. Written in closed form: sources fill in
    the order of cap / weight; the first whose cap is not below the level that is left gives the level.
    Works on one row a source, in one task.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("sid", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
    s = s.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = W.partitionBy()
    order = W.orderBy("ratio", "sid")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("place", F.row_number().over(order)).withColumn(
        "level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    hit = F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))
    s = s.withColumn("hit", F.min(hit).over(everything))
    return s.withColumn("target", F.when(F.col("place") < F.col("hit.place"), F.col("most"))
                        .otherwise(F.col("hit.level") * F.col("weight"))).drop("most", "ratio", "place", "level", "hit", "weight")


ORDER = ["key", "doc_id", "size", "text_hash"]


def in_buckets(d: DataFrame) -> DataFrame:
    """d (sid, key, doc_id, size, text_hash, ...) with bucket: ranges of (sid, key and what decides ties) that have about the same number of rows.

    There is a range for each shuffle partition, and its number rises with the order. The ranges are written once, as the sums over them and the order within them must see the same ones.
    """
    n = partitions(d.sparkSession)
    return staged(d.repartitionByRange(n, "sid", *ORDER).withColumn("bucket", F.spark_partition_id()), "mix_buckets")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = (5, 2, 1), seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text, source): how many of its words the mix takes.

    Columns: doc_id, source, size, source_size, target, epochs (complete passes), part (words of the last,
    fractional pass), taken = epochs * size + part, text_hash (tells texts of one doc_id apart).

    A source whose target is e times its size and a rest gives e complete epochs, then documents in the order of
    their Efraimidis-Spirakis key -ln(u) / weight until the rest is used up; the document at the edge gives
    its first words, so a source's taken words sum to floor(target). weight is quality_weight() or a column over doc_id, text, source and size. u comes
    from a digest of seed, doc_id and text: reruns agree, and rows that share a doc_id, null among them, spread.
    Prefix sums go by buckets of the key, cut where a sample of the keys themselves says (in_buckets), so that no task holds a source,
    whatever its weights are. Null text: size 0; null source: a source of its own, the last;
    null doc_id: as an empty one; rows with equal keys go by doc_id, size and text hash. An empty table gives no rows; other columns, of whatever names, are not read.
    """
    w = F.col("weight")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    base = docs.select("doc_id", "source", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    base = base.select("doc_id", "source", "size", F.xxhash64("text").alias("text_hash"), (quality_weight() if weight is None else weight).alias("weight"),
                       ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))).alias("u"))
    base = staged(base, "mix_sizes")
    totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(totals, share, cap, weights), "mix_targets")

    d = base.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", "b.source", "size", "text_hash", "sid", "source_size", "target", (-F.ln(F.col("u")) / w).alias("key"))
    d = in_buckets(d)
    sums = d.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(
        W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = W.partitionBy("sid", "bucket").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    d = d.join(sums, ["sid", "bucket"]).withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    d = d.withColumn("epochs", whole).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", rest - F.col("before"))))
    return d.select("doc_id", "source", "size", "source_size", "target", "epochs", "part",
                    (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "text_hash")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs, each row as often as it is taken whole, then the first words of what is taken in part.

    Repeated rows are numbered and matched one to one. A document of no words, which costs nothing, comes once. Columns of any names go along.
    """
    keys = ["doc_id", "source", "text_hash"]
    plan = mix(docs, **options).withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("part")))).alias("p")
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    mine = mine.select("doc", "doc.doc_id", "doc.source", F.xxhash64("doc.text").alias("text_hash"))
    mine = mine.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("text_hash"))).alias("m")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"p.{c}")) for c in keys[:2]] + [F.col(f"m.{c}") == F.col(f"p.{c}") for c in ("text_hash", "nth")]
    took = mine.join(plan, reduce(and_, same)).select("doc", "size", "epochs", "part")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + (F.col("part") == F.col("size")).cast("long"))
    copies = F.transform(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.col("doc.text"))
    first = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.array(first)).otherwise(F.array().cast("array<string>"))
    took = took.select("doc", F.explode(F.concat(copies, cut)).alias("text"))
    return took.select(*["text" if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(length(text), 0) AS n_cp, coalesce(len(regexp_extract_all(text, '[^\p{L}\x20\x09-\x0D]')), 0) AS marks, md5(coalesce(text, '')) AS text_md5 FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
s2 AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s1),
s3 AS (SELECT *, most / weight AS ratio FROM s2),
s4 AS (
  SELECT *, row_number() OVER o AS place,
    ((SELECT sum(source_size) FROM s3)::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(weight) FROM s3) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM s3 WINDOW o AS (ORDER BY ratio, sid)),
hit AS (SELECT arg_min(level, place) AS level, min(place) AS place FROM s4 WHERE level <= ratio),
t AS (SELECT s4.source, s4.source_size, CASE WHEN s4.place < hit.place THEN s4.most ELSE hit.level * s4.weight END AS target FROM s4, hit),
k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.source,
    -ln((CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || d.text_md5), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / (greatest(0.05::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * (d.marks::DOUBLE / greatest(d.n_cp, 1)))
       * CASE WHEN d.n_cp::DOUBLE / greatest(d.size, 1) BETWEEN 3 AND 11 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken
FROM p
"""
