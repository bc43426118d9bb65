"""URL filters: longest rule, and block decisions that spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, components, staged

#: (action, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TO = r"""(?is)\burl\s*=\s*["']?([^"'\s>;]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node(url: Column) -> Column:
    """What a url stands for among links: itself without its fragment."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def links(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> (src, dst): the page and what its canonical links and refreshes name, all of them, relative ones resolved."""
    named = lambda tag, what: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, what, 1))
    found = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", F.explode(F.concat(named(_CANONICAL, _HREF), named(_REFRESH, _TO))).alias("to"))
    root = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    to = F.replace("to", F.lit("&amp;"), F.lit("&"))
    full = (F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.regexp_extract("url", r"(?s)^(.*?:)//", 1), to))
            .when(to.startswith("/"), F.concat(root, to)).otherwise(F.concat(root, F.coalesce(F.regexp_extract(path(F.col("url")), r"(?s)^(.*/)", 1), F.lit("/")), to)))
    return found.where(F.col("to") != "").select(node(F.col("url")).alias("src"), node(full).alias("dst")).where(F.col("src") != F.col("dst"))


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (u, host, path; rows may repeat) -> distinct (u, rule, action) of those that a rule fits; the longest wins, then allow.

    A host is looked up with each of its own suffixes, so rules join by equality, however many there are.
    """
    u = urls.select("u", "host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    fits = u.select("u", "path", F.explode(tails).alias("rule_host")).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "allow").alias("is_allow"), rule.alias("rule"), "action")).alias("best")
    return fits.groupBy("u").agg(best).select("u", "best.rule", "best.action")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict.

    A page with a rule gets its verdict, allow included. Any other is blocked if its url is joined, by redirects and canonical
    links in either direction and over any number of steps, with a url that a rule blocks; else allowed.
    DataFrame functions only. Null url or none with a scheme: empty host and path, no rule, allow. Null html: no links. An empty table gives no rows; other
    columns, of whatever names, are not read. Repeated pages each give their row; urls and links are made distinct before they are joined.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "action string, rule_host string, rule_path string")
    base = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    edges = staged(links(pages), "url_links")
    comp = staged(components(edges, "url_rounds"), "url_components")
    nodes = comp.select(F.col("node").alias("u"), host(F.col("node")).alias("host"), path(F.col("node")).alias("path"))
    bad = judged(nodes, rules).where("action = 'block'").join(comp, F.col("u") == F.col("node")).select("root").distinct()
    spread = comp.join(bad, "root", "left_semi").select(F.col("node").alias("alias_of"), F.lit(True).alias("spread"))
    own = judged(base.where("url is not null").withColumn("u", F.concat("host", "path")), rules)
    out = base.withColumn("u", F.concat("host", "path")).join(own, "u", "left").withColumn("alias_of", node(F.col("url"))).join(spread, "alias_of", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("spread"), F.lit("block")), F.lit("allow")).alias("verdict"))


SQL = r"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
found AS (
  SELECT url, regexp_replace(unnest(list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))), '&amp;', '&', 'g') AS dest FROM pages
  UNION ALL
  SELECT url, regexp_replace(unnest(list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1))), '&amp;', '&', 'g') FROM pages),
edges AS (
  SELECT regexp_replace(url, '(?s)#.*$', '') AS src, regexp_replace(CASE WHEN contains(dest, '://') THEN dest
     WHEN starts_with(dest, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || dest
     WHEN starts_with(dest, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || dest
     ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || regexp_extract(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '(?s)^(.*/)', 1) || dest END, '(?s)#.*$', '') AS dst
  FROM found WHERE dest <> ''),
links AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
nodes AS (
  SELECT u, coalesce(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM (SELECT src AS u FROM links UNION SELECT url FROM pages)),
fits AS (
  SELECT nodes.u, action, rule_host || rule_path AS rule, row_number() OVER (PARTITION BY nodes.u ORDER BY length(rule_host || rule_path) DESC, action) AS n
  FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
own AS (SELECT * FROM fits WHERE n = 1),
reach(u) AS (SELECT u FROM own WHERE action = 'block' AND u IN (SELECT src FROM links) UNION SELECT links.dst FROM reach JOIN links ON links.src = reach.u)
SELECT p.page_id, n.host, n.path, own.rule,
  coalesce(own.action, CASE WHEN regexp_replace(p.url, '(?s)#.*$', '') IN (SELECT u FROM reach) THEN 'block' END, 'allow') AS verdict
FROM pages p JOIN nodes n ON p.url IS NOT DISTINCT FROM n.u LEFT JOIN own ON own.u = p.url
"""
