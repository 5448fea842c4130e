"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Each rule's expression is ``host`` + ``/...path``. A url expands into the expressions that could be
rules of its own: every suffix of its host at a dot, with every prefix of its path whose length some
rule has. Expressions meet rules on the first 32 bits of their SHA-256, the full digests confirm,
and the longest rule of a page decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules (verdict, host, path) of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PREFIX_HEX = 8


def parts(url: str = "url") -> dict:
    """Host and path of a url; both empty without ``://``."""
    rest = F.expr(f"case when {url} is not null and instr({url}, '://') > 0 then substr({url}, instr({url}, '://') + 3) else '' end")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def digests(expression) -> list:
    full = F.sha2(expression.cast("binary"), 256)
    return [F.substring(full, 1, PREFIX_HEX).alias("short"), full.alias("digest")]


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Verdict for each page by the longest rule (verdict, host, path) that fits its url.

    A rule fits its host and all subdomains of it if the path starts with the rule's path. Returns
    (page_id, host, path, rule, verdict), a row for each row of pages; rule is null and verdict
    ``default`` where none fits. Repeated pages each have their row, urls of any length are judged
    whole, an empty table of pages gives no rows and one of rules the default for all. Of rules of one length block wins over allow; a rule that is there
    twice counts once. Null urls and those without ``://`` have empty host and path. Other columns
    of pages are ignored.
    """
    listed = rules.select("verdict", F.lower("host").alias("host"), "path").distinct()
    text = F.concat("host", F.lit("\n"), "path")
    keyed = listed.select(F.concat("host", "path").alias("rule"), "verdict", *digests(text))
    keyed = keyed.groupBy("short", "digest", "rule").agg(F.max("verdict").alias("verdict"))
    # the lengths of rule paths, and of hosts in labels, bound what a url expands into
    sizes = listed.select(F.collect_set(F.length("path")).alias("lengths"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels")).first()
    lengths, labels = sorted(sizes.lengths), sorted(sizes.labels)
    split = pages.select("page_id", "url", *(c.alias(n) for n, c in parts().items()))
    urls = split.select("host", "path").distinct()
    # once for each different host and path, however many pages have it
    cut = urls.select("host", "path", F.split("host", r"\.").alias("h"))
    hosts = F.filter(F.array(*[F.when(F.size("h") >= n, F.array_join(F.slice("h", -n, n), ".")) for n in labels]), lambda x: x.isNotNull()) if labels else F.array().cast("array<string>")
    paths = F.filter(F.array(*[F.when(F.length("path") >= n, F.expr(f"left(path, {n})")) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    pairs = cut.select("host", "path", F.explode(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\n"), p))))).alias("expression"))
    hits = pairs.select("host", "path", *digests(F.col("expression"))).join(keyed.withColumnRenamed("digest", "full"), "short").where("digest = full")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict").alias("v"), F.col("rule").alias("rule"))).alias("best"))
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM parsed JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN hits USING (page_id)
"""
