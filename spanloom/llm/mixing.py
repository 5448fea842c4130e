"""Mixing sources to target weights with DataFrame functions only.

Targets come from a water-filling over the per-source totals. Within a source documents stand in
Efraimidis-Spirakis order: an exponential key -ln(u) / quality weight, u a hash of the id. Whole
epochs of the source come first; what is left of its budget goes to the prefix of that order.

Prefix sums over a source don't gather it in one task: the keys are cut into bins of about
``BIN_ROWS`` rows, a running sum over the small table of bins gives where each bin begins, and only
the rows of one bin are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, Staged

BIN_ROWS = 500
WEIGHTS = (5, 2, 1)
CAP = 3


def words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the id's SHA-256."""
    head = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """Adds target to a table of sources (source, n_rows, source_size).

    Sources by code point, null last, weigh 5, 2, 1 and so on and share the total by weight; no
    target is above CAP times its source, the excess goes to the others by weight. That is a level
    of words per weight, found by one pass over the sources in the order in which they fill up.
    The table has a row per source, so its windows need no partition.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    every = W.partitionBy(F.lit(1))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", (F.col("source_size") * CAP).cast("double")).withColumn("fill", F.col("cap") / F.col("weight"))
    up = W.partitionBy(F.lit(1)).orderBy("fill", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, -1)
    level = weighed.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_weight", F.sum("weight").over(every))
    level = level.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(up), F.lit(0.0))))
    # the level rises as long as the sources before are rightly held at their caps, and falls after
    level = level.withColumn("level", F.max("level").over(every))
    return level.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select("source", "n_rows", "source_size", "target")


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mixes all documents to the targets of their sources.

    Returns (doc_id, *keep, size, source_size, target, taken), a row for each row of docs. size is
    the number of words (null text: 0). taken is in [0, CAP * size]: whole epochs, and for the rest
    of the budget the first documents by key, the last of them in part. Labelled rows of quality 1
    weigh 2, all others 1. A null source is a source of its own, the last. Rows with one doc_id
    share a key and stand by size and text, so reruns agree; a null id is keyed as 'null', so
    all such rows of a source stand in one bin, in one task. Texts of any length count whole. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    rows = docs.select("doc_id", *dict.fromkeys(["source", *keep]), words().alias("size"), F.xxhash64("text").alias("tie"))
    quality = F.lit(1.0)
    if labels is not None:
        graded = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
        rows = rows.join(graded, "doc_id", "left")
        quality = F.when(F.col("quality") == 1, 2.0).otherwise(1.0)
    key = -F.log(unit(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))) / quality
    rows = staged.write(rows.withColumn("key", key).drop("quality"), "sized")
    per_source = targets(rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")))
    per_source = staged.write(per_source.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"), "targets")
    # 1 - exp(-key) is close to uniform, so each bin holds about BIN_ROWS rows
    keyed = rows.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(per_source, "source_key")
    binned = staged.write(keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * F.ceil(F.col("n_rows") / BIN_ROWS))), "binned")
    before = W.partitionBy("source_key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = binned.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size"))
    bins = staged.write(bins.select("source_key", "bin", F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("bin_start")), "bins")
    within = W.partitionBy("source_key", "bin").orderBy("key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = binned.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bins, ["source_key", "bin"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("bin_start") - F.col("ahead")))
    return placed.select("doc_id", *keep, "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || sha256(d.doc_id::VARCHAR)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / CASE WHEN l.quality = 1 THEN 2.0 ELSE 1.0 END AS key
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, cap / weight AS fill,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
  FROM sources WINDOW up AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM filled),
placed AS (
  SELECT s.doc_id, s.size, l.source_size, l.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         CASE WHEN l.source_size > 0 THEN floor(l.target)::BIGINT // l.source_size ELSE 0 END AS epochs
  FROM sized s JOIN leveled l ON s.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken
FROM placed
"""
