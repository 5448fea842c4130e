"""Sharding by proportional stratified interleaving, with DataFrame functions only.

The rows of each source are shuffled by a seeded hash and ranked; row r of a source of n rows has
the fractional rank (r + a) / n, where a is an offset in (0, 1) that the seed and the source decide.
All rows stand in the order of that number, so each stretch of the order holds every source in the
share it has of the whole, and equal cuts give shards of the same mixture.

Neither order is sorted in one task. Both numbers are close to uniform, so they are cut into bins of
about ``BIN_ROWS`` rows; running sums over the counts of bins, two levels of them, tell where each bin
begins, and only the rows of one bin are sorted together. Equal rows are one row with a count until
their places are dealt, so a hot id or a group of repeated rows is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import Staged

BIN_ROWS = 500
GROUP_BINS = 1000
RUN_ROWS = 10_000


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the SHA-256 of the parts, null as 'null'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def begun(bins: DataFrame, *keys: str) -> DataFrame:
    """Adds to a table of bins (keys, bin, n) the rows in bins before it (start) and in all of its key (total)."""
    wide = bins.withColumn("high", F.floor(F.col("bin") / GROUP_BINS))
    same = [F.col(k) for k in keys] or [F.lit(1)]
    groups = wide.groupBy(*keys, "high").agg(F.sum("n").alias("rows"))
    ahead = W.partitionBy(*same).orderBy("high").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(*keys, "high", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("base"), F.sum("rows").over(W.partitionBy(*same)).alias("total"))
    within = W.partitionBy(*keys, "high").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    wide = wide.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return wide.join(groups, [*keys, "high"]).select(*keys, "bin", (F.col("base") + F.col("inner")).alias("start"), "total")


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Deals all rows of docs to ``shards`` shards of the same mixture of sources.

    Returns (doc_id, *keep, size, text_crc32, law, shard, slot, grown_shard), a row for each row of
    docs. size is the number of UTF-8 bytes plus 1, a null text has no bytes and the checksum of
    none. law is ``rows``: shards differ by at most one row, whatever their sizes; slot counts the
    rows of a shard from 0; grown_shard is null, since this law moves rows everywhere when a shard
    is added. A null source is a source. Groups of equal texts are dealt as any rows: held together,
    a group of a third of all rows would break both the law and the mixture. Repeated rows get
    places of their own; which of two equal rows gets which can't be told. Ties of the hash stand by
    doc_id, size and checksum, so reruns agree. An empty table gives no rows, fewer rows than shards
    leave shards empty. keep names columns to carry, which must be comparable; others are ignored,
    whatever their names.
    """
    staged = Staged(docs.sparkSession)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    carried = F.struct(F.xxhash64("text").alias("tie"), *[F.col(c).alias(f"k_{c}") for c in keep])
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("stratum"), (F.length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), carried.alias("carried"))
    rows = rows.groupBy("doc_id", "stratum", "size", "text_crc32", "carried").agg(F.count("*").alias("copies"))
    rows = staged.write(rows.withColumn("u", unit(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("text_crc32"))), "rows")
    seen = rows.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()
    n = max(1, seen.n)

    binned = rows.withColumn("bin", F.floor(F.col("u") * (seen.kinds // BIN_ROWS + 1)))
    bins = begun(binned.groupBy("stratum", "bin").agg(F.sum("copies").alias("n")), "stratum")
    order = W.partitionBy("stratum", "bin").orderBy("u", "doc_id", "size", "text_crc32", "carried")
    ranked = binned.withColumn("ahead", F.sum("copies").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("copies")).join(bins, ["stratum", "bin"])
    ranked = ranked.select("doc_id", "stratum", "size", "text_crc32", "carried", "copies", "total", (F.col("start") + F.col("ahead")).alias("first"))
    # a row with copies takes as many ranks, written out by runs so that no array grows with them
    runs = ranked.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN_ROWS})")))
    each = runs.withColumn("rank", F.explode(F.expr(f"sequence(first + run * {RUN_ROWS}, first + least(copies - 1, run * {RUN_ROWS} + {RUN_ROWS - 1}))")))
    share = (F.col("rank") + unit(F.lit(seed), F.col("stratum"))) / F.col("total")
    each = each.withColumn("share", share).withColumn("bin", F.floor(F.col("share") * (n // BIN_ROWS + 1)))
    placed = staged.write(each.select("doc_id", "stratum", "size", "text_crc32", "carried", "rank", "share", "bin"), "ranked")
    starts = begun(placed.groupBy("bin").agg(F.count("*").alias("n"))).drop("total")
    inner = W.partitionBy("bin").orderBy("share", F.col("stratum").cast("binary"), "rank")
    dealt = placed.withColumn("place", F.row_number().over(inner) - 1).join(starts, "bin").withColumn("place", F.col("place") + F.col("start"))
    shard = F.expr(f"cast((place * {shards}) div {n} as int)")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return dealt.withColumn("shard", shard).select(
        "doc_id", *[F.col(f"carried.k_{c}").alias(c) for c in keep], "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: The same in DuckDB, which has no CRC-32: one fold over the bytes with the table of the polynomial.
ORACLE = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
raw AS (SELECT doc_id, source, coalesce(hex(encode(text)), '') AS h FROM documents),
sized AS (
  SELECT doc_id, source, length(h) // 2 + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM raw, crc),
keyed AS (
  SELECT *, coalesce('s' || source, 'n') AS stratum, (('0x' || sha256('0|' || coalesce(doc_id::VARCHAR, 'null') || '|' || size || '|' || text_crc32)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY u, doc_id, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS total,
         (('0x' || sha256('0|' || stratum)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS a
  FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank::DOUBLE + a) / total::DOUBLE, stratum, rank) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (place * 16 // n)::INTEGER AS shard,
       row_number() OVER (PARTITION BY place * 16 // n ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
