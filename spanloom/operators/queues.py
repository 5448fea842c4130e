"""Operational queue and log queries: order, latest rows, summaries, bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an aggregation, so no key is sorted as a whole."""
    best = df.groupBy(key).agg(F.max(F.struct(*order, *[c for c in df.columns if c not in (key, *order)])).alias("b"))
    return best.select(key, *[F.col("b").getField(c).alias(c) for c in df.columns if c != key])


def newest(df: DataFrame, key: str, order: str, keep: int, slices: int = 16) -> DataFrame:
    """A log bounded to the newest ``keep`` rows of each key, ranked in slices first."""
    part = W.partitionBy(key, "slice").orderBy(F.col(order).desc())
    whole = W.partitionBy(key).orderBy(F.col(order).desc())
    few = df.withColumn("slice", F.pmod(F.xxhash64(order), F.lit(slices))).withColumn("r", F.row_number().over(part)).where(F.col("r") <= keep)
    return few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= keep).drop("slice", "r")


def strata(df: DataFrame, bucket: Column, score: str, tie: str, keep: int) -> DataFrame:
    """The ``keep`` best rows of each bucket, the smallest ``tie`` first among equals."""
    order = W.partitionBy("bucket").orderBy(F.col(score).desc(), tie)
    return df.withColumn("bucket", bucket).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def under_budget(df: DataFrame, group: str, order: list[str], size: str, cap: float) -> DataFrame:
    """Newest rows of a group while their total size stays within ``cap``."""
    sofar = W.partitionBy(group).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("total", F.sum(size).over(sofar)).where(F.col("total") <= cap)


def numbered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Revision numbers 1, 2, ... of the rows of each key."""
    return df.withColumn("revision", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def unique_ids(df: DataFrame, parts: list[str], order: str) -> DataFrame:
    """A content-hash id of the given columns; rows that collide get an occurrence suffix."""
    base = F.concat(F.lit("item-"), F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), 1, 12))
    n = F.row_number().over(W.partitionBy("base").orderBy(order))
    named = df.withColumn("base", base).withColumn("n", n)
    return named.withColumn("item_key", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string")))).drop("base", "n")


def places(rows: DataFrame, key: str, first: Column, number: str, bins: int = 4096) -> DataFrame:
    """Adds ``place``, the rank of each row of a key by ``first`` and then by the whole number ``number``.

    Rows are ranked in bins of the number; what stands before a bin is summed over bins, so a key's
    rows don't meet in one task.
    """
    ends = rows.groupBy(key).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    bin_ = F.floor((F.col(number) - F.col("low")) * F.lit(bins) / (F.col("high") - F.col("low") + 1))
    dealt = rows.join(ends, key).withColumns({"first": first, "bin": bin_}).drop("low", "high")
    order = W.partitionBy(key).orderBy("first", "bin").rowsBetween(W.unboundedPreceding, -1)
    before = dealt.groupBy(key, "first", "bin").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0))).drop("c")
    own = F.row_number().over(W.partitionBy(key, "first", "bin").orderBy(number))
    return dealt.withColumn("own", own).join(before, [key, "first", "bin"]).withColumn("place", (F.col("before") + F.col("own")).cast("long")).drop("first", "bin", "before", "own")
