"""Interval algebra: sessions, islands, coverage, complements and pruning.

Intervals are rows with a key, ``start`` and ``end`` in seconds. A key may hold a large share of all
rows, so the sessionizer folds hits within time buckets first and only stitches the few partial
sessions of a key together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _stitch(parts: DataFrame, key: str, gap: float) -> DataFrame:
    """Numbers runs of rows (key, first, last) whose distance from all before is at most ``gap``."""
    before = W.partitionBy(key).orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(key).orderBy("first", "last").rowsBetween(W.unboundedPreceding, 0)
    opens = F.coalesce((F.col("first") - F.max("last").over(before) > gap).cast("int"), F.lit(1))
    return parts.withColumn("opens", opens).withColumn("run", F.sum("opens").over(upto)).drop("opens")


def sessionize(hits: DataFrame, key: str, time: str, score: str, evidence: str, gap: float, padding: float, bucket: float | None = None) -> DataFrame:
    """Groups hits of a key whose distance is at most ``gap`` and pads the groups.

    Returns (key, start, end, max_score, evidence, sample_count): evidence is that of the strongest
    hit, the earliest of equals. Starts don't go below 0. Hits with a null time are left out.
    """
    width = bucket or 16 * gap
    rows = hits.where(F.col(time).isNotNull()).select(key, F.col(time).alias("t"), F.col(score).alias("s"), F.col(evidence).alias("e"), F.floor(F.col(time) / width).alias("bucket"))
    inside = W.partitionBy(key, "bucket").orderBy("t")
    opens = F.coalesce((F.col("t") - F.lag("t").over(inside) > gap).cast("int"), F.lit(1))
    local = rows.withColumn("opens", opens).withColumn("part", F.sum("opens").over(inside.rangeBetween(W.unboundedPreceding, 0)))
    best = F.max(F.struct(F.col("s"), (-F.col("t")).alias("early"), F.col("e")))
    parts = local.groupBy(key, "bucket", "part").agg(F.min("t").alias("first"), F.max("t").alias("last"), best.alias("best"), F.count("*").alias("n"))
    runs = _stitch(parts, key, gap).groupBy(key, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("best").alias("best"), F.sum("n").alias("n"))
    return runs.select(
        key,
        F.greatest(F.lit(0.0), F.col("first") - padding).alias("start"),
        (F.col("last") + padding).alias("end"),
        F.col("best.s").alias("max_score"),
        F.col("best.e").alias("evidence"),
        F.col("n").alias("sample_count"),
    )


def merge_in_order(intervals: DataFrame, key: str, gap: float) -> DataFrame:
    """Merges an interval into the one before it, by start, if it begins at most ``gap`` after that one's end.

    The merged end is the last member's, also where an earlier member ends later.
    """
    order = W.partitionBy(key).orderBy("start", "end")
    opens = F.coalesce((F.col("start") - F.lag("end").over(order) > gap).cast("int"), F.lit(1))
    runs = intervals.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("start").alias("start"), F.max(F.struct("start", "end")).getField("end").alias("end"), F.count("*").alias("n_members")).drop("run")


def islands(intervals: DataFrame, key: str, gap: float = 0.0) -> DataFrame:
    """Union of the intervals of a key; touching ones merge, empty ones are left out."""
    parts = intervals.where("end > start").select(key, F.col("start").alias("first"), F.col("end").alias("last"))
    return _stitch(parts, key, gap).groupBy(key, "run").agg(F.min("first").alias("start"), F.max("last").alias("end")).drop("run")


def union_length(intervals: DataFrame, key: str) -> DataFrame:
    return islands(intervals, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("union_seconds"), F.count("*").alias("n_islands"))


def complement(intervals: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Parts of [low, high] (columns of the rows) that no interval covers."""
    bounds = intervals.groupBy(key).agg(F.min(low).alias("low"), F.max(high).alias("high"))
    order = W.partitionBy(key).orderBy("start")
    gaps = islands(intervals, key).withColumn("next", F.lead("start").over(order)).withColumn("first", F.row_number().over(order) == 1)
    joined = gaps.join(bounds, key)
    pieces = F.array(
        F.when(F.col("first"), F.struct(F.col("low").alias("start"), F.least("start", "high").alias("end"))),
        F.struct(F.greatest("end", "low").alias("start"), F.coalesce(F.least("next", "high"), F.col("high")).alias("end")),
    )
    return joined.select(key, F.explode(pieces).alias("p")).where("p.end > p.start").select(key, "p.start", "p.end")


def not_contained(intervals: DataFrame, key: str, identity: str, width: float) -> DataFrame:
    """Intervals of a key that no longer interval of the key contains; of equal ones the smallest identity stays.

    Containment is transitive here, so an anti join drops the same rows as the greedy order of durations.
    """
    cells = F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long")))
    outer = intervals.select(key, F.col(identity).alias("o_id"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), cells.alias("cell"))
    inner = intervals.withColumn("cell", F.floor(F.col("start") / width).cast("long"))
    longer = (F.col("o_end") - F.col("o_start") > F.col("end") - F.col("start")) | ((F.col("o_start") == F.col("start")) & (F.col("o_end") == F.col("end")) & (F.col("o_id") < F.col(identity)))
    inside = (F.col("o_start") <= F.col("start")) & (F.col("o_end") >= F.col("end")) & longer
    outer = outer.withColumnRenamed(key, "o_key").withColumnRenamed("cell", "o_cell")
    matched = inner.join(outer, (F.col(key) == F.col("o_key")) & (F.col("cell") == F.col("o_cell")) & inside, "left_anti")
    return matched.drop("cell")


def covered(targets: DataFrame, intervals: DataFrame, key: str, width: float) -> DataFrame:
    """Share of each target (key, t_start, t_end) that the union of the key's intervals covers."""
    merged = islands(intervals, key)
    hits = overlap_join(targets.withColumnRenamed("t_start", "start").withColumnRenamed("t_end", "end"), merged, key, width)
    length = hits.groupBy(key, "l_start", "l_end").agg(F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start")).alias("seconds"))
    length = length.withColumnsRenamed({"l_start": "t_start", "l_end": "t_end"})
    share = F.try_divide(F.coalesce("seconds", F.lit(0.0)), F.col("t_end") - F.col("t_start"))
    return targets.join(length, [key, "t_start", "t_end"], "left").select(key, "t_start", "t_end", F.coalesce(share, F.lit(0.0)).alias("covered"))


def covered_windows(intervals: DataFrame, key: str, width: float) -> DataFrame:
    """Covered share of the windows of ``width`` seconds from a key's first to its last: (key, t_start, t_end, covered).

    Each island is dealt to the windows it spans and summed there, so nothing is joined on time.
    """
    merged = islands(intervals, key)
    window = lambda c: F.floor(F.col(c) / width)
    dealt = merged.select(key, "start", "end", F.explode(F.sequence(window("start"), window("end"))).alias("w"))
    part = F.greatest(F.lit(0.0), F.least("end", (F.col("w") + 1) * width) - F.greatest("start", F.col("w") * width))
    filled = dealt.groupBy(key, "w").agg(F.sum(part).alias("seconds"))
    every = filled.groupBy(key).agg(F.explode(F.sequence(F.min("w"), F.max("w"))).alias("w"))
    out = every.join(filled, [key, "w"], "left")
    return out.select(key, (F.col("w") * width).alias("t_start"), (F.col("w") * width + width).alias("t_end"), (F.coalesce("seconds", F.lit(0.0)) / width).alias("covered"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of a key that overlap in time (touching is no overlap), by buckets of ``width`` seconds.

    Each side goes to the buckets it spans; a pair is kept in the bucket where its overlap begins,
    so it appears once.
    """

    def spread(df: DataFrame, p: str) -> DataFrame:
        named = df.select(F.col(key).alias(f"{p}_key"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key])
        ends = F.greatest(F.floor(F.col(f"{p}_start") / width), F.ceil(F.col(f"{p}_end") / width) - 1).cast("long")
        return named.withColumn(f"{p}_cell", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / width).cast("long"), ends)))

    l, r = spread(left, "l"), spread(right, "r")
    begins = F.floor(F.greatest("l_start", "r_start") / width).cast("long")
    met = (F.col("l_key") == F.col("r_key")) & (F.col("l_cell") == F.col("r_cell")) & (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (begins == F.col("l_cell"))
    return l.join(r, met).drop("l_cell", "r_cell", "r_key").withColumnRenamed("l_key", key)


def asof(left: DataFrame, right: DataFrame, key: str, time: str, forward: bool = False) -> DataFrame:
    """Adds to each left row the nearest time of the key's right rows at or before it (``forward``: at or after)."""
    both = left.select(key, F.col(time).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast("double").alias("found"))
    other = right.select(key, F.col(time).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(time).cast("double").alias("found"))
    order = W.partitionBy(key).orderBy(F.col("t").desc() if forward else F.col("t").asc(), "side").rowsBetween(W.unboundedPreceding, 0)
    return both.unionByName(other).withColumn("nearest", F.last("found", ignorenulls=True).over(order)).where("side = 1").select("row.*", "nearest")


def confirm(hits: DataFrame, key: str, index: str, frames: int, least: int) -> DataFrame:
    """Hits that belong to any window of ``frames`` consecutive frames with at least ``least`` hits."""
    ahead = W.partitionBy(key).orderBy(index).rangeBetween(0, frames - 1)
    behind = W.partitionBy(key).orderBy(index).rangeBetween(-(frames - 1), 0)
    return hits.withColumn("ahead", F.count("*").over(ahead)).withColumn("most", F.max("ahead").over(behind)).where(F.col("most") >= least).drop("ahead", "most")
