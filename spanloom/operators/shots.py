"""Completion of intervals to the shots that they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6


def counted_in(windows: DataFrame, points: DataFrame, key: str, width: float, *counts: Column) -> DataFrame:
    """Windows (key, low, high, both included, ...) with aggregates over the points (key, t, ...) in them, by buckets of ``width``.

    t is null in the aggregates where a window holds no point; a window without bounds stays too.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    dealt = windows.withColumn("bucket", F.explode_outer(F.sequence(bucket("low"), bucket("high"))))
    met = dealt.join(points.withColumn("bucket", bucket("t")), [key, "bucket"], "left")
    return met.withColumn("t", F.when(F.col("t").between(F.col("low"), F.col("high")), F.col("t"))).groupBy(*windows.columns).agg(*counts)


def shot_context(intervals: DataFrame, samples: DataFrame, cuts: DataFrame, key: str, seed: float, context: float, padding: float, longest: float = 8.0, reach: float = 20.0, seeds: int = 5, share: float = 0.4, margin: float = 0.5) -> DataFrame:
    """Moves the edges of intervals out to the cuts of the shot around their first and last hit.

    intervals: (key, interval_id, start, end, duration); samples: (key, t, score); cuts: (key, t). The
    cut may lie ``longest`` beyond the edge, and the shot (to the next cut on the other side of the
    hit, ``reach`` from it at most) needs ``seeds`` samples of score ``seed`` and a share of samples
    of score ``context``. Returns (interval_id, start, end, start_status, end_status); edges only
    move outward. Samples and cuts are counted by time buckets, never collected.
    """
    both = F.explode(F.array(
        F.struct(F.lit(True).alias("opens"), F.col("start").alias("edge")),
        F.struct(F.lit(False).alias("opens"), F.col("end").alias("edge")),
    ))
    edges = intervals.select(key, "interval_id", "duration", both.alias("e")).select(key, "interval_id", "duration", "e.*")
    opens, edge = F.col("opens"), F.col("edge")
    # told from the edge at each step, so that they aren't shuffled
    anchor = F.when(opens, edge + padding).otherwise(edge - padding)
    limit = F.when(opens, edge <= EPSILON).otherwise(edge >= F.col("duration") - EPSILON)
    first, last = F.when(opens, edge - longest).otherwise(anchor - reach), F.when(opens, anchor + reach).otherwise(edge + longest)
    # an edge that is settled has no bounds and is copied to no bucket
    free = ~F.coalesce(limit, F.lit(False))
    edges = edges.withColumns({"low": F.when(free, first), "high": F.when(free, last)})
    t, width = F.col("t"), longest + reach
    edges = counted_in(edges, samples.where(F.col("score") >= seed).select(key, "t"), key, width, F.count_if(t < F.col("high")).alias("hits"))
    open_ = free & (F.col("hits") >= seeds)
    seen = edges.withColumns({"low": F.when(open_, F.greatest(F.lit(0.0), first - margin)), "high": F.when(open_, F.least("duration", last + margin))})
    before = t <= anchor + EPSILON
    outside = F.when(opens, (t >= edge - longest - EPSILON) & before).otherwise((t > anchor) & (t <= edge + longest + EPSILON))
    inside = F.when(opens, (t > anchor) & (t <= anchor + reach + EPSILON)).otherwise((t >= anchor - reach - EPSILON) & before)
    o1, o2 = F.max(F.when(opens & outside, t)), F.min(F.when(~opens & outside, t))
    i1, i2 = F.min(F.when(opens & inside, t)), F.max(F.when(~opens & inside, t))
    edges = counted_in(seen, cuts.select(key, "t"), key, width, F.coalesce(o1, o2).alias("cut"), F.coalesce(i1, i2).alias("other"))
    within = F.when(opens, F.col("cut") >= edge - EPSILON).otherwise(F.col("cut") <= edge + EPSILON)
    moves = ~limit & open_ & ~within
    low = F.when(opens, F.col("cut")).otherwise(F.coalesce("other", anchor - reach))
    high = F.when(opens, F.coalesce("other", anchor + reach)).otherwise(F.col("cut"))
    shots = edges.withColumns({"low": F.when(moves, low), "high": F.when(moves, high)}).drop("other")
    held = lambda least: F.count_if((t < F.col("high")) & (F.col("score") >= least))
    full = F.try_divide(held(context), F.count_if(t < F.col("high"))) >= share
    edges = counted_in(shots, samples.select(key, "t", "score"), key, width, (held(seed) >= seeds).alias("sure"), full.alias("full"))
    passes = F.coalesce(F.col("sure") & F.col("full"), F.lit(False))
    status = (
        F.when(limit, F.when(opens, "at_video_start").otherwise("at_video_end"))
        .when(F.col("hits") < seeds, "too_few_seeds_nearby")
        .when(F.col("cut").isNull(), "no_cut_within_reach")
        .when(within, "cut_inside_interval")
        .when(passes, "extended")
        .otherwise("evidence_gate_failed")
    )
    moved = F.when(status == "extended", F.when(opens, F.col("cut")).otherwise(F.least("duration", "cut"))).otherwise(edge)
    return edges.groupBy("interval_id").agg(*[
        F.max(F.when(opens == side, value)).alias(name)
        for side, value, name in ((True, F.round(moved, 3), "start"), (False, F.round(moved, 3), "end"), (True, status, "start_status"), (False, status, "end_status"))
    ])
