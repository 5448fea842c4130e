"""Choices under a budget: windows by quotas of time buckets, frames at equal measure of what is shown, clips between keyframes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.folds import folded, runs
from spanloom.operators.graph import checkpointed
from spanloom.operators.intervals import asof, islands
from spanloom.sources.shipping import ship

# Frames of a strip at least and at most, seconds that one stands for, what counts as equal.
LEAST_FRAMES, MOST_FRAMES, FRAME_SECONDS, SLACK = 8, 16, 2.0, 1e-6
# Seconds before and after a scored window, the gap over which a clip off the grid joins one on it, how far before a keyframe on the grid is looked for.
PRE_ROLL, POST_ROLL, JOIN_GAP, ALIGN = 35.0, 36.0, 180.0, 300.0


def _distributed(rows: DataFrame, key: str, wanted: Column, budget: int, step: int) -> DataFrame:
    """One round of choices: adds to ``chosen`` (the number of a choice, null if not chosen) of the rows that are ``wanted``.

    Each bucket has an equal share of what the budget still allows; buckets are served in order, the
    rest goes to the best of all. Counts per bucket decide how many of each are taken; rows are
    ranked within their bucket, and only the best of each bucket against each other.
    """
    best = [F.col("score").desc(), F.col("start"), F.col("window_id")]
    marked = rows.withColumn("wanted", wanted)
    left = F.lit(budget) - F.count_if(F.col("chosen").isNotNull())
    room = marked.groupBy(key).agg(left.alias("left"), F.countDistinct(F.when(F.col("wanted"), F.col("bucket"))).alias("n_buckets"))
    ranked = marked.join(room, key).withColumn("in_bucket", F.row_number().over(W.partitionBy(key, "bucket", "wanted").orderBy(*best)))
    quota = F.greatest(F.lit(1), F.floor(F.col("left") / F.greatest(F.lit(1), F.col("n_buckets"))))
    open_ = F.col("wanted") & F.col("chosen").isNull()
    ranked = ranked.withColumn("quota", F.when(F.col("left") > 0, open_ & (F.col("in_bucket") <= quota)).otherwise(False)).checkpoint()
    counts = ranked.where("quota").groupBy(key, "bucket").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(key, "bucket", ahead.alias("ahead"))
    ranked = ranked.join(starts, [key, "bucket"], "left")
    place = F.row_number().over(W.partitionBy(key, "bucket", "quota").orderBy(*best)) + F.col("ahead")
    first = F.when(F.col("quota") & (place <= F.col("left")), place)
    ranked = ranked.withColumn("first", first).checkpoint()
    taken = ranked.groupBy(key).agg(F.count("first").alias("taken"))
    ranked = ranked.join(taken, key)
    again = open_ & F.col("first").isNull() & (F.col("left") > 0)
    # of a bucket no more than the budget can be chosen now, so the others need no place among all
    near = ranked.withColumn("again", again).withColumn("nth", F.row_number().over(W.partitionBy(key, "bucket", "again").orderBy(*best)))
    few = near.where(F.col("again") & (F.col("nth") <= budget)).withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(*best))).where(F.col("nth") <= budget)
    second = few.where(F.col("nth") <= F.col("left") - F.col("taken")).select(key, "window_id", (F.col("taken") + F.col("nth")).alias("second"))
    out = ranked.join(second, [key, "window_id"], "left")
    number = F.coalesce("first", "second")
    return out.withColumn("chosen", F.coalesce("chosen", F.when(number.isNotNull(), F.struct(F.lit(step).alias("step"), number.cast("long").alias("n"))))).select(*rows.columns)


def selected_windows(windows: DataFrame, key: str, budget: int, scan_start: float, scan_end: float, bucket_seconds: float = 300.0) -> DataFrame:
    """The windows to look at, at most ``budget`` of each key: (key, window_id, place), place counting from 1.

    windows: (key, window_id, start, score, kind, representative, grp), kind one of boundary, regional, full, known. Boundary windows come
    first by time. Regional ones follow, then representatives of full frames, then the best of each group of known marks, then
    the other full frames and the other known ones, each spread over buckets of time. Other kinds are never chosen.
    """
    if budget <= 0 or bucket_seconds <= 0:
        raise ValueError("budget and bucket must be positive")
    last = max(1, -int(-max(0.0, scan_end - scan_start) // bucket_seconds)) - 1
    checkpointed(windows.sparkSession)
    bucket = F.least(F.lit(last), F.greatest(F.lit(0), F.floor((F.col("start") - scan_start) / bucket_seconds)))
    kind = F.coalesce("kind", F.lit(""))
    edge = F.row_number().over(W.partitionBy(key, "edge").orderBy("start", "window_id"))
    rows = windows.withColumn("bucket", bucket).withColumn("kind", kind).withColumn("edge", kind == "boundary")
    rows = rows.withColumn("chosen", F.when(F.col("edge") & (edge <= budget), F.struct(F.lit(0).alias("step"), edge.cast("long").alias("n"))))
    head = F.row_number().over(W.partitionBy(key, "kind", "grp").orderBy(F.col("score").desc(), "start", "window_id")) == 1
    rows = rows.withColumn("head", head & (F.col("kind") == "known") & F.col("grp").isNotNull()).drop("edge")
    full = F.col("kind") == "full"
    steps = [F.col("kind") == "regional", full & F.coalesce("representative", F.lit(False)), F.col("head"), full, F.col("kind") == "known"]
    for k, wanted in enumerate(steps, 1):
        rows = _distributed(rows, key, wanted, budget, k).checkpoint()
    chosen = rows.where("chosen is not null")
    return chosen.select(key, "window_id", F.row_number().over(W.partitionBy(key).orderBy("chosen")).alias("place"))


def _snapped(value: Column, low: Column, high: Column, fps: float | None) -> Column:
    """The next sample of a grid of ``fps`` in [low, high], the value itself if there is none."""
    if not fps:
        return F.round(value, 3)
    near = F.round(value * fps) / fps
    near = F.when(near < low - SLACK, F.ceil(low * fps - SLACK) / fps).otherwise(near)
    near = F.when(near > high + SLACK, F.floor(high * fps + SLACK) / fps).otherwise(near)
    return F.round(F.when((near < low - SLACK) | (near > high + SLACK), value).otherwise(near), 3)


def context_frames(segments: DataFrame, key: str, fps: float | None = None) -> DataFrame:
    """Times at the middles of equal parts of what the segments (key, start, end) cover, never in a gap: (key, t).

    Eight to sixteen, one for each two seconds. How much is covered before each island is a prefix sum,
    so an island knows which of the middles lie in it. A key that covers nothing has its first start.
    """
    joined = islands(segments.where("end >= start"), key, SLACK)
    length = F.col("end") - F.col("start")
    before = F.coalesce(F.sum(length).over(W.partitionBy(key).orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(length).over(W.partitionBy(key))
    rows = joined.withColumns({"before": before, "total": total}).where(F.col("total") > SLACK)
    count = F.least(F.lit(MOST_FRAMES), F.greatest(F.lit(LEAST_FRAMES), F.ceil(F.col("total") / FRAME_SECONDS - SLACK)))
    rows = rows.withColumn("width", F.col("total") / count).withColumn("count", count)
    low = F.when(F.col("before") == 0, 0).otherwise(F.floor((F.col("before") + SLACK) / F.col("width") - 0.5) + 1)
    high = F.least(F.col("count") - 1, F.floor((F.col("before") + length + SLACK) / F.col("width") - 0.5))
    inside = rows.withColumns({"low": low.cast("long"), "high": high.cast("long")}).where("low <= high").withColumn("nth_frame", F.explode(F.sequence("low", "high")))
    offset = F.col("start") + F.least((F.col("nth_frame") + 0.5) * F.col("width") - F.col("before"), length)
    times = inside.select(key, _snapped(offset, F.col("start"), F.col("end"), fps).alias("t"), F.lit(True).alias("shown"))
    starts = segments.where("end >= start").groupBy(key).agg(F.round(F.min("start"), 3).alias("t")).withColumn("shown", F.lit(False))
    # a key has sixteen times at most, so its first start stands beside them and no join looks for keys without any
    told = times.unionByName(starts).groupBy(key).agg(F.collect_set(F.when(F.col("shown"), F.col("t"))).alias("times"), F.min(F.when(~F.col("shown"), F.col("t"))).alias("first"))
    return told.select(key, F.explode(F.when(F.size("times") > 0, F.col("times")).otherwise(F.array("first"))).alias("t"))


def planned_clips(windows: DataFrame, keyframes: DataFrame, duration: float) -> DataFrame:
    """Clips between keyframes that cover all windows: (source, scored, origin, end, n_windows, segment_ids, on_grid), a null end is the film's.

    windows: (source, segment_id, scored, start, end); keyframes: (source, t, grid), grid says whether the detectors' sampling falls on it. A scored window
    gets margins. A clip begins at the last keyframe before, or at one on the grid within ALIGN seconds before that, and ends at the first
    keyframe after. Windows whose clips touch share one; a clip off the grid joins one on it within JOIN_GAP. Whether it does
    depends on where that clip began, so the last step is a fold, over runs of windows that a longer pause parts.
    """
    ship(windows.sparkSession)
    scored = F.col("scored")
    rows = windows.withColumn("low", F.col("start") - F.when(scored, PRE_ROLL).otherwise(0.0)).withColumn("high", F.col("end") + F.when(scored, POST_ROLL).otherwise(0.0)).withColumn("row", F.struct("source", "scored", "segment_id", "start"))
    last = asof(rows.select("source", "row", F.col("low").alias("t")), keyframes.select("source", "t"), "source", "t").withColumnRenamed("nearest", "last")
    both = asof(last, keyframes.where("grid").select("source", "t"), "source", "t")
    both = both.join(keyframes.groupBy("source").agg(F.min("t").alias("first_key")), "source", "left")
    aligned = F.when(F.col("nearest") >= F.col("t") - ALIGN, F.col("nearest"))
    origin = F.when(F.col("t") <= 0, F.col("first_key")).otherwise(F.coalesce(aligned, "last", "first_key"))
    begun = both.select("row", origin.alias("origin"))
    ends = asof(rows.select("source", "row", F.col("high").alias("t")), keyframes.select("source", "t"), "source", "t", forward=True)
    until = ends.select("row", F.when(F.col("t") < duration, F.col("nearest")).alias("until"))
    placed = rows.select("row", "source", "scored", "segment_id").join(begun, "row").join(until, "row").drop("row")
    placed = placed.join(keyframes.where("grid").select("source", F.col("t").alias("origin"), F.lit(True).alias("on_grid")).distinct(), ["source", "origin"], "left").withColumn("on_grid", F.coalesce("on_grid", F.lit(False)))
    keyed = placed.withColumns({"k": F.concat_ws("|", F.col("source").cast("string"), "scored"), "stop": F.coalesce("until", F.lit(float("inf")))})
    cut = runs(keyed, "k", "origin", "stop", JOIN_GAP)

    def fold(run):
        clip = None
        for r in run:
            touches = clip is not None and (clip["end"] == float("inf") or r.origin <= clip["end"] or (r.origin - clip["end"] <= JOIN_GAP and clip["grid"] and not r.on_grid))
            if touches:
                clip["end"] = max(clip["end"], r.stop)
            else:
                clip = {"origin": r.origin, "end": r.stop, "grid": bool(r.on_grid)}
            yield r.source, bool(r.scored), r.segment_id, clip["origin"], clip["grid"], r.stop

    kinds = {c: windows.schema[c].dataType.simpleString() for c in ("source", "segment_id")}
    told = folded(cut, ["k", "run"], ["origin", "stop", "segment_id"], fold, f"source {kinds['source']}, scored boolean, segment_id {kinds['segment_id']}, origin double, on_grid boolean, stop double")
    out = told.groupBy("source", "scored", "origin", "on_grid").agg(F.max("stop").alias("end"), F.count("*").alias("n_windows"), F.array_sort(F.collect_list("segment_id")).alias("segment_ids"))
    return out.withColumn("end", F.when(F.col("end") < float("inf"), F.col("end")))
