"""Jobs and their stages, queues of tasks, decided cards as edits, and choices under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import boxes
from spanloom.operators.dealing import dealt
from spanloom.operators.graph import checkpointed
from spanloom.operators.intervals import islands, overlap_join
from spanloom.operators.queues import places

# States of work in a process, states that a stage may start from, the least blur, its share of a side, label parts of marks.
IN_PROCESS = ["PREFLIGHT", "SCANNING_SAFETY", "SCANNING_TEXT", "SCANNING_LOGO", "LOCALIZING_REGIONS", "BUILDING_REVIEW", "AI_AUDITING", "RENDERING", "VERIFYING"]
WAITING = ["PENDING", "FAILED_RETRYABLE"]
RECOVERABLE, RUNNING, PENDING, QUEUED = "INTERRUPTED_RECOVERABLE", "RUNNING", "PENDING", "QUEUED"
LEAST_SIGMA = 28
MARK_LABELS = ["brand logo", "channel watermark", "website banner"]


def blur_settings(width: Column, height: Column, share: float) -> list[Column]:
    """Strength and feather of a blur: by the region's shorter side and its height, the least without a region."""
    sigma = F.greatest(F.lit(LEAST_SIGMA), F.coalesce(F.bround(F.least(width, height) * share).cast("int"), F.lit(LEAST_SIGMA)))
    feather = F.when(height.isNull(), 0).otherwise(F.least(F.lit(4), F.greatest(F.lit(2), F.floor(height / 24).cast("int"))))
    return [sigma.alias("sigma"), feather.alias("feather")]


def approved_operations(cards: DataFrame, key: str, width: float, share: float) -> DataFrame:
    """The edits of decided cards: one for each time they apply to, cuts of a key that touch merged.

    cards: (key, card_id, decision, category, policy, start, end, detected, duration, note, reasons,
    region), region a struct (width, height) or null. An undecided card, or one outside its source,
    is an error. Returns (key, op_id, type, category, start, end, reason, card_ids, sigma, feather).
    A cut keeps the first one's id and category; it is found with its times merged in buckets, so
    a key's cuts are not sorted in one task.
    """
    open_ = F.col("decision").isNull() | (F.col("decision") == "NEEDS_MORE_CONTEXT")
    decided = cards.withColumn("decision", F.when(open_, F.raise_error(F.concat(F.lit("unresolved card "), F.col("card_id").cast("string")))).otherwise(F.col("decision"))).where("decision <> 'KEEP'")
    discrete = F.coalesce(F.col("policy") == "discrete_detected_intervals", F.lit(False))
    times = F.when(discrete, F.coalesce("detected", F.array().cast(cards.schema["detected"].dataType))).otherwise(F.array(F.struct("start", "end")))
    each = decided.withColumn("n", F.size(times)).select("*", F.posexplode(times).alias("place", "m"))
    base = F.concat(F.lit("op-"), F.regexp_replace("card_id", "^review-", ""))
    begin, finish = F.greatest(F.lit(0.0), F.col("m.start")), F.least("duration", F.col("m.end"))
    outside = F.raise_error(F.concat(F.lit("outside the source: "), F.col("card_id")))
    ops = each.select(
        key, F.when(F.col("n") > 1, F.concat(base, F.format_string("-%02d", F.col("place") + 1))).otherwise(base).alias("op_id"), F.lower("decision").alias("type"), "category", F.when(begin < finish, begin).otherwise(outside.cast("double")).alias("start"), finish.alias("end"),
        F.coalesce(F.when(F.col("note") != "", F.col("note")), F.array_join("reasons", ", ")).alias("reason"), "card_id", *[F.when(F.col("decision") == "BLUR", c).alias(n) for c, n in zip(blur_settings(F.col("region.width"), F.col("region.height"), share), ("sigma", "feather"), strict=True)],
    )
    cuts = ops.where("type = 'cut'")
    spans = islands(cuts.select(key, "start", "end"), key).select(key, "start", "end")
    met = overlap_join(spans, cuts.select(key, "start", "end", "op_id", "category", "reason", "card_id"), key, width)
    part = F.struct(F.col("r_start").alias("start"), F.col("r_op_id").alias("op_id"), F.col("r_category").alias("category"), F.col("r_reason").alias("reason"), F.col("r_card_id").alias("card_id"))
    merged = met.groupBy(key, F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    join = lambda a, r: F.when(a == "", r).when((r == "") | (r == a), a).otherwise(F.concat(a, F.lit("; "), r))
    reason = F.aggregate(F.transform("parts", lambda p: p["reason"]), F.lit(""), join)
    first = F.get("parts", F.lit(0))
    one = merged.select(key, first["op_id"].alias("op_id"), F.lit("cut").alias("type"), first["category"].alias("category"), "start", "end", reason.alias("reason"), F.transform("parts", lambda p: p["card_id"]).alias("card_ids"), *[F.lit(None).cast("int").alias(c) for c in ("sigma", "feather")])
    others = ops.where("type <> 'cut'").select(key, "op_id", "type", "category", "start", "end", "reason", F.array("card_id").alias("card_ids"), "sigma", "feather")
    return others.unionByName(one)


def stage_summary(stages: DataFrame, hits: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds of each stage, whether its result came from the cache while it ran, and its different artifacts.

    stages: (keys, started, completed), both times may be null; hits: (keys, at); artifacts: (keys, path).
    """
    during = F.col("at") >= F.col("started")
    ran = hits.join(stages.select(*keys, "started", "completed"), keys).where(during & (F.col("completed").isNull() | (F.col("at") <= F.col("completed"))))
    cached = ran.select(*keys).distinct().withColumn("cache_hit", F.lit(True))
    made = artifacts.groupBy(*keys).agg(F.count_distinct("path").alias("artifacts"))
    return stages.join(cached, keys, "left").join(made, keys, "left").select(*keys, F.timestamp_diff("SECOND", "started", "completed").alias("seconds"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), F.coalesce("artifacts", F.lit(0)).alias("artifacts"))


def started(requests: DataFrame, stages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (job, stage, job_state) that may start: the stage waits and the job is still in that state."""
    waiting = stages.where(F.col("state").isin(WAITING)).select("job", "stage")
    return requests.join(waiting, ["job", "stage"], "left_semi").join(jobs.select("job", F.col("state").alias("job_state")), ["job", "job_state"], "left_semi")


def recovered(jobs: DataFrame, stages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs (job, state, current) and stages (job, stage, state) after an unclean end: work in a process becomes resumable."""
    stale = F.coalesce(F.col("state").isin(IN_PROCESS), F.lit(False))
    lost = jobs.where(stale & (F.col("current") != "")).select("job", F.col("current").alias("stage")).distinct().withColumn("lost", F.lit(True))
    state = F.when(F.col("lost") & (F.col("state") == RUNNING), PENDING).otherwise(F.col("state"))
    return jobs.withColumn("state", F.when(stale, RECOVERABLE).otherwise(F.col("state"))), stages.join(lost, ["job", "stage"], "left").withColumn("state", state).drop("lost")


def next_queued(tasks: DataFrame, queue: str, excluded: DataFrame) -> DataFrame:
    """The task (queue, task, state, queued_at) that waited longest in each queue, of those not excluded; null times first, then the smaller id."""
    waiting = tasks.where(F.col("state") == QUEUED).join(excluded.select("task"), "task", "left_anti")
    return waiting.groupBy(queue).agg(F.min(F.struct(F.col("queued_at").isNotNull().alias("late"), "queued_at", "task")).alias("m")).select(queue, "m.task", "m.queued_at")


def limited(tracks: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """Review candidates, named platforms, the first others while there is room for ``most``, and others with evidence.

    tracks: (key, order, candidate, platform, evidence), order a whole number.
    """
    first = F.col("candidate") | F.col("platform")
    room = tracks.groupBy(key).agg(F.greatest(F.lit(0), F.lit(most) - F.count_if(first)).alias("room"))
    ranked = places(tracks.where(~first), key, F.lit(0), order).join(room, key)
    return tracks.where(first).unionByName(ranked.where((F.col("place") <= F.col("room")) | F.col("evidence")).select(*tracks.columns))


def representatives(windows: DataFrame, keys: list[str], most: int = 2) -> DataFrame:
    """Windows of a time bucket: the one most like an ident, of the rest the one most like an overlay, then the best scores.

    windows: (keys, start, ident_score, overlay_score, corner, score). Adds place, 1 to ``most``.
    """
    down = lambda c: F.col(c).desc_nulls_last()
    within = W.partitionBy(*keys)
    idents = F.row_number().over(within.orderBy(down("ident_score"), down("score"), "start"))
    rest = F.row_number().over(W.partitionBy(*keys, F.col("a") == 1).orderBy(down("overlay_score"), down("corner"), down("score"), "start"))
    kind = F.when(F.col("a") == 1, 1).when(F.col("b") == 1, 2).otherwise(3)
    ranked = windows.withColumn("a", idents).withColumn("b", rest).withColumn("kind", kind)
    return ranked.withColumn("place", F.row_number().over(within.orderBy("kind", down("score"), "start"))).where(F.col("place") <= most).drop("a", "b", "kind")


def grounding_fallback(found: DataFrame, regions: DataFrame, key: str, tile: int = 128, first: int = 64) -> DataFrame:
    """The box of each image that best supports what is there already, unless it only repeats a region.

    found: (key, id, x1, y1, x2, y2, label, score, width, height, focused), width and height those of
    the image, focused whether its centre is in the focus region; regions: (key, x1, y1, x2, y2).
    Boxes meet regions in tiles. No overlap is above 1, so where one of the ``first`` boxes by all else
    that ranks them has that, or an image has no region, the others can't be better and aren't compared.
    """
    share = boxes.area("l_") / F.greatest(F.lit(1), F.col("l_width") * F.col("l_height"))
    named = F.lit(False)
    for part in MARK_LABELS:
        named |= F.contains(F.lower(F.coalesce("l_label", F.lit(""))), F.lit(part))
    second = F.struct(F.col("l_focused").cast("int"), named.cast("int").alias("named"), F.coalesce("l_score", F.lit(0.0)).alias("score"), (-F.col("share")).alias("small"), (-F.col("l_id")).alias("first"))
    there = regions.where("x1 is not null")
    left = found.select(key, *[F.col(c).alias(f"l_{c}") for c in found.columns if c != key]).withColumn("share", share).where("share between 0.0001 and 0.35").withColumn("second", second)
    left = left.join(there.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    right = _tiled(there.select(F.col(key).alias("r_key"), *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")]).distinct(), "r_", tile)
    repeats = F.col("r_x1").isNotNull() & (boxes.iou("l_", "r_") >= 0.75) & (boxes.area("l_") <= boxes.area("r_") * 1.2)

    def best(rows: DataFrame) -> DataFrame:
        corner = (F.col("l_tx") == F.floor(F.greatest("l_x1", "r_x1") / tile)) & (F.col("l_ty") == F.floor(F.greatest("l_y1", "r_y1") / tile))
        same = (F.col(key) == F.col("r_key")) & (F.col("l_tx") == F.col("r_tx")) & (F.col("l_ty") == F.col("r_ty"))
        # of the tiles that both touch the first one counts
        met = dealt(_tiled(rows, "l_", tile), key, "l_tx", "l_ty").join(right, same & corner, "left").groupBy(key, "l_id", "l_label", "l_score", "l_focused", "second", "n").agg(
            F.coalesce(F.max(F.when(F.col("r_x1").isNotNull(), boxes.over_smaller("l_", "r_"))), F.lit(0.0)).alias("overlap"), F.coalesce(F.bool_or(repeats), F.lit(False)).alias("repeats")
        )
        supports = F.col("n").isNull() | (F.col("overlap") >= 0.5) | F.col("l_focused")
        return met.where(supports).groupBy(key).agg(F.max_by(F.struct("l_id", "repeats", "overlap", "n"), F.struct("overlap", "second")).alias("b"))

    leading = left.withColumn("place", F.rank().over(W.partitionBy(key).orderBy(F.col("second").desc()))).where(F.col("place") <= first).drop("place")
    checkpointed(found.sparkSession)
    sure = best(leading).where("b.overlap = 1 or b.n is null").checkpoint()
    rest = left.join(sure.select(F.col(key).alias("sure_key")), F.col(key).eqNullSafe(F.col("sure_key")), "left_anti")
    return sure.unionByName(best(rest)).where("not b.repeats").select(key, F.col("b.l_id").alias("id"), F.col("b.overlap").alias("overlap"))


def _tiled(rows: DataFrame, p: str, tile: int) -> DataFrame:
    """A row for each tile that a box touches."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / tile), F.floor(F.greatest(F.col(low), F.col(high)) / tile))
    return rows.withColumn(f"{p}tx", F.explode(span(f"{p}x1", f"{p}x2"))).withColumn(f"{p}ty", F.explode(span(f"{p}y1", f"{p}y2")))
