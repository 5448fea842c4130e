"""Scan reports to review cards, and the triage of weak cards by the evidence of the intervals that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import cards

# Settings at which scans and verifications were measured, levels of the triage and limits of hints.
EXPLICIT_SCAN = {"sample_fps": 2.0, "threshold": 0.95}
VERIFIER = {"state": "SCORED", "sample_fps": 2.0, "frame_size": 448, "model": "image_safety_classifier_m", "target_label": "NSFW", "revision": "a5ce9eec1ac11773ca9ff44f45b1bb6591631562"}
TAGGER_SCAN = {
    "version": 1,
    "model": "SmilingWolf/wd-vit-tagger-v3",
    "revision": "7f6b584d0bd3f55c4531f14ba3d4761b2bccdc0f",
    "precision": "fp16",
    "sample_fps": 2.0,
    "merge_gap_seconds": 6.0,
    "window_frames": 5,
    "high_threshold": 0.20,
    "low_threshold": 0.05,
    "context_threshold": 0.02,
    "cooccurrence_threshold": 0.03,
    "high_score_temporal_minimum_hits": 3,
    "context_temporal_minimum_hits": 4,
}
LEVELS = {"off": (False, None), "credits": (True, None), "conservative": (True, (2, 0.7)), "balanced": (True, (5, 0.7))}
CREDITS_LABEL, CREDITS_GUARD = "hentai", 0.7
NO_BLOOD, NO_CORPSE, BLOOD_SEEN, CORPSE_SEEN = 0.0716, 0.0104, 0.5, 0.05
DECISIONS = ["KEEP", "BLUR", "CUT", "NEEDS_MORE_CONTEXT"]
BOUNDARIES = ["opening_boundary", "ending_boundary"]
KEPT_CLASSES = ["movie_title", "subtitle", "scene_text"]
PROMPT_PARTS = ["brand name when known", "when branding exists", "we are finding graphics", "graphics added before", "actual brand name"]


def measured_like(settings: Column, expected: dict) -> Column:
    """Whether a struct has the expected values, numbers to 1e-9; false where it or a field is null."""
    same = F.lit(True)
    for name, value in expected.items():
        field = settings[name]
        same &= (field == value) if isinstance(value, str) else (F.abs(field.cast("double") - value) < 1e-9)
    return F.coalesce(same, F.lit(False))


def verified(v: Column) -> Column:
    """A verification measured at the calibrated settings, with a score from 0 to 1 over one frame at least."""
    scored = v["nsfw_max"].between(0.0, 1.0) & ~F.isnan(v["nsfw_max"]) & (v["nsfw_frames"] > 0)
    return F.coalesce(scored, F.lit(False)) & measured_like(v, VERIFIER)


def valid_evidence(e: Column) -> Column:
    """All three maxima are there and from 0 to 1."""
    sound = F.lit(True)
    for name in ("blood_family_max", "injury_max", "corpse_max"):
        sound &= e[name].between(0.0, 1.0) & ~F.isnan(e[name])
    return F.coalesce(sound, F.lit(False))


def nothing_seen(blood: Column, corpse: Column) -> Column:
    return (blood <= NO_BLOOD) & (corpse <= NO_CORPSE)


def evidence_hint(blood: Column, injury: Column, corpse: Column) -> Column:
    """One line of what a tagger saw. Its words."""
    first = F.when(blood >= BLOOD_SEEN, "thấy máu").when(blood > NO_BLOOD, "máu yếu, nên xem kỹ").when(injury > blood, "chỉ vết thương, không thấy máu").otherwise("không thấy máu")
    second = F.when(corpse >= CORPSE_SEEN, "có thể là xác").when(corpse > NO_CORPSE, "có dấu hiệu xác (yếu), nên xem kỹ")
    return F.concat(F.lit("Tagger: "), F.concat_ws(" · ", first, second))


def cited(items: DataFrame, intervals: DataFrame, scan_type: str, style: str, tolerance: float = 1.0) -> DataFrame:
    """The intervals that items cite: one row for each different reference, with what is wrong with it.

    items: (item_id, start, end, refs); a reference reads ``report#interval:n``. intervals: (report,
    n, payload, scan_type, style, begin, finish, ...); payload is one id for a report and its
    aliases. Adds to each interval's columns item_id, place, problem (null if it can be used) and
    again (the item cites the interval at an earlier place too) and timed (the item has both times).
    An item without references has one row. Rows of an item are in one partition.
    """
    form = "^([^\\n]+)#interval:([0-9]+)$"
    refs = items.select("item_id", "start", "end", F.posexplode_outer(F.array_distinct("refs")).alias("place", "ref")).fillna(0, ["place"])
    asked = refs.select("*", F.translate(F.regexp_extract("ref", form, 1), "\\", "/").alias("report"), F.regexp_extract("ref", form, 2).try_cast("bigint").alias("n"))
    met = asked.join(intervals, ["report", "n"], "left")
    overlaps = F.coalesce((F.col("begin") <= F.col("end") + tolerance) & (F.col("finish") >= F.col("start") - tolerance), F.lit(False))
    right = F.coalesce((F.col("scan_type") == scan_type) & (F.col("style") == style), F.lit(False))
    problem = F.when(F.col("ref").isNull(), "no_source_refs").when(F.col("payload").isNull(), "unresolved_source_refs").when(~right, f"not_{style}_{scan_type}_scan").when(~overlaps, "stale_source_refs")
    place = F.row_number().over(W.partitionBy("item_id", "payload", "n").orderBy("place"))
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    return met.repartition("item_id").withColumns({"problem": problem, "again": place > 1, "timed": timed}).drop("ref", "start", "end")


def _considered(items: DataFrame, category: str, style: str) -> tuple[DataFrame, DataFrame]:
    """Items that a triage looks at, and the verdicts of all others."""
    mine = F.coalesce((F.col("category") == category) & F.col("decision").isNull() & (F.col("job_style") == style), F.lit(False))
    absent = F.coalesce(F.col("job_style"), F.lit("")) == ""
    why = F.when(F.coalesce(F.col("category") != category, F.lit(True)), None).when(absent, "content_style_missing").when(F.col("job_style") != style, f"content_style_not_{style}").otherwise("decided")
    return items.where(mine), items.where(~mine).select("item_id", F.lit("kept").alias("outcome"), F.lit(None).cast("string").alias("rule"), why.alias("reason"))


def _first_problem() -> Column:
    return F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("place"))).alias("problem")


def triage_explicit(items: DataFrame, intervals: DataFrame, level: str = "conservative") -> DataFrame:
    """Moves weak undecided cards of live action to the optional list: (item_id, outcome, rule, reason, n_seeds, verifier_max).

    items: (item_id, category, decision, job_style, start, end, refs); intervals: as of ``cited``
    with label, sample_count, scan (sample_fps, threshold) and verification (state, nsfw_max, sample_fps,
    nsfw_frames, frame_size, model, target_label, revision; null if there is none). A card moves by
    the credits rule (every interval has the label of credits and no sure verification says
    otherwise) or if both signals are weak; anything missing or measured otherwise keeps it.
    """
    credits, two = LEVELS[level]
    nothing = {"n_seeds": F.lit(None).cast("long"), "verifier_max": F.lit(None).cast("double")}
    if not credits and two is None:
        return items.select("item_id", F.lit("kept").alias("outcome"), F.lit(None).cast("string").alias("rule"), F.lit("level_off").alias("reason")).withColumns(nothing)
    mine, others = _considered(items, "adult", "live_action")
    v = F.col("verification")
    seeds = F.when(~F.col("again"), F.greatest(F.col("sample_count"), F.lit(0)))
    facts = cited(mine, intervals, "nsfw", "live_action").groupBy("item_id").agg(
        _first_problem(),
        F.coalesce(F.sum(seeds), F.lit(0)).cast("long").alias("n_seeds"),
        F.bool_and(verified(v)).alias("sure"),
        F.max(v["nsfw_max"]).alias("most"),
        F.bool_and(F.coalesce(F.lower(F.trim("label")) == CREDITS_LABEL, F.lit(False))).alias("titles"),
        F.bool_and(measured_like(F.col("scan"), EXPLICIT_SCAN)).alias("calibrated"),
        F.bool_or(v.isNull()).alias("missing"),
        F.bool_or(F.coalesce(v["state"] != "SCORED", F.lit(True))).alias("failed"),
    )
    most = F.when(F.col("sure"), F.col("most"))
    by_titles = F.lit(credits) & F.col("titles") & ~F.coalesce(most >= CREDITS_GUARD, F.lit(False))
    usable = F.col("problem").isNull() & F.col("calibrated")
    rule = F.when(usable & by_titles, "credits")
    why = F.coalesce("problem", F.when(~F.col("calibrated"), "uncalibrated_scan"))
    if two is None:
        why = F.coalesce(why, F.lit("no_rule_for_level"))
    else:
        rule = F.coalesce(rule, F.when(usable & (F.col("n_seeds") < two[0]) & (most < two[1]), "two_signal"))
        why = F.coalesce(why, F.when(F.col("missing"), "verification_missing").when(F.col("failed"), "verification_failed").when(~F.col("sure"), "verification_uncalibrated").otherwise("strong_evidence"))
    known = F.col("problem").isNull()
    judged = facts.select("item_id", F.when(rule.isNotNull(), "advisory").otherwise("kept").alias("outcome"), rule.alias("rule"), F.when(rule.isNull(), why).alias("reason"), F.when(known, F.col("n_seeds")).alias("n_seeds"), F.when(known, F.round(most, 6)).alias("verifier_max"))
    return judged.unionByName(others.withColumns(nothing))


def _gore_facts(mine: DataFrame, intervals: DataFrame) -> DataFrame:
    e = F.col("evidence")
    rows = cited(mine, intervals, "gore", "animation")
    once = ~F.col("again")
    facts = rows.groupBy("item_id").agg(
        _first_problem(),
        F.bool_and("timed").alias("timed"),
        F.count_if(once).alias("n"),
        F.bool_and(measured_like(F.col("scan"), TAGGER_SCAN)).alias("calibrated"),
        F.bool_and(valid_evidence(e)).alias("valid"),
        F.bool_and(nothing_seen(e["blood_family_max"], e["corpse_max"])).alias("clear"),
        *[F.max(e[c]).alias(c) for c in ("blood_family_max", "injury_max", "corpse_max")],
        F.sum(F.when(once, F.coalesce(e["confirmed_frames"], F.lit(0)))).cast("long").alias("confirmed_frames"),
        F.max_by(e["strongest_blood_label"], F.struct(F.coalesce(e["strongest_blood_label_score"], F.lit(0.0)), -F.col("place"))).alias("strongest_blood_label"),
    )
    return facts.withColumn("problem", F.when(~F.col("timed"), "stale_source_refs").otherwise(F.col("problem")))


def triage_tagged(items: DataFrame, intervals: DataFrame) -> DataFrame:
    """Moves undecided cards of animation whose every interval shows neither blood nor a corpse.

    items: as of ``triage_explicit``; intervals: as of ``cited`` with scan (the fields of TAGGER_SCAN)
    and evidence (blood_family_max, injury_max, corpse_max, confirmed_frames, strongest_blood_label,
    strongest_blood_label_score). Returns (item_id, outcome, rule, reason, n_intervals,
    blood_family_max, corpse_max).
    """
    mine, others = _considered(items, "gore", "animation")
    facts = _gore_facts(mine, intervals)
    why = F.coalesce("problem", F.when(~F.col("calibrated"), "uncalibrated_scan").when(~F.col("valid"), "evidence_missing").when(~F.col("clear"), "blood_or_corpse_seen"))
    known = why.isNull() | (why == "blood_or_corpse_seen")
    judged = facts.select(
        "item_id", F.when(why.isNull(), "advisory").otherwise("kept").alias("outcome"), F.when(why.isNull(), "C1").alias("rule"), why.alias("reason"), F.when(F.col("problem").isNull(), F.col("n")).otherwise(0).alias("n_intervals"),
        *[F.when(known, F.round(c, 6)).alias(c) for c in ("blood_family_max", "corpse_max")],
    )
    return judged.unionByName(others.withColumns({"n_intervals": F.lit(0).cast("long"), "blood_family_max": F.lit(None).cast("double"), "corpse_max": F.lit(None).cast("double")}))


def tag_evidence(items: DataFrame, intervals: DataFrame) -> DataFrame:
    """What a tagger saw in all intervals of a gore card, with a hint: only cards whose every interval has sound evidence."""
    sound = _gore_facts(items.where("category = 'gore'"), intervals).where("problem is null and valid")
    hint = evidence_hint(F.col("blood_family_max"), F.col("injury_max"), F.col("corpse_max"))
    return sound.select("item_id", "blood_family_max", "injury_max", "corpse_max", "confirmed_frames", F.col("n").alias("n_intervals"), "strongest_blood_label", hint.alias("hint"))


def report_cards(intervals: DataFrame) -> DataFrame:
    """One card for each usable box that an interval of a report proposes, or one for the interval.

    intervals: (report, n, scan_type, start, end, label, priority, reason, candidate, suggestion,
    boundary_window, boundary_state, full_frame_score, proposals), proposals an array of structs
    (box array<int> as x, y, width, height, suggestion, classification, labels). Promotions that fill
    the frame and forced boundaries are one card without a region. Returns (card_id, category,
    start, end, priority, labels, region, kind, candidate, classification, suggestion, ref).
    """
    category = F.when(F.col("scan_type") == "nsfw", "adult").otherwise(F.coalesce("scan_type", F.lit("unknown")))
    logo = category == "visual_logo"
    opening = (
        logo & (F.col("candidate").isNull() | (F.col("candidate") == "opening_promotion")) & (F.col("start") < 30) & (F.col("end") <= 30) & F.coalesce("boundary_window", F.lit(False))
        & (F.coalesce("boundary_state", F.lit("UNCERTAIN")) != "MOVIE_CONTENT") & (F.coalesce("full_frame_score", F.lit(0.0)) >= 0.65)
    )
    rows = intervals.withColumns({"category": category, "opening": F.coalesce(opening, F.lit(False))}).withColumn("candidate", F.when(F.col("opening"), "opening_promotion").otherwise(F.col("candidate")))
    cut = F.col("opening") | F.coalesce(F.col("candidate") == "branded_end_card", F.lit(False))
    forced = F.coalesce(F.col("candidate").isin(BOUNDARIES), F.lit(False))
    usable = F.filter("proposals", lambda p: F.size(p["box"]) == 4)
    none = F.array(F.lit(None).cast(intervals.schema["proposals"].dataType.elementType))
    offered = F.when(cut | forced | F.coalesce(F.size(usable) <= 0, F.lit(True)), none).otherwise(usable)
    each = rows.select("*", cut.alias("cut"), forced.alias("forced"), F.posexplode(offered).alias("place", "p"))
    p = F.col("p")
    x, y, width, height = (F.get(p["box"], F.lit(i)) for i in range(4))
    region = F.when((width > 0) & (height > 0), F.array(F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0)), width, height))
    filled = lambda c: F.when(c != "", c)
    logo_box = p.isNotNull() & (F.col("category") == "visual_logo")
    authorised = F.coalesce((p["classification"] == "external_brand") | (F.col("candidate") == "persistent_overlay"), F.lit(False))
    asked = F.coalesce(filled(p["suggestion"]), F.when(~logo_box | authorised, F.col("suggestion")))
    named = F.when(F.col("cut"), "CUT").when(~F.col("forced"), F.upper(asked))
    allowed = F.when(named.isin(DECISIONS) & ~((named == "BLUR") & region.isNull()), named)
    suggestion = F.when(F.coalesce(p["classification"].isin(KEPT_CLASSES), F.lit(False)), "KEEP").otherwise(allowed)
    kind = F.when(F.col("cut"), F.col("candidate")).when(p["classification"] == "movie_title", "title_overlay").when(F.col("category") == "visual_logo", "logo_overlay").otherwise(F.col("category"))
    flat = F.regexp_replace(F.lower(F.trim("label")), r"\s+", " ")
    prompt = F.lit(False)
    for part in PROMPT_PARTS:
        prompt |= flat.contains(part)
    label = F.when(~((F.col("category") == "visual_logo") & prompt), filled(F.trim("label")))
    labels = F.array_distinct(F.concat(F.array_compact(F.array(label)), F.coalesce(F.filter(p["labels"], lambda s: F.trim(s) != ""), F.array().cast("array<string>"))))
    token = F.concat_ws("|", "category", F.format_string("%.3f", "start"), F.format_string("%.3f", "end"), "report", F.concat(F.lit("proposal:"), F.col("place")), F.coalesce(F.array_join(region, ","), F.lit("full")))
    return each.select(
        F.concat(F.lit("review-"), F.substring(F.sha2(token, 256), 1, 12)).alias("card_id"), "category", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), cards.priority(F.col("priority"), F.col("reason")).alias("priority"),
        labels.alias("labels"), region.alias("region"), kind.alias("kind"), "candidate", p["classification"].alias("classification"), suggestion.alias("suggestion"), F.concat("report", F.lit("#interval:"), "n").alias("ref"),
    )
