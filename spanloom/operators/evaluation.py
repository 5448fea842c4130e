"""Evaluation of review items against labelled events, and the metrics of each group and split.

Labels: (label_id, source, grp, split, start, end, action, present, severity, ambiguous, x1, y1, x2, y2),
a null box for the whole frame. Items: (item_id, source, grp, start, end, advisory, kind, decision, x1,
y1, x2, y2), kind 'region' with a box, 'frame' or 'unknown'. A label belongs to one source, so all
that follows is keyed by source and time bucket, or by label or item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.scores import ratio
from spanloom.operators import boxes, intervals

CAUGHT = 0.80
FRAME_SHARE = 0.50
SHARED = 0.30


def positive() -> Column:
    return F.col("action").isin("BLUR", "CUT") | F.col("present")


def compatible(item: str, label: str, frame_area: float, safe_groups: tuple[str, ...]) -> Column:
    """Whether an item can stand for a label: unknown places never, frames for frames, boxes by shared area."""
    kind, whole = F.col(f"{item}kind"), F.col(f"{label}x1").isNull()
    own = (F.col(f"{item}x2") - F.col(f"{item}x1")) * (F.col(f"{item}y2") - F.col(f"{item}y1"))
    shared = boxes.intersection(item, label) >= SHARED * F.least(boxes.area(item), boxes.area(label))
    return F.when(kind == "unknown", False).when(whole, (kind == "frame") | (own >= FRAME_SHARE * frame_area)).when(kind == "frame", F.col(f"{item}grp").isin(*safe_groups)).otherwise(shared)


def matches(labels: DataFrame, items: DataFrame, width: float, frame_area: float, safe_groups: tuple[str, ...]) -> DataFrame:
    """Compatible pairs that overlap in time, with the common part (start, end)."""
    pairs = intervals.overlap_join(labels, items, "source", width)
    met = pairs.where((F.col("l_grp") == F.col("r_grp")) & compatible("r_", "l_", frame_area, safe_groups))
    return met.withColumns({"start": F.greatest("l_start", "r_start"), "end": F.least("l_end", "r_end")})


def _share(parts: DataFrame, key: str, whole: str, name: str) -> DataFrame:
    """Share of each key's length ``whole`` that the union of its parts covers."""
    length = parts.groupBy(key).agg(F.max(whole).alias("whole"))
    return intervals.union_length(parts, key).join(length, key).select(key, (F.col("union_seconds") / F.col("whole")).alias(name))


def score_labels(labels: DataFrame, items: DataFrame, width: float, frame_area: float, safe_groups: tuple[str, ...]) -> DataFrame:
    """Status of each label: trap_ok, trap_hit, ambiguous, caught, advisory_only, partial or missed; its coverage and best item."""
    met = matches(labels, items, width, frame_area, safe_groups).withColumn("whole", F.col("l_end") - F.col("l_start"))
    parts = met.select(F.col("l_label_id").alias("label_id"), "start", "end", "whole", "r_advisory")
    closeness = -F.abs((F.col("r_end") - F.col("r_start")) - F.col("whole"))
    rank = F.struct(~F.col("r_advisory"), F.col("end") - F.col("start"), closeness, -F.col("r_item_id"))
    best = met.groupBy(F.col("l_label_id").alias("label_id")).agg(F.max_by(F.struct(F.col("r_item_id").alias("id"), F.col("r_decision").alias("decision")), rank).alias("best"), F.count_if(F.col("r_decision").isin("BLUR", "CUT")).alias("edits"))
    all_, main = _share(parts, "label_id", "whole", "coverage"), _share(parts.where("not r_advisory"), "label_id", "whole", "main_coverage")
    joined = labels.join(best, "label_id", "left").join(all_, "label_id", "left").join(main, "label_id", "left").fillna(0.0, ["coverage", "main_coverage"]).fillna(0, ["edits"])
    status = F.when(~positive(), F.when(F.col("edits") > 0, "trap_hit").otherwise("trap_ok")).when(F.col("ambiguous"), "ambiguous").when(F.col("main_coverage") >= CAUGHT, "caught").when(F.col("coverage") >= CAUGHT, "advisory_only").when(F.col("coverage") > 0, "partial").otherwise("missed")
    agrees = F.when(F.col("status").isin("caught", "advisory_only"), F.col("best.decision") == F.col("action"))
    return joined.withColumn("status", status).withColumn("agrees", agrees).select("label_id", "grp", "split", "severity", "status", F.round("coverage", 4).alias("coverage"), F.round("main_coverage", 4).alias("main_coverage"), F.col("best.id").alias("best_item"), "agrees")


def score_items(labels: DataFrame, items: DataFrame, width: float, frame_area: float, safe_groups: tuple[str, ...]) -> DataFrame:
    """Verdict of each item that meets its source's labels: useful, ambiguous_only or false_positive."""
    met = matches(labels.where(positive()), items, width, frame_area, safe_groups).withColumn("whole", F.col("r_end") - F.col("r_start"))
    parts = met.select(F.col("r_item_id").alias("item_id"), "start", "end", "whole", "l_ambiguous")
    sure, unsure = _share(parts.where("not l_ambiguous"), "item_id", "whole", "sure"), _share(parts.where("l_ambiguous"), "item_id", "whole", "unsure")
    joined = items.join(sure, "item_id", "left").join(unsure, "item_id", "left").fillna(0.0, ["sure", "unsure"])
    verdict = F.when(F.col("sure") >= 0.5, "useful").when((F.col("sure") == 0) & (F.col("unsure") > 0), "ambiguous_only").otherwise("false_positive")
    return joined.select("item_id", "grp", "advisory", F.round("sure", 4).alias("share"), verdict.alias("verdict"))


def label_metrics(scored: DataFrame) -> DataFrame:
    """Counts and recalls of each group and split, and of each group over all splits."""
    caught, counted = F.col("status").isin("caught", "advisory_only"), F.col("status").isin("caught", "advisory_only", "partial", "missed")
    must = counted & (F.col("severity") == "must_catch")
    sets = scored.withColumns({"c": caught, "p": counted, "m": must}).groupingSets([["grp", "split"], ["grp"]], "grp", "split")
    out = sets.agg(
        F.grouping("split").alias("g"),
        F.count_if("p").alias("labels"),
        F.count_if("c").alias("caught"),
        F.count_if(F.col("status") == "missed").alias("missed"),
        F.count_if("m").alias("must_catch"),
        F.count_if(F.col("m") & F.col("c")).alias("must_caught"),
        F.count_if(F.col("status") == "trap_hit").alias("trap_hits"),
        F.count_if(F.col("agrees")).alias("agree"),
    )
    named = F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split")
    return out.select("grp", named, "labels", "caught", "missed", "must_catch", "must_caught", "trap_hits", "agree", ratio(F.col("caught"), F.col("labels")).alias("recall_all"), ratio(F.col("must_caught"), F.col("must_catch")).alias("recall_must"))
