"""Decision tables over tag probabilities and text tracks, thresholds as parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.scores import probabilistic_union


def chances(tags: Column, labels: list[str]) -> Column:
    """Probabilities of the labels in a map, 0 where absent."""
    return F.transform(F.array(*map(F.lit, labels)), lambda name: F.coalesce(F.try_element_at(tags, name), F.lit(0.0)))


def above(values: Column, threshold: float) -> Column:
    return F.size(F.filter(values, lambda p: p >= threshold)).cast("long")


def explicit_policy(tags: Column, labels: list[str], threshold: float = 0.15, together: float = 0.05, least: int = 3) -> Column:
    """Accepted if the union of the labels is probable and enough of them occur together."""
    own = chances(tags, labels)
    score, n = probabilistic_union(own), above(own, together)
    accepted = (score >= threshold) & (n >= least)
    return F.struct(accepted.alias("accepted"), score.alias("score"), n.alias("cooccurring"))


def context_policy(tags: Column, labels: list[str], context: list[str], high: float = 0.20, low: float = 0.05, around: float = 0.02, together: float = 0.03) -> Column:
    """Accepted by a high score, or by a low one that context or a second label confirms."""
    own = chances(tags, labels)
    score, near = probabilistic_union(own), probabilistic_union(chances(tags, context))
    reason = F.when(score >= high, "high_score").when((score >= low) & ((near >= around) | (above(own, together) >= 2)), "context_confirmed").otherwise("below_policy")
    return F.struct((reason != "below_policy").alias("accepted"), score.alias("score"), near.alias("context"), reason.alias("reason"))


def track_route(hit: Column, ad: Column, subtitle: Column, credits: Column, scene: Column, progress: Column, zone: Column, seconds: Column, wide: Column, tall: Column, persistent: Column, length: Column, compact: Column) -> Column:
    """Route of a text track; the order of the branches is part of the rule.

    hit: a configured term occurs; wide and tall: the box as shares of the frame; length: of the
    text; compact: of its letters and digits. Returns (routing, priority, candidate).
    """
    corner = zone.startswith("top-") | zone.startswith("bottom-") | zone.endswith("-left") | zone.endswith("-right")
    overlay = persistent & (corner | (wide >= 0.30))
    # Thresholds and names of the routes.
    rules = [
        (hit, "REVIEW_POLICY_OVERRIDE", F.lit("high"), True),
        ((progress >= 0.90) & (length >= 3) & ~((ad >= 0.85) & overlay), "LIKELY_CREDITS", F.lit("low"), False),
        ((progress < 0.90) & (ad < 0.20) & (F.greatest(credits, scene) >= 0.65) & (~persistent | (wide < 0.30) | (compact <= 4)), "LIKELY_SCENE_TEXT", F.lit("low"), False),
        ((ad >= 0.45) & (ad >= F.greatest(subtitle, credits, scene) - 0.03), "REVIEW_AD_LIKELY", F.when((ad >= 0.62) | overlay, "high").otherwise("medium"), True),
        ((zone == "subtitle") & (seconds <= 12) & (tall <= 0.18) & (subtitle >= 0.52) & (subtitle >= ad + 0.12), "LIKELY_SUBTITLE", F.lit("low"), False),
        ((progress >= 0.85) & (credits >= 0.52) & (credits >= ad + 0.12), "LIKELY_CREDITS", F.lit("low"), False),
        (~overlay & (scene >= 0.55) & (scene >= ad + 0.15), "LIKELY_SCENE_TEXT", F.lit("low"), False),
        (~overlay & (ad < 0.20), "LOW_AD_UNCERTAIN", F.lit("low"), False),
        (overlay, "REVIEW_UNCERTAIN_OVERLAY", F.lit("medium"), True),
        (F.lit(True), "REVIEW_UNCERTAIN", F.lit("low"), True),
    ]
    out = None
    for test, name, priority, candidate in rules:
        row = F.struct(F.lit(name).alias("routing"), priority.alias("priority"), F.lit(candidate).alias("candidate"))
        out = F.when(test, row) if out is None else out.when(test, row)
    return out
