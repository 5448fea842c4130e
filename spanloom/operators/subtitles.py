"""Lines of subtitles that were read as uncertain text: they leave the main list in films with a stream of subtitles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators.addresses import remembered_in, track_addresses

# The zone, readings of a line at most, how far from the middle its own lies in shares of the width, lines of a film with
# subtitles, routings that move, the score from which a line counts as advertising, its class.
ZONE, READS, CENTRE, STREAM, MOVABLE, AD_SCORE, AD_CLASS = "subtitle", 2, 0.15, 20, ["REVIEW_UNCERTAIN"], 0.40, "advertisement"


def advertising(texts: Column) -> Column:
    """Whether a track shows an address, another token of advertising or a handle."""
    shown = F.coalesce(texts, F.array().cast("array<string>"))
    return (F.size(track_addresses(shown)) > 0) | F.exists(shown, lambda x: F.coalesce(F.contains(x, F.lit("@")) | (F.size(text.ad_tokens(x)) > 0), F.lit(False)))


def moved_lines(tracks: DataFrame, memory: DataFrame, width: float) -> DataFrame:
    """The tracks with ``subtitle_line``: whether they leave the main list; those have no review_candidate any more, and ``previous_routing``.

    tracks: (source, track_id, zone, review_candidate, routing, candidate, persistent, fixed, named, observations, x1, y1, x2, y2, texts, policy_hits, top_label,
    ad_probability); memory: (key). Only a film with STREAM tracks of the zone that were read READS times at most has subtitles. A line in the middle of
    the frame moves if nothing about it speaks of advertising; unknown readings prove nothing, so such a track stays.
    """
    false = F.lit(False)
    rarely = (F.col("zone") == ZONE) & (F.col("observations") <= READS)
    films = tracks.where(rarely).groupBy("source").agg(F.count("*").alias("lines")).where(F.col("lines") >= STREAM)
    centred = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")) & (F.abs((F.col("x1") + F.col("x2")) / 2 - width / 2) <= CENTRE * width)
    free = F.coalesce("review_candidate", F.lit(True)) & F.col("routing").isin(MOVABLE) & F.col("candidate").isNull() & ~F.coalesce("persistent", false) & ~F.coalesce("fixed", false)
    signs = (F.size(F.coalesce("policy_hits", F.array().cast("array<string>"))) > 0) | F.coalesce("named", false) | F.coalesce(F.col("top_label") == AD_CLASS, false) | (F.coalesce("ad_probability", F.lit(0.0)) >= AD_SCORE)
    likely = tracks.join(films, "source", "left_semi").where(rarely & centred & free & ~signs).where(~advertising(F.col("texts")))
    known = remembered_in(likely.select(F.struct("source", "track_id").alias("track_id"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts")), memory).select("track_id.*")
    lines = likely.select("source", "track_id").join(known, ["source", "track_id"], "left_anti").withColumn("subtitle_line", F.lit(True))
    out = tracks.join(lines, ["source", "track_id"], "left").withColumn("subtitle_line", F.coalesce("subtitle_line", false))
    moved = F.col("subtitle_line")
    return out.withColumns({"review_candidate": F.when(moved, False).otherwise(F.col("review_candidate")), "previous_routing": F.when(moved, F.col("routing"))})
