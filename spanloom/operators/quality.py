"""Findings about decisions before an export: openings that aren't cut whole, blurs that are too small, untrimmed or too wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import boxes
from spanloom.operators.absorption import PERSISTENT, SIDES, _beside

# Seconds of the opening and between neighbours, words of a promotion; area of a tight read and its overlap, reads that are
# needed, share of the box that reads of a whole logo have, shares of a blur that is too small and of one that is untrimmed, excess of one that is too wide.
OPENING, NEIGHBOUR = 30.0, 1.0
PROMOTION = ["quảng bá", "promotional", "promotion", "advertisement", "branded intro"]
TIGHT, OVERLAP, READS, WHOLE, SMALL, UNTRIMMED, WIDE = 0.60, 0.70, 2, 0.45, 0.55, 0.90, 1.50


def promotes(candidate: Column, labels: Column, reasons: Column) -> Column:
    """Whether a card is an opening promotion by its kind or by its words."""
    none = F.array().cast("array<string>")
    words = F.lower(F.array_join(F.concat(F.coalesce(labels, none), F.coalesce(reasons, none)), " "))
    named = F.lit(False)
    for term in PROMOTION:
        named = named | F.contains(words, F.lit(term))
    return F.coalesce(candidate == "opening_promotion", F.lit(False)) | named


def findings(items: DataFrame, tile: int = 128) -> DataFrame:
    """(source, item_id, finding, other_id): what is wrong with the decisions of a film; other_id is the neighbour that shows on.

    items: (source, item_id, category, candidate, start, end, labels, reasons, decision, ident, x1, y1, x2, y2, dx1, dy1, dx2, dy2, trusted), item_id in order of the queue,
    ident whether the opening is a studio's own, d.. the box that was decided, trusted whether the box was read by text or is a brand's.
    """
    early = items.where(F.col("start") < OPENING).withColumn("promotes", promotes(F.col("candidate"), F.col("labels"), F.col("reasons")))
    cut = F.col("decision") == "CUT"
    kept = (F.col("decision") == "KEEP") & F.coalesce("ident", F.lit(False))
    uncut = early.where(F.col("promotes") & F.col("decision").isNotNull() & ~cut & ~kept).select("source", "item_id", F.lit("opening_not_cut").alias("finding"), F.lit(None).cast("long").alias("other_id"))
    own = early.where(F.col("promotes") & cut).select("source", "item_id", "end")
    # the neighbour begins at most a second after the end, so it is in that second's bucket or the next
    mine = own.withColumn("second", F.explode(F.array(F.floor("end"), F.floor("end") + 1)))
    near = early.where((F.col("category") == "visual_logo") & (F.col("decision") == "BLUR")).select("source", F.col("item_id").alias("other_id"), "start", F.floor("start").alias("second"))
    shown = mine.join(near, ["source", "second"]).where("item_id <> other_id").where((F.col("start") - F.col("end")).between(0, NEIGHBOUR))
    shown = shown.groupBy("source", "item_id").agg(F.min("other_id").cast("long").alias("other_id")).select("source", "item_id", F.lit("opening_shows_on").alias("finding"), "other_id")

    blurred = items.where((F.col("candidate") == PERSISTENT) & (F.col("decision") == "BLUR") & F.col("x1").isNotNull() & F.col("dx1").isNotNull())
    reads = items.where(F.coalesce("trusted", F.lit(False)) & F.col("x1").isNotNull()).select("source", "item_id", "start", "end", *SIDES)
    pairs = _beside(blurred.select("source", "item_id", "start", "end", *SIDES, *[f"d{s}" for s in SIDES]), reads, tile)
    tight = pairs.where("b.start < a.end and b.end > a.start").where((boxes.area("b.") <= TIGHT * boxes.area("a.")) & (boxes.over_smaller("a.", "b.") >= OVERLAP))
    union = {s: (F.min if s in ("x1", "y1") else F.max)(f"b.{s}").alias(f"u_{s}") for s in SIDES}
    told = tight.groupBy("source", F.col("a.item_id").alias("item_id")).agg(F.count("*").alias("n"), F.first(boxes.area("a.")).alias("box"), F.first((F.col("a.dx2") - F.col("a.dx1")) * (F.col("a.dy2") - F.col("a.dy1"))).alias("blur"), *union.values()).where(F.col("n") >= READS)
    size = boxes.area("u_")
    share, decided = size / F.greatest(F.lit(1), F.col("box")), F.col("blur") / F.greatest(F.lit(1), F.col("box"))
    kind = F.when((share < WHOLE) & (decided < SMALL), "blur_too_small").when((share < WHOLE) & (decided > UNTRIMMED), "blur_untrimmed").when((share >= WHOLE) & (F.col("blur") > WIDE * size), "blur_too_wide")
    wrong = told.select("source", "item_id", kind.alias("finding"), F.lit(None).cast("long").alias("other_id")).where("finding is not null")
    return uncut.unionByName(shown).unionByName(wrong)
