"""Cards of nearby safety detections: scene cards of fights and blood, short event groups of the rest.

Whether an item joins the card before it depends on what that card has become, so this is a fold; it runs
over natural runs of a film and category, cut at pauses that no card crosses. What a card then is comes from
aggregations over its members.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.folds import PRIORITIES, folded, runs

# Categories that are grouped, those of scene cards; strict gap and span of a scene card, gap and span of an event group.
SAFETY, SCENES = ("adult", "gore", "violence"), ("gore", "violence")
SCENE_GAP, SCENE_SPAN, EVENT_GAP, EVENT_SPAN = 20.0, 300.0, 6.0, 30.0
DISCRETE = "discrete_detected_intervals"
MOMENT = "array<struct<start: double, end: double>>"


def joined(run: Iterator) -> Iterator[tuple]:
    """Names the card of each item by its first member.

    A scene card takes an item less than SCENE_GAP after its end while both together last SCENE_SPAN at most; an
    event group one at most EVENT_GAP after that ends EVENT_SPAN after its start at most. Suggestions must not differ: a scene card
    minds those of all members, an event group that of its first.
    """
    card = None
    for r in run:
        scene = r.category in SCENES
        fits = card is not None and r.category in SAFETY and card["decision"] is None and r.decision is None
        if fits and scene:
            fits = r.start - card["end"] < SCENE_GAP and max(card["end"], r.end) - card["start"] <= SCENE_SPAN
        elif fits:
            fits = r.start <= card["end"] + EVENT_GAP and r.end - card["start"] <= EVENT_SPAN
        if fits and (r.suggestion is None or card["said"] <= {r.suggestion}):
            if scene:
                card["start"], card["end"] = round(min(card["start"], r.start), 3), round(max(card["end"], r.end), 3)
                card["said"] |= {r.suggestion} - {None}
            else:
                card["end"] = max(card["end"], r.end)
        else:
            card = {"id": r.item_id, "start": r.start, "end": r.end, "decision": r.decision, "said": {r.suggestion} - {None}}
        yield r.source, r.category, r.item_id, card["id"]


def safety_cards(items: DataFrame) -> DataFrame:
    """One row for each card: (source, category, card_id, start, end, max_score, priority, suggestion, decision, labels, refs, moments, n_members, scene, detected_seconds, candidate, policy).

    items: (source, item_id, category, start, end, score, priority, suggestion, decision, policy, detected, labels, refs), item_id in order of the report,
    detected an array of (start, end). card_id is the first member's. The moments of a scene card are the union of what each member alone
    would edit; those of an event group are the members' detections, each once. A scene card suggests what all members suggest.
    Items of other categories and decided ones are cards of their own, as they came.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in ("source", "item_id")}
    keyed = items.withColumn("k", F.concat_ws("|", F.col("source").cast("string"), "category"))
    cut = runs(keyed.select("k", "source", "category", "item_id", "start", "end", "suggestion", "decision"), "k", "start", "end", SCENE_GAP)
    card = folded(cut, ["k", "run"], ["start", "item_id"], joined, f"source {kinds['source']}, category string, item_id {kinds['item_id']}, card_id {kinds['item_id']}")
    key = ["source", "category", "card_id"]
    size = F.count("*").over(W.partitionBy(*key))
    rows = items.join(card, ["source", "category", "item_id"]).withColumn("n_members", size).withColumn("scene", F.col("category").isin(*SCENES) & (F.col("n_members") > 1))
    own = F.array(F.struct("start", "end"))
    some = F.coalesce(F.size("detected") > 0, F.lit(False))
    first = F.col("item_id") == F.col("card_id")
    # of an event group the first member has no moment of its own unless it names some
    alone = F.when(first, F.array().cast(MOMENT)).otherwise(own)
    edits = F.when(F.col("scene"), F.when(some & (F.col("policy") == DISCRETE), F.col("detected")).otherwise(own)).otherwise(F.when(some, F.col("detected")).otherwise(alone))
    each = rows.select(*key, "scene", "n_members", F.explode(edits.cast(MOMENT)).alias("m")).select(*key, "scene", F.col("m.start").alias("a"), F.col("m.end").alias("b")).distinct()
    order = W.partitionBy(*key).orderBy("a", "b")
    opens = F.coalesce((F.col("a") > F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))).cast("int"), F.lit(1))
    run = F.sum(F.when(F.col("scene"), F.col("opens")).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    spans = each.withColumn("opens", opens).withColumn("run", run).groupBy(*key, "scene", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    whole = lambda c: F.when(F.col("scene"), F.round(c, 3)).otherwise(F.col(c))
    moments = spans.select(*key, F.struct(whole("a").alias("start"), whole("b").alias("end")).alias("m")).groupBy(*key).agg(F.array_sort(F.collect_list("m")).alias("moments"), F.round(F.sum(F.col("m.end") - F.col("m.start")), 3).alias("detected_seconds"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(0))
    rank = F.when(rank == 0, len(PRIORITIES)).otherwise(rank)
    place = F.struct("start", "item_id")
    none = F.array().cast("array<string>")

    def lists(c: str) -> Column:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "item_id", F.coalesce(c, none).alias("v")))), lambda x: x["v"])
        return F.array_distinct(F.flatten(ordered)).alias(c)

    said = F.struct("suggestion")
    out = rows.groupBy(*key).agg(
        F.min("start").alias("low"), F.max("end").alias("high"), F.max("score").alias("max_score"), F.min_by("priority", F.struct(rank.alias("r"), place.alias("p"))).alias("priority"), F.min_by(said, place)["suggestion"].alias("first_said"), F.size(F.collect_set(said)).alias("different"),
        F.min_by(F.struct("decision", "policy"), place).alias("as_came"), lists("labels"), lists("refs"), F.first("n_members").alias("n_members"), F.first("scene").alias("scene"),
    )
    out = out.join(moments, key, "left")
    group = F.col("n_members") > 1
    edge = lambda c: F.when(F.col("scene"), F.round(c, 3)).otherwise(F.col(c))
    return out.select(
        *key, edge("low").alias("start"), edge("high").alias("end"), "max_score", "priority", F.when(F.col("scene") & (F.col("different") > 1), F.lit(None)).otherwise(F.col("first_said")).alias("suggestion"), F.col("as_came.decision").alias("decision"), "labels", "refs",
        F.coalesce("moments", F.array().cast(MOMENT)).alias("moments"), "n_members", "scene", F.coalesce("detected_seconds", F.lit(0.0)).alias("detected_seconds"), F.when(group, "review_event_group").alias("candidate"), F.when(group, DISCRETE).otherwise(F.col("as_came.policy")).alias("policy"),
    )
