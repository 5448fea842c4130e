"""Marks that are read again and again at one place, and marks that detectors propose for whole films.

``repeated_marks`` groups sightings of addresses: in order of time a sighting joins the first group whose
median box it covers and one of whose keys is like one of its own. The median moves with each
member, so this is a fold; but groups never hold keys that no chain of likenesses links, so each
component of keys is folded for itself, with a running median of each edge as its state.
``leaders`` needs no fold: the box of a group stays that of its first member, so who leads is a
contest of first claims.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import boxes
from spanloom.operators.addresses import remembered_in, track_addresses
from spanloom.operators.folds import folded
from spanloom.operators.fuzzy import similar
from spanloom.operators.graph import connected, fallen
from spanloom.operators.reports import reach_edges
from spanloom.sources.shipping import ship

# Overlap with the median box, likeness of keys, readings from which a mark counts as always there, the seconds
# that it is then taken to last between two, the share of edges left out on either side of its box.
PLACE, LIKENESS, ROBUST, BRIDGE, EDGE_SHARE = 0.5, 0.75, 10, 150.0, 0.1
FIXED_ROUTINGS = ["REVIEW_PERSISTENT_OVERLAY", "LIKELY_TITLE_OVERLAY", "REVIEW_POLICY_OVERRIDE"]
FIXED_CANDIDATES = ["persistent_overlay", "title_overlay", "scrolling_text"]
# Share of the smaller box that makes two boxes one mark, seconds that a mark for a film spans at least.
SAME_BOX, LEAST_SPAN = 0.8, 60.0
SIDES = ["x1", "y1", "x2", "y2"]


class Middle:
    """Running median: the different values in order with their counts, and where the middle one stands."""

    def __init__(self):
        self.values, self.counts, self.n, self.at, self.before = [], [], 0, 0, 0

    def add(self, value: float) -> None:
        k = bisect_left(self.values, value)
        if k < len(self.values) and self.values[k] == value:
            self.counts[k] += 1
            self.before += k < self.at
        else:
            self.values.insert(k, value)
            self.counts.insert(k, 1)
            if self.n and k <= self.at:
                self.at += 1
                self.before += 1
        self.n += 1
        middle = (self.n - 1) // 2
        while self.before > middle:
            self.at -= 1
            self.before -= self.counts[self.at]
        while self.before + self.counts[self.at] <= middle:
            self.before += self.counts[self.at]
            self.at += 1

    def median(self) -> float:
        low = self.values[self.at]
        if self.n % 2 or self.n // 2 < self.before + self.counts[self.at]:
            return low
        return (low + self.values[self.at + 1]) / 2


def covers(box: tuple, core: tuple) -> float:
    common = max(0.0, min(box[2], core[2]) - max(box[0], core[0])) * max(0.0, min(box[3], core[3]) - max(box[1], core[1]))
    total = (box[2] - box[0]) * (box[3] - box[1]) + (core[2] - core[0]) * (core[3] - core[1]) - common
    return common / total if total > 0 else 0.0


def first_accepting(run: Iterator) -> Iterator[tuple]:
    """Folds sightings in order: each goes to the first group that accepts it, or opens one; yields its group as they come."""
    groups: list[tuple] = []  # (first track, keys, medians of the edges)
    for r in run:
        box, like = tuple(float(getattr(r, s)) for s in SIDES), set(r.alike)
        for mark, keys, edges in groups:
            if not like.isdisjoint(keys) and covers(box, tuple(e.median() for e in edges)) >= PLACE:
                break
        else:
            mark, keys, edges = r.track_id, set(), [Middle() for _ in SIDES]
            groups.append((mark, keys, edges))
        keys.update(r.keys)
        for edge, value in zip(edges, box, strict=True):
            edge.add(value)
        yield r.source, r.track_id, mark


def sightings(tracks: DataFrame, memory: DataFrame) -> DataFrame:
    """Tracks with addresses of their own or remembered ones, with the keys that tell marks apart: adds tokens, remembered, keys.

    A key is an address folded to letters and digits, six at least. Left out are tracks without a
    proper box, fixed overlays, titles and scrolling lines.
    """
    free = ~F.coalesce(F.col("routing").isin(FIXED_ROUTINGS), F.lit(False)) & ~F.coalesce(F.col("candidate").isin(FIXED_CANDIDATES), F.lit(False)) & ~F.coalesce("fixed", F.lit(False))
    rows = tracks.where(free).where("x2 > x1 and y2 > y1")
    node = rows.select(F.struct("source", "track_id").alias("track_id"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))
    known = remembered_in(node, memory).select("track_id.*", "remembered")
    none = F.array().cast("array<string>")
    rows = rows.join(known, ["source", "track_id"], "left").withColumns({"tokens": F.coalesce(track_addresses(F.col("texts")), none), "remembered": F.coalesce("remembered", none)})
    keys = F.array_distinct(F.concat(F.array_compact(F.transform("tokens", lambda x: text.memory_key(x))), F.col("remembered")))
    return rows.withColumn("keys", keys).where(F.size("keys") > 0)


def marked(seen: DataFrame) -> DataFrame:
    """(source, track_id, mark): the group of each sighting, named by its first member."""
    ship(seen.sparkSession)
    words = seen.select("source", F.explode("keys").alias("word")).distinct()
    pairs = similar(words, "source", LIKENESS).checkpoint()
    node = lambda c: F.struct("source", F.col(c).alias("key"))
    within = seen.where(F.size("keys") > 1).select("source", F.col("keys")[0].alias("a"), F.explode("keys").alias("b"))
    chains = pairs.select("source", "a", "b").unionByName(within).where("a <> b")
    found = connected(chains.select(node("a").alias("a"), node("b").alias("b"))).select("id.*", F.col("component.key").alias("component"))
    like = pairs.groupBy("source", F.col("a").alias("key")).agg(F.collect_set("b").alias("like"))
    each = seen.select("source", "track_id", F.explode("keys").alias("key")).join(like, ["source", "key"], "left").join(found, ["source", "key"], "left")
    own = each.groupBy("source", "track_id").agg(F.min(F.coalesce("component", "key")).alias("component"), F.array_union(F.collect_set("key"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("like", F.array().cast("array<string>")))))).alias("alike"))
    rows = seen.select("source", "track_id", "start", *SIDES, "keys").join(own, ["source", "track_id"])
    kinds = {c: seen.schema[c].dataType.simpleString() for c in ("source", "track_id")}
    return folded(rows, ["source", "component"], ["start", "track_id"], first_accepting, f"source {kinds['source']}, track_id {kinds['track_id']}, mark {kinds['track_id']}")


def told_first(rows: DataFrame, column: str, most: int) -> DataFrame:
    """(source, mark, column): the first ``most`` different values of an array column, in order of the members."""
    each = rows.select("source", "mark", "start", "track_id", F.posexplode(column).alias("pos", "value")).where("value is not null")
    firsts = each.groupBy("source", "mark", "value").agg(F.min(F.struct("start", "track_id", "pos")).alias("at"))
    ranked = firsts.withColumn("rank", F.row_number().over(W.partitionBy("source", "mark").orderBy("at"))).where(F.col("rank") <= most)
    return ranked.groupBy("source", "mark").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias(column))


def robust_box(rows: DataFrame) -> DataFrame:
    """(source, mark, x1, y1, x2, y2): the union of the members' boxes; with ROBUST members a tenth of each edge is left out on the outer side.

    Counts of equal edges come first, so a mark with very many members is ranked over pixels.
    """
    key = ["source", "mark"]
    edges = rows.select(*key, "n", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.when(F.lit(s).isin("x1", "y1"), F.col(s)).otherwise(-F.col(s)).alias("edge")) for s in SIDES])).alias("e")).select(*key, "n", "e.*")
    counts = edges.groupBy(*key, "side", "edge").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    upto = F.sum("c").over(W.partitionBy(*key, "side").orderBy("edge").rowsBetween(W.unboundedPreceding, 0))
    least = F.when(F.col("n") >= ROBUST, F.floor(EDGE_SHARE * F.col("n"))).otherwise(0)
    first = counts.withColumn("upto", upto).where(F.col("upto") > least).groupBy(*key, "side").agg(F.min("edge").alias("edge"))
    return first.groupBy(*key).agg(*[F.bround(F.abs(F.max(F.when(F.col("side") == s, F.col("edge"))))).alias(s) for s in SIDES])


def moments(rows: DataFrame, every: float, scan_start: float, scan_end: float | None) -> DataFrame:
    """(source, mark, moments, read_start, read_end): when a mark is there, from a reading before each sighting to its blur's end.

    Sightings that touch join; those of a mark with ROBUST of them join over BRIDGE seconds, and
    reach the ends of the scan over as many.
    """
    bridge = F.when(F.col("n") >= ROBUST, BRIDGE).otherwise(0.0)
    spans = rows.select(F.struct("source", "mark").alias("k"), "n", "start", "track_id", F.bround(F.greatest(F.lit(scan_start), F.col("start") - every), 3).alias("low"), F.bround(F.coalesce("blur_end", "end"), 3).alias("high"), bridge.alias("bridge"))
    order = W.partitionBy("k").orderBy("start", "track_id")
    opens = F.coalesce((F.col("low") - F.max("high").over(order.rowsBetween(W.unboundedPreceding, -1)) > F.col("bridge")).cast("int"), F.lit(1))
    runs = spans.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    read = runs.groupBy("k", "run").agg(F.min("low").alias("start"), F.max("high").alias("end"), F.max("n").alias("n"))
    span = read.groupBy("k").agg(F.min("start").alias("read_start"), F.max("end").alias("read_end"))
    often = read.where(F.col("n") >= ROBUST)
    scans = often.select("k").distinct().select("k", F.lit(scan_start).alias("scan_start"), F.lit(scan_end).cast("double").alias("scan_end"))
    moved = reach_edges(often.select("k", "start", "end"), scans, "k", BRIDGE).select("k", "start", "end")
    both = read.where(F.col("n") < ROBUST).select("k", "start", "end").unionByName(moved)
    return both.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("moments")).join(span, "k").select("k.*", "moments", "read_start", "read_end")


def repeated_marks(tracks: DataFrame, memory: DataFrame, every: float, scan_start: float = 0.0, scan_end: float | None = None) -> DataFrame:
    """One row for each mark that is read twice or more at one place.

    tracks: (source, track_id, start, end, blur_end, x1, y1, x2, y2, texts, routing, candidate, fixed, observations,
    confidence, ad_probability, policy_hits, persistent), track_id unique within its source and in
    order of the report; memory: (key). Returns (source, track_id, start, end, blur_end, moments, x1, y1, x2, y2, texts,
    observations, confidence, ad_probability, policy_hits, persistent, grouped_track_ids, tokens, remembered, sightings,
    read_start, read_end, previous_routings); track_id is that of the first sighting.
    """
    seen = sightings(tracks, memory)
    groups = marked(seen).groupBy("source", "mark").agg(F.count("*").alias("n"), F.collect_list("track_id").alias("members")).where("n >= 2").select("source", "mark", "n", F.explode("members").alias("track_id"))
    rows = seen.join(groups, ["source", "track_id"]).checkpoint()
    key = ["source", "mark"]
    sums = rows.groupBy(*key).agg(
        F.first("n").alias("sightings"), F.bround(F.max("end"), 3).alias("end"), F.sum(F.coalesce("observations", F.lit(0))).alias("observations"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"), F.max(F.coalesce("ad_probability", F.lit(0.0))).alias("ad_probability"),
        F.bool_or(F.coalesce("persistent", F.lit(False))).alias("persistent"), F.transform(F.array_sort(F.collect_list(F.struct("start", "track_id"))), lambda x: x["track_id"]).alias("grouped_track_ids"), F.array_sort(F.collect_set(F.coalesce("routing", F.lit("")))).alias("previous_routings"),
    )
    out = sums.join(moments(rows, every, scan_start, scan_end), key).join(robust_box(rows), key)
    for column, most in (("texts", 8), ("tokens", 5), ("remembered", 5), ("policy_hits", 1 << 30)):
        out = out.join(told_first(rows, column, most), key, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out.select(
        "source", F.col("mark").alias("track_id"), F.col("moments")[0]["start"].alias("start"), "end", F.element_at("moments", -1)["end"].alias("blur_end"), "moments", *SIDES, "texts", "observations", "confidence", "ad_probability",
        "policy_hits", "persistent", "grouped_track_ids", "tokens", "remembered", "sightings", "read_start", "read_end", "previous_routings",
    )


def compatible(a: str, b: str, share: float) -> Column:
    """Boxes that have ``share`` of the smaller one in common."""
    return boxes.intersection(a, b) >= share * F.least(boxes.area(a), boxes.area(b))


def leaders(rows: DataFrame, key: str, order: list, fits: Callable[[str, str], Column], tile: int = 64) -> DataFrame:
    """Groups boxes (key, x1, y1, x2, y2, ...) by first fit: adds ``leader``, the place in order of the box that leads the group.

    In order, a box joins the first leader of its key that it fits, or leads itself. Boxes that fit
    overlap, and a box fits itself. A box leads if no leader before it fits, which is a contest of first claims among the
    different boxes of a key; the others go to the first leader that fits. Boxes meet on the tiles that they touch.
    """
    same = W.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("place", F.row_number().over(same).cast("long")).checkpoint()
    # equal boxes always go together, so only the first of them can lead
    distinct = numbered.groupBy(key, *SIDES).agg(F.min("place").alias("first"))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / tile), F.floor(F.greatest(F.col(low), F.col(high)) / tile))
    tiled = distinct.withColumn("tx", F.explode(span("x1", "x2"))).withColumn("ty", F.explode(span("y1", "y2")))
    a, b = (tiled.select(key, "tx", "ty", *[F.col(c).alias(f"{p}_{c}") for c in (*SIDES, "first")]) for p in "ab")
    pairs = a.join(b, [key, "tx", "ty"]).where("a_first < b_first").where(fits("a_", "b_")).select(key, "a_first", "b_first").distinct().checkpoint()
    node = lambda c: F.struct(key, F.col(c).alias("place"))
    led = fallen(pairs.select(node("a_first").alias("a"), node("b_first").alias("b"))).select("id.*")
    heads = distinct.select(key, F.col("first").alias("place")).join(led, [key, "place"], "left_anti")
    follow = pairs.join(heads.withColumnRenamed("place", "a_first"), [key, "a_first"], "left_semi").groupBy(key, F.col("b_first").alias("first")).agg(F.min("a_first").alias("leads"))
    found = distinct.join(follow, [key, "first"], "left").join(heads.withColumnRenamed("place", "first").withColumn("head", F.lit(True)), [key, "first"], "left")
    found = found.select(key, *SIDES, F.when(F.col("head"), F.col("first")).otherwise(F.col("leads")).alias("leader"))
    return numbered.join(found, [key, *SIDES]).drop("place")


def film_marks(suggestions: DataFrame, tile: int = 64) -> DataFrame:
    """Marks that detectors propose for a film: (source, x1, y1, x2, y2, start, end, suggestion_ids, labels, prior_blur).

    suggestions: (source, suggestion_id, start, end, x1, y1, x2, y2, labels, decision, decided_at,
    dx1, dy1, dx2, dy2), with the box of an earlier decision to blur. The longest come first, by start and id; a mark that spans less than
    LEAST_SPAN seconds is left out. The latest decided box stands for the first member's.
    """
    led = leaders(suggestions.where("x1 is not null"), "source", [(F.col("start") - F.col("end")), "start", "suggestion_id"], lambda a, b: compatible(a, b, SAME_BOX), tile)
    plain = F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: ~F.contains(x, F.lit("Persistent")) & ~F.contains(x, F.lit("candidate")))
    blur = (F.col("decision") == "BLUR") & F.col("dx1").isNotNull()
    first = F.struct((F.col("start") - F.col("end")).alias("d"), "start", "suggestion_id")
    out = led.groupBy("source", "leader").agg(
        F.round(F.min("start"), 3).alias("start"), F.round(F.max("end"), 3).alias("end"), (F.max("end") - F.min("start")).alias("span"), F.array_sort(F.collect_list("suggestion_id")).alias("suggestion_ids"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_set(plain)))), 1, 4).alias("labels"), F.min_by(F.struct(*SIDES), first).alias("box"),
        F.max_by(F.struct(*[F.col(f"d{s}").alias(s) for s in SIDES]), F.when(blur, F.struct(F.coalesce("decided_at", F.lit("")).alias("at"), first.alias("member")))).alias("decided"), F.bool_or(F.coalesce(blur, F.lit(False))).alias("prior_blur"),
    )
    box = F.when(F.col("prior_blur"), F.col("decided")).otherwise(F.col("box"))
    return out.where(F.col("span") >= LEAST_SPAN).select("source", *[box[s].alias(s) for s in SIDES], "start", "end", "suggestion_ids", "labels", "prior_blur")
