"""From scan reports to queue rows and back to edits: normalised items, moments, references, clip times, runs of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.intervals import asof, islands, overlap_join

# Groups of categories, event types that fill the frame, errors that may pass and states of a busy server.
GROUP_OF = {"visual_logo": "advertising", "text": "advertising", "adult": "adult", "gore": "gore", "violence": "violence"}
FRAME_EVENTS = ["opening_promotion", "branded_end_card"]
TRANSIENT = ["NETWORK", "DNS_FAILED"]
BUSY = [429, 502, 503, 504]


def scope(selected: Column) -> Column:
    """The known groups that a queue selects; all of them if it says nothing."""
    known = F.array(*map(F.lit, dict.fromkeys(GROUP_OF.values())))
    return F.coalesce(F.array_intersect(known, selected), known)


def scene_moments(scene: Column, policy: Column, detected: Column) -> Column:
    """Moments of a scene card in order, each of half a second at least; null for other cards and without moments.

    detected: an array of structs (start, end).
    """
    moments = F.array_sort(F.transform(detected, lambda m: F.struct(m["start"].alias("start"), F.greatest(m["end"], m["start"] + 0.5).alias("end"))))
    return F.when(scene & (policy == "discrete_detected_intervals") & (F.size(detected) > 0), moments)


def queue_items(items: DataFrame, advisory: DataFrame) -> DataFrame:
    """Rows of a queue and its advisory part in one form: group, end, kind; unknown categories are left out.

    Both: (item_id, category, start, end, region, suggestion, candidate), region any column that is
    null without a region.
    """
    group = F.create_map(*[F.lit(x) for kv in GROUP_OF.items() for x in kv])
    rows = items.withColumn("advisory", F.lit(False)).unionByName(advisory.withColumn("advisory", F.lit(True)))
    rows = rows.withColumn("group", F.try_element_at(group, F.col("category"))).where("group is not null")
    whole = (F.col("group") != "advertising") | F.coalesce(F.col("suggestion") == "CUT", F.lit(False)) | F.coalesce(F.col("candidate").isin(FRAME_EVENTS), F.lit(False))
    kind = F.when(F.col("region").isNotNull(), "region").when(whole, "frame").otherwise("unknown")
    return rows.select("item_id", "category", "group", "start", F.greatest("end", F.col("start") + 0.5).alias("end"), "advisory", kind.alias("kind"))


def application_intervals(cards: DataFrame, key: str) -> DataFrame:
    """The times that a decision on a card edits, touching ones merged: (key, start, end) to the millisecond.

    cards: (key, policy, start, end, detected); the detected moments of a card with that policy, else its own span.
    """
    own = F.array(F.struct("start", "end"))
    times = F.when((F.col("policy") == "discrete_detected_intervals") & (F.size("detected") > 0), F.col("detected")).otherwise(own)
    spans = cards.select(key, F.explode(times).alias("m")).select(key, "m.start", "m.end")
    return islands(spans, key).select(key, F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def strong_first(category: Column, labels: Column, score: Column, seconds: Column, priority: Column) -> Column:
    """Sustained and nearly sure explicit scenes come first; other priorities stay. Labels, score and seconds."""
    named = F.arrays_overlap(F.transform(labels, lambda x: F.lower(F.trim(x))), F.array(F.lit("porn"), F.lit("hentai")))
    strong = (category == "adult") & F.coalesce(named, F.lit(False)) & (F.coalesce(score, F.lit(0.0)) >= 0.99) & (seconds >= 4.0)
    return F.when(strong, "high").otherwise(priority)


def is_transient(code: Column, status: Column) -> Column:
    return F.coalesce(code.isin(TRANSIENT) | ((code == "SERVER_BUSY") & (status.isNull() | status.isin(BUSY))), F.lit(False))


def resolved_refs(items: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows that the references ``report#interval:n`` of items (item_id, refs) stand for; those that stand for none are left out.

    intervals: (report, n, ...). Returns (item_id, place, ...) with the place of the reference.
    """
    refs = items.select("item_id", F.posexplode("refs").alias("place", "ref")).select("item_id", "place", F.translate("ref", "\\", "/").alias("ref"))
    parts = refs.select("item_id", "place", F.regexp_extract("ref", "^(.*)#interval:([0-9]+)$", 1).alias("report"), F.expr("try_cast(regexp_extract(ref, '^(.*)#interval:([0-9]+)$', 2) as bigint)").alias("n"))
    return parts.where("n is not null").join(intervals, ["report", "n"])


def origins(targets: DataFrame, frames: DataFrame, key: str, grid: Column, search: float) -> DataFrame:
    """The last frame at or before each target (key, t); one on the grid wins if it lies within ``search`` before.

    frames: (key, t); ``grid`` says of a frame whether it is on the grid. Returns the targets and ``origin``.
    """
    last = asof(targets, frames.select(key, "t"), key, "t").withColumnRenamed("nearest", "last")
    both = asof(last, frames.where(grid).select(key, "t"), key, "t")
    return both.withColumn("origin", F.when(F.col("nearest") >= F.col("t") - search, F.col("nearest")).otherwise(F.col("last"))).drop("last", "nearest")


def shifted(items: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """Items (key, item_id, start, end) in the time of their clips (key, clip_id, offset, duration), only those that touch the clip.

    clamped_start and clamped_end keep to the clip, as a label's times do.
    """
    moved = items.join(clips, key).withColumns({"start": F.round(F.col("start") - F.col("offset"), 6), "end": F.round(F.col("end") - F.col("offset"), 6)})
    touch = moved.where((F.greatest("end", F.col("start") + 0.5) > 0) & (F.col("start") < F.col("duration")))
    return touch.select(key, "item_id", "clip_id", "start", "end", F.greatest(F.lit(0.0), "start").alias("clamped_start"), F.least("duration", "end").alias("clamped_end"))


def frame_interval(times: DataFrame, key: str, otherwise: float = 0.04) -> DataFrame:
    """Upper median of the positive steps between a key's times: (key, step, n)."""
    steps = times.withColumn("step", F.col("t") - F.lag("t").over(W.partitionBy(key).orderBy("t"))).where("step > 0").groupBy(key, "step").agg(F.count("*").alias("c"))
    order = W.partitionBy(key).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    ranked = steps.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(W.partitionBy(key)))
    found = ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(key).agg(F.min("step").alias("step"), F.first("n").alias("n"))
    return times.select(key).distinct().join(found, key, "left").select(key, F.coalesce("step", F.lit(otherwise)).alias("step"), F.coalesce("n", F.lit(0)).alias("n"))


def reach_edges(moments: DataFrame, scans: DataFrame, key: str, bridge: float) -> DataFrame:
    """Moves a key's first moment to its scan's start and the last to its end where they are within ``bridge``.

    moments: (key, start, end); scans: (key, scan_start, scan_end), a null end is unknown.
    """
    ends = moments.groupBy(key).agg(F.min("start").alias("first"), F.max("end").alias("last")).join(scans, key)
    rows = moments.join(ends, key)
    opens = (F.col("start") == F.col("first")) & (F.col("first") > F.col("scan_start")) & (F.col("first") <= F.col("scan_start") + bridge)
    closes = F.coalesce((F.col("end") == F.col("last")) & (F.col("last") < F.col("scan_end")) & (F.col("last") >= F.col("scan_end") - bridge), F.lit(False))
    return rows.select(key, F.when(opens, F.col("scan_start")).otherwise(F.col("start")).alias("start"), F.when(closes, F.col("scan_end")).otherwise(F.col("end")).alias("end"), opens.alias("reaches_start"), closes.alias("reaches_end"))


def fingerprints(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """A digest of each key's events in order: sha256 over the digests of the rows, which holds 64 characters a row."""
    row = F.sha2(F.to_json(F.struct(order, *columns)), 256)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), row.alias("d"))))
    return events.groupBy(key).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), "\n"), 256).alias("fingerprint"), F.count("*").alias("n"))


def segment_blurs(segments: DataFrame, blurs: DataFrame, key: str, group: str, width: float) -> DataFrame:
    """Blurs in the time of the kept segments that they overlap, merged by group: (segment_id, group, start, end)."""
    met = overlap_join(segments, blurs, key, width)
    ids = F.struct(F.col("l_segment_id").alias("segment_id"), F.col(f"r_{group}").alias(group))
    local = met.select(ids.alias("k"), (F.greatest("l_start", "r_start") - F.col("l_start")).alias("start"), (F.least("l_end", "r_end") - F.col("l_start")).alias("end"))
    return islands(local, "k").select("k.*", "start", "end")


def latest_runs(records: DataFrame, machine: str, most: int = 2) -> DataFrame:
    """The last ``most`` runs of each machine while its fingerprint stays the same: (machine, run, option, value).

    records: (machine, run, seq, fingerprint, option, value). A run has its first record's
    fingerprint; records of another one don't count; the last value of an option does.
    """
    print_of = records.groupBy(machine, "run").agg(F.min_by("fingerprint", "seq").alias("print"), F.min("seq").alias("began"))
    order = W.partitionBy(machine).orderBy(F.col("began").desc())
    newest = print_of.withColumn("latest", F.first("print").over(order)).withColumn("other", F.sum((F.col("print") != F.col("latest")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = newest.where("other = 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(machine, "run", "print")
    values = records.join(runs, [machine, "run"]).where("fingerprint = print")
    return values.groupBy(machine, "run", "option").agg(F.max_by("value", "seq").alias("value"))


def preview_order(cards: DataFrame, longest: DataFrame) -> DataFrame:
    """Previews of a text card with the longest line read first, if all of them are known: (card_id, previews).

    cards: (card_id, category, previews); longest: (preview, longest).
    """
    each = cards.select("card_id", "category", F.posexplode("previews").alias("place", "preview")).join(longest, "preview", "left")
    by_length = F.sort_array(F.collect_list(F.struct((-F.coalesce("longest", F.lit(0))).alias("k"), "place", "preview")))
    as_given = F.sort_array(F.collect_list(F.struct("place", "preview")))
    known = (F.first("category") == "text") & (F.count("*") > 1) & (F.count("longest") == F.count("*"))
    names = lambda a: F.transform(a, lambda x: x["preview"])
    return each.groupBy("card_id").agg(F.when(known, names(by_length)).otherwise(names(as_given)).alias("previews"))


def bulk_decided(items: DataFrame, chosen: Column, decision: Column) -> DataFrame:
    """Undecided items that a filter chooses get a decision; a null one leaves them undecided."""
    takes = F.col("decision").isNull() & F.coalesce(chosen, F.lit(False))
    return items.withColumn("decision", F.when(takes, decision).otherwise(F.col("decision")))
