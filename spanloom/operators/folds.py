"""Order-dependent merges: by windows where they can express them, else folded over natural runs of a key.

A fold's state never crosses a pause longer than its gap, so a key is first cut into runs at such
pauses with a window; each run, not each key, is one group of the fold.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import boxes
from spanloom.operators.dealing import dealt
from spanloom.sources.shipping import ship


def runs(rows: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """Numbers runs of rows that a pause of more than ``gap`` separates."""
    ship(rows.sparkSession)
    before = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    opens = F.coalesce((F.col(start) - F.max(end).over(before) > gap).cast("int"), F.lit(1))
    marked = rows.withColumn("opens", opens)
    return marked.withColumn("run", F.sum("opens").over(W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def folded(rows: DataFrame, keys: list[str], order: list, fold: Callable[[Iterator], Iterator[tuple]], schema: str, deal: bool = False) -> DataFrame:
    """Folds the rows of each key in order: ``fold`` takes an iterator of them and yields result rows.

    Rows stream through the sorted partitions, so a fold holds its own state only, and many short
    runs cost no more than one long one. ``deal``: a fold that works long on few bytes goes to many tasks.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for batch in batches for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False))
        groups = itertools.groupby(each, key=lambda r: tuple(getattr(r, k) for k in keys))
        told = itertools.chain.from_iterable(fold(own) for _, own in groups)
        while some := list(itertools.islice(told, 10_000)):
            yield pd.DataFrame(some, columns=names)

    return (dealt(rows, *keys) if deal else rows.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def bounded_sessions(rows: DataFrame, gap: float, span: float) -> DataFrame:
    """Groups rows (source, category, start, end, suggestion) by gap, total span and compatible suggestions.

    A row joins the open group of its category if it begins at most ``gap`` after the group's end,
    the group stays within ``span`` seconds and no two different suggestions meet. Returns
    (source, category, start, end, suggestion, n).
    """

    def fold(run: Iterator) -> Iterator[tuple]:
        last = None
        for r in run:
            clash = last and last[4] and r.suggestion and last[4] != r.suggestion
            if last and r.start - last[3] <= gap and max(r.end, last[3]) - last[2] <= span and not clash:
                last[3], last[4], last[5] = max(r.end, last[3]), last[4] or r.suggestion, last[5] + 1
            else:
                if last:
                    yield tuple(last)
                last = [r.source, r.category, r.start, r.end, r.suggestion, 1]
        yield tuple(last)

    keyed = rows.withColumn("k", F.concat_ws("|", F.col("source").cast("string"), "category"))
    cut = runs(keyed, "k", "start", "end", gap)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("source", "category", "suggestion")}
    return folded(cut, ["k", "run"], ["start", "end", "suggestion"], fold, f"source {kinds['source']}, category string, start double, end double, suggestion string, n long")


def tracks(detections: DataFrame, absence: float, least_iou: float) -> DataFrame:
    """Follows boxes through time: (source, track, start, end, observations, x1, y1, x2, y2).

    Detections (source, t, confidence, x1, y1, x2, y2) of one moment are matched to open tracks by
    falling confidence, each to the free track of highest overlap with its last box, at least
    ``least_iou``; a track ends after ``absence`` seconds without a sighting. The box is the union.
    Tracks of a source are numbered from 0 by start, box and end.
    """

    def fold(run: Iterator) -> Iterator[tuple]:
        told = lambda k: (k["source"], k["start"], k["end"], k["n"], *k["union"])
        open_: list[dict] = []
        for t, moment in itertools.groupby(run, key=lambda d: d.t):
            yield from (told(k) for k in open_ if t - k["end"] > absence)
            open_ = [k for k in open_ if t - k["end"] <= absence]
            free = list(open_)
            for d in moment:
                box = (d.x1, d.y1, d.x2, d.y2)
                best = max(free, key=lambda k: _iou(k["last"], box), default=None)
                if best is not None and _iou(best["last"], box) >= least_iou:
                    free = [k for k in free if k is not best]
                    u = best["union"]
                    best.update(end=t, last=box, n=best["n"] + 1, union=(min(u[0], box[0]), min(u[1], box[1]), max(u[2], box[2]), max(u[3], box[3])))
                else:
                    open_.append({"source": d.source, "start": t, "end": t, "last": box, "union": box, "n": 1})
        yield from map(told, open_)

    cut = runs(detections.withColumn("until", F.col("t")), "source", "t", "until", absence)
    kind = detections.schema["source"].dataType.simpleString()
    found = folded(cut, ["source", "run"], ["t", F.col("confidence").desc(), "x1", "y1", "x2", "y2"], fold, f"source {kind}, start double, end double, observations long, x1 double, y1 double, x2 double, y2 double")
    number = F.row_number().over(W.partitionBy("source").orderBy("start", "x1", "y1", "x2", "y2", "end", "observations")) - 1
    return found.withColumn("track", number.cast("long"))


def _iou(a, b) -> float:
    common = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / total if total > 0 else 0.0


# The order of priorities.
PRIORITIES = ["high", "context", "normal"]


def merge_cards(cards: DataFrame, gap: float, least_iou: float = 0.5) -> DataFrame:
    """Merges cards of one source, category and kind that follow each other and don't contradict.

    cards: (source, category, start, end, max_score, priority, kind, suggestion, refs, x1, y1, x2,
    y2, card_id). In the order of start, end and card_id a card opens a new group if it begins more
    than ``gap`` after all before have ended, if its suggestion differs from the last one known, or
    if its box overlaps the last one known by less than ``least_iou``. A group has the earliest start
    and latest end, the highest score and priority, the first suggestion and box, and all refs once,
    in order.
    """
    order = W.partitionBy("source", "category", "kind").orderBy("start", "end", "card_id")
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    box = F.when(F.col("x1").isNotNull(), F.struct("x1", "y1", "x2", "y2"))
    known = F.last(box, ignorenulls=True).over(before)
    rows = cards.withColumn("known", known).withColumns({f"k_{c}": F.col(f"known.{c}") for c in ("x1", "y1", "x2", "y2")})
    late = F.col("start") - F.max("end").over(before) > gap
    clash = F.col("suggestion") != F.last("suggestion", ignorenulls=True).over(before)
    apart = boxes.iou("", "k_") < least_iou
    opens = F.greatest(*[F.coalesce(c.cast("int"), F.lit(0)) for c in (late, clash, F.col("x1").isNotNull() & F.col("known").isNotNull() & apart)])
    grouped = rows.withColumn("opens", opens).withColumn("group", F.sum("opens").over(upto))
    place = F.struct("start", "end", "card_id")
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), place))
    refs = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "refs"))), lambda x: x["refs"])))
    return grouped.groupBy("source", "category", "kind", "group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("max_score").alias("max_score"), F.min_by("priority", rank).alias("priority"), first("suggestion").alias("suggestion"),
        refs.alias("refs"), F.count("*").alias("n"), *[first(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
    ).drop("group")


def merge_suggestions(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Clusters of suggestions (segment, tier, start, end, decision, decided_at) by common time.

    In the order of start, the longer first, a suggestion stays with the one before it if they share
    ``share`` of the shorter one's time. A cluster has its first row's times and the latest decision.
    """
    order = W.partitionBy("segment", "tier").orderBy("start", F.col("end").desc(), "decided_at")
    common = F.least("end", F.lag("end").over(order)) - F.col("start")
    shorter = F.least(F.col("end") - F.col("start"), F.lag("end").over(order) - F.lag("start").over(order))
    stays = F.coalesce((shorter > 0) & (common >= share * shorter), F.lit(False))
    grouped = rows.withColumn("opens", (~stays).cast("int")).withColumn("cluster", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min(F.struct(F.col("start"), (-F.col("end")).alias("e")))
    out = grouped.groupBy("segment", "tier", "cluster").agg(first.alias("f"), F.max(F.struct("decided_at", "decision")).alias("d"), F.count("*").alias("n"))
    return out.select("segment", "tier", F.col("f.start").alias("start"), (-F.col("f.e")).alias("end"), "d.decision", "d.decided_at", "n")
