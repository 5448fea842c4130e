"""Lines of text that scroll through a band of the frame, put together from the short tracks that reading leaves.

The frame is read every few seconds, so a line that crosses it comes out as pieces with
overlapping stretches of its text. Pieces of one band that follow each other are linked where two of
their readings show the same stretch; components that crossed from edge to edge, or whose reading
moved on, are crossings; crossings that meet are one; other pieces in the band meanwhile go with it.

A band is cut at pauses that no link can cross. Nearly every run between two pauses is short, and one fold of it
links its pieces and tells which of its components moved; only runs of many readings go through equi-joins on source, band and
time bucket and through rounds of components. Of crossings that want each other's pieces the earlier one has
them; that is settled by rounds over the conflicts alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from spanloom.functions import text
from spanloom.operators.addresses import track_addresses
from spanloom.operators.dealing import dealt
from spanloom.operators.folds import folded
from spanloom.operators.graph import checkpointed, connected, fallen
from spanloom.sources.shipping import ship

# Share of the height of a band, overlap that pieces need, seconds a piece lasts at most, letters of a
# reading that links, of the run that aligns it, their likeness, letters of a long reading, share of the width that is an edge, letters lost and
# gained by a reading that moved, width of the pieces that show it, height of a piece without links, width that a last reading may still have.
BAND, OVERLAP, LONGEST, LETTERS, RUN, ALIKE = 0.25, 0.5, 45.0, 6, 4, 0.75
LONG, EDGE, SLID, WIDE, HEIGHT, TAIL, SLACK = 12, 0.05, 6, 0.5, 0.5, 0.3, 0.001
# Readings of a run that is folded by one task, longer ones are joined by many; crossings that a run can number.
SHORT, NUMBERS = 500, 1 << 32
FIXED_ROUTINGS = ["REVIEW_PERSISTENT_OVERLAY", "LIKELY_TITLE_OVERLAY", "REVIEW_POLICY_OVERRIDE"]
FIXED_CANDIDATES = ["persistent_overlay", "title_overlay"]
SUBTITLE = "LIKELY_SUBTITLE"


@dataclass(frozen=True)
class Scan:
    """Size of the frame and times of the readings."""

    width: float
    height: float
    every: float
    start: float = 0.0

    @property
    def gap(self) -> float:
        return self.every + SLACK

    @property
    def bucket(self) -> float:
        return LONGEST + self.gap + 1


def longest_run(a: str, b: str) -> tuple[int, int, int]:
    """The longest run of letters that two texts share, the first one in a and then in b: (place in a, place in b, length), as difflib finds it."""
    at = size = 0
    for i in range(len(a)):
        while i + size < len(a) and a[i : i + size + 1] in b:
            at, size = i, size + 1
    return at, b.find(a[at : at + size]), size


def line_up(a: str, b: str) -> tuple[bool, bool]:
    """Whether two readings show one stretch of a line, and whether the second is the first moved on.

    Their longest common run says how they lie against each other; what both cover must be alike.
    """
    at, where, size = longest_run(a, b)
    shift = at - where
    low, high = max(0, shift), min(len(a), shift + len(b))
    if size < RUN or high - low < LETTERS:
        return False, False
    x, y = a[low:high], b[low - shift : high - shift]
    if x != y and SequenceMatcher(None, x, y, autojunk=False).ratio() < ALIKE:
        return False, False
    ahead = shift + len(b) - len(a)
    return True, high - low >= LONG and abs(shift) >= SLID and abs(ahead) >= SLID and (shift > 0) == (ahead > 0)


@F.pandas_udf(StructType([StructField("related", BooleanType()), StructField("moved", BooleanType())]))
def lined_up(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([line_up(x, y) for x, y in zip(a, b, strict=True)], columns=["related", "moved"])


def overlap(a: str, b: str) -> Column:
    """Share of the lower of two boxes (structs with y1, y2) that both cover in height."""
    shared = F.least(f"{a}.y2", f"{b}.y2") - F.greatest(f"{a}.y1", f"{b}.y1")
    return F.greatest(F.lit(0.0), shared) / F.greatest(F.lit(1.0), F.least(F.col(f"{a}.y2") - F.col(f"{a}.y1"), F.col(f"{b}.y2") - F.col(f"{b}.y1")))


def runs_of_letters(reading: Column) -> Column:
    """The runs of four letters of a reading, each once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(reading) - (RUN - 1))), lambda i: F.substring(reading, i, RUN)))


def pieces(tracks: DataFrame, scan: Scan) -> DataFrame:
    """(source, side, track_id, p): short tracks in the top or bottom band that nothing else holds, p with all they have and their folded readings."""
    centre = (F.col("y1") + F.col("y2")) / 2 / scan.height
    side = F.when(centre < BAND, "top").when(centre > 1 - BAND, "bottom")
    readings = F.array_distinct(F.filter(F.transform("texts", text.fold_alnum), lambda x: F.length(x) >= LETTERS))
    none = F.array().cast("array<string>")
    free = ~F.coalesce(F.col("routing").isin(FIXED_ROUTINGS), F.lit(False)) & ~F.coalesce(F.col("candidate").isin(FIXED_CANDIDATES), F.lit(False)) & ~F.coalesce("grouped", F.lit(False))
    rows = tracks.where(free & (F.col("end") - F.col("start") <= LONGEST)).withColumn("side", side).where("side is not null").withColumn("readings", F.coalesce(readings, none))
    rows = rows.withColumn("letters", F.coalesce(F.array_max(F.transform("readings", F.length)), F.lit(0)))
    return rows.select("source", "side", "track_id", F.struct("start", "end", F.coalesce("blur_end", "end").alias("blur_end"), "x1", "y1", "x2", "y2", "texts", "routing", "observations", "ad_probability", "policy_hits", "readings", "letters", "track_id").alias("p"))


def buckets(rows: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def links(own: DataFrame, scan: Scan) -> DataFrame:
    """(source, side, a, b): pieces a and b of which b follows a in its band and shows a stretch of the same line."""
    read = own.where("p.letters > 0")
    early = buckets(read.withColumnRenamed("p", "a"), F.col("a.start"), F.col("a.end") + scan.gap, scan.bucket).drop("track_id")
    late = read.withColumnRenamed("p", "b").withColumn("bucket", F.floor(F.col("b.start") / scan.bucket)).drop("track_id")
    after = F.expr("struct(a.start, a.track_id) < struct(b.start, b.track_id)") & (F.col("b.start") <= F.col("a.end") + scan.gap)
    near = early.join(late, ["source", "side", "bucket"]).where(after & (overlap("a", "b") >= OVERLAP))
    each = near.select("source", "side", F.col("a.track_id").alias("a"), F.col("b.track_id").alias("b"), F.explode("a.readings").alias("first"), F.col("b.readings").alias("others"))
    each = each.select("source", "side", "a", "b", "first", F.explode("others").alias("second"))
    same = each.where("first = second").select("source", "side", "a", "b")
    # pieces that meet in a bucket are few bytes and much work
    alike = dealt(each.where("first <> second"), "source", "side", "a").where(lined_up("first", "second")["related"]).select("source", "side", "a", "b")
    return same.unionByName(alike).distinct()


def crossed(scan: Scan) -> Column:
    """Which way the pieces p of a group crossed: from an edge, later at the other; null if they didn't."""
    edge = EDGE * scan.width
    right = (F.col("p.x2") >= scan.width - edge) & (F.col("p.x1") > edge)
    left = (F.col("p.x1") <= edge) & (F.col("p.x2") < scan.width - edge)
    at = lambda side, f: f(F.when(side, F.col("p.start")))
    return F.when(at(right, F.min) < at(left, F.max), "right_to_left").when(at(left, F.min) < at(right, F.max), "left_to_right")


def slid(members: DataFrame, scan: Scan) -> DataFrame:
    """(source, side, component) of those with a wide reading that is an earlier one moved on.

    Each different reading of a component is one row with its first and last place, so readings that
    repeat don't multiply. Most that moved show it in two readings that follow each other; only components
    that don't are compared whole, where two readings meet if they share a run of letters.
    """
    key = ["source", "side", "component"]
    wide = members.where(F.col("p.x2") - F.col("p.x1") >= WIDE * scan.width)
    # moved on by six letters and twelve in common: shorter readings can't have
    each = wide.select(*key, F.col("p.start").alias("start"), F.posexplode("p.readings").alias("pos", "reading")).where(F.length("reading") >= LONG + SLID)
    place = F.struct("start", "pos", "reading")
    each = each.groupBy(*key, "reading").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    next_to = each.withColumn("before", F.lag("reading").over(W.partitionBy(*key).orderBy("first"))).where("before is not null")
    told = dealt(next_to, *key, "reading").where(lined_up("before", "reading")["moved"]).select(*key).distinct().checkpoint()
    grams = each.join(told, key, "left_anti").withColumn("gram", F.explode(runs_of_letters(F.col("reading"))))
    a = grams.select(*key, "gram", F.col("reading").alias("x"), F.col("first").alias("first_at"))
    b = grams.select(*key, "gram", F.col("reading").alias("y"), F.col("last").alias("last_at"))
    pairs = a.join(b, [*key, "gram"]).where(F.col("x") != F.col("y")).where("first_at < last_at").select(*key, "x", "y").distinct()
    return told.unionByName(dealt(pairs, *key, "x").where(lined_up("x", "y")["moved"]).select(*key).distinct())


def cut(own: DataFrame, scan: Scan) -> DataFrame:
    """Adds ``part`` to pieces: the number of the run of their band between pauses, and ``weight``: readings in it, more than ``SHORT`` if a box isn't a number."""
    odd = [F.isnan(f"p.{c}") for c in ("x1", "y1", "x2", "y2")]
    one = F.when(F.coalesce(F.greatest(*odd), F.lit(False)), SHORT + 1).otherwise(F.greatest(F.lit(1), F.coalesce(F.size("p.texts"), F.lit(1)))).cast("long")
    band = W.partitionBy("source", "side").orderBy("p.start", "track_id")
    opens = F.coalesce((F.col("p.start") > F.max("p.end").over(band.rowsBetween(W.unboundedPreceding, -1)) + scan.gap).cast("long"), F.lit(1))
    parted = own.where("source is not null and track_id is not null").withColumn("opens", opens).withColumn("part", F.sum("opens").over(band.rowsBetween(W.unboundedPreceding, 0)))
    return parted.withColumn("weight", F.sum(one).over(W.partitionBy("source", "side", "part"))).drop("opens")


def moved_in_run(scan: Scan) -> Callable[[Iterator], Iterator[tuple]]:
    """A fold of one run's pieces in order: the members of its crossings, numbered. What ``links``, ``connected``, ``crossed``, ``slid`` and ``joined`` tell, for a run that fits a task."""
    edge = EDGE * scan.width

    def level(a, b) -> bool:
        return max(0.0, min(a.y2, b.y2) - max(a.y1, b.y1)) / max(1.0, min(a.y2 - a.y1, b.y2 - b.y1)) >= OVERLAP

    def meet(a, b) -> bool:
        return max(a.start, b.start) <= min(a.end, b.end) + scan.gap and level(a, b)

    def related(a, b) -> bool:
        return level(a, b) and any(x == y or line_up(x, y)[0] for x in a.readings for y in b.readings)

    def crosses(members: list) -> bool:
        boxed = [r for r in members if r.x1 is not None and r.x2 is not None]
        right = [r.start for r in boxed if r.x2 >= scan.width - edge and r.x1 > edge]
        left = [r.start for r in boxed if r.x1 <= edge and r.x2 < scan.width - edge]
        return bool(right and left) and (min(right) < max(left) or min(left) < max(right))

    def slides(members: list) -> bool:
        first, last = {}, {}
        for r in members:
            if r.x1 is not None and r.x2 is not None and r.x2 - r.x1 >= WIDE * scan.width:
                for place in ((r.start, i, x) for i, x in enumerate(r.readings) if len(x) >= LONG + SLID):
                    first[place[2]], last[place[2]] = min(place, first.get(place[2], place)), max(place, last.get(place[2], place))
        order = sorted(first, key=first.get)
        return any(line_up(x, y)[1] for x, y in zip(order, order[1:])) or any(x != y and first[x] < last[y] and line_up(x, y)[1] for x in order for y in order)

    def fold(rows: Iterator) -> Iterator[tuple]:
        own, root, live = list(rows), [], []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, b in enumerate(own):
            root.append(i)
            live = [j for j in live if b.start <= own[j].end + scan.gap]
            for j in reversed(live):  # the nearest first, since what already hangs together needn't be aligned
                if top(j) != top(i) and related(own[j], b):
                    root[top(i)] = top(j)
            live.append(i)
        parts: dict[int, list] = {}
        for i, r in enumerate(own):
            parts.setdefault(top(i), []).append(r)
        # in the order of their first pieces, as the pieces are
        told = [m for m in parts.values() if max(r.letters for r in m) >= LONG and (crosses(m) or slides(m))]
        run = 0
        for no, members in enumerate(told, 1):
            met = next((k for k in range(no - 1, 0, -1) if any(meet(a, b) for a in told[k - 1] for b in members)), 0)
            run = run if run and met >= run else no
            yield from ((r.source, r.side, r.track_id, r.part * NUMBERS + run) for r in members)

    return fold


def moved(own: DataFrame, scan: Scan) -> DataFrame:
    """(source, side, track_id, run) of the pieces of crossings, numbered in order of time."""
    key = ["source", "side", "component"]
    parts = cut(own, scan)
    read = parts.where("p.letters > 0").where(F.col("weight") <= SHORT)
    flat = read.select("source", "side", "part", "track_id", *[f"p.{c}" for c in ("start", "end", "x1", "y1", "x2", "y2", "readings", "letters")])
    kinds = {c: own.schema[c].dataType.simpleString() for c in ("source", "track_id")}
    short = folded(flat, ["source", "side", "part"], ["start", "track_id"], moved_in_run(scan), f"source {kinds['source']}, side string, track_id {kinds['track_id']}, run long", deal=True)
    # few bytes by now: small partitions are put together again before each later step writes one file for each
    short = short.repartition("source", "side", "track_id")
    checkpointed(own.sparkSession)
    long = parts.where(F.col("weight") > SHORT).select("source", "side", "part").distinct().checkpoint()
    if long.isEmpty():
        return short
    own = parts.join(long, ["source", "side", "part"], "left_semi").drop("weight")
    edges = links(own.drop("part"), scan)
    node = lambda c: F.struct("source", "side", F.col(c).alias("track_id"))
    found = connected(edges.select(node("a").alias("a"), node("b").alias("b"))).select("id.*", F.col("component.track_id").alias("component"))
    members = own.where("p.letters > 0").join(found, ["source", "side", "track_id"], "left").withColumn("component", F.coalesce("component", "track_id"))
    told = members.groupBy(*key).agg(F.max("p.letters").alias("letters"), crossed(scan).alias("direction")).where(F.col("letters") >= LONG)
    still = told.where("direction is null").select(*key)
    gone = told.where("direction is not null").select(*key).unionByName(slid(members.join(still, key, "left_semi"), scan)).checkpoint()
    # no crossing goes beyond its part
    crossings = joined(members.join(gone, key, "left_semi"), scan).withColumn("run", F.col("part") * NUMBERS + F.col("run"))
    return short.unionByName(crossings.select("source", "side", "track_id", "run"))


def joined(moving: DataFrame, scan: Scan) -> DataFrame:
    """Numbers the crossings: adds ``run`` to the pieces (source, side, component, track_id, p) of moving components.

    Components stand by their first piece; one goes on with the crossing before it if a piece of
    that crossing meets one of its own. The latest component before it that it meets decides.
    """
    firsts = moving.groupBy("source", "side", "component").agg(F.min(F.struct("p.start", "p.track_id")).alias("first"))
    numbered = firsts.withColumn("no", F.row_number().over(W.partitionBy("source", "side").orderBy("first")).cast("long")).drop("first")
    moving = moving.join(numbered, ["source", "side", "component"])
    timed = buckets(moving, F.col("p.start"), F.col("p.end") + scan.gap, scan.bucket)
    a, b = (timed.select("source", "side", "bucket", F.col("p").alias(x), F.col("no").alias(f"{x}_no")) for x in "ab")
    meets = (F.greatest("a.start", "b.start") <= F.least("a.end", "b.end") + scan.gap) & (F.col("bucket") == F.floor(F.greatest("a.start", "b.start") / scan.bucket))
    met = a.join(b, ["source", "side", "bucket"]).where("a_no < b_no").where(meets & (overlap("a", "b") >= OVERLAP)).groupBy("source", "side", F.col("b_no").alias("no")).agg(F.max("a_no").alias("met"))

    def fold(rows):
        run = None
        for r in rows:
            run = run if run is not None and r.met >= run else r.no
            yield r.source, r.side, r.no, run

    rows = numbered.select("source", "side", "no").join(met, ["source", "side", "no"], "left").withColumn("met", F.coalesce("met", F.lit(0)))
    kind = moving.schema["source"].dataType.simpleString()
    return moving.join(folded(rows, ["source", "side"], ["no"], fold, f"source {kind}, side string, no long, run long"), ["source", "side", "no"]).drop("no")


def absorbed(crossings: DataFrame, own: DataFrame, scan: Scan) -> DataFrame:
    """(source, side, run, p): the members of each crossing, with other pieces in its band while it crosses.

    A crossing that has lost a piece to an earlier one is none; its other pieces are free again.
    """
    key = ["source", "side", "run"]
    bands = crossings.groupBy(*key).agg(F.struct(F.min("p.y1").alias("y1"), F.max("p.y2").alias("y2")).alias("band"), (F.min("p.start") - scan.gap).alias("low"), (F.max("p.end") + scan.gap).alias("high"))
    held = crossings.select("source", "side", "track_id", F.col("run").alias("owner"))
    free = own.where(F.coalesce(F.col("p.routing") != SUBTITLE, F.lit(True))).withColumn("bucket", F.floor(F.col("p.start") / scan.bucket)).join(held, ["source", "side", "track_id"], "left")
    tall = F.greatest(F.lit(1.0), F.col("p.y2") - F.col("p.y1")) >= HEIGHT * (F.col("band.y2") - F.col("band.y1"))
    inside = (F.col("p.start") >= F.col("low")) & (F.col("p.end") <= F.col("high")) & tall & (overlap("p", "band") >= OVERLAP)
    wants = buckets(bands, F.col("low"), F.col("high"), scan.bucket).join(free, ["source", "side", "bucket"]).where(inside & ~F.col("owner").eqNullSafe(F.col("run"))).select(*key, "track_id", "p", "owner")
    node = lambda c: F.struct("source", "side", F.col(c).alias("run"))
    lost = fallen(wants.where("owner > run").select(node("run").alias("a"), node("owner").alias("b"))).select("id.*")
    claims = crossings.select(*key, "track_id", "p").unionByName(wants.drop("owner")).join(lost, key, "left_anti")
    first = W.partitionBy("source", "side", "track_id").orderBy("run")
    return claims.withColumn("claim", F.row_number().over(first)).where("claim = 1").drop("claim")


def scrolling_lines(tracks: DataFrame, scan: Scan) -> DataFrame:
    """One row for each line that scrolls through the top or bottom band.

    tracks: (source, track_id, start, end, blur_end, x1, y1, x2, y2, texts, routing, candidate, grouped,
    observations, ad_probability, policy_hits), track_id unique within its source. Returns (source, track_id,
    start, end, blur_end, x1, y1, x2, y2, texts, observations, ad_probability, policy_hits, grouped_track_ids, side,
    direction, first_read, last_read, lead, tail, addresses); track_id is that of the member with the
    longest reading. The line begins one reading before its first piece, two if that isn't at the
    edge where it enters, and lasts a reading longer if the last piece still covers much of the frame.
    Tracks without box, texts or times make no lines.
    """
    ship(tracks.sparkSession)
    own = pieces(tracks, scan)
    crossings = own.join(moved(own, scan), ["source", "side", "track_id"]).checkpoint()
    return described(absorbed(crossings, own, scan), scan)


def described(lines: DataFrame, scan: Scan) -> DataFrame:
    """What a line is, from its members (source, side, run, p)."""
    edge = EDGE * scan.width
    rows = lines.groupBy("source", "side", "run").agg(
        F.min("p.start").alias("first_read"), F.max("p.end").alias("last_end"), F.max("p.blur_end").alias("last_blur"), F.min("p.y1").alias("top"), F.max("p.y2").alias("bottom"), crossed(scan).alias("direction"),
        F.array_sort(F.collect_list(F.struct("p.start", "p.x1", "p.track_id", "p.end", "p.x2", "p.texts", "p.policy_hits"))).alias("m"), F.sum("p.observations").alias("observations"), F.max(F.coalesce("p.ad_probability", F.lit(0.0))).alias("ad_probability"),
        F.min(F.struct((-F.col("p.letters")).alias("letters"), "p.start", "p.x1", "p.track_id")).alias("anchor"),
    )
    opening, closing = F.filter("m", lambda x: x["start"] == F.col("first_read")), F.filter("m", lambda x: x["end"] == F.col("last_end"))
    to_left, to_right = F.coalesce(F.col("direction") == "right_to_left", F.lit(False)), F.coalesce(F.col("direction") == "left_to_right", F.lit(False))
    entered = F.when(to_left, F.exists(opening, lambda x: (x["x2"] >= scan.width - edge) & (x["x1"] > edge))).when(to_right, F.exists(opening, lambda x: (x["x1"] <= edge) & (x["x2"] < scan.width - edge))).otherwise(False)
    left = F.when(to_left, F.array_max(F.transform(closing, lambda x: x["x2"])) / scan.width).when(to_right, (scan.width - F.array_min(F.transform(closing, lambda x: x["x1"]))) / scan.width).otherwise(1.0)
    rows = rows.withColumn("lead", F.when(entered, scan.every).otherwise(2 * scan.every)).withColumn("tail", F.when(left > TAIL, scan.every).otherwise(0.0))
    texts = F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x["texts"], F.array().cast("array<string>")))))
    hits = F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x["policy_hits"], F.array().cast("array<string>")))))
    end = F.bround(F.col("last_end") + F.col("tail"), 3)
    return rows.select(
        "source", "anchor.track_id", F.bround(F.greatest(F.lit(scan.start), F.col("first_read") - F.col("lead")), 3).alias("start"), end.alias("end"), F.greatest(end, F.bround(F.col("last_blur") + F.col("tail"), 3)).alias("blur_end"),
        F.lit(0.0).alias("x1"), F.bround("top").alias("y1"), F.bround(F.lit(scan.width)).alias("x2"), F.bround("bottom").alias("y2"), F.slice(texts, 1, 8).alias("texts"), "observations", "ad_probability", hits.alias("policy_hits"),
        F.transform("m", lambda x: x["track_id"]).alias("grouped_track_ids"), "side", "direction", F.bround("first_read", 3).alias("first_read"), F.bround(F.col("last_end") - scan.every, 3).alias("last_read"), "lead", (F.lit(scan.every) + F.col("tail")).alias("tail"),
        F.slice(track_addresses(texts), 1, 5).alias("addresses"),
    )


def regrouped(tracks: DataFrame, lines: DataFrame) -> DataFrame:
    """The tracks that no line holds, and the lines as tracks to be blurred."""
    gone = lines.select("source", F.explode("grouped_track_ids").alias("track_id"))
    kept = tracks.join(gone, ["source", "track_id"], "left_anti").withColumn("suggestion", F.lit(None).cast("string"))
    return kept.unionByName(lines.withColumns({"routing": F.lit("REVIEW_SCROLLING_TEXT"), "candidate": F.lit("scrolling_text"), "grouped": F.lit(True), "suggestion": F.lit("BLUR")}).select(*kept.columns))
