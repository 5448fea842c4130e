"""Text that stands at one place for most of a film, as one track or as many that read pieces of one line.

A faint line is read now and then, and then only in part. Its tracks are found by a fuzzy join of
their readings (a piece is like a stretch of another) and by place, and put together by
components. Tracks of equal place and readings are one node of the graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import boxes
from spanloom.operators.addresses import track_addresses
from spanloom.operators.fuzzy import fragments
from spanloom.operators.graph import connected

# Share of the scan in which one track is read, seconds and share of it that it spans, share from which a card
# covers all of it; tracks of a recurring line, long readings among them, their letters, letters of a piece, its likeness, the
# share it spans; share of a track inside a whole-film text that makes it a piece of that.
COVERAGE, SPAN, WHOLE = 0.5, 60.0, 0.5
TRACKS, LONG_READINGS, LONG, PIECE, LIKENESS, LINE_SPAN, INSIDE = 8, 3, 12, 6, 0.75, 0.3, 0.6
# Where the middle of a subtitle line lies, the share of its pieces that make it one line, the score of an advertisement.
BAND_TOP, BAND_LEFT, BAND_RIGHT, CONSENSUS, AD_SCORE = 0.7, 0.18, 0.82, 0.6, 0.45
SKIPPED = ["REVIEW_PERSISTENT_OVERLAY", "REVIEW_POLICY_OVERRIDE", "LIKELY_TITLE_OVERLAY"]
AD_ROUTINGS = ["REVIEW_AD_LIKELY", "REVIEW_POLICY_OVERRIDE"]
DOMAIN, SITE_LETTERS = r"(?iU)\b[a-z0-9][a-z0-9-]{2,}\.[a-z]{2,6}\b", 6
SIDES = ["x1", "y1", "x2", "y2"]
KEY = ["source", "line"]


@dataclass(frozen=True)
class Film:
    """Size of the frame, seconds between readings and the scanned time."""

    width: float
    height: float
    every: float
    start: float
    seconds: float
    end: float


def _none() -> Column:
    return F.array().cast("array<string>")


def readings(texts: str = "texts") -> Column:
    """Folded texts of six letters or more, each once."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(texts, text.fold_alnum), lambda x: F.length(x) >= PIECE)), _none())


def longest(texts: str = "texts") -> Column:
    """The longest folded text of a track, the first of equal ones; empty without any."""
    folded = F.array_compact(F.transform(F.coalesce(texts, _none()), text.fold_alnum))
    return F.aggregate(folded, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def contacts(value: Column) -> Column:
    """Whether a text names a site, an address, a telephone or a handle."""
    return value.rlike(DOMAIN) | (F.size(text.ad_tokens(value)) > 0)


def recurring(tracks: DataFrame, least_tracks: int = TRACKS) -> DataFrame:
    """(source, track_id, line): tracks that read pieces of one line at one place, the lines of enough tracks and long readings; named by their first track.

    Two tracks are of one line if they overlap by half the lower one's height, share columns, and a reading of one is like a
    stretch of a reading of the other.
    """
    proper = tracks.where(~F.coalesce(F.col("routing").isin(SKIPPED), F.lit(False)) & ~F.coalesce(F.col("candidate") == "persistent_overlay", F.lit(False))).where("x2 > x1 and y2 >= y1")
    own = proper.select("source", "track_id", *SIDES, F.array_sort(readings()).alias("read")).where(F.size("read") > 0)
    spots = own.groupBy("source", *SIDES, "read").agg(F.min("track_id").alias("spot"), F.max("track_id").alias("last"))
    each = spots.select("source", F.struct("spot", "last", *SIDES).alias("s"), F.explode("read").alias("word"))
    words = each.select("source", "word").distinct()
    pairs = fragments(words, ["source"], LIKENESS).unionByName(words.select("source", F.col("word").alias("a"), F.col("word").alias("b")))
    met = each.select("source", F.col("s").alias("p"), F.col("word").alias("a")).join(pairs, ["source", "a"]).join(each.select("source", F.col("s").alias("q"), F.col("word").alias("b")), ["source", "b"])
    # of two readings of one length the earlier track's is the piece
    ordered = (F.length("a") < F.length("b")) | (F.col("a") == F.col("b")) | (F.col("p.spot") < F.col("q.last"))
    placed = boxes.same_band("p.", "q.") & (F.least("p.x2", "q.x2") > F.greatest("p.x1", "q.x1"))
    node = lambda c: F.struct("source", F.col(c).alias("spot"))
    edges = met.where("p.spot <> q.spot").where(ordered & placed).select(node("p.spot").alias("a"), node("q.spot").alias("b"))
    found = connected(edges).select("id.*", F.col("component.spot").alias("line"))
    lines = own.join(spots, ["source", *SIDES, "read"]).join(found, ["source", "spot"], "left").select("source", "track_id", F.coalesce("line", "spot").alias("line"), F.array_max(F.transform("read", F.length)).alias("letters"))
    enough = lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("letters") >= LONG).alias("long")).where((F.col("n") >= least_tracks) & (F.col("long") >= LONG_READINGS))
    return lines.join(enough, KEY, "left_semi").select("source", "track_id", "line")


def line_consensus(members: DataFrame) -> DataFrame:
    """(source, line, consensus): largest share of a line's members (source, line, texts) whose longest reading is a piece of one long reading among them."""
    told = members.select(*KEY, longest().alias("word")).where("word <> ''").groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    order = F.struct(F.length("word").alias("n"), F.col("word").alias("w"))
    whole = told.groupBy(*KEY).agg(F.sum("n").alias("total"), F.max(order)["w"].alias("most"), F.max(F.length("word")).alias("letters"))
    refs = told.join(whole, KEY).where((F.length("word") >= LONG) | ((F.col("letters") < LONG) & (F.col("word") == F.col("most")))).select(*KEY, F.col("word").alias("ref"))
    near = fragments(told, KEY, LIKENESS)
    # a text is the piece of a reference as long as itself, and a longer text has the reference as its piece
    pairs = near.select(*KEY, F.col("a").alias("word"), F.col("b").alias("ref")).unionByName(near.where("length(a) < length(b)").select(*KEY, F.col("b").alias("word"), F.col("a").alias("ref")))
    pairs = pairs.unionByName(told.select(*KEY, "word", F.col("word").alias("ref"))).join(refs, [*KEY, "ref"], "left_semi").distinct()
    best = pairs.join(told, [*KEY, "word"]).groupBy(*KEY, "ref").agg(F.sum("n").alias("n")).groupBy(*KEY).agg(F.max("n").alias("best"))
    return whole.join(best, KEY, "left").select(*KEY, (F.coalesce("best", F.lit(0)) / F.col("total")).alias("consensus"))


def evidence(members: DataFrame) -> DataFrame:
    """(source, line, evidence): signs of advertising among the members in order, five at most, each as 'kind value'."""
    none = _none()
    signs = F.concat(
        F.when(F.col("routing").isin(AD_ROUTINGS), F.array(F.concat(F.lit("routing "), "routing"))).otherwise(none),
        F.when(F.col("ad_probability") >= AD_SCORE, F.array(F.format_string("score %.2f", F.col("ad_probability")))).otherwise(none),
        F.transform(F.filter(F.coalesce("texts", none), lambda x: F.coalesce(contacts(x), F.lit(False))), lambda x: F.concat(F.lit("address "), x)),
        F.when(F.col("platform").isNotNull(), F.array(F.concat(F.lit("platform "), "platform"))).otherwise(none),
    )
    each = members.select(*KEY, "track_id", F.posexplode(signs).alias("pos", "sign"))
    return _first(each, "sign", F.struct("track_id", "pos"), 5).withColumnRenamed("sign", "evidence")


def _first(rows: DataFrame, column: str, order: Column, most: int) -> DataFrame:
    """(source, line, column): the first ``most`` different values by the order, as an array."""
    at = rows.groupBy(*KEY, column).agg(F.min(order).alias("at"))
    ranked = at.withColumn("rank", F.row_number().over(W.partitionBy(*KEY).orderBy("at", column))).where(F.col("rank") <= most)
    return ranked.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", column))), lambda x: x[column]).alias(column))


def site_words(texts: str = "texts") -> Column:
    """Folded words of six letters or more of the sites that texts name."""
    sites = F.flatten(F.transform(texts, lambda x: F.regexp_extract_all(x, F.lit(DOMAIN), F.lit(0))))
    return F.array_distinct(F.filter(F.flatten(F.transform(sites, lambda x: F.split(text.fold(x), "[^0-9a-z]+"))), lambda w: F.length(w) >= SITE_LETTERS))


def fixed_overlays(tracks: DataFrame, film: Film) -> DataFrame:
    """One row for each text that stays at one place: a track read in half of the scan, or a recurring line.

    tracks: (source, track_id, start, end, blur_end, x1, y1, x2, y2, texts, routing, candidate, persistent, observations, ad_probability,
    platform), track_id unique within its source and in order of the report. Returns (source, track_id, rule,
    start, end, observed_start, observed_end, whole_film, n_tracks, coverage, x1, y1, x2, y2, texts, observations, evidence, consensus, suggestion, grouped_track_ids).
    A blur is suggested with evidence: an advertisement's routing or score, an address, a platform, or the name of a
    site that another such text shows. A chain of dialogue in the subtitle band, whose pieces are of no one line (``consensus``), suggests nothing.
    """
    key = ["source", "track_id"]
    free = ~F.coalesce(F.col("routing").isin(SKIPPED), F.lit(False)) & ~F.coalesce(F.col("candidate") == "persistent_overlay", F.lit(False)) & F.col("x1").isNotNull()
    coverage = F.coalesce("observations", F.lit(0)) * film.every / film.seconds
    whole = tracks.where(free & F.coalesce("persistent", F.lit(False)) & (coverage >= COVERAGE) & (F.col("end") - F.col("start") >= max(SPAN, WHOLE * film.seconds)))
    rest = tracks.join(whole.select(key), key, "left_anti")
    held = rest.alias("i").join(whole.select("source", *[F.col(s).alias(f"o_{s}") for s in SIDES]), "source").where(boxes.intersection("i.", "o_") / F.greatest(F.lit(1.0), boxes.area("i.")) >= INSIDE).select("source", "i.track_id")
    lines = recurring(rest.join(held, key, "left_anti"))
    joined = tracks.join(lines, key).withColumn("rule", F.lit("recurring_fixed_text"))
    spans = joined.groupBy(*KEY).agg((F.max("end") - F.min("start")).alias("span")).where(F.col("span") >= max(SPAN, LINE_SPAN * film.seconds))
    members = joined.join(spans, KEY, "left_semi").unionByName(whole.withColumn("line", F.col("track_id")).withColumn("rule", F.lit("whole_film_text"))).checkpoint()
    return described(members, film)


def described(members: DataFrame, film: Film) -> DataFrame:
    """What each line of members (source, line, rule, and the columns of tracks) is."""
    none = _none()
    letters = F.length(longest())
    until = F.coalesce("blur_end", "end")
    anchor = F.min(F.struct((-letters).alias("n"), "start", "track_id"))["track_id"]
    sums = members.groupBy(*KEY, "rule").agg(
        F.min("start").alias("low"), F.max(until).alias("high"), anchor.alias("track_id"), F.count("*").alias("n_tracks"), F.sum(F.coalesce("observations", F.lit(0))).alias("observations"), *[F.bround((F.min if s in ("x1", "y1") else F.max)(s)).alias(s) for s in SIDES],
        F.array_sort(F.collect_list("track_id")).alias("grouped_track_ids"), F.bool_or(F.exists(F.coalesce("texts", none), lambda x: F.coalesce(contacts(x), F.lit(False))) | (F.size(track_addresses(F.coalesce("texts", none))) > 0) | F.col("platform").isNotNull()).alias("contact"),
    )
    length = F.coalesce(F.array_max(F.transform("texts", F.length)), F.lit(0))
    shown = _first(members.select(*KEY, "track_id", length.alias("n"), F.posexplode("texts").alias("pos", "texts")).where("texts is not null"), "texts", F.struct((-F.col("n")).alias("n"), "track_id", "pos"), 8)
    rows = sums.join(shown, KEY, "left").join(evidence(members), KEY, "left").withColumns({"texts": F.coalesce("texts", none), "evidence": F.coalesce("evidence", none)})
    rows = rows.withColumn("whole_film", F.col("high") - F.col("low") >= WHOLE * film.seconds).withColumn("place", F.struct(F.col("rule") != "whole_film_text", "line")).checkpoint()
    # the few fixed texts of a film are compared by the names of sites
    sites = rows.where(F.size("evidence") > 0).select("source", F.col("line").alias("other"), F.col("rule").alias("other_rule"), F.col("place").alias("at"), F.explode(site_words()).alias("site"))
    folded = F.transform("texts", text.fold_alnum)
    named = rows.select(*KEY, "rule", folded.alias("folded")).join(sites, "source").where("not (line = other and rule = other_rule)").where(F.exists("folded", lambda x: F.contains(x, F.col("site"))))
    named = named.groupBy(*KEY, "rule").agg(F.min(F.struct("at", "site"))["site"].alias("named"))
    middle = ((F.col("x1") + F.col("x2")) / 2 / film.width, (F.col("y1") + F.col("y2")) / 2 / film.height)
    band = (F.col("rule") == "recurring_fixed_text") & F.col("whole_film") & (middle[1] >= BAND_TOP) & middle[0].between(BAND_LEFT, BAND_RIGHT) & ~F.col("contact")
    subtitles = members.join(rows.where(band).select(*KEY, "rule"), [*KEY, "rule"], "left_semi")
    rows = rows.join(named, [*KEY, "rule"], "left").join(line_consensus(subtitles).withColumn("rule", F.lit("recurring_fixed_text")), [*KEY, "rule"], "left")
    dialogue = F.coalesce((F.col("consensus") < CONSENSUS) & F.col("named").isNull(), F.lit(False))
    signs = F.when((F.size("evidence") == 0) & F.col("named").isNotNull(), F.array(F.concat(F.lit("site "), "named"))).otherwise(F.col("evidence"))
    total = F.least(F.lit(1.0), F.col("observations") * film.every / film.seconds)
    return rows.select(
        "source", "track_id", "rule", F.when(F.col("whole_film"), film.start).otherwise(F.round("low", 3)).alias("start"), F.when(F.col("whole_film"), film.end).otherwise(F.round("high", 3)).alias("end"), F.round("low", 3).alias("observed_start"), F.round("high", 3).alias("observed_end"), "whole_film", "n_tracks",
        F.when(F.col("rule") == "whole_film_text", F.round(total, 4)).alias("coverage"), *SIDES, "texts", "observations", signs.alias("evidence"), F.when(dialogue, F.round("consensus", 3)).alias("consensus"), F.when((F.size(signs) > 0) & ~dialogue, "BLUR").alias("suggestion"), "grouped_track_ids",
    )
