"""Registered queries over text tracks: scrolling lines and what else follows a text through a film."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import fixed_text, fuzzy, scenes, scrolling, subtitles, watermarks
from spanloom.plans.catalog import query
from spanloom.sources.tables import samples, table
from spanloom.streaming import tracks

STEP, SHOWN = 20, 40


def line_pieces(spark, sf_dir):
    """Each turn of a conversation as a line that scrolls through a band, read every two seconds.

    A piece shows 40 characters, twenty further than the one before; the first stands at the right
    edge, the last at the left, those between across the frame. Every fifth turn stands still.
    """
    turns = table(spark, sf_dir, "conversations").where("length(text) > 0")
    still = F.col("turn") % 5 == 4
    k, last = F.col("k"), F.floor((F.length("text") - 1) / STEP)
    rows = turns.withColumn("last", last).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    start = F.col("turn") * 20000.0 + k * 2.0
    entering, leaving = ~still & (k == 0) & (F.col("last") > 0), ~still & (k == F.col("last")) & (k > 0)
    top = F.when(F.col("turn") % 2 == 0, 12.0).otherwise(318.0) + k % 3
    shown = F.substring("text", F.when(still, 1).otherwise(k * STEP + 1).cast("int"), F.lit(SHOWN))
    return rows.select(
        F.col("conv_id").alias("source"), (F.col("turn") * 100000 + k).alias("track_id"), start.alias("start"), (start + 2).alias("end"), (start + 2.5).alias("blur_end"),
        F.when(entering, 380.0).otherwise(0.0).alias("x1"), top.alias("y1"), F.when(leaving, 180.0).otherwise(640.0).alias("x2"), (top + 28).alias("y2"), F.array(shown).alias("texts"),
        F.when((F.col("turn") % 7 == 6) & (k % 2 == 0), "LIKELY_SUBTITLE").otherwise("LIKELY_SCENE_TEXT").alias("routing"), F.when(F.col("turn") % 11 == 10, "title_overlay").alias("candidate"), F.lit(False).alias("grouped"),
        (k % 4 + 1).alias("observations"), (F.length(shown) / 100.0).alias("ad_probability"), F.array(F.element_at(F.array(F.lit("ad"), F.lit("link"), F.lit("free")), (k % 3 + 1).cast("int"))).alias("policy_hits"),
    )


@query(None)
def scrolling_lines(spark, sf_dir):
    """Alignment of readings is a ratio of matching runs, beyond SQL: see tests/test_scrolling.py."""
    lines = scrolling.scrolling_lines(line_pieces(spark, sf_dir), scrolling.Scan(640, 360, 2.0))
    joined = {c: F.array_join(c, "|") for c in ("texts", "policy_hits", "addresses")}
    return lines.withColumn("line", F.floor(F.col("track_id") / 100000)).withColumns(joined | {"grouped_track_ids": F.array_join(F.transform("grouped_track_ids", lambda x: x.cast("string")), ",")})


def mark_tracks(spark, sf_dir):
    """Pages as tracks of a film for each of their top domains, read one after the other; the place moves by a few pixels and jumps by the length of the page."""
    pages = table(spark, sf_dir, "pages")
    i, n = F.col("page_id"), F.coalesce(F.length("html"), F.lit(0))
    x, y = (n % 4) * 160.0 + i % 7, F.floor(n / 4) % 2 * 200.0 + i % 5
    domain = F.coalesce(F.regexp_extract("url", "://[^/?#]*[.]([a-z]+)", 1), F.lit(""))
    routing = F.when(i % 13 == 12, "LIKELY_TITLE_OVERLAY").when(i % 3 == 0, "REVIEW_LOW_AD").otherwise("LIKELY_SCENE_TEXT")
    return pages.select(
        domain.alias("source"), i.alias("track_id"), (i * 40.0).alias("start"), (i * 40.0 + 10).alias("end"), (i * 40.0 + 10.5).alias("blur_end"), x.alias("x1"), y.alias("y1"), (x + 120 + n % 3 * 10).alias("x2"), (y + 40 + n % 5).alias("y2"),
        F.array("url").alias("texts"), routing.alias("routing"), F.when(i % 17 == 16, "scrolling_text").alias("candidate"), (i % 19 == 18).alias("fixed"), (n % 9 + 1).cast("long").alias("observations"), (n % 100 / 100.0).alias("confidence"), (n % 50 / 50.0).alias("ad_probability"),
        F.array(F.element_at(F.array(F.lit("ad"), F.lit("link")), (n % 2 + 1).cast("int"))).alias("policy_hits"), (i % 23 == 22).alias("persistent"),
    )


@query(None)
def repeated_marks(spark, sf_dir):
    """The moving median decides in order of time, and keys are alike by a ratio of matching runs: see tests/test_watermarks.py."""
    memory = spark.createDataFrame([], "key string")
    out = watermarks.repeated_marks(mark_tracks(spark, sf_dir), memory, 3.0, 0.0, 40.0 * 3000)
    joined = {c: F.array_join(c, "|") for c in ("texts", "policy_hits", "tokens", "remembered", "previous_routings")}
    return out.withColumns(joined | {"grouped_track_ids": F.array_join(F.transform("grouped_track_ids", lambda x: x.cast("string")), ","), "moments": F.to_json("moments")})


@query("""WITH RECURSIVE v AS (SELECT *, floor(value * 100)::BIGINT AS v, epoch_us(ts) / 1e6 AS t FROM events),
s AS (SELECT user_id AS source, event_id AS id, t AS a, t + value * 3 AS b, (v % 4) * 150 + (v // 7) % 9 AS x1, (v // 11) % 3 * 100 + (v // 13) % 7 AS y1, 80 + (v // 17) % 20 AS w, 40 + (v // 19) % 10 AS h, event_type FROM v),
r AS (SELECT *, x1 + w AS x2, y1 + h AS y2, row_number() OVER (PARTITION BY source ORDER BY a - b, a, id) AS place FROM s),
f(source, place, heads) AS (SELECT source, place, [{'place': place, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] FROM r WHERE place = 1 UNION ALL
SELECT r.source, r.place, CASE WHEN len(list_filter(heads, lambda k: greatest(0, least(k.x2, x2) - greatest(k.x1, x1)) * greatest(0, least(k.y2, y2) - greatest(k.y1, y1)) >= 0.8 * least((k.x2 - k.x1) * (k.y2 - k.y1), w * h))) > 0 THEN heads
ELSE list_append(heads, {'place': r.place, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}) END FROM f JOIN r ON r.source = f.source AND r.place = f.place + 1),
e AS (SELECT source, arg_max(heads, place) AS heads FROM f GROUP BY source),
l AS (SELECT r.*, list_filter(heads, lambda k: k.place <= r.place AND greatest(0, least(k.x2, x2) - greatest(k.x1, x1)) * greatest(0, least(k.y2, y2) - greatest(k.y1, y1)) >= 0.8 * least((k.x2 - k.x1) * (k.y2 - k.y1), w * h))[1].place AS leader FROM r JOIN e USING (source)),
g AS (SELECT source, leader, round(min(a), 3) AS "start", round(max(b), 3) AS "end", max(b) - min(a) AS span, string_agg(id, ',' ORDER BY id) AS suggestion_ids, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS labels,
bool_or(event_type = 'purchase') AS prior_blur, arg_min({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}, place) AS box, arg_max({'x1': x1 + 1, 'y1': y1 + 2, 'x2': x2 + 1, 'y2': y2 + 2}, (id::VARCHAR, place)) FILTER (event_type = 'purchase') AS decided FROM l GROUP BY source, leader),
o AS (SELECT *, CASE WHEN prior_blur THEN decided ELSE box END AS k, list_slice(string_split(labels, ','), 1, 4) AS few FROM g WHERE span >= 60)
SELECT source, k.x1, k.y1, k.x2, k.y2, "start", "end", suggestion_ids, array_to_string(few, ',') AS labels, prior_blur FROM o""")
def film_marks(spark, sf_dir):
    v = F.floor(F.col("score") * 100)
    t = F.col("t")
    x, y = v % 4 * 150 + F.floor(v / 7) % 9, F.floor(v / 11) % 3 * 100 + F.floor(v / 13) % 7
    right, bottom = x + 80 + F.floor(v / 17) % 20, y + 40 + F.floor(v / 19) % 10
    rows = samples(spark, sf_dir).select(
        "source", F.col("sample_id").alias("suggestion_id"), t.alias("start"), (t + F.col("score") * 3).alias("end"), *[c.alias(n) for n, c in (("x1", x), ("y1", y), ("x2", right), ("y2", bottom))],
        F.array("label", F.lit("Persistent external logo"), F.lit("a candidate")).alias("labels"), F.when(F.col("label") == "purchase", "BLUR").alias("decision"), F.col("sample_id").cast("string").alias("decided_at"),
        *[F.when(F.col("label") == "purchase", c).alias(n) for n, c in (("dx1", x + 1), ("dy1", y + 2), ("dx2", right + 1), ("dy2", bottom + 2))],
    )
    out = watermarks.film_marks(rows)
    return out.withColumns({"suggestion_ids": F.array_join(F.transform("suggestion_ids", lambda x: x.cast("string")), ","), "labels": F.array_join("labels", ",")})


def sentence_tracks(spark, sf_dir):
    """Each benchmark item as a film whose sentences are lines that are read nine times each, whole or by halves; lines of odd number stand under the picture."""
    items = table(spark, sf_dir, "benchmark").where("text is not null")
    lines = items.select("item_id", F.posexplode(F.split("text", "[.][ \\n]*")).alias("line", "words")).where("length(words) > 0")
    k, n = F.col("k"), F.length("words")
    half = F.floor(n / 2).cast("int")
    shown = F.when(k % 3 == 0, F.col("words")).when(k % 3 == 1, F.substring("words", F.lit(1), half)).otherwise(F.substring("words", half + 1, n))
    rows = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    start = F.when(F.col("line") % 3 == 2, k * 10.0).otherwise(k * 100.0) + F.col("line")
    top = F.when(F.col("line") % 2 == 1, 300.0).otherwise(F.col("line") * 40.0)
    persistent = (F.col("line") == 0) & (k == 0)
    return rows.select(
        F.col("item_id").alias("source"), (F.col("line") * 100 + k).cast("long").alias("track_id"), start.alias("start"), F.when(persistent, start + 700).otherwise(start + 3).alias("end"), F.when(persistent, start + 700).otherwise(start + 3.5).alias("blur_end"),
        (200.0 + k).alias("x1"), (top + k % 2).alias("y1"), (440.0 - k).alias("x2"), (top + 24).alias("y2"), F.array(shown).alias("texts"), F.when((n % 11 == 0) & (k == 4), "REVIEW_AD_LIKELY").otherwise("LIKELY_SCENE_TEXT").alias("routing"), F.lit(None).cast("string").alias("candidate"),
        persistent.alias("persistent"), F.when(persistent, 260).otherwise(n % 3 + 1).cast("long").alias("observations"), (n % 50 / 100.0).alias("ad_probability"), F.lit(None).cast("string").alias("platform"),
    )


@query(None)
def fixed_overlays(spark, sf_dir):
    """Pieces are like stretches of longer readings by a ratio of matching runs: see tests/test_fixed_text.py."""
    out = fixed_text.fixed_overlays(sentence_tracks(spark, sf_dir), fixed_text.Film(640.0, 360.0, 3.0, 0.0, 900.0, 900.0))
    return out.withColumns({"texts": F.array_join("texts", "|"), "evidence": F.array_join("evidence", "|"), "grouped_track_ids": F.array_join(F.transform("grouped_track_ids", lambda x: x.cast("string")), ",")})


@query(None)
def known_reads(spark, sf_dir):
    """The hosts of pages that repeat the name of another page's host, but for one misread letter: see tests/test_fixed_text.py."""
    pages = table(spark, sf_dir, "pages")
    host = text.normalize_read(F.regexp_extract("url", "://([^/?#]*)", 1))
    domain = F.regexp_extract("url", "://[^/?#]*[.]([a-z]+)", 1)
    reads = pages.select(domain.alias("scope"), host.alias("read"), F.col("page_id"))
    memory = reads.groupBy("scope", "read").agg(F.count("*").alias("n")).where("n > 1").select("scope", F.col("read").alias("word"))
    told = fuzzy.known(reads, memory, ["scope"]).withColumn("known", F.lit(True))
    return reads.join(told, ["scope", "read"], "left").select("page_id", "read", F.coalesce("known", F.lit(False)).alias("known"))


@query(None)
def text_tracks(spark, sf_dir):
    """Which track a reading goes on with depends on those before it: see tests/test_text_tracks.py. Every turn of a conversation stands in one of two zones for a minute and is read each two seconds, a word less each time."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    words = F.split("text", " ")
    rows = turns.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    shown = F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.size(words) - F.col("k"))), " ")
    x = F.length("text") % 50 + F.col("k")
    readings = rows.select(
        F.col("conv_id").alias("source"), (F.col("turn") * 4 + F.col("k") * 2).cast("double").alias("t"), (F.length(shown) % 100 / 100.0).alias("confidence"), x.cast("double").alias("x1"), F.lit(300.0).alias("y1"), (x + 200).cast("double").alias("x2"), F.lit(330.0).alias("y2"),
        F.when(F.col("turn") % 2 == 0, "subtitle").otherwise("bottom-left").alias("zone"), shown.alias("text"),
    )
    return tracks.text_tracks(readings, 2.0)


@query(None)
def safety_cards(spark, sf_dir):
    """Whether an item joins depends on what the card before it has become: see tests/test_scenes.py."""
    rows = samples(spark, sf_dir)
    category = F.when(F.col("label") == "error", "violence").when(F.col("label") == "click", "gore").when(F.col("label") == "view", "adult").otherwise("text")
    start, whole = (F.col("t") - 1704067200.0) / 900, F.floor("score")
    items = rows.select(
        "source", F.col("sample_id").alias("item_id"), category.alias("category"), start.alias("start"), (start + F.col("score") / 30).alias("end"), "score", F.when(whole % 3 == 0, "high").when(whole % 3 == 1, "context").otherwise("normal").alias("priority"), F.when(whole % 5 == 1, "CUT").when(whole % 5 == 2, "BLUR").alias("suggestion"),
        F.when(whole % 17 == 0, "KEEP").alias("decision"), F.when(whole % 2 == 0, "discrete_detected_intervals").alias("policy"), F.when(whole % 2 == 0, F.array(F.struct(start.alias("start"), (start + 0.5).alias("end")))).alias("detected"), F.array("label").alias("labels"), F.array(F.col("sample_id").cast("string")).alias("refs"),
    )
    return scenes.safety_cards(items).withColumns({"labels": F.array_join("labels", ","), "refs": F.array_join("refs", ","), "moments": F.to_json("moments")})


@query(None)
def subtitle_lines(spark, sf_dir):
    """Addresses are told by patterns that look around their matches, beyond SQL: see tests/test_subtitles.py. The sentences of all turns are tracks of one film for each conversation."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    rows = turns.select("conv_id", "turn", F.posexplode(F.split("text", "[.][ \\n]*")).alias("line", "words")).where("length(words) > 0")
    n = F.length("words")
    left = 320.0 - F.least(n * 4, F.lit(300)) + n % 40
    tracks_ = rows.select(
        F.col("conv_id").alias("source"), (F.col("turn") * 10000 + F.col("line")).alias("track_id"), F.when(n % 6 == 0, "top-left").otherwise("subtitle").alias("zone"), F.lit(True).alias("review_candidate"), F.when(n % 5 == 0, "REVIEW_AD_LIKELY").otherwise("REVIEW_UNCERTAIN").alias("routing"),
        F.lit(None).cast("string").alias("candidate"), (n % 17 == 0).alias("persistent"), F.lit(False).alias("fixed"), F.lit(False).alias("named"), (n % 3 + 1).cast("long").alias("observations"), left.alias("x1"), F.lit(300.0).alias("y1"), (left + F.least(n * 8, F.lit(600))).alias("x2"), F.lit(330.0).alias("y2"),
        F.array("words").alias("texts"), F.lit(None).cast("array<string>").alias("policy_hits"), F.lit("dialogue").alias("top_label"), (n % 50 / 100.0).alias("ad_probability"),
    )
    out = subtitles.moved_lines(tracks_, spark.createDataFrame([], "key string"), 640.0)
    return out.select("source", "track_id", "subtitle_line", "review_candidate", "previous_routing")
