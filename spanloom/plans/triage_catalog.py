"""Registered queries over reports, their cards and the triage of cards, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import addresses, shots, triage
from spanloom.plans.catalog import HOUR, SESSIONS, query, sessions
from spanloom.sources.tables import samples, table

# The lines of an order are the intervals of its report, the order is the card that cites some of them.
IV = "iv AS (SELECT l_orderkey AS k, l_linenumber - 1 AS n, min(l_quantity) AS q, min(l_discount) AS d, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS f, min(l_tax) AS x FROM lineitem GROUP BY 1, 2)"
CITED = f"""{IV}, it AS (SELECT o_orderkey AS k, o_custkey % 5 AS m, 30.0 + o_custkey % 50 AS e, CASE WHEN o_orderkey % 7 = 0 THEN 'text' ELSE 'mine' END AS category, o_orderkey % 19 = 0 AS decided,
CASE WHEN o_orderkey % 29 = 0 THEN 'content_style_missing' WHEN o_orderkey % 31 = 0 THEN 'content_style_not_' || $style END AS other FROM orders),
c AS (SELECT * FROM it WHERE category = 'mine' AND NOT decided AND other IS NULL), r AS (SELECT k, e, unnest([0, m - 1]) AS n, unnest([0, 1]) AS place FROM it WHERE m > 1),
y AS (SELECT r.*, q, d, p, s, f, x, CASE WHEN q IS NULL THEN 'unresolved_source_refs' WHEN k % 17 = 0 THEN 'not_' || $style || '_' || $scan || '_scan' WHEN n * 20 > e + 1 OR n * 20 + q < -1 THEN 'stale_source_refs' END AS problem FROM r LEFT JOIN iv USING (k, n))"""
EXPLICIT, TAGGED = (CITED.replace("$style", style).replace("$scan", scan) for style, scan in (("'live_action'", "'nsfw'"), ("'animation'", "'gore'")))
GORE = """g AS (SELECT k, arg_min(problem, place) FILTER (problem IS NOT NULL) AS problem, count(*) AS n, bool_and(k % 13 <> 0) AS calibrated, bool_and(p % 10 <> 0) AS valid, max(d * 0.9) FILTER (p % 10 <> 0) AS blood, max(x) FILTER (p % 10 <> 0) AS injury,
max(CASE WHEN p % 7 = 0 THEN 0.06::DOUBLE ELSE (p % 3) * 0.005::DOUBLE END) FILTER (p % 10 <> 0) AS corpse, sum(p % 5) FILTER (p % 10 <> 0) AS frames, arg_max('blood' || s % 3, (d, -place)) FILTER (p % 10 <> 0) AS label FROM y GROUP BY k)"""


def _intervals(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("n"))
    return rows.agg(*[F.min(c).alias(a) for c, a in (("l_quantity", "q"), ("l_discount", "d"), ("l_partkey", "p"), ("l_suppkey", "s"), ("l_returnflag", "f"), ("l_tax", "x"))])


def _report(name: str = "k"):
    return F.concat(F.lit("scan/"), F.col(name).cast("string"), F.lit(".json"))


def _scanned(spark, sf_dir, scan: str, other: str, style: str):
    rows = _intervals(spark, sf_dir)
    times = {"report": _report(), "payload": F.col("k"), "scan_type": F.when(F.col("k") % 17 == 0, other).otherwise(scan), "style": F.lit(style), "begin": F.col("n") * 20.0, "finish": F.col("n") * 20.0 + F.col("q")}
    return rows.withColumns(times)


def _cards(spark, sf_dir, category: str, style: str):
    k, m = F.col("o_orderkey"), F.col("o_custkey") % 5
    ref = lambda name, n: F.concat(name, F.lit("#interval:"), n.cast("string"))
    report = _report("o_orderkey")
    refs = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("nonsense"))).otherwise(F.array(ref(report, F.lit(0)), ref(F.translate(report, "/", "\\"), F.lit(0)), ref(report, m - 1)))
    job = F.when(k % 29 == 0, "").when(k % 31 == 0, "mixed").otherwise(style)
    return table(spark, sf_dir, "orders").select(
        k.alias("item_id"), F.when(k % 7 == 0, "text").otherwise(category).alias("category"), F.when(k % 19 == 0, "CUT").alias("decision"), job.alias("job_style"), F.lit(0.0).alias("start"), (30.0 + F.col("o_custkey") % 50).alias("end"), refs.alias("refs")
    )


@query(f"""WITH {EXPLICIT}, g AS (SELECT k, arg_min(problem, place) FILTER (problem IS NOT NULL) AS problem, sum(s % 3) AS seeds, bool_and(p % 10 > 1 AND p % 23 > 0) AS sure, max(d * 9) AS most, bool_and(f = 'R') AS titles, bool_and(k % 13 <> 0) AS calibrated,
bool_or(p % 10 = 0) AS missing, bool_or(p % 10 = 1) AS failed FROM y GROUP BY k),
j AS (SELECT c.k, CASE WHEN m = 0 THEN 'no_source_refs' WHEN m = 1 THEN 'unresolved_source_refs' ELSE problem END AS problem, seeds, CASE WHEN sure THEN most END AS most, titles, calibrated, missing, failed FROM c LEFT JOIN g USING (k)),
v AS (SELECT *, CASE WHEN problem IS NULL AND calibrated THEN CASE WHEN titles AND NOT coalesce(most >= 0.7, false) THEN 'credits' WHEN seeds < 2 AND most < 0.7 THEN 'two_signal' END END AS rule FROM j)
SELECT k AS item_id, CASE WHEN rule IS NULL THEN 'kept' ELSE 'advisory' END AS outcome, rule, CASE WHEN rule IS NULL THEN CASE WHEN problem IS NOT NULL THEN problem WHEN NOT calibrated THEN 'uncalibrated_scan' WHEN missing THEN 'verification_missing' WHEN failed THEN 'verification_failed' WHEN most IS NULL THEN 'verification_uncalibrated' ELSE 'strong_evidence' END END AS reason,
CASE WHEN problem IS NULL THEN seeds END::BIGINT AS n_seeds, CASE WHEN problem IS NULL THEN round(most, 6) END AS verifier_max FROM v
UNION ALL SELECT k, 'kept', NULL, CASE WHEN category = 'mine' THEN coalesce(other, 'decided') END, NULL, NULL FROM it WHERE k NOT IN (SELECT k FROM c)""")
def triage_explicit(spark, sf_dir):
    p = F.col("p")
    fixed = [F.lit(triage.VERIFIER[name]).alias(name) for name in ("sample_fps", "frame_size", "model", "target_label", "revision")]
    seen = F.struct(F.when(p % 10 == 1, "FAILED").otherwise("SCORED").alias("state"), (F.col("d") * 9).alias("nsfw_max"), (p % 23).alias("nsfw_frames"), *fixed)
    scan = F.struct(F.when(F.col("k") % 13 == 0, 1.0).otherwise(2.0).alias("sample_fps"), F.lit(0.95).alias("threshold"))
    rows = _scanned(spark, sf_dir, "nsfw", "gore", "live_action").withColumns({"label": F.when(F.col("f") == "R", " Hentai ").otherwise("porn"), "sample_count": F.col("s") % 3, "scan": scan, "verification": F.when(p % 10 != 0, seen)})
    return triage.triage_explicit(_cards(spark, sf_dir, "adult", "live_action"), rows)


def _tagged(spark, sf_dir):
    p = F.col("p")
    scan = F.struct(*[(F.when(F.col("k") % 13 == 0, 4).otherwise(5) if name == "window_frames" else F.lit(value)).alias(name) for name, value in triage.TAGGER_SCAN.items()])
    seen = F.struct(
        (F.col("d") * 0.9).alias("blood_family_max"), F.col("x").alias("injury_max"), F.when(p % 7 == 0, 0.06).otherwise((p % 3) * 0.005).alias("corpse_max"), (p % 5).alias("confirmed_frames"),
        F.concat(F.lit("blood"), (F.col("s") % 3).cast("string")).alias("strongest_blood_label"), F.col("d").alias("strongest_blood_label_score"),
    )
    return _scanned(spark, sf_dir, "gore", "nsfw", "animation").withColumns({"scan": scan, "evidence": F.when(p % 10 != 0, seen)})


@query(f"""WITH {TAGGED}, {GORE}, j AS (SELECT c.k, CASE WHEN m = 0 THEN 'no_source_refs' WHEN m = 1 THEN 'unresolved_source_refs' ELSE problem END AS problem, n, blood, corpse, calibrated, valid FROM c LEFT JOIN g USING (k)),
v AS (SELECT *, CASE WHEN problem IS NOT NULL THEN problem WHEN NOT calibrated THEN 'uncalibrated_scan' WHEN NOT valid THEN 'evidence_missing' WHEN blood > 0.0716 OR corpse > 0.0104 THEN 'blood_or_corpse_seen' END AS reason FROM j)
SELECT k AS item_id, CASE WHEN reason IS NULL THEN 'advisory' ELSE 'kept' END AS outcome, CASE WHEN reason IS NULL THEN 'C1' END AS rule, reason, CASE WHEN problem IS NULL THEN n ELSE 0 END::BIGINT AS n_intervals,
CASE WHEN coalesce(reason, 'blood_or_corpse_seen') = 'blood_or_corpse_seen' THEN round(blood, 6) END AS blood_family_max, CASE WHEN coalesce(reason, 'blood_or_corpse_seen') = 'blood_or_corpse_seen' THEN round(corpse, 6) END AS corpse_max FROM v
UNION ALL SELECT k, 'kept', NULL, CASE WHEN category = 'mine' THEN coalesce(other, 'decided') END, 0, NULL, NULL FROM it WHERE k NOT IN (SELECT k FROM c)""")
def triage_tagged(spark, sf_dir):
    return triage.triage_tagged(_cards(spark, sf_dir, "gore", "animation"), _tagged(spark, sf_dir))


@query(f"""WITH {TAGGED}, {GORE} SELECT k AS item_id, blood AS blood_family_max, injury AS injury_max, corpse AS corpse_max, frames::BIGINT AS confirmed_frames, n AS n_intervals, label AS strongest_blood_label,
'Tagger: ' || CASE WHEN blood >= 0.5 THEN 'thấy máu' WHEN blood > 0.0716 THEN 'máu yếu, nên xem kỹ' WHEN injury > blood THEN 'chỉ vết thương, không thấy máu' ELSE 'không thấy máu' END || CASE WHEN corpse >= 0.05 THEN ' · có thể là xác' WHEN corpse > 0.0104 THEN ' · có dấu hiệu xác (yếu), nên xem kỹ' ELSE '' END AS hint
FROM g JOIN it USING (k) WHERE category = 'mine' AND problem IS NULL AND valid""")
def tag_evidence(spark, sf_dir):
    return triage.tag_evidence(_cards(spark, sf_dir, "gore", "animation"), _tagged(spark, sf_dir))


@query(f"""WITH {IV}, a AS (SELECT *, CASE k % 4 WHEN 0 THEN 'adult' WHEN 3 THEN 'text' ELSE 'visual_logo' END AS category, n * 5.0::DOUBLE AS a, n * 5.0 + q / 2 AS b, ['opening_promotion', 'branded_end_card', 'opening_boundary', 'persistent_overlay', NULL, 'other'][(p % 6)::INT + 1] AS cand FROM iv),
o AS (SELECT *, category = 'visual_logo' AND p % 6 IN (0, 4) AND a < 30 AND b <= 30 AND k % 3 = 0 AND d * 10 >= 0.65 AS opening FROM a),
h AS (SELECT *, CASE WHEN opening THEN 'opening_promotion' ELSE cand END AS candidate, opening OR p % 6 = 1 AS cut, p % 6 = 2 AS forced, [x FOR x IN range(p % 3) IF x = 0 OR s % 5 <> 0] AS offers FROM o),
e AS (SELECT *, unnest(CASE WHEN cut OR forced OR len(offers) = 0 THEN [NULL] ELSE offers END) AS i FROM h),
t AS (SELECT *, CASE WHEN i IS NOT NULL AND s % 7 > 0 THEN [greatest(0, p % 50 - 5), 10 + i, s % 7 * 10, 20] END AS region, CASE WHEN i IS NOT NULL THEN ['external_brand', 'movie_title', 'other', NULL][((s + i) % 4)::INT + 1] END AS classification FROM e),
w AS (SELECT *, CASE WHEN cut THEN 'CUT' WHEN NOT forced THEN CASE WHEN i = 1 THEN 'KEEP' WHEN i IS NULL OR category <> 'visual_logo' OR coalesce(classification = 'external_brand', false) OR p % 6 = 3 THEN CASE WHEN d > 0.05 THEN 'BLUR' WHEN d > 0.02 THEN 'CUT' ELSE 'LATER' END END END AS named FROM t)
SELECT 'review-' || left(sha256(concat_ws('|', category, printf('%.3f', a), printf('%.3f', b), 'scan/' || k || '.json', 'proposal:' || coalesce(i, 0), coalesce(array_to_string(region, ','), 'full'))), 12) AS card_id, category, round(a, 3) AS "start", round(b, 3) AS "end",
CASE p % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'normal' WHEN 2 THEN 'high' ELSE 'context' END AS priority, array_to_string(CASE WHEN s % 3 = 1 OR (s % 3 = 2 AND category <> 'visual_logo') THEN [CASE WHEN s % 3 = 1 THEN 'Brand' ELSE 'The  actual brand  name' END] ELSE [] END || CASE WHEN i IS NULL THEN [] WHEN s % 3 = 1 THEN ['box'] ELSE ['Brand', 'box'] END, ',') AS labels,
coalesce(array_to_string(region, ','), 'full') AS region, CASE WHEN cut THEN candidate WHEN classification = 'movie_title' THEN 'title_overlay' WHEN category = 'visual_logo' THEN 'logo_overlay' ELSE category END AS kind, candidate, classification,
CASE WHEN classification = 'movie_title' THEN 'KEEP' WHEN named IN ('KEEP', 'CUT') OR (named = 'BLUR' AND region IS NOT NULL) THEN named END AS suggestion, 'scan/' || k || '.json#interval:' || n AS ref FROM w""")
def report_cards(spark, sf_dir):
    p, s, d, k, n = (F.col(c) for c in "psdkn")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))

    def proposal(i):
        box = F.array(p % 50 - 5, F.lit(10).cast("long") + i, s % 7 * 10, F.lit(20).cast("long"))
        return F.struct(
            F.when((i == 1) & (s % 5 == 0), F.slice(box, 1, 3)).otherwise(box).alias("box"), F.when(i == 1, "keep").otherwise("").alias("suggestion"),
            pick(["external_brand", "movie_title", "other", None], (s + i) % 4).alias("classification"), F.array(F.lit("Brand"), F.lit(" "), F.lit("box")).alias("labels"),
        )

    proposals = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")), lambda i: i < p % 3), proposal)
    rows = _intervals(spark, sf_dir).select(
        _report().alias("report"), "n", pick(["nsfw", "visual_logo", "visual_logo", "text"], k % 4).alias("scan_type"), (n * 5.0).alias("start"), (n * 5.0 + F.col("q") / 2).alias("end"), pick([None, " Brand ", "The  actual brand  name"], s % 3).alias("label"),
        pick(["High", "normal", "", None], p % 4).alias("priority"), F.when(p % 4 == 2, "a HIGH score").alias("reason"), pick(["opening_promotion", "branded_end_card", "opening_boundary", "persistent_overlay", None, "other"], p % 6).alias("candidate"),
        F.when(d > 0.05, "blur").when(d > 0.02, "cut").otherwise("later").alias("suggestion"), (k % 3 == 0).alias("boundary_window"), F.lit(None).cast("string").alias("boundary_state"), (d * 10).alias("full_frame_score"), proposals.alias("proposals"),
    )
    return triage.report_cards(rows).withColumns({"labels": F.array_join("labels", ","), "region": F.coalesce(F.array_join("region", ","), F.lit("full"))})


SIDE = """SELECT e.*, (SELECT count(*) FROM s WHERE s.source = e.source AND score >= 150 AND t >= e.low AND t < e.high AND NOT at_limit) AS hits FROM e"""


@query(f"""WITH {SESSIONS}, iv AS (SELECT source, "start" AS a, "end" AS b, max("end") OVER (PARTITION BY source) AS duration FROM sessions),
e AS (SELECT *, true AS opens, a AS edge, a + 3600 AS anchor, a - 28800 AS low, a + 3600 + 72000 AS high, a <= 1e-6 AS at_limit FROM iv UNION ALL SELECT *, false, b, b - 3600, b - 3600 - 72000, b + 28800, b >= duration - 1e-6 FROM iv),
h AS ({SIDE}), cuts AS (SELECT source, t FROM s WHERE label = 'error'),
c AS (SELECT *, CASE WHEN NOT at_limit AND hits >= 2 THEN CASE WHEN opens THEN (SELECT max(t) FROM cuts WHERE cuts.source = h.source AND t >= edge - 28800 - 1e-6 AND t <= anchor + 1e-6 AND t >= greatest(0.0, low - 1800))
ELSE (SELECT min(t) FROM cuts WHERE cuts.source = h.source AND t > anchor AND t <= edge + 28800 + 1e-6 AND t <= least(duration, high + 1800)) END END AS cut FROM h),
i AS (SELECT *, CASE WHEN opens THEN cut ELSE coalesce((SELECT max(t) FROM cuts WHERE cuts.source = c.source AND t >= anchor - 72000 - 1e-6 AND t <= anchor + 1e-6), anchor - 72000) END AS x,
CASE WHEN opens THEN coalesce((SELECT min(t) FROM cuts WHERE cuts.source = c.source AND t > anchor AND t <= anchor + 72000 + 1e-6 AND t <= duration), anchor + 72000) ELSE cut END AS y, CASE WHEN opens THEN cut >= edge - 1e-6 ELSE cut <= edge + 1e-6 END AS within FROM c),
n AS (SELECT *, (SELECT count(*) FROM s WHERE s.source = i.source AND t >= x AND t < y AND NOT within) AS n, (SELECT count(*) FROM s WHERE s.source = i.source AND t >= x AND t < y AND score >= 150) AS n_seeds, (SELECT count(*) FROM s WHERE s.source = i.source AND t >= x AND t < y AND score >= 50) AS n_context FROM i),
v AS (SELECT *, CASE WHEN at_limit THEN CASE WHEN opens THEN 'at_video_start' ELSE 'at_video_end' END WHEN hits < 2 THEN 'too_few_seeds_nearby' WHEN cut IS NULL THEN 'no_cut_within_reach' WHEN within THEN 'cut_inside_interval' WHEN n > 0 AND n_seeds >= 2 AND n_context / n >= 0.4 THEN 'extended' ELSE 'evidence_gate_failed' END AS status FROM n),
m AS (SELECT *, round(CASE WHEN status = 'extended' THEN CASE WHEN opens THEN cut ELSE least(duration, cut) END ELSE edge END, 3) AS moved FROM v)
SELECT source || '|' || (round(a * 1000)::BIGINT)::VARCHAR AS interval_id, max(moved) FILTER (opens) AS "start", max(moved) FILTER (NOT opens) AS "end", max(status) FILTER (opens) AS start_status, max(status) FILTER (NOT opens) AS end_status FROM m GROUP BY 1""")
def shot_context(spark, sf_dir):
    rows = samples(spark, sf_dir)
    spans = sessions(spark, sf_dir).select("source", "start", "end")
    ends = spans.groupBy("source").agg(F.max("end").alias("duration"))
    named = spans.join(ends, "source").withColumn("interval_id", F.concat_ws("|", "source", F.round(F.col("start") * 1000).cast("long").cast("string")))
    return shots.shot_context(named, rows.select("source", "t", "score"), rows.where("label = 'error'").select("source", "t"), "source", 150.0, 50.0, HOUR, 8 * HOUR, 20 * HOUR, 2, 0.4, 0.5 * HOUR)


def _page_tracks(spark, sf_dir):
    """Pages as tracks with two reads, and the hosts of all pages as the memory."""
    pages = table(spark, sf_dir, "pages")
    routing = F.get(F.array(*map(F.lit, ("REVIEW_AD_LIKELY", "REVIEW_LOW_AD", "", "REVIEW_SCROLLING_TEXT"))), (F.col("page_id") % 4).cast("int"))
    tracks = pages.select(
        F.col("page_id").alias("track_id"), F.when(F.col("page_id") % 9 == 0, "scrolling_text").alias("candidate"), routing.alias("routing"), F.lit("context").alias("priority"), F.lit(None).cast("string").alias("suggestion"), (F.col("page_id") % 11 == 0).alias("named"), F.array("url", "html").alias("texts")
    )
    host = text.fold_alnum(F.regexp_extract("url", "://([^/?#]*)", 1))
    return tracks, pages.select(host.alias("key")).where(F.length("key") >= 6).distinct()


@query(f"""WITH h AS (SELECT DISTINCT regexp_replace(translate(lower(regexp_extract(url, '://([^/?#]*)', 1)), '{text.MARKED}', '{text.PLAIN}'), '[^0-9a-z]', '', 'g') AS key FROM pages),
r AS (SELECT page_id, unnest([url, html]) AS read FROM pages), f AS (SELECT DISTINCT page_id, regexp_replace(translate(lower(read), '{text.MARKED}', '{text.PLAIN}'), '[^0-9a-z]', '', 'g') AS read FROM r),
m AS (SELECT DISTINCT page_id, key FROM f JOIN h ON length(key) >= 6 AND contains(read, key)) SELECT page_id AS track_id, string_agg(key, ',' ORDER BY key) AS remembered FROM m GROUP BY page_id""")
def remembered_tracks(spark, sf_dir):
    tracks, memory = _page_tracks(spark, sf_dir)
    return addresses.remembered_in(tracks, memory).withColumn("remembered", F.array_join("remembered", ","))


@query(None)
def promoted_addresses(spark, sf_dir):
    """Six shapes of addresses look around their matches, which the other engine's patterns can't: see tests/test_addresses.py."""
    tracks, memory = _page_tracks(spark, sf_dir)
    return addresses.promoted(tracks, memory).withColumns({c: F.array_join(c, ",") for c in ("tokens", "remembered")})
