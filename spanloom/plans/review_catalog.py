"""Registered queries over reports, queues and regions, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import boxes, reports
from spanloom.plans.catalog import DAY, HOUR, ISLANDS, S, query, sessions
from spanloom.sources.tables import samples, table

PAIRS = """b AS (SELECT p_partkey AS id, p_size AS kind, p_partkey % 97 AS x1, p_partkey % 89 AS y1, p_partkey % 97 + 5 + p_partkey % 31 AS x2, p_partkey % 89 + 5 + p_partkey % 17 AS y2 FROM part),
q AS (SELECT l.id AS l_id, r.id AS r_id, l.x1 AS a1, l.y1 AS b1, l.x2 AS a2, l.y2 AS b2, r.x1 AS c1, r.y1 AS d1, r.x2 AS c2, r.y2 AS d2 FROM b l JOIN b r ON l.kind = r.kind AND l.id < r.id),
p AS (SELECT *, greatest(0, least(a2, c2) - greatest(a1, c1)) * greatest(0, least(b2, d2) - greatest(b1, d1)) AS common, (a2 - a1) * (b2 - b1) AS la, (c2 - c1) * (d2 - d1) AS ra,
greatest(a1, c1) - least(a2, c2) AS gx, greatest(b1, d1) - least(b2, d2) AS gy, a2 - a1 AS w, b2 - b1 AS h, c2 - c1 AS v, d2 - d1 AS g FROM q)"""


def _parts(spark, sf_dir):
    k = F.col("p_partkey")
    x, y = k % 97, k % 89
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_size").alias("kind"), x.alias("x1"), y.alias("y1"), (x + 5 + k % 31).alias("x2"), (y + 5 + k % 17).alias("y2"))


@query(f"""WITH {PAIRS} SELECT l_id, r_id, common / (la + ra - common) >= 0.2 OR (abs(a1 + a2 - c1 - c2) / 2.0 <= greatest(24, 0.45 * w) AND abs(b1 + b2 - d1 - d2) / 2.0 <= greatest(18, 0.55 * h)) AS same_region,
round(common / la, 6) AS inside, gx <= h / 2.0 AND gy <= h / 2.0 AND h <= 2.5 * g AS touches, gy <= 3.0 * least(h, g) AS adjacent, -gy >= 0.5 * least(h, g) AS band, greatest(la, ra) / least(la, ra) <= 2 AND common / least(la, ra) >= 0.7 AS blur_target,
common < 0.95 * ra AND -gx >= 0.5 * v AND gy <= greatest(8, 0.5 * g) AND g <= 2.5 * h AS joins_logo, CASE WHEN common / ra >= 0.85 AND la <= 4 * ra THEN 'ok' ELSE 'fail' END AS quality,
least(a1, c1) AS x1, least(b1, d1) AS y1, greatest(a2, c2) AS x2, greatest(b2, d2) AS y2 FROM p""")
def box_relations(spark, sf_dir):
    """Rules on two boxes, over all pairs of a kind (a key of the data, some 200 boxes at scale factor 1)."""
    rows = _parts(spark, sf_dir)
    pairs = boxes.paired(rows, "kind", near=(["x1", "x2", "y1", "y2"], ["y1", "y2", "x1", "x2"]))
    # rounding is the dearest step, and most boxes have nothing in common
    inside = F.when(boxes.intersection("l_", "r_") > 0, F.round(boxes.coverage("l_", "r_"), 6)).otherwise(0.0)
    return pairs.select(
        "l_id", "r_id", boxes.same_region("l_", "r_").alias("same_region"), inside.alias("inside"), boxes.touches_overlay("l_", "r_").alias("touches"), boxes.lines_adjacent("l_", "r_").alias("adjacent"), boxes.same_band("l_", "r_").alias("band"),
        boxes.same_blur_target("l_", "r_").alias("blur_target"), boxes.joins_logo("l_", "r_").alias("joins_logo"), boxes.region_quality("l_", "r_").alias("quality"), *boxes.union_box("l_", "r_"),
    )


@query("""WITH r AS (SELECT p_partkey AS id, (p_partkey % 101) / 101.0::DOUBLE AS x, (p_partkey % 83) / 83.0::DOUBLE AS y, (p_partkey % 13) / 26.0::DOUBLE AS w, (p_partkey % 7) / 14.0::DOUBLE AS h FROM part),
p AS (SELECT *, greatest(0, least(639, round_even(x * 640, 0))) AS px, greatest(0, least(359, round_even(y * 360, 0))) AS py FROM r),
e AS (SELECT *, greatest(px + 1, least(640, round_even((x + w) * 640, 0))) - px AS pw, greatest(py + 1, least(360, round_even((y + h) * 360, 0))) - py AS ph FROM p)
SELECT id, px::BIGINT AS x, py::BIGINT AS y, pw::BIGINT AS width, ph::BIGINT AS height, CASE WHEN w > 0 AND h > 0 THEN round(x + w, 6) END AS right_share, greatest(0, px - 4)::BIGINT AS padded_x1, least(640, px + pw + 4)::BIGINT AS padded_x2 FROM e""")
def relative_regions(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), ((k % 101) / F.lit(101.0)).alias("r_x"), ((k % 83) / F.lit(83.0)).alias("r_y"), ((k % 13) / F.lit(26.0)).alias("r_width"), ((k % 7) / F.lit(14.0)).alias("r_height"))
    pixels = rows.select("id", "r_x", "r_y", "r_width", "r_height", *boxes.to_pixels("r_", F.lit(640), F.lit(360)))
    cornered = pixels.select("*", F.struct(*boxes.from_region("r_")).alias("c"), F.struct(*boxes.from_region("")).alias("p")).withColumns({f"p_{c}": F.col(f"p.{c}") for c in ("x1", "y1", "x2", "y2")})
    margin = F.struct(*boxes.padded("p_", 4, 640, 360))
    return cornered.select("id", "x", "y", "width", "height", F.round("c.x2", 6).alias("right_share"), margin["x1"].cast("long").alias("padded_x1"), margin["x2"].cast("long").alias("padded_x2"))


@query(f"""WITH {PAIRS.split('q AS')[0].rstrip().rstrip(',')}, m AS (SELECT kind, count(*) AS n, median(x2 - x1) AS mw, median(y2 - y1) AS mh, round_even(median(x1), 0) AS m1, round_even(median(y1), 0) AS m2, round_even(median(x2), 0) AS m3, round_even(median(y2), 0) AS m4 FROM b GROUP BY kind),
f AS (SELECT b.*, n, x2 - x1 BETWEEN 0.55 * mw AND 1.8 * mw AND y2 - y1 BETWEEN 0.55 * mh AND 1.8 * mh AND greatest(0, least(x2, m3) - greatest(x1, m1)) * greatest(0, least(y2, m4) - greatest(y1, m2)) / greatest(1, least((x2 - x1) * (y2 - y1), greatest(0, m3 - m1) * greatest(0, m4 - m2))) >= 0.7 AS fits FROM b JOIN m USING (kind)),
g AS (SELECT kind, count(*) AS n, count(*) FILTER (fits) AS inliers, min(x1) AS p1, min(y1) AS p2, max(x2) AS p3, max(y2) AS p4, min(x1) FILTER (fits) AS i1, min(y1) FILTER (fits) AS i2, max(x2) FILTER (fits) AS i3, max(y2) FILTER (fits) AS i4 FROM f GROUP BY kind)
SELECT kind, n, inliers, CASE WHEN u THEN i1 ELSE p1 END AS x1, CASE WHEN u THEN i2 ELSE p2 END AS y1, CASE WHEN u THEN i3 ELSE p3 END AS x2, CASE WHEN u THEN i4 ELSE p4 END AS y2 FROM (SELECT *, n >= 4 AND inliers >= greatest(3, ceil(n * 0.55)) AS u FROM g)""")
def overlay_consensus(spark, sf_dir):
    return boxes.consensus(_parts(spark, sf_dir), "kind")


CATEGORY = "['visual_logo', 'text', 'adult', 'gore', 'violence', 'other'][(sample_id % 6)::INT + 1]"


@query(f"""WITH s AS ({S}), i AS (SELECT *, {CATEGORY} AS category, sample_id % 11 = 0 AS advisory, CASE WHEN sample_id % 3 = 0 THEN 1 END AS region, CASE WHEN sample_id % 7 = 0 THEN 'CUT' END AS sug, CASE WHEN sample_id % 5 = 0 THEN 'branded_end_card' END AS candidate FROM s)
SELECT sample_id AS item_id, category, CASE WHEN category IN ('visual_logo', 'text') THEN 'advertising' ELSE category END AS "group", t AS "start", greatest(t + (sample_id % 3) / 4.0, t + 0.5) AS "end", advisory,
CASE WHEN region IS NOT NULL THEN 'region' WHEN category NOT IN ('visual_logo', 'text') OR sug IS NOT NULL OR candidate IS NOT NULL THEN 'frame' ELSE 'unknown' END AS kind FROM i WHERE category <> 'other'""")
def queue_items(spark, sf_dir):
    i, t = F.col("sample_id"), F.col("t")
    category = F.element_at(F.array(*map(F.lit, ("visual_logo", "text", "adult", "gore", "violence", "other"))), (i % 6 + 1).cast("int"))
    rows = samples(spark, sf_dir).select(i.alias("item_id"), category.alias("category"), t.alias("start"), (t + (i % 3) / 4.0).alias("end"), F.when(i % 3 == 0, 1).alias("region"), F.when(i % 7 == 0, "CUT").alias("suggestion"), F.when(i % 5 == 0, "branded_end_card").alias("candidate"))
    return reports.queue_items(rows.where("item_id % 11 <> 0"), rows.where("item_id % 11 = 0"))


@query(f"""WITH s AS ({S}), c AS (SELECT label, source, count(*) AS n, min(t) AS a, max(t) + 10 AS b, list(struct_pack(a := t, b := t + 3600 * (1 + sample_id % 5)) ORDER BY t) AS detected FROM s GROUP BY ALL),
m AS (SELECT source || '|' || label AS card, unnest(CASE WHEN source % 2 = 0 THEN detected ELSE [struct_pack(a := a, b := b)] END) AS x FROM c),
o AS (SELECT card, x.a AS a, x.b AS b, coalesce((x.a > max(x.b) OVER (PARTITION BY card ORDER BY x.a, x.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS opens FROM m),
g AS (SELECT *, sum(opens) OVER (PARTITION BY card ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM o) SELECT card, round(min(a), 3) AS "start", round(max(b), 3) AS "end" FROM g GROUP BY card, grp""")
def application_intervals(spark, sf_dir):
    t, i = F.col("t"), F.col("sample_id")
    moments = F.collect_list(F.struct(t.alias("start"), (t + 3600 * (1 + i % 5)).alias("end")))
    cards = samples(spark, sf_dir).groupBy("source", "label").agg(F.min("t").alias("start"), (F.max("t") + 10).alias("end"), moments.alias("detected"))
    policy = F.when(F.col("source") % 2 == 0, "discrete_detected_intervals").otherwise("span")
    return reports.application_intervals(cards.withColumn("policy", policy).withColumn("card", F.concat_ws("|", F.col("source").cast("string"), "label")), "card")


@query(f"""WITH s AS ({S}), c AS (SELECT source, label, sum(1) AS n, list(struct_pack("start" := t, "end" := greatest(t + (sample_id % 3) / 4.0, t + 0.5)) ORDER BY t, sample_id % 3) AS m FROM s GROUP BY ALL)
SELECT source, label, CASE WHEN source % 3 = 0 THEN len(m) END AS moments, CASE WHEN source % 3 = 0 THEN list_sum(list_transform(m, lambda x: x['end'] - x['start'])).round(4) END AS seconds, len(list_filter(['advertising', 'adult', 'gore', 'violence'], lambda g: source % 5 = 0 OR (g = 'gore' AND source % 5 < 3)))::BIGINT AS groups FROM c""")
def scene_cards(spark, sf_dir):
    t, i, s = F.col("t"), F.col("sample_id"), F.col("source")
    detected = F.collect_list(F.struct(t.alias("start"), (t + (i % 3) / 4.0).alias("end")))
    cards = samples(spark, sf_dir).groupBy("source", "label").agg(detected.alias("detected"))
    selected = F.when(s % 5 == 0, None).when(s % 5 < 3, F.array(F.lit("gore"), F.lit("weather"))).otherwise(F.array().cast("array<string>"))
    moments = reports.scene_moments(s % 3 == 0, F.lit("discrete_detected_intervals"), F.col("detected"))
    rows = cards.select("source", "label", moments.alias("m"), F.size(reports.scope(selected)).cast("long").alias("groups"))
    seconds = F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x["end"] - x["start"]), 4)
    return rows.select("source", "label", F.size("m").cast("long").alias("moments"), seconds.alias("seconds"), "groups").withColumn("moments", F.when(F.col("moments") > 0, F.col("moments")))


@query(f"""WITH {{}} SELECT sample_id, CASE WHEN label IN ('click', 'view') AND sample_id % 3 < 2 AND score / 100 >= 0.99 AND sample_id % 9 >= 4 THEN 'high' ELSE 'context' END AS priority FROM s""".replace("{}", f"s AS ({S})"))
def promoted_priorities(spark, sf_dir):
    i = F.col("sample_id")
    labels = F.when(i % 3 == 0, F.array(F.lit(" Porn "), F.lit("x"))).when(i % 3 == 1, F.array(F.lit("HENTAI"))).otherwise(F.array(F.lit("neutral")))
    category = F.when(F.col("label").isin("click", "view"), "adult").otherwise("gore")
    return samples(spark, sf_dir).select("sample_id", reports.strong_first(category, labels, F.col("score") / 100, (i % 9).cast("double"), F.lit("context")).alias("priority"))


@query("""SELECT o_orderkey, o_orderkey % 5 IN (0, 1) OR (o_orderkey % 5 = 2 AND (o_orderkey % 4 = 0 OR o_orderkey % 4 = 1)) AS transient FROM orders""")
def transient_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, ("NETWORK", "DNS_FAILED", "SERVER_BUSY", "FORBIDDEN", "OTHER"))), (k % 5 + 1).cast("int"))
    status = F.when(k % 4 == 1, 503).when(k % 4 == 2, 500).when(k % 4 == 3, 404)
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.is_transient(code, status).alias("transient"))


@query("""SELECT o.o_orderkey AS item_id, (l.l_linenumber - 1)::INT AS place, l.l_quantity AS quantity FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber <= 4 AND o.o_orderkey % 3 <> 2""")
def resolved_refs(spark, sf_dir):
    k = F.col("o_orderkey")
    ref = lambda n: F.concat(F.lit("scan\\"), k.cast("string"), F.when(k % 3 == 2, "#hit:").otherwise("#interval:"), F.lit(str(n)))
    items = table(spark, sf_dir, "orders").select(k.alias("item_id"), F.array(*[ref(n) for n in range(1, 5)]).alias("refs"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("scan/"), F.col("l_orderkey").cast("string")).alias("report"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").alias("quantity"))
    return reports.resolved_refs(items, rows).select("item_id", "place", "quantity")


@query(f"""WITH s AS ({S}), g AS (SELECT source, sample_id, t FROM s WHERE label = 'click'), f AS (SELECT source, t, floor(t)::BIGINT % 4 = 0 AS ok FROM s WHERE label <> 'click'),
x AS (SELECT g.*, f.t AS near FROM g ASOF LEFT JOIN f ON g.source = f.source AND g.t >= f.t), y AS (SELECT g.sample_id, f.t AS aligned FROM g ASOF LEFT JOIN (SELECT * FROM f WHERE ok) f ON g.source = f.source AND g.t >= f.t)
SELECT x.source, x.sample_id, CASE WHEN aligned >= t - 172800 THEN aligned ELSE near END AS origin FROM x JOIN y USING (sample_id)""")
def clip_origins(spark, sf_dir):
    rows = samples(spark, sf_dir)
    targets = rows.where("label = 'click'").select("source", "sample_id", "t")
    return reports.origins(targets, rows.where("label <> 'click'").select("source", "t"), "source", F.floor("t") % 4 == 0, 2 * DAY).drop("t")


@query(f"""WITH s AS ({S}), c AS (SELECT source, min(t) + 86400 AS off, 864000.0::DOUBLE AS duration FROM s GROUP BY source),
m AS (SELECT s.source, sample_id AS item_id, s.source AS clip_id, round(t - off, 6) AS "start", round(t + sample_id % 100 - off, 6) AS "end", duration FROM s JOIN c USING (source))
SELECT source, item_id, clip_id, "start", "end", greatest(0.0, "start") AS clamped_start, least(duration, "end") AS clamped_end FROM m WHERE greatest("end", "start" + 0.5) > 0 AND "start" < duration""")
def clip_times(spark, sf_dir):
    rows = samples(spark, sf_dir)
    clips = rows.groupBy("source").agg((F.min("t") + DAY).alias("offset")).withColumn("clip_id", F.col("source")).withColumn("duration", F.lit(10 * DAY))
    items = rows.select("source", F.col("sample_id").alias("item_id"), F.col("t").alias("start"), (F.col("t") + F.col("sample_id") % 100).alias("end"))
    return reports.shifted(items, clips, "source")


@query(f"""WITH s AS (SELECT user_id AS source, floor(epoch_us(ts) / 1e6 / 60) * 60 AS t FROM events), d AS (SELECT source, t - lag(t) OVER (PARTITION BY source ORDER BY t) AS step FROM s),
l AS (SELECT source, list_sort(list(step)) AS v FROM d WHERE step > 0 GROUP BY source) SELECT source, coalesce(v[len(v) // 2 + 1], 0.04) AS step, coalesce(len(v), 0) AS n FROM (SELECT DISTINCT source FROM s) LEFT JOIN l USING (source)""")
def frame_intervals(spark, sf_dir):
    rows = samples(spark, sf_dir).select("source", (F.floor(F.col("t") / 60) * 60.0).alias("t"))
    return reports.frame_interval(rows, "source")


@query(ISLANDS + """, e AS (SELECT source, min(a) AS first, max(b) AS last FROM islands GROUP BY source), x AS (SELECT source, first - source % 7 * 3600 AS scan_start, CASE WHEN source % 4 > 0 THEN last + source % 5 * 3600 END AS scan_end FROM e)
SELECT source, CASE WHEN o THEN scan_start ELSE a END AS "start", CASE WHEN c THEN scan_end ELSE b END AS "end", o AS reaches_start, c AS reaches_end FROM (SELECT i.*, x.*, a = first AND first > scan_start AND first <= scan_start + 10800 AS o, coalesce(b = last AND last < scan_end AND last >= scan_end - 10800, false) AS c
FROM islands i JOIN e USING (source) JOIN x USING (source))""".replace("SELECT i.*, x.*,", "SELECT i.source, a, b, scan_start, scan_end,"))
def edge_moments(spark, sf_dir):
    from spanloom.operators.intervals import islands

    moments = islands(sessions(spark, sf_dir), "source")
    s = F.col("source")
    scans = moments.groupBy("source").agg((F.min("start") - s % 7 * HOUR).alias("scan_start"), F.when(s % 4 > 0, F.max("end") + s % 5 * HOUR).alias("scan_end"))
    return reports.reach_edges(moments, scans, "source", 3 * HOUR)


@query("""WITH r AS (SELECT o_custkey, o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS d FROM orders)
SELECT o_custkey, sha256(string_agg(d, chr(10) ORDER BY o_orderkey)) AS fingerprint, count(*) AS n FROM r GROUP BY o_custkey""")
def label_fingerprints(spark, sf_dir):
    return reports.fingerprints(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus"])


@query(f"""WITH s AS ({S}), g AS (SELECT source, label AS grp, t AS a, t + 3600 * (1 + sample_id % 9) AS b FROM s), k AS (SELECT DISTINCT source, floor(t / 172800) * 172800.0 AS a FROM s),
p AS (SELECT k.source || ':' || k.a::BIGINT AS segment_id, grp, greatest(k.a, g.a) - k.a AS a, least(k.a + 172800, g.b) - k.a AS b FROM k JOIN g ON k.source = g.source AND k.a < g.b AND g.a < k.a + 172800),
o AS (SELECT *, coalesce((a > max(b) OVER (PARTITION BY segment_id, grp ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS opens FROM p),
i AS (SELECT *, sum(opens) OVER (PARTITION BY segment_id, grp ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT segment_id, grp, round(min(a), 6) AS "start", round(max(b), 6) AS "end" FROM i GROUP BY segment_id, grp, n""")
def segment_blurs(spark, sf_dir):
    t = F.col("t")
    rows = samples(spark, sf_dir)
    begin = F.floor(t / (2 * DAY)) * (2 * DAY)
    kept = rows.select("source", begin.alias("start")).distinct().select("source", F.concat_ws(":", F.col("source").cast("string"), F.col("start").cast("long").cast("string")).alias("segment_id"), "start", (F.col("start") + 2 * DAY).alias("end"))
    blurs = rows.select("source", F.col("label").alias("grp"), t.alias("start"), (t + 3600 * (1 + F.col("sample_id") % 9)).alias("end"))
    return reports.segment_blurs(kept, blurs, "source", "grp", DAY).withColumns({c: F.round(c, 6) for c in ("start", "end")})


@query("""WITH r AS (SELECT l_suppkey AS machine, year(l_shipdate) AS run, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_suppkey % 3 = 0 THEN l_linestatus ELSE 'same' END AS print, l_returnflag AS option, l_quantity AS value FROM lineitem),
f AS (SELECT machine, run, arg_min(print, seq) AS print, min(seq) AS began FROM r GROUP BY ALL), n AS (SELECT *, first_value(print) OVER w AS latest FROM f WINDOW w AS (PARTITION BY machine ORDER BY began DESC)),
o AS (SELECT *, sum((print <> latest)::INT) OVER (PARTITION BY machine ORDER BY began DESC ROWS UNBOUNDED PRECEDING) AS other FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY began DESC) AS rank FROM o WHERE other = 0)
SELECT r.machine, r.run, r.option, arg_max(value, seq) AS value FROM r JOIN k ON r.machine = k.machine AND r.run = k.run AND r.print = k.print WHERE rank <= 2 GROUP BY ALL""")
def latest_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("machine"), F.year("l_shipdate").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linestatus")).otherwise("same").alias("fingerprint"), F.col("l_returnflag").alias("option"), F.col("l_quantity").alias("value"),
    )
    return reports.latest_runs(rows, "machine")


@query("""WITH p AS (SELECT l_orderkey AS card, l_linenumber AS place, 'p' || l_partkey AS preview, l_partkey FROM lineitem), k AS (SELECT 'p' || p_partkey AS preview, length(p_name) AS longest FROM part WHERE p_partkey % 50 > 0),
j AS (SELECT p.*, longest FROM p LEFT JOIN k USING (preview)), c AS (SELECT card, card % 2 = 0 AND count(*) > 1 AND count(longest) = count(*) AS known, string_agg(preview, ',' ORDER BY place, l_partkey) AS given, string_agg(preview, ',' ORDER BY longest DESC, place, l_partkey) AS ordered FROM j GROUP BY card)
SELECT card AS card_id, CASE WHEN known THEN ordered ELSE given END AS previews FROM c""")
def preview_order(spark, sf_dir):
    given = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string")))
    cards = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("card_id")).agg(given.alias("previews")).withColumn("category", F.when(F.col("card_id") % 2 == 0, "text").otherwise("logo"))
    longest = table(spark, sf_dir, "part").where("p_partkey % 50 > 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("preview"), F.length("p_name").alias("longest"))
    return reports.preview_order(cards, longest).withColumn("previews", F.array_join("previews", ","))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'KEEP' WHEN o_orderpriority LIKE '1%' THEN 'CUT' END ELSE 'BLUR' END AS decision FROM orders""")
def bulk_decisions(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), "CUT").alias("suggestion"), F.when(F.col("o_orderkey") % 3 == 0, "BLUR").alias("decision"))
    kept = reports.bulk_decided(items, F.col("o_orderstatus") == "F", F.lit("KEEP"))
    return reports.bulk_decided(kept, F.col("suggestion").isNotNull(), F.col("suggestion")).select("o_orderkey", "decision")


@query("""WITH f AS (SELECT page_id, url, (ARRAY['temp', 'work', 'previews', 'cache'])[(page_id % 4)::INT + 1] AS folder, page_id % 40 AS days FROM pages), k AS (SELECT * FROM (VALUES ('temp', 1), ('work', 7), ('previews', 30)) v(folder, most))
SELECT page_id, folder, days FROM f JOIN k USING (folder) WHERE days >= most""")
def cleanup_candidates(spark, sf_dir):
    kept = spark.createDataFrame([("temp", 1), ("work", 7), ("previews", 30)], "folder string, most int")
    files = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, ("temp", "work", "previews", "cache"))), (F.col("page_id") % 4 + 1).cast("int")).alias("folder"), (F.col("page_id") % 40).alias("days"))
    return files.join(kept, "folder").where("days >= most").select("page_id", "folder", "days")


@query("""SELECT e.event_id, CASE WHEN e.props IS NULL THEN NULL ELSE coalesce((e.props->>'duration')::DOUBLE, (e.props->>'k')::DOUBLE) END AS seconds FROM events e""")
def probe_durations(spark, sf_dir):
    """The duration of the whole, else the longest stream's, from JSON."""
    probe = F.from_json(F.concat(F.lit('{"format":'), F.col("props"), F.lit(',"streams":[{"duration":"0"},{"duration":"'), F.get_json_object("props", "$.k"), F.lit('"},{}]}')), "format struct<duration:string>, streams array<struct<duration:string>>")
    longest = F.array_max(F.transform(probe["streams"], lambda s: s["duration"].cast("double")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(probe["format"]["duration"].cast("double"), longest).alias("seconds"))
