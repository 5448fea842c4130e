"""Registered queries over choices under a budget and over cards that absorb each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import absorption, boxes, quality, selection
from spanloom.plans.catalog import DAY, S, query
from spanloom.sources.tables import samples

BUDGET, SINCE, DAYS = 20, 1704067200.0, 30


def _window_sql() -> str:
    """The rounds of choices one after the other, each on the rows as the one before it left them."""
    best = "score DESC, a, id"
    wanted = ["kind = 'regional'", "kind = 'full' AND rep", "kind = 'known' AND head", "kind = 'full'", "kind = 'known'"]
    parts = [
        f"s AS ({S}), w0 AS (SELECT source, sample_id AS id, t AS a, score, CASE label WHEN 'error' THEN 'boundary' WHEN 'purchase' THEN 'regional' WHEN 'click' THEN 'known' ELSE 'full' END AS kind, label = 'signup' AS rep, floor(score / 50)::BIGINT AS grp FROM s)",
        f"w1 AS (SELECT *, least({DAYS - 1}, greatest(0, floor((a - {SINCE}) / 86400)))::BIGINT AS bucket, row_number() OVER (PARTITION BY source, kind, grp ORDER BY {best}) = 1 AS head, row_number() OVER (PARTITION BY source, kind ORDER BY a, id) AS edge FROM w0)",
        f"r0 AS (SELECT *, CASE WHEN kind = 'boundary' AND edge <= {BUDGET} THEN edge END AS chosen FROM w1)",
    ]
    for k, what in enumerate(wanted, 1):
        parts += [
            f"a{k} AS (SELECT *, coalesce({what}, false) AS wanted FROM r{k - 1})",
            f"m{k} AS (SELECT source, {BUDGET} - count(chosen) AS room, count(DISTINCT CASE WHEN wanted THEN bucket END) AS n FROM a{k} GROUP BY source)",
            f"b{k} AS (SELECT *, row_number() OVER (PARTITION BY source, bucket, wanted ORDER BY {best}) AS rank, greatest(1, room // greatest(1, n)) AS quota FROM a{k} JOIN m{k} USING (source))",
            f"c{k} AS (SELECT *, CASE WHEN wanted AND chosen IS NULL AND rank <= quota AND room > 0 THEN row_number() OVER (PARTITION BY source, wanted AND chosen IS NULL AND rank <= quota ORDER BY bucket, {best}) END AS nth FROM b{k})",
            f"d{k} AS (SELECT *, CASE WHEN nth <= room THEN nth END AS first, least(room, count(nth) OVER (PARTITION BY source)) AS taken FROM c{k})",
            f"e{k} AS (SELECT *, CASE WHEN wanted AND chosen IS NULL AND first IS NULL THEN taken + row_number() OVER (PARTITION BY source, wanted AND chosen IS NULL AND first IS NULL ORDER BY {best}) END AS again FROM d{k})",
            f"r{k} AS (SELECT source, id, a, score, kind, rep, grp, bucket, head, edge, coalesce(chosen, {k} * 1000 + coalesce(first, CASE WHEN again <= room THEN again END)) AS chosen FROM e{k})",
        ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT source, id AS window_id, row_number() OVER (PARTITION BY source ORDER BY chosen) AS place FROM r{len(wanted)} WHERE chosen IS NOT NULL"


@query(_window_sql())
def selected_windows(spark, sf_dir):
    kind = F.when(F.col("label") == "error", "boundary").when(F.col("label") == "purchase", "regional").when(F.col("label") == "click", "known").otherwise("full")
    rows = samples(spark, sf_dir).select("source", F.col("sample_id").alias("window_id"), F.col("t").alias("start"), "score", kind.alias("kind"), (F.col("label") == "signup").alias("representative"), F.floor(F.col("score") / 50).alias("grp"))
    return selection.selected_windows(rows, "source", BUDGET, SINCE, SINCE + DAYS * DAY, DAY)


@query(f"""WITH s AS ({S}), o AS (SELECT source, t AS a, t + score / 20 AS b FROM s), g AS (SELECT *, coalesce((a > max(b) OVER (PARTITION BY source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-6)::INT, 1) AS opens FROM o WHERE b > a),
n AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM g), i AS (SELECT source, min(a) AS a, max(b) AS b FROM n GROUP BY source, run),
t AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY source ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(b - a) OVER (PARTITION BY source) AS total FROM i),
c AS (SELECT *, least(16, greatest(8, ceil(total / 2 - 1e-6))) AS k FROM t), m AS (SELECT *, unnest(range(k::BIGINT)) AS nth, total / k AS width FROM c)
SELECT DISTINCT source, round(round(a + least((nth + 0.5) * width - before, b - a), 3), 2) AS t FROM m WHERE (nth + 0.5) * width > before + CASE WHEN before > 0 THEN 1e-6 ELSE -1 END AND (nth + 0.5) * width <= before + (b - a) + 1e-6""")
def context_frames(spark, sf_dir):
    rows = samples(spark, sf_dir).select("source", F.col("t").alias("start"), (F.col("t") + F.col("score") / 20).alias("end"))
    return selection.context_frames(rows, "source").select("source", F.round("t", 2).alias("t")).distinct()


@query(f"""WITH RECURSIVE s AS ({S}), k AS (SELECT DISTINCT source, floor(t / 60) * 60 - {SINCE} AS t FROM s), w AS (SELECT source, sample_id AS id, label IN ('click', 'view') AS scored, t - {SINCE} AS a, t - {SINCE} + score AS b FROM s),
x AS (SELECT *, a - CASE WHEN scored THEN 35 ELSE 0 END AS low, b + CASE WHEN scored THEN 36 ELSE 0 END AS high FROM w),
y AS (SELECT *, (SELECT max(t) FROM k WHERE k.source = x.source AND t <= low) AS prev, (SELECT max(t) FROM k WHERE k.source = x.source AND t <= low AND t % 240 = 0 AND t >= low - 300) AS aligned, (SELECT min(t) FROM k WHERE k.source = x.source) AS head, (SELECT min(t) FROM k WHERE k.source = x.source AND t >= high) AS stop FROM x),
z AS (SELECT source, id, scored, CASE WHEN low <= 0 THEN head ELSE coalesce(aligned, prev, head) END AS origin, CASE WHEN high < 2600000 THEN coalesce(stop, 'infinity'::DOUBLE) ELSE 'infinity'::DOUBLE END AS stop FROM y),
n AS (SELECT *, row_number() OVER (PARTITION BY source, scored ORDER BY origin, stop, id) AS place FROM z),
f(source, scored, place, origin, until) AS (SELECT source, scored, place, origin, stop FROM n WHERE place = 1 UNION ALL
SELECT n.source, n.scored, n.place, CASE WHEN n.origin <= until OR (n.origin - until <= 180 AND f.origin % 240 = 0 AND n.origin % 240 <> 0) THEN f.origin ELSE n.origin END, CASE WHEN n.origin <= until OR (n.origin - until <= 180 AND f.origin % 240 = 0 AND n.origin % 240 <> 0) THEN greatest(until, stop) ELSE stop END
FROM f JOIN n ON n.source = f.source AND n.scored = f.scored AND n.place = f.place + 1)
SELECT source, scored, origin, origin % 240 = 0 AS on_grid, CASE WHEN max(until) < 'infinity'::DOUBLE THEN max(until) END AS "end", count(*) AS n_windows FROM f GROUP BY source, scored, origin""")
def planned_clips(spark, sf_dir):
    t = F.col("t") - SINCE
    rows = samples(spark, sf_dir)
    windows = rows.select("source", F.col("sample_id").alias("segment_id"), F.col("label").isin("click", "view").alias("scored"), t.alias("start"), (t + F.col("score")).alias("end"))
    keys = rows.select("source", (F.floor(F.col("t") / 60) * 60 - SINCE).alias("t")).distinct()
    return selection.planned_clips(windows, keys.withColumn("grid", F.col("t") % 240 == 0), 2600000.0).drop("segment_ids")


@query(f"""WITH s AS ({S}), v AS (SELECT *, floor(score * 100)::BIGINT AS v FROM s), b AS (SELECT label, sample_id AS id, t, score, v % 40 AS x1, (v // 7) % 30 AS y1, v % 40 + 60 + (v // 11) % 20 AS x2, (v // 7) % 30 + 20 + (v // 13) % 20 AS y2 FROM v),
c AS (SELECT label, min(x1) + 12 AS x1, min(y1) + 12 AS y1, max(x2) - 12 AS x2, max(y2) - 12 AS y2 FROM b GROUP BY label),
j AS (SELECT b.*, c.x1 AS a1, c.y1 AS b1, c.x2 AS a2, c.y2 AS b2, greatest(0, least(b.x2, c.x2) - greatest(b.x1, c.x1)) * greatest(0, least(b.y2, c.y2) - greatest(b.y1, c.y1)) / (greatest(1, b.x2 - b.x1) * greatest(1, b.y2 - b.y1)) AS inside FROM b JOIN c USING (label) WHERE v_reads >= 10 AND score >= 120),
k AS (SELECT *, greatest(x1, a1) - least(x2, a2) <= greatest(1, y2 - y1) / 2 AND greatest(y1, b1) - least(y2, b2) <= greatest(1, y2 - y1) / 2 AND greatest(1, y2 - y1) <= 2.5 * greatest(1, b2 - b1) AS joined FROM j WHERE inside < 0.95)
SELECT c.label, least(c.x1, min(k.x1) FILTER (joined)) AS x1, least(c.y1, min(k.y1) FILTER (joined)) AS y1, greatest(c.x2, max(k.x2) FILTER (joined)) AS x2, greatest(c.y2, max(k.y2) FILTER (joined)) AS y2, count(k.id) AS n_anchors, count_if(joined) AS n_joined FROM c LEFT JOIN k USING (label) GROUP BY ALL""".replace("v_reads >= 10 AND ", "id % 20 >= 10 AND ").replace("GROUP BY ALL", "GROUP BY c.label, c.x1, c.y1, c.x2, c.y2"))
def anchored_boxes(spark, sf_dir):
    v = F.floor(F.col("score") * 100)
    x, y = v % 40, F.floor(v / 7) % 30
    members = samples(spark, sf_dir).select("label", F.col("sample_id").alias("track_id"), F.lit(0.0).alias("start"), F.col("score").alias("end"), (F.col("sample_id") % 20).alias("observations"), x.alias("x1"), y.alias("y1"), (x + 60 + F.floor(v / 11) % 20).alias("x2"), (y + 20 + F.floor(v / 13) % 20).alias("y2"))
    core = members.groupBy("label").agg((F.min("x1") + 12).alias("x1"), (F.min("y1") + 12).alias("y1"), (F.max("x2") - 12).alias("x2"), (F.max("y2") - 12).alias("y2"))
    return boxes.with_anchors(members, core, "label", 120.0)


def _cards(spark, sf_dir):
    """Events as cards of a user's film: those of a value that fifty divides evenly last for weeks, the others for hours; six places that move by some pixels."""
    v = F.floor(F.col("score") * 100)
    lasting = F.floor(F.col("score")) % 5 == 0
    x, y = v % 3 * 200 + F.floor(v / 7) % 12, F.floor(v / 11) % 2 * 150 + F.floor(v / 13) % 8
    text = F.col("label").isin("purchase", "signup")
    # reads of a logo's text are tighter than the box of the logo
    read = ~lasting & ~text & (F.floor(F.col("score")) % 3 == 0)
    return samples(spark, sf_dir).select(
        "source", F.col("sample_id").alias("item_id"), F.when(text, "text").otherwise("visual_logo").alias("category"), F.when(lasting, "persistent_overlay").alias("candidate"), F.lit(None).cast("string").alias("kind"), F.col("t").alias("start"), (F.col("t") + F.when(lasting, 20 * DAY).otherwise(3600.0)).alias("end"),
        (x + F.when(read, 12).otherwise(0)).alias("x1"), (y + F.when(read, 6).otherwise(0)).alias("y1"), (x + 100 + F.floor(v / 17) % 9 - F.when(read, 20).otherwise(0)).alias("x2"), (y + 50 + F.floor(v / 19) % 6).alias("y2"), (lasting & (F.floor(F.col("score")) % 4 == 0)).alias("approved"), read.alias("ocr"),
        F.when(F.col("label") == "view", "external_brand").alias("classification"), F.when(F.col("label") == "click", "BLUR").alias("suggestion"), F.when((F.col("label") == "error") & (F.floor(F.col("score")) % 7 == 0), "KEEP").alias("decision"), F.lit(False).alias("dialogue"), F.lit(True).alias("absorbable"),
        F.array("label").alias("labels"), F.array(F.col("sample_id").cast("string")).alias("refs"),
    )


@query(None)
def reconciled_cards(spark, sf_dir):
    """Owners absorb in order, each from what the ones before it have left: see tests/test_absorption.py."""
    out = absorption.reconciled(_cards(spark, sf_dir), 1e10)
    return out.select("source", "item_id", "category", "candidate", "start", "end", "suggestion", F.array_join("labels", ",").alias("labels"), F.array_join("refs", ",").alias("refs"), "n_absorbed")


@query(None)
def refined_regions(spark, sf_dir):
    """Reads of a box are grouped by leaders in order of size: see tests/test_absorption.py."""
    return absorption.refined_regions(_cards(spark, sf_dir))


@query(f"""WITH s AS ({S}), v AS (SELECT *, floor(score * 100)::BIGINT AS v, floor(score)::BIGINT AS w, (t - {SINCE}) / 86400 * 20 AS a FROM s),
i AS (SELECT source, sample_id AS id, a, a + CASE WHEN label = 'purchase' THEN 200 ELSE score / 50 END AS b, CASE WHEN label IN ('click', 'view') THEN 'visual_logo' ELSE 'text' END AS category, label, w % 9 = 0 AS named, ['CUT', 'BLUR', 'KEEP', NULL][w % 4 + 1] AS decision, w % 6 = 0 AS ident, w % 3 > 0 AS trusted,
v % 2 * 300 + (v // 7) % 12 + CASE WHEN label = 'purchase' THEN 0 ELSE 20 END AS x1, (v // 13) % 8 + CASE WHEN label = 'purchase' THEN 0 ELSE 10 END AS y1, v, w FROM v),
j AS (SELECT *, x1 + CASE WHEN label = 'purchase' THEN 120 ELSE 50 + (v // 17) % 40 END AS x2, y1 + CASE WHEN label = 'purchase' THEN 60 ELSE 30 + (v // 19) % 10 END AS y2 FROM i),
k AS (SELECT *, x2 - x1 - CASE WHEN w % 5 < 2 THEN 50 ELSE 0 END AS dw, y2 - y1 AS dh, (label = 'error' OR named) AND a < 30 AS promo FROM j),
x AS (SELECT p.source, p.id, p.dw * p.dh AS blur, (p.x2 - p.x1) * (p.y2 - p.y1) AS box, count(*) AS n, (max(o.x2) - min(o.x1)) * (max(o.y2) - min(o.y1)) AS tight FROM k p JOIN k o ON o.source = p.source AND o.id <> p.id AND o.trusted AND o.a < p.b AND o.b > p.a AND (o.x2 - o.x1) * (o.y2 - o.y1) <= 0.6 * (p.x2 - p.x1) * (p.y2 - p.y1)
AND greatest(0, least(p.x2, o.x2) - greatest(p.x1, o.x1)) * greatest(0, least(p.y2, o.y2) - greatest(p.y1, o.y1)) >= 0.7 * (o.x2 - o.x1) * (o.y2 - o.y1) WHERE p.label = 'purchase' AND p.decision = 'BLUR' GROUP BY ALL HAVING count(*) >= 2),
y AS (SELECT source, id, CASE WHEN tight / box < 0.45 AND blur / box < 0.55 THEN 'blur_too_small' WHEN tight / box < 0.45 AND blur / box > 0.9 THEN 'blur_untrimmed' WHEN tight / box >= 0.45 AND blur > 1.5 * tight THEN 'blur_too_wide' END AS finding FROM x)
SELECT source, id AS item_id, 'opening_not_cut' AS finding, NULL::BIGINT AS other_id FROM k WHERE promo AND decision <> 'CUT' AND NOT (decision = 'KEEP' AND ident)
UNION ALL SELECT p.source, p.id, 'opening_shows_on', min(o.id) FROM k p JOIN k o ON o.source = p.source AND o.id <> p.id AND o.a < 30 AND o.category = 'visual_logo' AND o.decision = 'BLUR' AND o.a - p.b BETWEEN 0 AND 1 WHERE p.promo AND p.decision = 'CUT' GROUP BY ALL
UNION ALL SELECT source, id, finding, NULL FROM y WHERE finding IS NOT NULL""")
def quality_findings(spark, sf_dir):
    v, w, label = F.floor(F.col("score") * 100), F.floor("score"), F.col("label")
    start, lasting = (F.col("t") - SINCE) / 86400 * 20, label == "purchase"
    x, y = v % 2 * 300 + F.floor(v / 7) % 12 + F.when(lasting, 0).otherwise(20), F.floor(v / 13) % 8 + F.when(lasting, 0).otherwise(10)
    right, bottom = x + F.when(lasting, 120).otherwise(50 + F.floor(v / 17) % 40), y + F.when(lasting, 60).otherwise(30 + F.floor(v / 19) % 10)
    items = samples(spark, sf_dir).select(
        "source", F.col("sample_id").alias("item_id"), F.when(label.isin("click", "view"), "visual_logo").otherwise("text").alias("category"), F.when(label == "error", "opening_promotion").when(lasting, "persistent_overlay").alias("candidate"), start.alias("start"), (start + F.when(lasting, 200.0).otherwise(F.col("score") / 50)).alias("end"),
        F.array("label").alias("labels"), F.when(w % 9 == 0, F.array(F.lit("A Branded Intro"))).alias("reasons"), F.get(F.array(F.lit("CUT"), F.lit("BLUR"), F.lit("KEEP"), F.lit(None)), (w % 4).cast("int")).alias("decision"), (w % 6 == 0).alias("ident"), (w % 3 > 0).alias("trusted"),
        x.alias("x1"), y.alias("y1"), right.alias("x2"), bottom.alias("y2"), x.alias("dx1"), y.alias("dy1"), (right - F.when(w % 5 < 2, 50).otherwise(0)).alias("dx2"), bottom.alias("dy2"),
    )
    return quality.findings(items)
