"""Registered queries over whole tables, each with its SQL equivalent for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import scores, text
from spanloom.operators import boxes, cards, evaluation, folds, fuzzy, intervals, metrics, policies, queues, review
from spanloom.operators.graph import connected
from spanloom.sources.tables import samples, table
from spanloom.streaming.sessions import session_stream

HOUR, DAY = 3600.0, 86400.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
S = "SELECT user_id AS source, epoch_us(ts) / 1e6 AS t, value AS score, event_type AS label, event_id AS sample_id FROM events"
SESSIONS = f"""s AS ({S}), o AS (SELECT *, coalesce((t - lag(t) OVER w > 21600)::INT, 1) AS opens FROM s WINDOW w AS (PARTITION BY source ORDER BY t)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY t) AS run FROM o),
sessions AS (SELECT source, greatest(0.0, min(t) - 3600) AS "start", max(t) + 3600 AS "end", max(score) AS max_score, arg_max(label, (score, -t)) AS evidence, count(*) AS sample_count FROM r GROUP BY source, run)"""


def query(sql: str | None):
    """Registers a query under its name, with its SQL if it can be put in SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sessionize(samples(spark, sf_dir), "source", "t", "score", "label", gap=6 * HOUR, padding=HOUR)


@query(f"WITH {SESSIONS} SELECT * FROM sessions")
def sessionize_events(spark, sf_dir):
    return sessions(spark, sf_dir)


@query(f"""WITH {SESSIONS}, m AS (SELECT *, coalesce(("start" - lag("end") OVER w > 14400)::INT, 1) AS opens FROM sessions WINDOW w AS (PARTITION BY source ORDER BY "start", "end")),
g AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT source, min("start") AS "start", arg_max("end", ("start", "end")) AS "end", count(*) AS n_members FROM g GROUP BY source, grp""")
def merge_intervals_gap(spark, sf_dir):
    return intervals.merge_in_order(sessions(spark, sf_dir).select("source", "start", "end"), "source", 4 * HOUR)


ISLANDS = f"""WITH {SESSIONS}, m AS (SELECT source, "start" AS a, "end" AS b, coalesce(("start" - max("end") OVER (PARTITION BY source ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0)::INT, 1) AS opens FROM sessions),
g AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m),
islands AS (SELECT source, min(a) AS a, max(b) AS b FROM g GROUP BY source, grp)"""


@query(ISLANDS + " SELECT source, round(sum(b - a), 3) AS union_seconds, count(*) AS n_islands FROM islands GROUP BY source")
def union_length(spark, sf_dir):
    return intervals.union_length(sessions(spark, sf_dir), "source").withColumn("union_seconds", F.round("union_seconds", 3))


@query(ISLANDS + """, d AS (SELECT source, unnest(range(floor(min(a) / 86400)::BIGINT, floor(max(b) / 86400)::BIGINT + 1)) * 86400.0::DOUBLE AS t_start FROM islands GROUP BY source)
SELECT d.source, t_start, t_start + 86400.0::DOUBLE AS t_end, round(coalesce(sum(least(b, t_start + 86400.0) - greatest(a, t_start)) FILTER (a IS NOT NULL), 0) / 86400.0, 6) AS covered
FROM d LEFT JOIN islands i ON d.source = i.source AND a < t_start + 86400.0 AND b > t_start GROUP BY 1, 2""")
def coverage_daily(spark, sf_dir):
    spans = sessions(spark, sf_dir).select("source", "start", "end")
    return intervals.covered_windows(spans, "source", DAY).withColumn("covered", F.round("covered", 6))


@query(ISLANDS + """, n AS (SELECT source, b AS s, lead(a) OVER (PARTITION BY source ORDER BY a) AS e FROM islands)
SELECT source, s AS "start", e AS "end" FROM n WHERE e > s""")
def complement_segments(spark, sf_dir):
    spans = sessions(spark, sf_dir)
    every = W.partitionBy("source")
    return intervals.complement(spans.withColumns({"low": F.min("start").over(every), "high": F.max("end").over(every)}), "source", "low", "high")


@query(f"""WITH {SESSIONS}, d AS (SELECT DISTINCT source, label, floor(t / 172800) * 172800.0 AS a FROM s)
SELECT x.source, x."start" AS l_start, x."end" AS l_end, d.a AS r_start, d.a + 172800.0 AS r_end, d.label AS r_label, round(least(x."end", d.a + 172800.0) - greatest(x."start", d.a), 3) AS seconds
FROM sessions x JOIN d ON x.source = d.source AND x."start" < d.a + 172800.0 AND d.a < x."end" """)
def interval_overlap_join(spark, sf_dir):
    spans = sessions(spark, sf_dir).select("source", "start", "end")
    begin = F.floor(F.col("t") / (2 * DAY)) * (2 * DAY)
    segments = samples(spark, sf_dir).select("source", "label", begin.alias("start"), (begin + 2 * DAY).alias("end")).distinct()
    joined = intervals.overlap_join(spans, segments, "source", DAY)
    return joined.withColumn("seconds", F.round(F.least("l_end", "r_end") - F.greatest("l_start", "r_start"), 3))


BY_LABEL = f"""WITH s AS ({S}), iv AS (SELECT sample_id, label, t AS a, t + 60 * (score + 1) AS b FROM s)"""


@query(BY_LABEL + """ SELECT x.sample_id, x.label, x.a AS "start", x.b AS "end" FROM iv x WHERE NOT EXISTS (SELECT 1 FROM iv o WHERE o.label = x.label AND o.a <= x.a AND o.b >= x.b
AND ((o.b - o.a > x.b - x.a) OR (o.a = x.a AND o.b = x.b AND o.sample_id < x.sample_id)))""")
def containment_prune(spark, sf_dir):
    spans = samples(spark, sf_dir).select("sample_id", "label", F.col("t").alias("start"), (F.col("t") + 60 * (F.col("score") + 1)).alias("end"))
    return intervals.not_contained(spans, "label", "sample_id", 6 * HOUR)


def _asof(op: str) -> str:
    return f"""WITH s AS ({S}), c AS (SELECT * FROM s WHERE label = 'click'), p AS (SELECT source, t FROM s WHERE label = 'purchase')
SELECT c.source, c.sample_id, c.t, p.t AS nearest FROM c ASOF LEFT JOIN p ON c.source = p.source AND c.t {op} p.t"""


def _nearest(spark, sf_dir, forward: bool) -> DataFrame:
    rows = samples(spark, sf_dir)
    return intervals.asof(rows.where("label = 'click'").select("source", "sample_id", "t"), rows.where("label = 'purchase'").select("source", "t"), "source", "t", forward)


@query(_asof(">="))
def asof_backward(spark, sf_dir):
    return _nearest(spark, sf_dir, False)


@query(_asof("<="))
def asof_forward(spark, sf_dir):
    return _nearest(spark, sf_dir, True)


@query(f"""WITH s AS ({S}), i AS (SELECT source, sample_id, score, floor(t / 3600)::BIGINT AS frame FROM s WHERE score >= 40),
a AS (SELECT *, count(*) OVER (PARTITION BY source ORDER BY frame RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS ahead FROM i),
m AS (SELECT *, max(ahead) OVER (PARTITION BY source ORDER BY frame RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS most FROM a)
SELECT source, sample_id, score, frame FROM m WHERE most >= 3""")
def temporal_confirm(spark, sf_dir):
    hits = samples(spark, sf_dir).where("score >= 40").select("source", "sample_id", "score", F.floor(F.col("t") / HOUR).cast("long").alias("frame"))
    return intervals.confirm(hits, "source", "frame", 12, 3)


@query(f"""WITH s AS ({S}) SELECT label, min(score) AS minimum, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.9), 6) AS p90,
round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99, max(score) AS maximum FROM s GROUP BY label""")
def score_summary(spark, sf_dir):
    return metrics.score_summary(samples(spark, sf_dir), "label", "score")


@query(f"""WITH s AS ({S}), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, sample_id) AS k FROM s)
SELECT source, round(avg(score), 6) AS top_mean, count(*) AS n FROM r WHERE k <= 5 GROUP BY source""")
def topk_mean(spark, sf_dir):
    return metrics.top_k_mean(samples(spark, sf_dir), "source", "score", "sample_id", 5)


LABELLED = "x AS (SELECT d.lang, d.source, l.quality = 1 AS e, d.n_chars >= 1500 AS p FROM labels l JOIN documents d USING (doc_id))"
COUNTS = "count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND NOT p) AS tn, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn"
RATES = """round(tp / nullif(tp + fn, 0), 4) AS recall, round(tp / nullif(tp + fp, 0), 4) AS "precision", round(tn / nullif(tn + fp, 0), 4) AS specificity,
round((tp + tn) / nullif(tp + tn + fp + fn, 0), 4) AS accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 4) AS balanced_accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1"""


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query(f"WITH {LABELLED}, c AS (SELECT {COUNTS} FROM x) SELECT tp, tn, fp, fn, {RATES} FROM c")
def binary_metrics(spark, sf_dir):
    counted = _labelled(spark, sf_dir).agg(*metrics.confusion(F.expr("quality = 1"), F.expr("n_chars >= 1500")))
    return counted.select("tp", "tn", "fp", "fn", *metrics.rates())


CARD = f"SELECT lang, CASE WHEN g = 1 THEN 'all' ELSE source END AS source, tp, tn, fp, fn, {RATES} FROM (SELECT lang, source, grouping(source) AS g, {COUNTS} FROM x GROUP BY GROUPING SETS ((lang, source), (lang)))"


@query(f"WITH {LABELLED} {CARD}")
def scorecard_grouping_sets(spark, sf_dir):
    return metrics.scorecard(_labelled(spark, sf_dir), "lang", "source", F.expr("quality = 1"), F.expr("n_chars >= 1500"))


@query(f"""WITH {LABELLED}, b AS ({CARD}), y AS (SELECT lang, source, e, n_chars >= 900 AS p FROM (SELECT d.lang, d.source, l.quality = 1 AS e, d.n_chars FROM labels l JOIN documents d USING (doc_id) WHERE d.lang <> 'es')),
c AS ({CARD.replace('FROM x', 'FROM y')})
SELECT lang, source, b.accuracy AS "before", c.accuracy AS "after", round(c.accuracy - b.accuracy, 4) AS delta,
CASE WHEN c.lang IS NULL THEN 'missing' WHEN b.lang IS NULL THEN 'new' WHEN round(c.accuracy - b.accuracy, 4) < -0.02 THEN 'violation' WHEN c.accuracy - b.accuracy IS NULL THEN 'unknown' ELSE 'ok' END AS status
FROM b FULL JOIN c USING (lang, source)""")
def scorecard_compare(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    base = metrics.scorecard(rows, "lang", "source", F.expr("quality = 1"), F.expr("n_chars >= 1500"))
    new = metrics.scorecard(rows.where("lang <> 'es'"), "lang", "source", F.expr("quality = 1"), F.expr("n_chars >= 900"))
    return metrics.compare(base, new, ["lang", "source"], "accuracy", 0.02)


@query(f"WITH s AS ({S}) SELECT source, round(1 - product(1 - greatest(0, least(1, score / 1000))), 6) AS any_probability FROM s GROUP BY source")
def probabilistic_union(spark, sf_dir):
    rest = F.product(1 - scores.clamp01(F.col("score") / 1000))
    return samples(spark, sf_dir).groupBy("source").agg(F.round(1 - rest, 6).alias("any_probability"))


TAGS = f"""WITH s AS ({S}), p AS (SELECT source, label, least(1.0, max(score) / 1200) AS p FROM s GROUP BY ALL),
g AS (SELECT source, 1 - product(1 - p) FILTER (label IN ('error', 'click')) AS score, 1 - product(1 - p) FILTER (label IN ('view', 'signup')) AS context, count(*) FILTER (label IN ('error', 'click') AND p >= 0.3) AS n,
1 - product(1 - p) AS every, count(*) FILTER (p >= 0.3) AS together FROM p GROUP BY source),
r AS (SELECT source, coalesce(score, 0) AS score, coalesce(context, 0) AS context, n, every, together FROM g)"""


def _tags(spark, sf_dir) -> DataFrame:
    per_label = samples(spark, sf_dir).groupBy("source", "label").agg(F.least(F.lit(1.0), F.max("score") / 1200).alias("p"))
    return per_label.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("label", "p"))).alias("tags"))


@query(TAGS + """ SELECT source, score_reason <> 'below_policy' AS accepted, round(score, 6) AS score, round(context, 6) AS context, score_reason AS reason FROM
(SELECT *, CASE WHEN score >= 0.6 THEN 'high_score' WHEN score >= 0.2 AND (context >= 0.5 OR n >= 2) THEN 'context_confirmed' ELSE 'below_policy' END AS score_reason FROM r)""")
def tag_policy(spark, sf_dir):
    d = policies.context_policy(F.col("tags"), ["error", "click"], ["view", "signup"], high=0.6, low=0.2, around=0.5, together=0.3)
    return _tags(spark, sf_dir).select("source", d.alias("d")).select("source", "d.accepted", F.round("d.score", 6).alias("score"), F.round("d.context", 6).alias("context"), "d.reason")


@query(TAGS + " SELECT source, every >= 0.5 AND together >= 3 AS accepted, round(every, 6) AS score, together AS cooccurring FROM r")
def explicit_policy(spark, sf_dir):
    d = policies.explicit_policy(F.col("tags"), ["click", "error", "purchase", "signup", "view"], threshold=0.5, together=0.3, least=3)
    return _tags(spark, sf_dir).select("source", d.alias("d")).select("source", "d.accepted", F.round("d.score", 6).alias("score"), "d.cooccurring")


TRACKS = """t AS (SELECT doc_id, regexp_matches(text, 'licen[cs]ed', 'i') AS hit, (doc_id % 97) / 96.0 AS ad, (doc_id % 89) / 88.0 AS subtitle, (doc_id % 83) / 82.0 AS credits, (doc_id % 79) / 78.0 AS scene,
(doc_id % 101) / 100.0 AS progress, ['subtitle', 'top-left', 'middle-center', 'bottom-right'][(doc_id % 4)::INT + 1] AS zone, n_chars / 100.0 AS seconds, (doc_id % 7) / 10.0 AS wide, (doc_id % 5) / 10.0 AS tall,
doc_id % 3 = 0 AS persistent, n_chars AS length, length(regexp_replace(lower(text), '[^0-9a-z]+', '', 'g')) AS compact FROM documents),
o AS (SELECT *, persistent AND (zone IN ('top-left', 'bottom-right') OR wide >= 0.3) AS overlay FROM t)"""


@query(f"""WITH {TRACKS}, r AS (SELECT doc_id, ad, overlay, CASE WHEN hit THEN 'REVIEW_POLICY_OVERRIDE' WHEN progress >= 0.9 AND length >= 3 AND NOT (ad >= 0.85 AND overlay) THEN 'LIKELY_CREDITS'
WHEN progress < 0.9 AND ad < 0.2 AND greatest(credits, scene) >= 0.65 AND (NOT persistent OR wide < 0.3 OR compact <= 4) THEN 'LIKELY_SCENE_TEXT'
WHEN ad >= 0.45 AND ad >= greatest(subtitle, credits, scene) - 0.03 THEN 'REVIEW_AD_LIKELY' WHEN zone = 'subtitle' AND seconds <= 12 AND tall <= 0.18 AND subtitle >= 0.52 AND subtitle >= ad + 0.12 THEN 'LIKELY_SUBTITLE'
WHEN progress >= 0.85 AND credits >= 0.52 AND credits >= ad + 0.12 THEN 'LIKELY_CREDITS' WHEN NOT overlay AND scene >= 0.55 AND scene >= ad + 0.15 THEN 'LIKELY_SCENE_TEXT' WHEN NOT overlay AND ad < 0.2 THEN 'LOW_AD_UNCERTAIN'
WHEN overlay THEN 'REVIEW_UNCERTAIN_OVERLAY' ELSE 'REVIEW_UNCERTAIN' END AS routing FROM o)
SELECT doc_id, routing, CASE WHEN routing = 'REVIEW_POLICY_OVERRIDE' THEN 'high' WHEN routing = 'REVIEW_AD_LIKELY' THEN CASE WHEN ad >= 0.62 OR overlay THEN 'high' ELSE 'medium' END WHEN routing = 'REVIEW_UNCERTAIN_OVERLAY' THEN 'medium' ELSE 'low' END AS priority,
starts_with(routing, 'REVIEW') AS candidate FROM r""")
def route_text_tracks(spark, sf_dir):
    i = F.col("doc_id")
    zone = F.element_at(F.array(*map(F.lit, ("subtitle", "top-left", "middle-center", "bottom-right"))), (i % 4 + 1).cast("int"))
    shares = [(i % n) / F.lit(float(n - 1)) for n in (97, 89, 83, 79, 101)]
    compact = F.length(F.regexp_replace(F.lower("text"), "[^0-9a-z]+", ""))
    route = policies.track_route(F.col("text").rlike("(?i)licen[cs]ed"), *shares, zone, F.col("n_chars") / 100.0, (i % 7) / 10.0, (i % 5) / 10.0, i % 3 == 0, F.col("n_chars"), compact)
    return table(spark, sf_dir, "documents").select("doc_id", route.alias("r")).select("doc_id", "r.routing", "r.priority", "r.candidate")


@query(r"""SELECT doc_id, CASE WHEN n_chars < 40 THEN 'too_short' WHEN regexp_matches(lower(text), '([a-z0-9-]+\.)+(com|net|org)\b') THEN 'address' WHEN lang <> 'en' AND n_chars < 500 THEN 'subtitle'
WHEN source IN ('src0', 'src1') THEN 'review' WHEN n_chars > 5000 THEN 'long' ELSE 'other' END AS route FROM documents""")
def route_decision_table(spark, sf_dir):
    address = F.lower("text").rlike(r"([a-z0-9-]+\.)+(com|net|org)\b")
    route = F.when(F.col("n_chars") < 40, "too_short").when(address, "address").when((F.col("lang") != "en") & (F.col("n_chars") < 500), "subtitle")
    return table(spark, sf_dir, "documents").select("doc_id", route.when(F.col("source").isin("src0", "src1"), "review").when(F.col("n_chars") > 5000, "long").otherwise("other").alias("route"))


@query(r"""WITH a AS (SELECT page_id, regexp_extract_all(lower(url || ' ' || html), '(?:[a-z0-9-]+\.)+(?:com|net|org|edu|gov|info)\b') AS f FROM pages)
SELECT page_id, len(list_distinct(f)) AS n_hosts, f[1] AS first_host FROM a""")
def web_address_tokens(spark, sf_dir):
    found = text.web_addresses(F.concat_ws(" ", "url", "html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_hosts"), F.get(found, F.lit(0)).alias("first_host"))


@query(f"""SELECT doc_id, md5(regexp_replace(translate(lower(text), '{text.MARKED}', '{text.PLAIN}'), '[^0-9a-z]', '', 'g')) AS folded_md5,
md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS clean_md5 FROM documents""")
def text_fold(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_alnum(t)).alias("folded_md5"), F.md5(text.clean(t)).alias("clean_md5"))


@query("""WITH n AS (SELECT DISTINCT s_name AS a FROM supplier) SELECT x.a AS first_name, y.a AS second_name, levenshtein(x.a, y.a) AS edits FROM n x JOIN n y ON x.a < y.a AND levenshtein(x.a, y.a) <= 1""")
def edit_distance_match(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("a")).distinct().select("a", F.explode(text.deletions(F.col("a"))).alias("k"))
    x, y = names.alias("x"), names.alias("y")
    edits = F.levenshtein("first_name", "second_name")
    met = x.join(y, F.expr("x.k = y.k and x.a < y.a")).select(F.col("x.a").alias("first_name"), F.col("y.a").alias("second_name")).distinct()
    return met.withColumn("edits", edits.cast("long")).where("edits <= 1")


@query("SELECT sha256(text) AS content_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_by_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


HASHED = "h AS (SELECT vec_id, label, list_reduce(list_prepend(0::BIGINT, list_transform(embedding, lambda x: (x > 0)::BIGINT)), lambda a, x: ((a & 4611686018427387903) * 2) | x) AS bits, embedding FROM embeddings)"


@query(f"""WITH {HASHED}, m AS (SELECT label, min(vec_id) AS record, arg_min(bits, vec_id) AS bits FROM h GROUP BY label),
n AS (SELECT q.vec_id, arg_max(m.label, (64 - bit_count(xor(q.bits, m.bits)), -m.record)) AS memory, max(1 - bit_count(xor(q.bits, m.bits)) / 64.0) AS similarity FROM h q JOIN m ON bit_count(xor(q.bits, m.bits)) <= 15 GROUP BY q.vec_id)
SELECT vec_id, memory, similarity FROM h LEFT JOIN n USING (vec_id)""")
def nearest_memory(spark, sf_dir):
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a.bitwiseAND(F.lit((1 << 62) - 1)), 1).bitwiseOR((x > 0).cast("long")))
    hashed = table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.alias("bits"))
    memory = hashed.groupBy("label").agg(F.min("vec_id").alias("record"), F.min_by("bits", "vec_id").alias("bits"))
    return cards.recalled(hashed.select("vec_id", "bits"), memory, "vec_id", 15)


@query("""SELECT a.vec_id, b.vec_id AS other, round(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS chebyshev
FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1""")
def chebyshev_grid(spark, sf_dir):
    grid = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    before = grid.select((F.col("vec_id") + 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("a").alias("b"))
    return grid.join(before, "vec_id").select("vec_id", "other", F.round(scores.chebyshev(F.col("a"), F.col("b")), 6).alias("chebyshev"))


BOXES = "b AS (SELECT p_partkey AS id, p_size AS kind, (p_partkey % 97)::INT AS x1, (p_partkey % 89)::INT AS y1, (p_partkey % 97)::INT + 5 + (p_partkey % 11)::INT AS x2, (p_partkey % 89)::INT + 5 + (p_partkey % 7)::INT AS y2 FROM part)"


@query(f"""WITH {BOXES}, p AS (SELECT l.id AS l_id, r.id AS r_id, greatest(0, least(l.x2, r.x2) - greatest(l.x1, r.x1)) * greatest(0, least(l.y2, r.y2) - greatest(l.y1, r.y1)) AS common,
(l.x2 - l.x1) * (l.y2 - l.y1) AS la, (r.x2 - r.x1) * (r.y2 - r.y1) AS ra FROM b l JOIN b r ON l.kind = r.kind AND l.id < r.id)
SELECT l_id, r_id, round(common / (la + ra - common), 6) AS iou, round(common / least(la, ra), 6) AS over_smaller FROM p WHERE common / (la + ra - common) >= 0.3""")
def box_iou_join(spark, sf_dir):
    k = F.col("p_partkey")
    x1, y1 = (k % 97).cast("int"), (k % 89).cast("int")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_size").alias("kind"), x1.alias("x1"), y1.alias("y1"), (x1 + 5 + (k % 11).cast("int")).alias("x2"), (y1 + 5 + (k % 7).cast("int")).alias("y2"))
    met = boxes.overlapping(rows, ["kind"], 0.3, 8)
    return met.select("l_id", "r_id", F.round(boxes.iou("l_", "r_"), 6).alias("iou"), F.round(boxes.over_smaller("l_", "r_"), 6).alias("over_smaller"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", "o_orderstatus")
    return queues.latest(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority ORDER BY nullif(o_orderstatus, 'O') NULLS LAST, o_orderkey) AS place FROM orders""")
def queue_order(spark, sf_dir):
    status = F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("\U0010ffff"))  # null last
    return queues.places(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority", status, "o_orderkey")


@query("""SELECT o.o_orderkey, count(l_linenumber) AS members, count(*) FILTER (l_returnflag = 'R') AS returned, coalesce(round(sum(l_quantity), 2), 0) AS quantity,
coalesce(round(sum(CASE WHEN l_linestatus = 'F' THEN least(l_quantity, 30) END), 2), 0) AS done_quantity,
CASE WHEN count(l_linenumber) = 0 THEN NULL WHEN bool_and(l_linestatus = 'F') THEN 100 ELSE least(99, floor(100.0 * count(*) FILTER (l_linestatus = 'F') / count(l_linenumber))::INT) END AS percent
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1""")
def group_counts(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    done = F.expr("l_linestatus = 'F'")
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(members, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(
        F.count("l_linenumber").alias("members"),
        F.count_if(F.expr("l_returnflag = 'R'")).alias("returned"),
        F.coalesce(F.round(F.sum("l_quantity"), 2), F.lit(0.0)).alias("quantity"),
        F.coalesce(F.round(F.sum(F.when(done, F.least("l_quantity", F.lit(30.0)))), 2), F.lit(0.0)).alias("done_quantity"),
        F.count_if(done).alias("f"),
    )
    percent = F.when(F.col("members") == 0, None).when(F.col("f") == F.col("members"), 100).otherwise(F.least(F.lit(99), F.floor(F.lit(100.0) * F.col("f") / F.nullif("members", F.lit(0))).cast("int")))
    return joined.withColumn("percent", percent).drop("f")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20")
def bounded_log(spark, sf_dir):
    return queues.newest(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", 20)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, total FROM (SELECT l_suppkey, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_quantity DESC ROWS UNBOUNDED PRECEDING) AS total FROM lineitem) WHERE total <= 2000""")
def running_total_prune(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return queues.under_budget(rows, "l_suppkey", ["o", "l_quantity"], "l_quantity", 2000.0).select("l_suppkey", "l_orderkey", "l_linenumber", "total")


@query(f"""WITH s AS ({S}) SELECT sample_id, bucket, score, rank FROM (SELECT sample_id, score, floor(t / 7200)::BIGINT AS bucket, row_number() OVER (PARTITION BY floor(t / 7200) ORDER BY score DESC, sample_id) AS rank FROM s) WHERE rank <= 3""")
def stratified_topk(spark, sf_dir):
    return queues.strata(samples(spark, sf_dir), F.floor(F.col("t") / 7200).cast("long"), "score", "sample_id", 3).select("sample_id", "bucket", "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT c_custkey AS id, 'customer' AS kind FROM customer WHERE c_acctbal IS NOT NULL UNION SELECT s_suppkey, 'supplier' FROM supplier UNION SELECT o_custkey, 'customer' FROM orders
UNION SELECT l_suppkey, 'supplier' FROM lineitem UNION SELECT p_partkey, 'part' FROM part""")
def recorded_paths_union(spark, sf_dir):
    def arm(name, column, kind, where="true"):
        return table(spark, sf_dir, name).where(where).select(F.col(column).alias("id"), F.lit(kind).alias("kind"))

    arms = [arm("customer", "c_custkey", "customer", "c_acctbal is not null"), arm("supplier", "s_suppkey", "supplier"), arm("orders", "o_custkey", "customer"), arm("lineitem", "l_suppkey", "supplier"), arm("part", "p_partkey", "part")]
    out = arms[0]
    for a in arms[1:]:
        out = out.union(a)
    return out.distinct()


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS taken FROM customer")
def semi_anti(spark, sf_dir):
    customers, large = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    yes = customers.join(large, "c_custkey", "left_semi").withColumn("taken", F.lit(True))
    return yes.unionByName(customers.join(large, "c_custkey", "left_anti").withColumn("taken", F.lit(False)))


@query("""SELECT 'duplicate_text' AS finding, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1
UNION ALL SELECT 'empty_span', l_orderkey * 10 + l_linenumber, 1 FROM lineitem WHERE l_discount <= 0 UNION ALL SELECT 'unknown_label', l.doc_id, 1 FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""")
def integrity_checks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    twice = docs.groupBy("text").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_text").alias("finding"), "id", "n")
    empty = table(spark, sf_dir, "lineitem").where("l_discount <= 0").select(F.lit("empty_span").alias("finding"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit(1).cast("long").alias("n"))
    unknown = table(spark, sf_dir, "labels").join(docs.select("doc_id"), "doc_id", "left_anti").select(F.lit("unknown_label").alias("finding"), F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("n"))
    return twice.unionByName(empty).unionByName(unknown)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, 1000000000000 + l_partkey * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS b FROM lineitem),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, seen) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.seen = u.a)
SELECT id, min(seen) AS component FROM r GROUP BY id""")
def connected_components(spark, sf_dir):
    """Orders that ship the same part on the same day hang together."""
    shipped = 1000000000000 + F.col("l_partkey") * 100000 + F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    return connected(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), shipped.alias("b")))


@query("""SELECT p_partkey AS ref, count(l_orderkey) AS represented, count(l_orderkey) = 0 AS missing FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON p_partkey = l_partkey GROUP BY 1""")
def queue_coverage(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("ref")).agg(F.count("*").alias("represented"))
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref")).join(used, "ref", "left")
    return refs.select("ref", F.coalesce("represented", F.lit(0).cast("long")).alias("represented"), F.col("represented").isNull().alias("missing"))


@query(f"""WITH s AS ({S}) SELECT source, sample_id, round(avg(score) OVER w, 6) AS window_mean, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY source ORDER BY t, sample_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)
QUALIFY (row_number() OVER (PARTITION BY source ORDER BY t, sample_id) - 1) % 8 = 7""")
def sliding_windows(spark, sf_dir):
    order = W.partitionBy("source").orderBy("t", "sample_id")
    frame = order.rowsBetween(-15, 0)
    rows = samples(spark, sf_dir).withColumns({"i": F.row_number().over(order), "window_mean": F.round(F.avg("score").over(frame), 6), "n": F.count("*").over(frame)})
    return rows.where("(i - 1) % 8 = 7").select("source", "sample_id", "window_mean", "n")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders")
def revisions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return queues.numbered(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", F.col("revision").cast("long").alias("revision"))


@query("""WITH b AS (SELECT page_id, 'item-' || left(sha256(regexp_replace(url, '[0-9]+', '', 'g') || '|' || length(url)::VARCHAR), 12) AS base FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS n FROM b) SELECT page_id, CASE WHEN n = 1 THEN base ELSE base || '-' || n::VARCHAR END AS item_key FROM n""")
def unique_item_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[0-9]+", "").alias("u"), F.length("url").alias("n_url"))
    return queues.unique_ids(rows, ["u", "n_url"], "page_id").select("page_id", "item_key")


@query("""SELECT event_id, CASE WHEN event_id % 6 < 4 THEN round(greatest([5.0, 30.0, 120.0, 600.0][(event_id % 6)::INT + 1] * (1 - 0.2 + 0.4 * (event_id % 101) / 101.0), CASE WHEN event_id % 7 = 0 THEN 90.0 ELSE 0.0 END), 6) END AS delay FROM events""")
def retry_delays(spark, sf_dir):
    e = F.col("event_id")
    delay = scores.retry_delay((e % 6).cast("int"), [5.0, 30.0, 120.0, 600.0], 0.2, (e % 101) / F.lit(101.0), F.when(e % 7 == 0, 90.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(delay, 6).alias("delay"))


@query("""SELECT s_suppkey, trim(left(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-'), 48)) || '-' || left(sha256(s_name), 8) AS job_key,
printf('%d:%02d:%02d', floor(s_acctbal + 1000)::BIGINT // 3600, floor(s_acctbal + 1000)::BIGINT % 3600 // 60, floor(s_acctbal + 1000)::BIGINT % 60) AS clock FROM supplier""")
def job_keys(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.slug_key(F.col("s_name"), F.sha2("s_name", 256)).alias("job_key"), text.clock(F.col("s_acctbal") + 1000).alias("clock"))


@query("""WITH j AS (SELECT event_id, event_type, (props->>'k')::BIGINT AS k FROM events) SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, min(k) AS lowest, max(k) AS highest FROM j GROUP BY 1""")
def json_payloads(spark, sf_dir):
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.min("k").alias("lowest"), F.max("k").alias("highest"))


@query("""SELECT n_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2""")
def names_by_group(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region").where("r_name in ('ASIA', 'EUROPE')"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


GOLDEN = f"""WITH s AS ({S}), labels AS (SELECT sample_id AS label_id, source, CASE WHEN label = 'error' THEN 'safety' ELSE 'advertising' END AS grp, CASE WHEN source % 2 = 0 THEN 'dev' ELSE 'holdout' END AS split,
t AS "start", t + 1800 + 60 * score AS "end", ['KEEP', 'BLUR', 'CUT', 'BLUR', 'KEEP'][(sample_id % 5)::INT + 1] AS action, sample_id % 10 = 4 AS present, CASE WHEN sample_id % 3 = 0 THEN 'must_catch' ELSE 'optional' END AS severity, sample_id % 11 = 0 AS ambiguous,
CASE WHEN sample_id % 4 > 0 THEN sample_id % 50 END AS x1, CASE WHEN sample_id % 4 > 0 THEN sample_id % 30 END AS y1, CASE WHEN sample_id % 4 > 0 THEN sample_id % 50 + 40 END AS x2, CASE WHEN sample_id % 4 > 0 THEN sample_id % 30 + 20 END AS y2 FROM s WHERE label IN ('error', 'purchase')),
items AS (SELECT sample_id AS item_id, source, CASE WHEN sample_id % 2 = 0 THEN 'safety' ELSE 'advertising' END AS grp, t - 3600 AS "start", t + 14400 AS "end", sample_id % 7 = 0 AS advisory, ['frame', 'region', 'region', 'region', 'unknown'][(sample_id % 5)::INT + 1] AS kind,
['BLUR', 'CUT', 'KEEP'][(sample_id % 3)::INT + 1] AS decision, sample_id % 60 AS x1, sample_id % 40 AS y1, sample_id % 60 + 60 AS x2, sample_id % 40 + 45 AS y2 FROM s WHERE label IN ('click', 'view')),
met AS (SELECT l.*, i.item_id, i.advisory, i.decision, i."end" - i."start" AS extent, greatest(l."start", i."start") AS a, least(l."end", i."end") AS b FROM labels l JOIN items i ON l.source = i.source AND l.grp = i.grp AND l."start" < i."end" AND i."start" < l."end"
WHERE CASE WHEN kind = 'unknown' THEN false WHEN l.x1 IS NULL THEN kind = 'frame' OR (i.x2 - i.x1) * (i.y2 - i.y1) >= 0.5 * 4800 WHEN kind = 'frame' THEN l.grp = 'safety'
ELSE greatest(0, least(i.x2, l.x2) - greatest(i.x1, l.x1)) * greatest(0, least(i.y2, l.y2) - greatest(i.y1, l.y1)) >= 0.3 * least((i.x2 - i.x1) * (i.y2 - i.y1), (l.x2 - l.x1) * (l.y2 - l.y1)) END),"""


def _covered(name: str, key: str, where: str) -> str:
    return f"""{name}_o AS (SELECT {key} AS k, a, b, coalesce((a > max(b) OVER (PARTITION BY {key} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS opens FROM met WHERE {where}),
{name}_g AS (SELECT *, sum(opens) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_o), {name} AS (SELECT k, sum(e - s) AS seconds FROM (SELECT k, min(a) AS s, max(b) AS e FROM {name}_g GROUP BY k, grp) GROUP BY k)"""


SCORED = GOLDEN + _covered("every", "label_id", "true") + ", " + _covered("main", "label_id", "NOT advisory") + """, best AS (SELECT label_id, arg_max(item_id, (NOT advisory, b - a, -abs(extent - ("end" - "start")), -item_id)) AS best_item, arg_max(decision, (NOT advisory, b - a, -abs(extent - ("end" - "start")), -item_id)) AS best_decision,
count(*) FILTER (decision IN ('BLUR', 'CUT')) AS edits FROM met GROUP BY label_id),
c AS (SELECT l.*, best_item, best_decision, coalesce(edits, 0) AS edits, coalesce(e.seconds, 0) / ("end" - "start") AS coverage, coalesce(m.seconds, 0) / ("end" - "start") AS main_coverage FROM labels l LEFT JOIN best USING (label_id) LEFT JOIN every e ON e.k = l.label_id LEFT JOIN main m ON m.k = l.label_id),
st AS (SELECT *, CASE WHEN NOT (action IN ('BLUR', 'CUT') OR present) THEN CASE WHEN edits > 0 THEN 'trap_hit' ELSE 'trap_ok' END WHEN ambiguous THEN 'ambiguous' WHEN main_coverage >= 0.8 THEN 'caught' WHEN coverage >= 0.8 THEN 'advisory_only' WHEN coverage > 0 THEN 'partial' ELSE 'missed' END AS status FROM c),
scored AS (SELECT label_id, grp, split, severity, status, round(coverage, 4) AS coverage, round(main_coverage, 4) AS main_coverage, best_item, CASE WHEN status IN ('caught', 'advisory_only') THEN best_decision = action END AS agrees FROM st)"""


def _golden(spark, sf_dir):
    """Labelled events and review items made from the samples."""
    rows, i, s = samples(spark, sf_dir), F.col("sample_id"), F.col("score")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    boxed = {"x1": i % 50, "y1": i % 30, "x2": i % 50 + 40, "y2": i % 30 + 20}
    labels = rows.where("label in ('error', 'purchase')").select(
        i.alias("label_id"), "source", F.when(F.col("label") == "error", "safety").otherwise("advertising").alias("grp"), F.when(F.col("source") % 2 == 0, "dev").otherwise("holdout").alias("split"),
        F.col("t").alias("start"), (F.col("t") + 1800 + 60 * s).alias("end"), pick(5, "KEEP", "BLUR", "CUT", "BLUR", "KEEP").alias("action"), (i % 10 == 4).alias("present"),
        F.when(i % 3 == 0, "must_catch").otherwise("optional").alias("severity"), (i % 11 == 0).alias("ambiguous"), *[F.when(i % 4 > 0, c).alias(n) for n, c in boxed.items()],
    )
    items = rows.where("label in ('click', 'view')").select(
        i.alias("item_id"), "source", F.when(i % 2 == 0, "safety").otherwise("advertising").alias("grp"), (F.col("t") - 3600).alias("start"), (F.col("t") + 14400).alias("end"), (i % 7 == 0).alias("advisory"),
        pick(5, "frame", "region", "region", "region", "unknown").alias("kind"), pick(3, "BLUR", "CUT", "KEEP").alias("decision"), (i % 60).alias("x1"), (i % 40).alias("y1"), (i % 60 + 60).alias("x2"), (i % 40 + 45).alias("y2"),
    )
    return labels, items, 6 * HOUR, 4800.0, ("safety",)


@query(SCORED + " SELECT * FROM scored")
def golden_labels(spark, sf_dir):
    return evaluation.score_labels(*_golden(spark, sf_dir))


@query(GOLDEN.replace("FROM labels l JOIN items", "FROM (SELECT * FROM labels WHERE action IN ('BLUR', 'CUT') OR present) l JOIN items") + _covered("sure", "item_id", "NOT ambiguous") + ", " + _covered("unsure", "item_id", "ambiguous") + """
SELECT item_id, grp, advisory, round(coalesce(s.seconds, 0) / ("end" - "start"), 4) AS share, CASE WHEN coalesce(s.seconds, 0) / ("end" - "start") >= 0.5 THEN 'useful' WHEN s.seconds IS NULL AND u.seconds > 0 THEN 'ambiguous_only' ELSE 'false_positive' END AS verdict
FROM items LEFT JOIN sure s ON s.k = item_id LEFT JOIN unsure u ON u.k = item_id""")
def golden_items(spark, sf_dir):
    return evaluation.score_items(*_golden(spark, sf_dir))


@query(SCORED + """, m AS (SELECT grp, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) FILTER (status IN ('caught', 'advisory_only', 'partial', 'missed')) AS labels, count(*) FILTER (status IN ('caught', 'advisory_only')) AS caught, count(*) FILTER (status = 'missed') AS missed,
count(*) FILTER (status IN ('caught', 'advisory_only', 'partial', 'missed') AND severity = 'must_catch') AS must_catch, count(*) FILTER (status IN ('caught', 'advisory_only') AND severity = 'must_catch') AS must_caught, count(*) FILTER (status = 'trap_hit') AS trap_hits, count(*) FILTER (agrees) AS agree
FROM scored GROUP BY GROUPING SETS ((grp, split), (grp))) SELECT *, round(caught / nullif(labels, 0), 4) AS recall_all, round(must_caught / nullif(must_catch, 0), 4) AS recall_must FROM m""")
def golden_metrics(spark, sf_dir):
    return evaluation.label_metrics(evaluation.score_labels(*_golden(spark, sf_dir)))


@query(f"""WITH {SESSIONS}, x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "start") AS n FROM sessions), y AS (SELECT source, source || ':' || n AS span_id, "start", "end" FROM x)
SELECT y.source, y.span_id, least(y."start", coalesce(min(s.t), y."start")) AS "start", greatest(y."end", coalesce(max(s.t), y."end")) AS "end" FROM y
LEFT JOIN s ON s.source = y.source AND s.score >= 60 AND s.t < y."end" + 14400 AND s.t + 1e-6 > y."start" - 14400 GROUP BY y.source, y.span_id, y."start", y."end" """)
def sequence_context(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("source").orderBy("start"))
    spans = sessions(spark, sf_dir).select("source", F.concat_ws(":", F.col("source").cast("string"), n.cast("string")).alias("span_id"), "start", "end")
    return review.with_context(spans, samples(spark, sf_dir), "source", 4 * HOUR, 60.0)


GUARDS = f"""WITH s AS ({S}), i AS (SELECT source, sample_id AS item_id, t AS a, t + 7200 AS b, sample_id % 60 AS x1, sample_id % 40 AS y1, sample_id % 60 + 60 AS x2, sample_id % 40 + 45 AS y2 FROM s WHERE label = 'view'),
r AS (SELECT source, sample_id AS ref_id, t - 3600 AS a, t + 10800 AS b, sample_id % 50 AS x1, sample_id % 30 AS y1, sample_id % 50 + 50 AS x2, sample_id % 30 + 40 AS y2 FROM s WHERE label = 'signup'),
p AS (SELECT i.item_id, r.ref_id, greatest(0, least(i.x2, r.x2) - greatest(i.x1, r.x1)) * greatest(0, least(i.y2, r.y2) - greatest(i.y1, r.y1)) AS c, 60 * 45 + 50 * 40 AS u FROM i JOIN r ON i.source = r.source AND i.a < r.b AND r.a < i.b)"""


@query(GUARDS + " SELECT i.item_id, min(p.ref_id) AS guard FROM i LEFT JOIN p ON p.item_id = i.item_id AND c / (u - c) >= 0.5 GROUP BY 1")
def guard_title_overlays(spark, sf_dir):
    i, t = F.col("sample_id"), F.col("t")
    rows = samples(spark, sf_dir)
    items = rows.where("label = 'view'").select("source", i.alias("item_id"), t.alias("start"), (t + 7200).alias("end"), (i % 60).alias("x1"), (i % 40).alias("y1"), (i % 60 + 60).alias("x2"), (i % 40 + 45).alias("y2"))
    refs = rows.where("label = 'signup'").select("source", i.alias("ref_id"), (t - 3600).alias("start"), (t + 10800).alias("end"), (i % 50).alias("x1"), (i % 30).alias("y1"), (i % 50 + 50).alias("x2"), (i % 30 + 40).alias("y2"))
    return review.guarded(items, refs, "source", 6 * HOUR, 0.5)


CARDS = f"""WITH s AS ({S}), c AS (SELECT source, sample_id AS card_id, CASE WHEN sample_id % 2 = 0 THEN 'a' ELSE 'b' END AS category, t AS a, t + 20000 AS b, sample_id % 20 AS x1, sample_id % 10 AS y1, sample_id % 20 + 100 AS x2, sample_id % 10 + 100 AS y2, ['KEEP', 'CUT', 'BLUR'][(sample_id % 3)::INT + 1] AS decision, label FROM s),
o AS (SELECT * FROM c WHERE label IN ('click', 'error') OR card_id % 5 = 0), n AS (SELECT * FROM c WHERE label IN ('view', 'purchase') OR card_id % 5 = 0),
v AS (SELECT n.card_id, count(DISTINCT o.decision) AS k, min(o.decision) AS d FROM n JOIN o ON n.source = o.source AND n.category = o.category AND n.a < o.b AND o.a < n.b AND least(n.b, o.b) - greatest(n.a, o.a) >= 0.8 * least(n.b - n.a, o.b - o.a)
AND greatest(0, least(n.x2, o.x2) - greatest(n.x1, o.x1)) * greatest(0, least(n.y2, o.y2) - greatest(n.y1, o.y1)) / least((n.x2 - n.x1) * (n.y2 - n.y1), (o.x2 - o.x1) * (o.y2 - o.y1)) >= 0.75 WHERE n.card_id NOT IN (SELECT card_id FROM o) GROUP BY 1)"""


@query(CARDS + """ SELECT n.card_id, coalesce(o.decision, CASE WHEN k = 1 THEN d END) AS decision, CASE WHEN o.card_id IS NOT NULL THEN 'same' WHEN k = 1 THEN 'alike' WHEN k > 1 THEN 'conflict' ELSE 'open' END AS how
FROM n LEFT JOIN o USING (card_id) LEFT JOIN v ON v.card_id = n.card_id""")
def carry_decisions(spark, sf_dir):
    i, t = F.col("sample_id"), F.col("t")
    cards = samples(spark, sf_dir).select("source", i.alias("card_id"), F.when(i % 2 == 0, "a").otherwise("b").alias("category"), t.alias("start"), (t + 20000).alias("end"), (i % 20).alias("x1"), (i % 10).alias("y1"), (i % 20 + 100).alias("x2"), (i % 10 + 100).alias("y2"), F.element_at(F.array(*map(F.lit, ("KEEP", "CUT", "BLUR"))), (i % 3 + 1).cast("int")).alias("decision"), "label")
    old, new = (cards.where(F.col("label").isin(*names) | (F.col("card_id") % 5 == 0)).drop("label") for names in (("click", "error"), ("view", "purchase")))
    return review.carry_decisions(old, new, "source", 6 * HOUR)


@query(f"""WITH s AS ({S}), e AS (SELECT source, sample_id, score, CASE WHEN sample_id % 40 > 0 THEN label END AS tag FROM s)
SELECT source, CASE WHEN bool_and(tag IS NOT NULL) THEN max(score) END AS score_max, CASE WHEN bool_and(tag IS NOT NULL) THEN arg_max(tag, (score, -sample_id)) END AS strongest, count(*) AS n FROM e GROUP BY source""")
def interval_evidence(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("tag", F.when(F.col("sample_id") % 40 > 0, F.col("label")))
    return review.complete_evidence(rows, "source", "score", "tag")


@query(f"""WITH {SESSIONS}, b AS (SELECT *, coalesce((lag("start") OVER w - "end" > 21600)::INT, 0) AS brk FROM sessions WINDOW w AS (PARTITION BY source ORDER BY "start" DESC, "end" DESC)),
c AS (SELECT *, sum(brk) OVER (PARTITION BY source ORDER BY "start" DESC, "end" DESC ROWS UNBOUNDED PRECEDING) AS chain FROM b)
SELECT source, min("start") AS "start", max("end") AS "end", count(*) AS n FROM c WHERE chain = 0 GROUP BY source""")
def end_card_chain(spark, sf_dir):
    return review.last_chain(sessions(spark, sf_dir).select("source", "start", "end"), "source", 6 * HOUR)


@query(f"""WITH s AS ({S}), d AS (SELECT source, sample_id, t, abs(score - lag(score) OVER (PARTITION BY source ORDER BY t)) AS change FROM s),
o AS (SELECT *, (sum(change) OVER w - change) / nullif(count(change) OVER w - 1, 0) AS others FROM d WHERE change IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT source, sample_id, round(change, 6) AS change, round(others, 6) AS others FROM o WHERE change >= 20 AND change >= 3 * coalesce(others, 0)""")
def detect_steps(spark, sf_dir):
    change = F.abs(F.col("score") - F.lag("score").over(W.partitionBy("source").orderBy("t")))
    rows = samples(spark, sf_dir).withColumn("change", change).where("change is not null")
    return review.steps_above(rows, "source", "t", "change", 5, 3.0, 20.0).select("source", "sample_id", F.round("change", 6).alias("change"), F.round("others", 6).alias("others"))


@query(f"WITH s AS ({S}) SELECT source, arg_max(sample_id, (score, -t)) AS strongest, arg_max(sample_id, t) AS latest FROM s GROUP BY source")
def window_evidence(spark, sf_dir):
    return review.ends_of(samples(spark, sf_dir), "source", "score", "t")


@query("""WITH d AS (SELECT DISTINCT p_brand, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_name) AS k FROM d)
SELECT p_brand, string_agg(p_name, ' | ' ORDER BY k) AS texts FROM r WHERE k <= 5 GROUP BY 1""")
def representative_texts(spark, sf_dir):
    return review.longest_texts(table(spark, sf_dir, "part"), "p_brand", "p_name", 5)


@query("""WITH r AS (SELECT l_suppkey AS machine, year(l_shipdate) AS run, l_returnflag AS option, round(sum(l_quantity), 2) AS seconds FROM lineitem GROUP BY ALL),
b AS (SELECT machine, run, arg_min(option, (seconds, option)) AS option, min(seconds) AS first, list_sort(list(seconds))[2] AS second FROM r GROUP BY ALL),
l AS (SELECT *, coalesce(second - first >= 5 AND first <= 0.9 * second, false) AS clear, row_number() OVER (PARTITION BY machine ORDER BY run DESC) AS k FROM b)
SELECT machine, CASE WHEN count(*) = 2 AND bool_and(clear) AND min(option) = max(option) THEN min(option) END AS choice FROM l WHERE k <= 2 GROUP BY machine""")
def hysteresis_choice(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("machine"), F.year("l_shipdate").alias("run"), F.col("l_returnflag").alias("option")).agg(F.round(F.sum("l_quantity"), 2).alias("seconds"))
    return review.steady_choice(runs, "machine", 0.1, 5.0)


@query("""WITH f AS (SELECT o_orderkey AS pts, o_orderstatus AS h FROM orders), c AS (SELECT l_orderkey + CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END AS pts, max(l_linestatus) AS h FROM lineitem GROUP BY 1)
SELECT CASE WHEN f.pts IS NULL THEN 'extra' WHEN c.pts IS NULL THEN 'missing' WHEN f.h = 'P' THEN 'unknown' WHEN f.h = c.h THEN 'same' ELSE 'mismatched' END AS status, count(*) AS n, min(coalesce(f.pts, c.pts)) AS first_pts FROM f FULL JOIN c ON f.pts = c.pts GROUP BY 1""")
def compare_frames(spark, sf_dir):
    film = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pts"), F.col("o_orderstatus").alias("h"), F.lit(1).alias("in_film"))
    clip = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + F.when(F.col("l_orderkey") % 17 == 0, 1).otherwise(0)).alias("pts")).agg(F.max("l_linestatus").alias("ch"), F.lit(1).alias("in_clip"))
    both = film.join(clip, "pts", "full_outer")
    status = F.when(F.col("in_film").isNull(), "extra").when(F.col("in_clip").isNull(), "missing").when(F.col("h") == "P", "unknown").when(F.col("h") == F.col("ch"), "same").otherwise("mismatched")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min("pts").alias("first_pts"))


@query(f"""WITH s AS ({S}), w AS (SELECT floor(t / 300)::BIGINT AS bucket, count(*) AS windows, count(*) FILTER (score >= 50) AS selected FROM s GROUP BY 1)
SELECT bucket // 288 AS day, count(*) AS buckets, count(*) FILTER (selected > 0) AS covered, sum(windows)::BIGINT AS windows, sum(windows - selected)::BIGINT AS omitted, count(*) FILTER (selected = 0) AS uncovered FROM w GROUP BY 1""")
def candidate_coverage(spark, sf_dir):
    w = samples(spark, sf_dir).groupBy(F.floor(F.col("t") / 300).cast("long").alias("bucket")).agg(F.count("*").alias("windows"), F.count_if(F.col("score") >= 50).alias("selected"))
    return w.groupBy(F.expr("bucket div 288").alias("day")).agg(F.count("*").alias("buckets"), F.count_if(F.col("selected") > 0).alias("covered"), F.sum("windows").alias("windows"), F.sum(F.col("windows") - F.col("selected")).alias("omitted"), F.count_if(F.col("selected") == 0).alias("uncovered"))


@query("""WITH u AS (SELECT page_id, url, count(*) OVER (PARTITION BY url) AS n FROM pages) SELECT page_id, CASE WHEN url IS NULL OR url NOT LIKE 'http%://%' THEN 'bad_link' WHEN n > 1 THEN 'duplicate' WHEN length(url) > 60 THEN 'too_long' ELSE 'ok' END AS result FROM u""")
def validate_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    twice = pages.groupBy("url").agg(F.count("*").alias("n"))
    bad = F.col("url").isNull() | ~F.col("url").like("http%://%")
    return pages.join(twice, "url", "left").select("page_id", F.when(bad, "bad_link").when(F.col("n") > 1, "duplicate").when(F.length("url") > 60, "too_long").otherwise("ok").alias("result"))


@query(f"""WITH {BOXES} SELECT kind, count(*) AS n, quantile_cont(x1, 0.5) AS core_x1, quantile_cont(y1, 0.5) AS core_y1, quantile_cont(x2, 0.5) AS core_x2, quantile_cont(y2, 0.5) AS core_y2,
CASE WHEN count(*) >= 10 THEN list_sort(list(x1))[floor(0.1 * count(*))::INT + 1] ELSE min(x1) END AS low_x1, CASE WHEN count(*) >= 10 THEN list_reverse_sort(list(x2))[floor(0.1 * count(*))::INT + 1] ELSE max(x2) END AS high_x2 FROM b GROUP BY kind""")
def consensus_boxes(spark, sf_dir):
    k = F.col("p_partkey")
    x1, y1 = (k % 97).cast("int"), (k % 89).cast("int")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("kind"), x1.alias("x1"), y1.alias("y1"), (x1 + 5 + (k % 11).cast("int")).alias("x2"), (y1 + 5 + (k % 7).cast("int")).alias("y2"))
    # coordinates are pixels, so a key's counts per value stay small however many boxes it has
    ranked = {"low_x1": ("x1", "asc"), "high_x2": ("x2", "desc")}
    out = rows.groupBy("kind").agg(F.count("*").alias("n"), *[F.percentile(c, F.lit(0.5)).alias(f"core_{c}") for c in ("x1", "y1", "x2", "y2")], F.min("x1").alias("least"), F.max("x2").alias("most"))
    for name, (c, way) in ranked.items():
        order = W.partitionBy("kind").orderBy(F.col(c).asc() if way == "asc" else F.col(c).desc())
        counted = rows.groupBy("kind", c).agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(order.rowsBetween(W.unboundedPreceding, 0)))
        edge = counted.join(out.select("kind", "n"), "kind").where(F.col("upto") > F.floor(F.col("n") * 0.1)).groupBy("kind").agg((F.min(c) if way == "asc" else F.max(c)).alias(name))
        out = out.join(edge, "kind")
    return out.withColumn("low_x1", F.when(F.col("n") >= 10, F.col("low_x1")).otherwise(F.col("least"))).withColumn("high_x2", F.when(F.col("n") >= 10, F.col("high_x2")).otherwise(F.col("most"))).drop("least", "most")


@query(f"""WITH RECURSIVE s AS ({S}), b AS (SELECT source, label AS category, t AS a, t + 600 AS b, CASE WHEN sample_id % 3 = 0 THEN 'BLUR' WHEN sample_id % 7 = 0 THEN 'CUT' END AS sug FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY source, category ORDER BY a, b, sug) AS n FROM b),
f AS (SELECT source, category, n, 1 AS grp, a AS low, b AS high, sug FROM r WHERE n = 1 UNION ALL
SELECT source, category, n, CASE WHEN stays THEN grp ELSE grp + 1 END AS grp, CASE WHEN stays THEN low ELSE a END, CASE WHEN stays THEN greatest(high, b) ELSE b END, CASE WHEN stays THEN coalesce(known, sug) ELSE sug END
FROM (SELECT r.*, f.grp, f.low, f.high, f.sug AS known, r.a - f.high <= 43200 AND greatest(r.b, f.high) - f.low <= 129600 AND NOT coalesce(f.sug <> r.sug, false) AS stays FROM f JOIN r ON r.source = f.source AND r.category = f.category AND r.n = f.n + 1))
SELECT source, category, min(low) AS "start", max(high) AS "end", arg_max(sug, n) AS suggestion, count(*) AS n FROM f GROUP BY source, category, grp""")
def bounded_sessions(spark, sf_dir):
    t = F.col("t")
    rows = samples(spark, sf_dir).select("source", F.col("label").alias("category"), t.alias("start"), (t + 600).alias("end"), F.when(F.col("sample_id") % 3 == 0, "BLUR").when(F.col("sample_id") % 7 == 0, "CUT").alias("suggestion"))
    return folds.bounded_sessions(rows, 12 * HOUR, 36 * HOUR)


@query(None)
def box_tracks(spark, sf_dir):
    i = F.col("sample_id")
    x = (i % 5).cast("double") * 10
    rows = samples(spark, sf_dir).select("source", (F.floor(F.col("t") / HOUR) * HOUR).alias("t"), (F.col("score") / 500).alias("confidence"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 25).alias("x2"), F.lit(20.0).alias("y2"))
    return folds.tracks(rows, 12 * HOUR, 0.3)


@query("""WITH b AS (SELECT user_id AS source, ts, value, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000)::INT, 1) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY ts) AS run FROM b) SELECT source, epoch_us(min(ts)) AS "first", epoch_us(max(ts)) AS "last", max(value) AS max_score, count(*) AS sample_count FROM r GROUP BY source, run""")
def session_windows(spark, sf_dir):
    """The streaming plan on a table."""
    hits = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("score"))
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{c}` as timestamp_ntz))")
    return session_stream(hits.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "1 day").withColumns({"first": micros("first"), "last": micros("last")})


@query(r"""WITH z AS (SELECT p_partkey, p_name, (p_partkey % 101) / 100.0::DOUBLE AS x, (p_partkey % 97) / 96.0::DOUBLE AS y, (p_partkey % 50) / 49.0::DOUBLE AS conf, p_size * 3 AS h FROM part),
q AS (SELECT *, CASE WHEN y >= 0.72 AND x BETWEEN 0.18 AND 0.82 THEN 'subtitle' ELSE (CASE WHEN y < 0.28 THEN 'top' WHEN y > 0.72 THEN 'bottom' ELSE 'middle' END) || '-' || (CASE WHEN x < 0.3 THEN 'left' WHEN x > 0.7 THEN 'right' ELSE 'center' END) END AS zone,
length(regexp_replace(p_name, '[^0-9A-Za-zÀ-ỹĐđ]+', '', 'g')) AS n, least(8, greatest(2, round(h * 0.1)::INT)) AS trim FROM z)
SELECT p_partkey, zone, n >= 2 AND (conf >= 0.5 OR (conf >= 0.3 AND starts_with(zone, 'top-') AND n >= 12)) AS accepted, CASE WHEN h >= 24 AND h - trim >= 12 THEN h - trim ELSE h END AS height FROM q""")
def accepted_reads(spark, sf_dir):
    k = F.col("p_partkey")
    where = cards.zone((k % 101) / F.lit(100.0), (k % 97) / F.lit(96.0))
    return table(spark, sf_dir, "part").select("p_partkey", where.alias("zone"), cards.accepted(F.col("p_name"), (k % 50) / F.lit(49.0), where, 0.5, 0.3).alias("accepted"), cards.trimmed_height(F.col("p_size") * 3).alias("height"))


@query("""SELECT o_orderkey, CASE WHEN lower(split_part(o_orderpriority, '-', 2)) IN ('high', 'context', 'normal') THEN lower(split_part(o_orderpriority, '-', 2)) WHEN o_orderkey % 4 = 0 THEN 'high' ELSE 'context' END AS priority FROM orders""")
def card_priorities(spark, sf_dir):
    reason = F.when(F.col("o_orderkey") % 4 == 0, "Very HIGH score").otherwise("plain")
    return table(spark, sf_dir, "orders").select("o_orderkey", cards.priority(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), reason).alias("priority"))


@query(GUARDS + " SELECT i.item_id AS card_id, count(p.ref_id) AS confirmations FROM i LEFT JOIN p ON p.item_id = i.item_id AND c / least(60 * 45, 50 * 40) >= 0.6 GROUP BY 1")
def corroborated_cards(spark, sf_dir):
    i, t = F.col("sample_id"), F.col("t")
    rows = samples(spark, sf_dir)
    own = rows.where("label = 'view'").select("source", i.alias("card_id"), t.alias("start"), (t + 7200).alias("end"), (i % 60).alias("x1"), (i % 40).alias("y1"), (i % 60 + 60).alias("x2"), (i % 40 + 45).alias("y2"))
    marks = rows.where("label = 'signup'").select("source", (t - 3600).alias("start"), (t + 10800).alias("end"), (i % 50).alias("x1"), (i % 30).alias("y1"), (i % 50 + 50).alias("x2"), (i % 30 + 40).alias("y2"))
    return cards.corroborated(own, marks, "source", 6 * HOUR, 0.6)


@query(f"""WITH s AS ({S}), w AS (SELECT source, sample_id AS window_id, t AS a, t + 18000 AS b FROM s WHERE label = 'purchase'), r AS (SELECT source, t AS a, t + 60 AS b, CASE WHEN sample_id % 3 > 0 THEN label END AS token FROM s),
c AS (SELECT source, floor(t / 86400) * 86400 AS a, floor(t / 86400) * 86400 + 86400.0 AS b FROM s WHERE label = 'view')
SELECT w.source, w.window_id, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.source = w.source AND c.a <= w.a AND c.b >= w.b) THEN coalesce((SELECT string_agg(DISTINCT token, ',' ORDER BY token) FROM r WHERE r.source = w.source AND r.a < w.b AND w.a < r.b), '') END AS tokens FROM w""")
def window_evidence_tokens(spark, sf_dir):
    t, day = F.col("t"), F.floor(F.col("t") / DAY) * DAY
    rows = samples(spark, sf_dir)
    windows = rows.where("label = 'purchase'").select("source", F.col("sample_id").alias("window_id"), t.alias("start"), (t + 18000).alias("end"))
    reads = rows.select("source", t.alias("start"), (t + 60).alias("end"), F.when(F.col("sample_id") % 3 > 0, F.col("label")).alias("token"))
    scans = rows.where("label = 'view'").select("source", day.alias("start"), (day + DAY).alias("end")).distinct()
    found = cards.window_evidence_tokens(windows, reads, scans, "source", 12 * HOUR)
    return found.select("source", "window_id", F.array_join("tokens", ",").alias("tokens"))


@query(f"""WITH s AS ({S}), c AS (SELECT source, sample_id AS card_id, t AS a, t + 9000 AS b FROM s WHERE label = 'view'), o AS (SELECT source, sample_id AS owner_id, t - 1800 AS a, t + 7200 AS b FROM s WHERE label = 'click'),
p AS (SELECT c.card_id, o.owner_id, (least(c.b, o.b) - greatest(c.a, o.a)) / (c.b - c.a) AS share FROM c JOIN o ON c.source = o.source AND c.a < o.b AND o.a < c.b),
b AS (SELECT card_id, arg_max(owner_id, (share, -owner_id)) AS owner_id, max(share) AS share FROM p GROUP BY 1 HAVING max(share) >= 0.5)
SELECT c.card_id, b.owner_id, round(b.share, 6) AS share FROM c LEFT JOIN b USING (card_id)""")
def linked_cards(spark, sf_dir):
    t, i = F.col("t"), F.col("sample_id")
    rows = samples(spark, sf_dir)
    own = rows.where("label = 'view'").select("source", i.alias("card_id"), t.alias("start"), (t + 9000).alias("end"))
    owners = rows.where("label = 'click'").select("source", i.alias("owner_id"), (t - 1800).alias("start"), (t + 7200).alias("end"))
    return cards.best_owner(own, owners, "source", 6 * HOUR, 0.5)


@query("""WITH e AS (SELECT md5(d.text) AS image, d.lang, d.doc_id, l.quality = 1 AS expected FROM documents d JOIN labels l USING (doc_id)),
f AS (SELECT image, arg_min(expected, (lang, doc_id)) AS expected, min((lang, doc_id)) AS k FROM e GROUP BY image),
r AS (SELECT image, expected, k[1] AS lang, k[2] AS doc_id, row_number() OVER (PARTITION BY expected ORDER BY k, image) AS n FROM f) SELECT image, lang, doc_id, expected FROM r WHERE n <= 24""")
def balanced_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.md5("text").alias("image"), "lang", "doc_id", (F.col("quality") == 1).alias("expected"))
    return cards.balanced(rows, "image", "expected", ["lang", "doc_id"], 24)


@query("""WITH m AS (SELECT l_orderkey, CASE l_linenumber % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'held' ELSE 'given' END AS status, CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity > 30 THEN 'active' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'paused' END AS state,
CASE WHEN l_discount > 0.05 THEN 'failed' WHEN l_discount > 0.02 THEN 'active' END AS last FROM lineitem),
b AS (SELECT *, CASE WHEN status <> 'given' THEN status WHEN coalesce(state, last) IS NULL THEN 'removed' WHEN coalesce(state, last) = 'active' THEN CASE WHEN state IS NULL THEN 'removed' ELSE 'running' END
WHEN coalesce(state, last) IN ('completed', 'failed', 'expired') THEN coalesce(state, last) WHEN state IS NULL THEN 'removed' ELSE 'attention' END AS bucket FROM m)
SELECT l_orderkey, count(*) AS total, count(*) FILTER (bucket = 'pending') AS pending, count(*) FILTER (bucket = 'held') AS held, count(*) FILTER (bucket = 'running') AS running, count(*) FILTER (bucket = 'completed') AS completed,
count(*) FILTER (bucket = 'failed') AS failed, count(*) FILTER (bucket = 'attention') AS attention, count(*) FILTER (bucket = 'removed') AS removed FROM b GROUP BY 1""")
def group_buckets(spark, sf_dir):
    n, q = F.col("l_linenumber") % 5, F.col("l_quantity")
    status = F.when(n == 0, "pending").when(n == 1, "held").otherwise("given")
    state = F.when(q > 40, None).when(q > 30, "active").when(F.col("l_linestatus") == "F", "completed").otherwise("paused")
    last = F.when(F.col("l_discount") > 0.05, "failed").when(F.col("l_discount") > 0.02, "active")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", cards.bucket_of(status, state, last).alias("b"))
    names = ["pending", "held", "running", "completed", "failed", "attention", "removed"]
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("total"), *[F.count_if(F.col("b") == b).alias(b) for b in names])


@query(f"""WITH s AS ({S}), g AS (SELECT floor(t / 18000)::BIGINT AS bucket, count(*) FILTER (label = 'click') AS regional, count(*) FILTER (label = 'click' AND score < 40) AS regional_omitted, count(*) FILTER (label <> 'click') AS full_frame,
count(*) FILTER (label <> 'click' AND score >= 40) AS full_frame_selected FROM s GROUP BY 1) SELECT *, greatest(0, least(2, full_frame) - full_frame_selected) AS missing, regional_omitted = 0 AND greatest(0, least(2, full_frame) - full_frame_selected) = 0 AS complete FROM g""")
def representative_coverage(spark, sf_dir):
    kind = F.when(F.col("label") == "click", "regional").otherwise("full_frame")
    rows = samples(spark, sf_dir).select(F.floor(F.col("t") / 18000).cast("long").alias("bucket"), kind.alias("kind"), (F.col("score") >= 40).alias("chosen"))
    return cards.representatives(rows, "bucket", "kind", "chosen")


@query("""SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase') AS last_purchase, arg_max(value, event_id) FILTER (event_type = 'error') AS last_error, max(event_id) AS event_id FROM events GROUP BY user_id""")
def last_write_wins(spark, sf_dir):
    value = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", value("purchase").alias("last_purchase"), value("error").alias("last_error"))
    return cards.adopted(rows, "user_id", "event_id")


@query("""SELECT l_partkey AS part, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def shared_sources(spark, sf_dir):
    return cards.shared_keys(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_suppkey"), "part", ["l_suppkey"])


@query(f"""WITH s AS ({S}), b AS (SELECT source, sample_id, t AS "start", max(t + 3600) OVER (PARTITION BY source ORDER BY t, t + 3600 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "before" FROM s) SELECT * FROM b WHERE "start" < "before" """)
def overlapping_segments(spark, sf_dir):
    rows = samples(spark, sf_dir).select("source", "sample_id", F.col("t").alias("start"), (F.col("t") + 3600).alias("end"))
    return cards.disjoint(rows, "source").drop("end")


def _ad_sql(c: str) -> str:
    found = [f"list_transform(regexp_extract_all({c}, '{p}'), lambda x: trim(regexp_replace(x, '^[ >(]', '')))" for p in text.AD_SHAPES.values()]
    return f"list_distinct(list_concat({', '.join(found)}))"


CALLS = "url || ' +' || (5550000000 + page_id) || ' (@user_' || page_id || ' mail' || page_id || '@example.org ' || html"


@query(f"""WITH p AS (SELECT page_id, url, {CALLS} AS t FROM pages) SELECT page_id, md5(array_to_string(list_sort({_ad_sql('t')}), ',')) AS tokens_md5, len({_ad_sql('t')}) AS n,
CASE WHEN length(regexp_replace(regexp_replace(lower(url), '^\\s*(?:https?:/*)?(?:www\\.)?', ''), '[^0-9a-z]', '', 'g')) >= 24 THEN regexp_replace(regexp_replace(lower(url), '^\\s*(?:https?:/*)?(?:www\\.)?', ''), '[^0-9a-z]', '', 'g') END AS memory_key FROM p""")
def ad_text_tokens(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", text.ad_tokens(F.expr(CALLS)).alias("t"))
    return pages.select("page_id", F.md5(F.array_join(F.array_sort("t"), ",")).alias("tokens_md5"), F.size("t").cast("long").alias("n"), text.memory_key(F.col("url"), 24).alias("memory_key"))


@query("""WITH names(name) AS (VALUES ('bluework'), ('redsteel'), ('almond'), ('lavender'), ('brand12'), ('economy')), t AS (SELECT p_partkey, lower(p_name || ' ' || p_brand) AS s FROM part),
k AS (SELECT p_partkey, regexp_extract_all(s, '[a-z0-9]+') AS w, list_transform(string_split_regex(s, '\\s+'), lambda c: regexp_replace(c, '[^a-z0-9]', '', 'g')) AS chunks FROM t),
c AS (SELECT DISTINCT p_partkey, unnest(list_concat(list_concat(w, chunks), list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || w[i + 1]))) AS cand FROM k)
SELECT p_partkey, name, min(levenshtein(cand, name)) AS edits FROM c JOIN names ON abs(length(cand) - length(name)) <= 1 AND levenshtein(cand, name) <= 1 GROUP BY 1, 2""")
def platform_names(spark, sf_dir):
    """Texts that repeat are read once, and of their words each different one is held against the names."""
    names = spark.createDataFrame([(n,) for n in ("bluework", "redsteel", "almond", "lavender", "brand12", "economy")], "name string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("s"))
    return fuzzy.named_in(rows, names, "p_partkey", "s")


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(CASE WHEN len(v) <= 4 THEN v ELSE list_transform(range(0, 4), lambda i: v[round_even(i * (len(v) - 1) / 3.0, 0)::INT + 1]) END, ',') AS spread, len(v) AS n FROM o""")
def spread_picks(spark, sf_dir):
    v = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v"))
    return v.select("o_custkey", F.array_join(text.spread(F.col("v"), 4).cast("array<string>"), ",").alias("spread"), F.size("v").cast("long").alias("n"))


@query("""SELECT o_orderkey, least(200, greatest(40, o_orderkey % 30 + 18 * greatest(1, ceil(o_totalprice / 100 / 300.0)::BIGINT)))::BIGINT AS budget, (o_orderkey * 40000) % 1000000 = 0 AND (o_orderkey * 40000) % 120000 = 0 AS on_grid FROM orders""")
def candidate_budgets(spark, sf_dir):
    k = F.col("o_orderkey")
    budget = scores.candidate_budget(F.col("o_totalprice") / 100, F.lit(200), k % 30)
    return table(spark, sf_dir, "orders").select("o_orderkey", budget.cast("long").alias("budget"), scores.on_grid(k * 40000, [1_000_000, 120_000]).alias("on_grid"))


@query(f"""WITH s AS ({S}), c AS (SELECT source, label AS category, t AS a, t + 1800 AS b, score, CASE WHEN sample_id % 9 = 0 THEN 'high' WHEN sample_id % 4 = 0 THEN 'normal' ELSE 'context' END AS priority, CASE WHEN sample_id % 2 = 0 THEN 'logo' ELSE 'overlay' END AS kind,
CASE WHEN sample_id % 5 = 0 THEN 'BLUR' WHEN sample_id % 7 = 0 THEN 'CUT' END AS sug, sample_id AS id, CASE WHEN sample_id % 4 > 0 THEN {{'x1': sample_id % 40, 'y1': sample_id % 30, 'x2': sample_id % 40 + 80, 'y2': sample_id % 30 + 60}} END AS box FROM s),
l AS (SELECT *, max(b) OVER w AS latest, last_value(sug IGNORE NULLS) OVER w AS known, last_value(box IGNORE NULLS) OVER w AS old FROM c WINDOW w AS (PARTITION BY source, category, kind ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, greatest(0, least(box.x2, old.x2) - greatest(box.x1, old.x1)) * greatest(0, least(box.y2, old.y2) - greatest(box.y1, old.y1)) AS common FROM l),
o AS (SELECT *, coalesce(a - latest > 86400, false) OR coalesce(sug <> known, false) OR (box IS NOT NULL AND old IS NOT NULL AND common / (2 * 80 * 60 - common) < 0.5) AS opens FROM i),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY source, category, kind ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS grp FROM o)
SELECT source, category, kind, min(a) AS "start", max(b) AS "end", max(score) AS max_score, arg_min(priority, CASE priority WHEN 'high' THEN 0 WHEN 'context' THEN 1 ELSE 2 END) AS priority, first(sug ORDER BY a, b, id) FILTER (sug IS NOT NULL) AS suggestion,
string_agg(id::VARCHAR, ',' ORDER BY a, b, id) AS refs, count(*) AS n, first(box.x1 ORDER BY a, b, id) FILTER (box IS NOT NULL) AS x1, first(box.y2 ORDER BY a, b, id) FILTER (box IS NOT NULL) AS y2 FROM g GROUP BY source, category, kind, grp""")
def merged_cards(spark, sf_dir):
    i, t = F.col("sample_id"), F.col("t")
    boxed = {"x1": i % 40, "y1": i % 30, "x2": i % 40 + 80, "y2": i % 30 + 60}
    rows = samples(spark, sf_dir).select(
        "source", F.col("label").alias("category"), t.alias("start"), (t + 1800).alias("end"), F.col("score").alias("max_score"), F.when(i % 9 == 0, "high").when(i % 4 == 0, "normal").otherwise("context").alias("priority"), F.when(i % 2 == 0, "logo").otherwise("overlay").alias("kind"),
        F.when(i % 5 == 0, "BLUR").when(i % 7 == 0, "CUT").alias("suggestion"), F.array(i.cast("string")).alias("refs"), i.alias("card_id"), *[F.when(i % 4 > 0, c).alias(n) for n, c in boxed.items()],
    )
    return folds.merge_cards(rows, 24 * HOUR).withColumn("refs", F.array_join("refs", ",")).drop("y1", "x2")


@query(f"""WITH s AS ({S}), r AS (SELECT source AS segment, CASE WHEN sample_id % 2 = 0 THEN 'dense' ELSE 'review' END AS tier, t AS a, t + 7200 + 30 * score AS b, ['KEEP', 'CUT', 'BLUR'][(sample_id % 3)::INT + 1] AS decision, sample_id::DOUBLE AS moment FROM s),
l AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM r WINDOW w AS (PARTITION BY segment, tier ORDER BY a, b DESC, moment)),
o AS (SELECT *, coalesce(least(b - a, pb - pa) > 0 AND least(b, pb) - a >= 0.5 * least(b - a, pb - pa), false) AS stays FROM l),
g AS (SELECT *, sum((NOT stays)::INT) OVER (PARTITION BY segment, tier ORDER BY a, b DESC, moment ROWS UNBOUNDED PRECEDING) AS grp FROM o)
SELECT segment, tier, min(a) AS "start", first(b ORDER BY a, b DESC) AS "end", arg_max(decision, moment) AS decision, max(moment) AS decided_at, count(*) AS n FROM g GROUP BY segment, tier, grp""")
def merged_suggestions(spark, sf_dir):
    i, t = F.col("sample_id"), F.col("t")
    decision = F.element_at(F.array(*map(F.lit, ("KEEP", "CUT", "BLUR"))), (i % 3 + 1).cast("int"))
    rows = samples(spark, sf_dir).select(F.col("source").alias("segment"), F.when(i % 2 == 0, "dense").otherwise("review").alias("tier"), t.alias("start"), (t + 7200 + 30 * F.col("score")).alias("end"), decision.alias("decision"), i.cast("double").alias("decided_at"))
    return folds.merge_suggestions(rows)


from spanloom.plans import jobs_catalog, review_catalog, selection_catalog, tracks_catalog, triage_catalog  # noqa: E402, F401  register their queries beside these
