"""Registered queries over jobs, queues, edits and choices, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import jobs
from spanloom.plans.catalog import S, query
from spanloom.sources.tables import samples, table


def _pick(values, i):
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


@query("""WITH c AS (SELECT o_custkey AS source, o_orderkey AS k, ['KEEP', 'CUT', 'BLUR', 'CUT'][(o_orderkey % 4)::INT + 1] AS decision, (o_orderkey % 450)::DOUBLE AS s, o_orderkey % 3 = 0 AS discrete, CASE WHEN o_orderkey % 7 = 0 THEN 'note' END AS note,
CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 80 + 10 END AS w, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 + 10 END AS h FROM orders),
m AS (SELECT *, unnest(CASE WHEN discrete THEN [0, 1] ELSE [2] END) AS i FROM c WHERE decision <> 'KEEP'),
o AS (SELECT source, 'op-' || k || CASE i WHEN 0 THEN '-01' WHEN 1 THEN '-02' ELSE '' END AS op_id, lower(decision) AS type, 'c' || k % 2 AS category, s + CASE i WHEN 1 THEN 20 ELSE 0 END AS a, least(480.0, s + CASE i WHEN 0 THEN 10 WHEN 1 THEN 25 ELSE 30 END) AS b,
coalesce(note, 'a, b' || k % 3) AS reason, 'review-' || k AS card_id, CASE WHEN decision = 'BLUR' THEN greatest(28, coalesce(round_even(least(w, h) * 0.6, 0), 28))::INT END AS sigma, CASE WHEN decision = 'BLUR' THEN CASE WHEN h IS NULL THEN 0 ELSE least(4, greatest(2, h // 24)) END END::INT AS feather FROM m),
p AS (SELECT *, coalesce((a > max(b) OVER (PARTITION BY source ORDER BY a, op_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS opens FROM o WHERE type = 'cut'), g AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY a, op_id ROWS UNBOUNDED PRECEDING) AS grp FROM p)
SELECT source, op_id, type, category, a AS "start", b AS "end", reason, card_id AS card_ids, sigma, feather FROM o WHERE type <> 'cut' UNION ALL
SELECT source, arg_min(op_id, (a, op_id)), 'cut', arg_min(category, (a, op_id)), min(a), max(b), list_reduce(list(reason ORDER BY a, op_id), lambda x, r: CASE WHEN x = r THEN x ELSE x || '; ' || r END), string_agg(card_id, ',' ORDER BY a, op_id), NULL, NULL FROM g GROUP BY source, grp""")
def approved_operations(spark, sf_dir):
    k = F.col("o_orderkey")
    s = (k % 450).cast("double")
    span = lambda a, b: F.struct((s + a).alias("start"), (s + b).alias("end"))
    region = F.struct((k % 80 + 10).alias("width"), (k % 100 + 10).alias("height"))
    cards = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("source"), F.concat(F.lit("review-"), k.cast("string")).alias("card_id"), _pick(["KEEP", "CUT", "BLUR", "CUT"], k % 4).alias("decision"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("category"),
        F.when(k % 3 == 0, "discrete_detected_intervals").alias("policy"), s.alias("start"), (s + 30).alias("end"), F.array(span(0, 10), span(20, 25)).alias("detected"), F.lit(480.0).alias("duration"), F.when(k % 7 == 0, "note").alias("note"),
        F.array(F.lit("a"), F.concat(F.lit("b"), (k % 3).cast("string"))).alias("reasons"), F.when(k % 5 > 0, region).alias("region"),
    )
    return jobs.approved_operations(cards, "source", 60.0, 0.6).withColumn("card_ids", F.array_join("card_ids", ","))


@query("""WITH s AS (SELECT o_custkey AS job, o_orderkey AS stage, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END AS a, CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate + to_days((o_orderkey % 40)::INT) END AS b FROM orders),
h AS (SELECT DISTINCT stage FROM s JOIN lineitem ON l_orderkey = stage WHERE l_shipdate >= a AND (b IS NULL OR l_shipdate <= b)), f AS (SELECT l_orderkey AS stage, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT stage, date_diff('second', a, b) AS seconds, h.stage IS NOT NULL AS cache_hit, coalesce(n, 0) AS artifacts FROM s LEFT JOIN h USING (stage) LEFT JOIN f USING (stage)""")
def stage_summary(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    stages = table(spark, sf_dir, "orders").select(k.alias("stage"), F.when(k % 11 > 0, day).alias("started"), F.when(k % 6 > 0, F.timestamp_add("DAY", (k % 40).cast("int"), day)).alias("completed"))
    lines = table(spark, sf_dir, "lineitem")
    return jobs.stage_summary(stages, lines.select(F.col("l_orderkey").alias("stage"), F.col("l_shipdate").alias("at")), lines.select(F.col("l_orderkey").alias("stage"), F.col("l_partkey").alias("path")), ["stage"])


STATES = ["QUEUED", "RENDERING", "PAUSED", "VERIFYING", "AI_AUDITING"]


def _jobs(spark, sf_dir):
    """Orders as jobs, their lines as stages."""
    k, line = F.col("o_orderkey"), F.col("l_linenumber")
    works = table(spark, sf_dir, "orders").select(k.alias("job"), _pick(STATES, k % 5).alias("state"), F.when(k % 9 > 0, F.concat(F.lit("s"), (F.col("o_custkey") % 7).cast("string"))).otherwise("").alias("current"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job"), F.concat(F.lit("s"), line.cast("string")).alias("stage")).agg(F.min("l_returnflag").alias("f"))
    return works, lines.select("job", "stage", F.when(F.col("f") == "R", "RUNNING").when(F.col("f") == "A", "PENDING").otherwise("DONE").alias("state"))


JOBS = """j AS (SELECT o_orderkey AS job, ['QUEUED', 'RENDERING', 'PAUSED', 'VERIFYING', 'AI_AUDITING'][(o_orderkey % 5)::INT + 1] AS state, CASE WHEN o_orderkey % 9 > 0 THEN 's' || o_custkey % 7 ELSE '' END AS current FROM orders),
l AS (SELECT l_orderkey AS job, 's' || l_linenumber AS stage, CASE min(l_returnflag) WHEN 'R' THEN 'RUNNING' WHEN 'A' THEN 'PENDING' ELSE 'DONE' END AS state FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {JOBS} SELECT job, stage, CASE WHEN l.state = 'RUNNING' AND j.state IN ('RENDERING', 'VERIFYING', 'AI_AUDITING') AND current = stage THEN 'PENDING' ELSE l.state END AS state,
CASE WHEN j.state IN ('RENDERING', 'VERIFYING', 'AI_AUDITING') THEN 'INTERRUPTED_RECOVERABLE' ELSE j.state END AS job_state FROM l JOIN j USING (job)""")
def recovered_jobs(spark, sf_dir):
    works, stages = jobs.recovered(*_jobs(spark, sf_dir))
    return stages.join(works.select("job", F.col("state").alias("job_state")), "job")


@query(f"""WITH {JOBS}, r AS (SELECT job, stage, ['QUEUED', 'PAUSED'][(job % 2)::INT + 1] AS job_state FROM l) SELECT r.* FROM r JOIN l USING (job, stage) JOIN j USING (job) WHERE l.state = 'PENDING' AND j.state = job_state""")
def started_stages(spark, sf_dir):
    works, stages = _jobs(spark, sf_dir)
    return jobs.started(stages.select("job", "stage", _pick(["QUEUED", "PAUSED"], F.col("job") % 2).alias("job_state")), stages, works)


@query("""WITH t AS (SELECT o_custkey AS queue, o_orderkey AS task, CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate END AS queued_at FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT queue, task, strftime(queued_at, '%Y-%m-%d') AS queued_at FROM t QUALIFY row_number() OVER (PARTITION BY queue ORDER BY queued_at NULLS FIRST, task) = 1""")
def next_queued(spark, sf_dir):
    k = F.col("o_orderkey")
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("queue"), k.alias("task"), F.when(F.col("o_orderstatus") == "F", "DONE").otherwise("QUEUED").alias("state"), F.when(k % 13 > 0, F.col("o_orderdate")).alias("queued_at"))
    return jobs.next_queued(tasks, "queue", table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task"))).withColumn("queued_at", F.date_format("queued_at", "yyyy-MM-dd"))


@query(f"""WITH s AS ({S}), t AS (SELECT source, sample_id, label = 'click' AS candidate, sample_id % 17 = 0 AS platform, coalesce(score > 400, false) AS evidence FROM s),
n AS (SELECT *, candidate OR platform AS first, greatest(0, 20 - count(*) FILTER (candidate OR platform) OVER (PARTITION BY source)) AS room FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY source, first ORDER BY sample_id) AS place FROM n)
SELECT source, sample_id, candidate, platform, evidence FROM r WHERE first OR place <= room OR evidence""")
def limited_tracks(spark, sf_dir):
    i = F.col("sample_id")
    tracks = samples(spark, sf_dir).select("source", "sample_id", (F.col("label") == "click").alias("candidate"), (i % 17 == 0).alias("platform"), F.coalesce(F.col("score") > 400, F.lit(False)).alias("evidence"))
    return jobs.limited(tracks, "source", "sample_id", 20)


@query(f"""WITH s AS ({S}), w AS (SELECT source, floor(t / 604800)::BIGINT AS bucket, t AS "start", sample_id, sample_id % 13 AS ident, sample_id % 7 AS overlay, sample_id % 5 AS corner, score FROM s),
a AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY ident DESC, score DESC NULLS LAST, "start") AS a FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY overlay DESC, corner DESC, score DESC NULLS LAST, "start") AS b FROM a WHERE a > 1),
c AS (SELECT *, 2 + row_number() OVER (PARTITION BY source, bucket ORDER BY score DESC NULLS LAST, "start") AS c FROM b WHERE b > 1)
SELECT source, bucket, sample_id, 1 AS place FROM a WHERE a = 1 UNION ALL SELECT source, bucket, sample_id, 2 FROM b WHERE b = 1 UNION ALL SELECT source, bucket, sample_id, c FROM c WHERE c <= 3""")
def frame_representatives(spark, sf_dir):
    i = F.col("sample_id")
    windows = samples(spark, sf_dir).select("source", F.floor(F.col("t") / 604800).cast("long").alias("bucket"), F.col("t").alias("start"), "sample_id", (i % 13).alias("ident_score"), (i % 7).alias("overlay_score"), (i % 5).alias("corner"), "score")
    return jobs.representatives(windows, ["source", "bucket"], 3).select("source", "bucket", "sample_id", F.col("place").cast("long").alias("place"))


@query("""WITH b AS (SELECT p_partkey % 53 AS image, p_partkey AS id, p_partkey % 97 AS x1, p_partkey % 89 AS y1, p_partkey % 97 + 5 + p_partkey % 31 AS x2, p_partkey % 89 + 5 + p_partkey % 17 AS y2, p_partkey % 6 = 0 AS named, p_size / 50.0::DOUBLE AS score, p_partkey % 8 = 0 AS focused FROM part),
r AS (SELECT s_suppkey % 53 AS image, s_suppkey % 97 AS c1, s_suppkey % 89 AS d1, s_suppkey % 97 + 20 AS c2, s_suppkey % 89 + 10 AS d2 FROM supplier), e AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, (x2 - x1) * (y2 - y1) / 10000.0::DOUBLE AS share FROM b),
p AS (SELECT e.*, c1, CASE WHEN c1 IS NOT NULL THEN greatest(0, least(x2, c2) - greatest(x1, c1)) * greatest(0, least(y2, d2) - greatest(y1, d1)) END AS common FROM e LEFT JOIN r USING (image) WHERE share BETWEEN 0.0001 AND 0.35),
g AS (SELECT image, id, named, score, focused, share, count(c1) AS n, coalesce(max(common / least(area, 200)), 0) AS overlap, coalesce(bool_or(common / (area + 200 - common) >= 0.75 AND area <= 240), false) AS repeats FROM p GROUP BY ALL),
q AS (SELECT * FROM g WHERE n = 0 OR overlap >= 0.5 OR focused QUALIFY row_number() OVER (PARTITION BY image ORDER BY overlap DESC, focused DESC, named DESC, score DESC, share, id) = 1) SELECT image, id, round(overlap, 6) AS overlap FROM q WHERE NOT repeats""")
def grounding_fallback(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    found = table(spark, sf_dir, "part").select(
        (k % 53).alias("image"), k.alias("id"), (k % 97).alias("x1"), (k % 89).alias("y1"), (k % 97 + 5 + k % 31).alias("x2"), (k % 89 + 5 + k % 17).alias("y2"), F.when(k % 6 == 0, "a Channel watermark").otherwise("logo").alias("label"), (F.col("p_size") / 50.0).alias("score"), F.lit(100).alias("width"), F.lit(100).alias("height"), (k % 8 == 0).alias("focused")
    )
    regions = table(spark, sf_dir, "supplier").select((s % 53).alias("image"), (s % 97).alias("x1"), (s % 89).alias("y1"), (s % 97 + 20).alias("x2"), (s % 89 + 10).alias("y2"))
    return jobs.grounding_fallback(found, regions, "image", 16).withColumn("overlap", F.round("overlap", 6))
