from spanloom.operators import intervals

HITS = "source long, t double, score double, label string"
SPANS = "source long, start double, end double"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_hits_group_within_the_gap(spark):
    hits = spark.createDataFrame([(1, 0.5, 0.8, "a"), (1, 1.5, 0.9, "b"), (1, 8.0, 0.7, "c"), (1, None, 1.0, "d")], HITS)
    out = intervals.sessionize(hits, "source", "t", "score", "label", gap=2.0, padding=1.0)
    assert rows(out, "start", "end", "max_score", "evidence", "sample_count") == [(0.0, 2.5, 0.9, "b", 2), (7.0, 9.0, 0.7, "c", 1)]


def test_sessions_cross_buckets_and_equal_gaps_merge(spark):
    hits = spark.createDataFrame([(1, float(t), 1.0, str(t)) for t in range(0, 100, 2)], HITS)
    out = intervals.sessionize(hits, "source", "t", "score", "label", gap=2.0, padding=0.0, bucket=7.0)
    assert rows(out, "start", "end", "evidence", "sample_count") == [(0.0, 98.0, "0", 50)]


def test_merge_takes_the_last_end(spark):
    spans = spark.createDataFrame([(1, 0.0, 10.0), (1, 2.0, 5.0), (1, 5.5, 6.0)], SPANS)
    assert rows(intervals.merge_in_order(spans, "source", 1.0), "start", "end", "n_members") == [(0.0, 6.0, 3)]


def test_union_and_coverage(spark):
    spans = spark.createDataFrame([(1, 0.0, 10.0), (1, 5.0, 15.0), (1, 20.0, 25.0), (1, 30.0, 30.0)], SPANS)
    assert rows(intervals.union_length(spans, "source"), "union_seconds", "n_islands") == [(20.0, 2)]
    spans = spark.createDataFrame([(1, -5.0, 4.0), (1, 8.0, 30.0)], SPANS)
    targets = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 1.0)], "source long, t_start double, t_end double")
    assert rows(intervals.covered(targets, spans, "source", 3.0), "source", "covered") == [(1, 0.6), (2, 0.0)]


def test_complement_within_bounds(spark):
    spans = spark.createDataFrame([(1, 2.0, 3.0, 0.0, 10.0), (1, 3.0, 5.0, 0.0, 10.0), (1, 8.0, 12.0, 0.0, 10.0)], SPANS + ", low double, high double")
    assert rows(intervals.complement(spans, "source", "low", "high"), "start", "end") == [(0.0, 2.0), (5.0, 8.0)]


def test_overlap_join_finds_each_pair_once(spark):
    left = spark.createDataFrame([(1, 0.0, 100.0), (1, 200.0, 210.0)], SPANS)
    right = spark.createDataFrame([(1, 50.0, 205.0), (1, 100.0, 120.0), (2, 0.0, 300.0)], SPANS)
    out = intervals.overlap_join(left, right, "source", 10.0)
    assert rows(out, "l_start", "r_start") == [(0.0, 50.0), (200.0, 50.0)]


def test_as_of_both_ways(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 0.5), (2, 1.0)], "source long, t double")
    right = spark.createDataFrame([(1, 1.0), (1, 5.0), (1, 9.0)], "source long, t double")
    assert rows(intervals.asof(left, right, "source", "t").fillna(-1), "source", "t", "nearest") == [(1, 0.5, -1.0), (1, 5.0, 5.0), (2, 1.0, -1.0)]
    assert rows(intervals.asof(left, right, "source", "t", forward=True).fillna(-1), "source", "t", "nearest") == [(1, 0.5, 1.0), (1, 5.0, 5.0), (2, 1.0, -1.0)]


def test_containment_and_confirmation(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 10.0), (2, 1, 2.0, 3.0), (3, 1, 0.0, 10.0), (4, 2, 2.0, 3.0)], "id long, source long, start double, end double")
    assert rows(intervals.not_contained(spans, "source", "id", 4.0), "id") == [(1,), (4,)]
    hits = spark.createDataFrame([(1, f) for f in (1, 2, 3, 10)], "source long, frame long")
    assert rows(intervals.confirm(hits, "source", "frame", 3, 3), "frame") == [(1,), (2,), (3,)]
