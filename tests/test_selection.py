"""Choices under a budget: cases with the values that they must give, beside the SQL of the catalog."""

import pytest

from spanloom.operators import boxes, selection

WINDOWS = "source string, window_id long, start double, score double, kind string, representative boolean, grp long"


def test_windows_under_a_budget(spark):
    rows = [("a", 1, 90.0, 0.1, "boundary", False, None), ("a", 2, 5.0, 0.2, "boundary", False, None)]
    rows += [("a", 10 + i, 10.0 * i, i / 10, "regional", False, None) for i in range(6)]
    rows += [("a", 20 + i, 10.0 * i, 0.9 - i / 10, "full", i == 4, None) for i in range(6)]
    rows += [("a", 30 + i, 10.0 * i, i / 10, "known", False, i // 3) for i in range(6)]
    rows += [("a", 40, 0.0, 9.0, None, True, 1), ("b", 1, 0.0, 1.0, "full", False, None), ("c", 1, 500.0, 1.0, "boundary", False, None)]
    df = spark.createDataFrame(rows, WINDOWS)

    def chosen(budget):
        got = {}
        for r in selection.selected_windows(df, "source", budget, 0.0, 60.0, 30.0).orderBy("source", "place").collect():
            got.setdefault(r.source, []).append(r.window_id)
        return got

    # one boundary window, by time
    assert chosen(1) == {"a": [2], "b": [1], "c": [1]}
    # both of them, two regional ones of either half, then by score
    assert chosen(7)["a"] == [2, 1, 12, 11, 15, 14, 13]
    # after all regional ones the representative, the best of each group of known ones, and full frames of either half
    assert chosen(13)["a"] == [2, 1, 12, 11, 10, 15, 14, 13, 24, 32, 35, 20, 23]
    assert sorted(chosen(99)["a"]) == sorted(r[1] for r in rows if r[0] == "a" and r[4])
    with pytest.raises(ValueError, match="positive"):
        chosen(0)
    assert selection.selected_windows(df.limit(0), "source", 3, 0.0, 60.0).count() == 0


def test_frames_at_equal_measure(spark):
    rows = [("gap", 0.0, 4.0), ("gap", 100.0, 104.0), ("gap", 3.0, 4.0), ("point", 7.5, 7.5), ("point", 9.0, 9.0), ("turned", 5.0, 4.0), ("long", 0.0, 100.0), ("steps", 10.0, 11.0)]
    df = spark.createDataFrame(rows, "k string, start double, end double")
    got = {}
    for r in selection.context_frames(df, "k").collect():
        got.setdefault(r.k, []).append(r.t)
    assert sorted(got["gap"]) == [0.5, 1.5, 2.5, 3.5, 100.5, 101.5, 102.5, 103.5]
    assert got["point"] == [7.5] and "turned" not in got
    assert sorted(got["long"]) == [3.125 + 6.25 * i for i in range(16)]
    snapped = sorted(r.t for r in selection.context_frames(df.where("k = 'steps'"), "k", 2.0).collect())
    assert snapped == [10.0, 10.5, 11.0]
    assert [r.t for r in selection.context_frames(spark.createDataFrame([("s", 10.1, 10.2)], "k string, start double, end double"), "k", 2.0).orderBy("t").collect()][0] == 10.106


def test_frames_read_what_is_covered_once(spark):
    df = spark.createDataFrame([("a", 0.0, 4.0), ("b", 2.0, 2.0)], "k string, start double, end double")
    out = selection.context_frames(df, "k")
    assert sorted(r.t for r in out.where("k = 'b'").collect()) == [2.0] and out.count() == 9
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [max(") == 1


def test_clips_between_keyframes(spark):
    keys = spark.createDataFrame([("f", float(t), t % 240 == 0) for t in range(0, 2000, 60)], "source string, t double, grid boolean")
    windows = spark.createDataFrame(
        [("f", 1, True, 20.0, 30.0), ("f", 2, True, 500.0, 510.0), ("f", 3, True, 560.0, 570.0), ("f", 4, False, 1000.0, 1010.0), ("f", 5, False, 1500.0, 1510.0), ("f", 6, True, 1990.0, 1999.0), ("g", 1, True, 5.0, 6.0)],
        "source string, segment_id long, scored boolean, start double, end double",
    )
    got = sorted((r.source, not r.scored, r.origin, r.end, r.segment_ids, r.on_grid) for r in selection.planned_clips(windows, keys, 2000.0).where("source = 'f'").collect())
    assert got == [
        ("f", False, 0.0, 120.0, [1], True), ("f", False, 240.0, 660.0, [2, 3], True), ("f", False, 1920.0, None, [6], True),
        ("f", True, 960.0, 1020.0, [4], True), ("f", True, 1440.0, 1560.0, [5], True),
    ]
    # off the grid: the second begins 120 seconds after the first, which is on it, and joins; a third after that is too far
    few = spark.createDataFrame([("f", 0.0, True), ("f", 60.0, False), ("f", 180.0, False), ("f", 240.0, False), ("f", 600.0, False)], "source string, t double, grid boolean")
    near = spark.createDataFrame([("f", 1, False, 10.0, 50.0), ("f", 2, False, 500.0, 501.0), ("f", 3, False, 700.0, 701.0)], "source string, segment_id long, scored boolean, start double, end double")
    got = sorted((r.origin, r.end, r.segment_ids) for r in selection.planned_clips(near, few, 2000.0).collect())
    assert got == [(0.0, None, [1, 2, 3])] or got[0][:2] == (0.0, 600.0)
    assert selection.planned_clips(windows.limit(0), keys, 9.0).count() == 0


def test_anchors_widen_a_box(spark):
    core = spark.createDataFrame([("a", 100.0, 100.0, 200.0, 130.0), ("b", 0.0, 0.0, 10.0, 10.0)], "k string, x1 double, y1 double, x2 double, y2 double")
    rows = [("a", 1, 0.0, 99.0, 10, (100.0, 135.0, 180.0, 155.0)), ("a", 2, 0.0, 99.0, 9, (90.0, 100.0, 180.0, 130.0)), ("a", 3, 0.0, 9.0, 99, (90.0, 100.0, 180.0, 130.0)), ("a", 4, 0.0, 99.0, 99, (110.0, 105.0, 150.0, 125.0)), ("a", 5, 0.0, 99.0, 99, (400.0, 100.0, 450.0, 130.0)), ("a", 6, 0.0, 99.0, 99, (100.0, 0.0, 180.0, 125.0))]
    members = spark.createDataFrame([(*r[:5], *r[5]) for r in rows], "k string, track_id long, start double, end double, observations long, x1 double, y1 double, x2 double, y2 double")
    got = {r.k: (r.x1, r.y1, r.x2, r.y2, r.n_anchors, r.n_joined) for r in boxes.with_anchors(members, core, "k", 50.0).collect()}
    assert got == {"a": (100.0, 100.0, 200.0, 155.0, 3, 1), "b": (0.0, 0.0, 10.0, 10.0, 0, 0)}
