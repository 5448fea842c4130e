"""Edits, recovery and choices on small cases."""

import pytest

from spanloom.operators import jobs

CARD = "source int, card_id string, decision string, category string, policy string, start double, end double, detected array<struct<start: double, end: double>>, duration double, note string, reasons array<string>, region struct<width: int, height: int>"


def card(i, decision, start, end, detected=None, **over):
    return (1, f"review-{i}", decision, "gore", "discrete_detected_intervals" if detected is not None else None, start, end, detected or [], over.get("duration", 100.0), over.get("note"), over.get("reasons", ["r"]), over.get("region"))


def test_cuts_merge_where_they_touch(spark):
    rows = [card("a", "CUT", 0.0, 10.0), card("b", "CUT", 10.0, 12.0, note="n"), card("c", "CUT", 12.5, 14.0), card("d", "KEEP", 0.0, 50.0), card("e", "BLUR", -5.0, 200.0, region=(100, 60)), card("f", "CUT", 0.0, 99.0, [(11.0, 13.0), (90.0, 120.0)]), card("g", "BLUR", 1.0, 2.0)]
    got = {r.op_id: r for r in jobs.approved_operations(spark.createDataFrame(rows, CARD), "source", 5.0, 0.6).collect()}
    assert set(got) == {"op-a", "op-e", "op-f-02", "op-g"}
    assert (got["op-a"].start, got["op-a"].end, got["op-a"].card_ids, got["op-a"].reason) == (0.0, 14.0, ["review-a", "review-b", "review-f", "review-c"], "r; n; r; r")
    assert (got["op-f-02"].start, got["op-f-02"].end) == (90.0, 100.0)
    assert (got["op-e"].start, got["op-e"].end, got["op-e"].sigma, got["op-e"].feather) == (0.0, 100.0, 36, 2)
    assert (got["op-g"].sigma, got["op-g"].feather) == (28, 0)
    assert jobs.approved_operations(spark.createDataFrame([], CARD), "source", 5.0, 0.6).count() == 0


@pytest.mark.parametrize("row", [card("x", None, 0.0, 1.0), card("x", "NEEDS_MORE_CONTEXT", 0.0, 1.0), card("x", "CUT", 100.0, 101.0)])
def test_undecided_or_outside_is_an_error(spark, row):
    with pytest.raises(Exception, match="unresolved|outside"):
        jobs.approved_operations(spark.createDataFrame([row], CARD), "source", 5.0, 0.6).collect()


def test_a_box_without_regions_or_that_repeats_one(spark):
    found = spark.createDataFrame([(1, 1, 0, 0, 10, 10, "x", 0.5, 100, 100, False), (1, 2, 0, 0, 20, 20, "Brand logo", 0.5, 100, 100, False), (2, 3, 0, 0, 10, 10, None, 0.9, 100, 100, False), (3, 4, 50, 50, 60, 60, "x", 0.9, 100, 100, False), (3, 5, 50, 50, 70, 60, "x", 0.1, 100, 100, True), (4, 6, 0, 0, 90, 90, "x", 1.0, 100, 100, True)], "image int, id int, x1 int, y1 int, x2 int, y2 int, label string, score double, width int, height int, focused boolean")
    regions = spark.createDataFrame([(2, 0, 0, 10, 10), (3, 0, 0, 5, 5)], "image int, x1 int, y1 int, x2 int, y2 int")
    assert {(r.image, r.id, r.overlap) for r in jobs.grounding_fallback(found, regions, "image").collect()} == {(1, 2, 0.0), (3, 5, 0.0)}


def test_recovery_leaves_other_work_alone(spark):
    works = spark.createDataFrame([(1, "RENDERING", "a"), (2, "QUEUED", "a"), (3, "VERIFYING", None), (4, None, "a")], "job int, state string, current string")
    stages = spark.createDataFrame([(1, "a", "RUNNING"), (1, "b", "RUNNING"), (2, "a", "RUNNING"), (3, "a", "DONE")], "job int, stage string, state string")
    j, s = jobs.recovered(works, stages)
    assert {(r.job, r.state) for r in j.collect()} == {(1, "INTERRUPTED_RECOVERABLE"), (2, "QUEUED"), (3, "INTERRUPTED_RECOVERABLE"), (4, None)}
    assert {(r.job, r.stage, r.state) for r in s.collect()} == {(1, "a", "PENDING"), (1, "b", "RUNNING"), (2, "a", "RUNNING"), (3, "a", "DONE")}
