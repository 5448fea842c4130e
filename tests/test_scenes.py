"""Scene cards and event groups: a walk over all items, and cards with the values that they must have."""

import random

import pytest

from spanloom.operators import scenes

ITEMS = "source string, item_id long, category string, start double, end double, score double, priority string, suggestion string, decision string, policy string, detected array<struct<start: double, end: double>>, labels array<string>, refs array<string>"


def item(i, category, start, end, suggestion=None, decision=None, source="s", score=None, priority="normal", policy=None, detected=None, labels=None):
    return (source, i, category, float(start), float(end), score, priority, suggestion, decision, policy, detected, labels, None)


def test_cards_against_a_walk(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        start = round(rng.uniform(0, 1500), 2)
        rows.append(item(i, rng.choice(["adult", "gore", "violence", "text"]), start, round(start + rng.uniform(0.1, 12), 2), rng.choice([None, None, None, "CUT", "BLUR"]), "KEEP" if rng.random() < 0.05 else None, rng.choice("ab")))
    want, open_ = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[1])):
        source, i, category, start, end, _, _, said, decision, *_ = r
        members = open_.get((source, category))
        joins = False
        if members and category != "text" and decision is None and all(m[8] is None for m in members):
            low, high = members[0][3], max(m[4] for m in members)
            if category == "adult":
                near, heard = start - high <= 6 and end - low <= 30, {members[0][7]}
            else:
                near, heard = start - high < 20 and max(high, end) - low <= 300, {m[7] for m in members}
            joins = near and (said is None or heard - {None} <= {said})
        if joins:
            members.append(r)
        else:
            open_[source, category] = [r]
        want[source, i] = open_[source, category][0][1]
    got = scenes.safety_cards(spark.createDataFrame(rows, ITEMS)).collect()
    sizes = {}
    for (source, _), card in want.items():
        sizes[source, card] = sizes.get((source, card), 0) + 1
    assert {(r.source, r.card_id): r.n_members for r in got} == sizes and max(sizes.values()) > 3


def test_what_cards_hold(spark):
    both = [(5.0, 6.0), (9.0, 9.5)]
    rows = [
        item(1, "gore", 0, 10, "CUT", source="scene", score=0.5, labels=["a"], policy=scenes.DISCRETE, detected=both),
        item(2, "gore", 9.4, 12, "CUT", source="scene", score=0.9, priority="high", labels=["b", "a"]),
        item(3, "gore", 31.9, 33, "CUT", source="scene"),
        item(4, "gore", 53, 54, source="scene"),  # twenty seconds after is too late
        item(1, "violence", 0, 1, "CUT", source="mixed"), item(2, "violence", 2, 3, source="mixed"), item(3, "violence", 4, 5, "BLUR", source="mixed"),
        item(1, "adult", 0, 1, "BLUR", source="events"), item(2, "adult", 7, 8, source="events", detected=both), item(3, "adult", 13, 14, "CUT", source="events"), item(4, "adult", 14.5, 15, "CUT", source="events"), item(5, "adult", 15.1, 45, source="events"),
        item(1, "text", 0, 1, source="other"), item(2, "text", 1, 2, source="other"), item(3, "gore", 0, 1, decision="KEEP", source="other"), item(4, "gore", 1, 2, source="other", policy="p"),
    ]
    got = {(r.source, r.card_id): r for r in scenes.safety_cards(spark.createDataFrame(rows, ITEMS)).collect()}
    members = {k: r.n_members for k, r in got.items()}
    assert members == {("scene", 1): 3, ("scene", 4): 1, ("mixed", 1): 2, ("mixed", 3): 1, ("events", 1): 2, ("events", 3): 2, ("events", 5): 1, ("other", 1): 1, ("other", 2): 1, ("other", 3): 1, ("other", 4): 1}
    r = got["scene", 1]
    assert [tuple(m) for m in r.moments] == [(5.0, 6.0), (9.0, 12.0), (31.9, 33.0)] and r.detected_seconds == pytest.approx(5.1)
    assert (r.start, r.end, r.max_score, r.priority, r.suggestion, r.labels, r.candidate, r.policy, r.scene) == (0.0, 33.0, 0.9, "high", "CUT", ["a", "b"], "review_event_group", scenes.DISCRETE, True)
    assert got["mixed", 1].suggestion is None and got["mixed", 3].suggestion == "BLUR"
    r = got["events", 1]
    # an event group suggests what its first member does; that one named no moments
    assert r.suggestion == "BLUR" and [tuple(m) for m in r.moments] == both and not r.scene
    assert (got["other", 4].policy, got["other", 4].candidate, got["other", 3].decision) == ("p", None, "KEEP")
    assert scenes.safety_cards(spark.createDataFrame([], ITEMS)).count() == 0
