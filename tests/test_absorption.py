"""Owners that absorb their supporters against a walk through all cards in order, and trimmed boxes by cases and all pairs."""

import random

import pytest

from spanloom.operators import absorption

ITEMS = "source string, item_id long, category string, candidate string, kind string, start double, end double, x1 double, y1 double, x2 double, y2 double, approved boolean, ocr boolean, classification string, suggestion string, decision string, dialogue boolean, absorbable boolean, labels array<string>, refs array<string>"
NAMES = [c.split()[0] for c in ITEMS.split(", ")]
BASE = {"source": "s", "category": "visual_logo", "candidate": None, "kind": None, "approved": None, "ocr": None, "classification": None, "suggestion": None, "decision": None, "dialogue": None, "absorbable": None, "labels": None, "refs": None}


def card(i, start, end, box, **changes):
    box = box or (None,) * 4
    return BASE | {"item_id": i, "start": float(start), "end": float(end), **{n: None if v is None else float(v) for n, v in zip(("x1", "y1", "x2", "y2"), box, strict=True)}} | changes


def frame(spark, cards):
    return spark.createDataFrame([tuple(c[n] for n in NAMES) for c in cards], ITEMS)


def common(a, b):
    return max(0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"])) * max(0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))


def area(a):
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def over(a, b):
    return common(a, b) / max(1, min(area(a), area(b)))


def walk(cards, duration):
    """What each owner takes when all cards are looked at one after the other."""
    gone, out = set(), set()
    cards = sorted(cards, key=lambda c: c["item_id"])
    persistent = [c for c in cards if c["candidate"] == "persistent_overlay" and c["x1"] is not None and c["category"] in ("visual_logo", "text")]
    for o in sorted(persistent, key=lambda c: 2 if c["category"] == "text" else 0 if c["approved"] else 1):
        if o["item_id"] in gone:
            continue
        start, end, track = o["start"], o["end"], None
        others = [c for c in cards if c is not o and c["source"] == o["source"] and c["x1"] is not None and c["item_id"] not in gone]
        for c in others:
            if o["category"] == "visual_logo" and c["category"] == "text" and c["candidate"] == "persistent_overlay" and over(o, c) >= (0.6 if o["approved"] else 0.75) and c["start"] < end and c["end"] > start:
                track, start, end = c, max(0.0, min(start, c["start"])), min(duration, max(end, c["end"]))
                gone.add(c["item_id"])
                out.add((o["item_id"], c["item_id"], "track"))
                break
        for c in others:
            enough = over(o, c) >= (0.6 if c["classification"] in absorption.BRANDS else 0.8)
            inside = track is not None and over(o, c) >= 0.6 and c["suggestion"] == "BLUR" and area(c) > 0 and common(c, track) / area(c) >= 0.8
            refused = (
                c["item_id"] in gone or c["category"] not in ("visual_logo", "text") or c["candidate"] in absorption.OWN_CARDS or c["kind"] == "title_overlay"
                or (c["approved"] and not o["approved"] and common(c, o) / area(c) < 0.95) or (o["dialogue"] and not c["absorbable"]) or (c["decision"] is not None and c["decision"] != o["decision"])
            )
            if not refused and (enough or inside) and c["start"] >= start and c["end"] <= end:
                gone.add(c["item_id"])
                out.add((o["item_id"], c["item_id"], "card"))
    return out


def crowd(rng, n):
    out = []
    for i in range(n):
        x, y = rng.choice([0, 8, 300]) + rng.randrange(25), rng.choice([0, 200]) + rng.randrange(12)
        persistent = rng.random() < 0.4
        start = rng.randrange(100)
        end = start + rng.randrange(60, 200) if persistent else start + rng.randrange(1, 60)
        box = (x, y, x + rng.randrange(60, 110), y + rng.randrange(30, 60)) if rng.random() < 0.95 else None
        out.append(card(i, start, end, box, source=rng.choice("st"), category=rng.choice(["visual_logo", "text", "text", "adult"]), candidate="persistent_overlay" if persistent else rng.choice([None, "subtitle", "logo"]), kind=rng.choice([None, None, "title_overlay"]), approved=rng.random() < 0.2, classification=rng.choice([None, "external_brand"]), suggestion=rng.choice([None, "BLUR", "KEEP"]), decision=rng.choice([None, None, None, "BLUR"]), dialogue=rng.random() < 0.1, absorbable=rng.random() < 0.5))
    return out


@pytest.mark.parametrize("n", [60, 150])
def test_absorption_against_a_walk_in_order(spark, n):
    cards = crowd(random.Random(n), n)
    want = walk(cards, 180.0)
    got = {(r.owner, r.item_id, r.role) for r in absorption.absorbed(frame(spark, cards), 180.0).collect()}
    assert got == want and len(want) > n / 5 and len({r for _, _, r in want}) == 2


def test_what_stays(spark):
    cards = [
        card(1, 10, 50, (0, 0, 100, 50), candidate="persistent_overlay", labels=["logo"], refs=["a"]),
        card(2, 5, 90, (0, 0, 110, 55), category="text", candidate="persistent_overlay", labels=["text", "logo"], refs=["b"]),
        card(3, 60, 70, (5, 5, 95, 45), labels=["more"], refs=None),
        card(4, 95, 99, (5, 5, 95, 45), labels=["later"]),
        card(5, 20, 30, None),
    ]
    got = {r.item_id: r for r in absorption.reconciled(frame(spark, cards), 85.0).collect()}
    assert set(got) == {1, 4, 5}
    assert (got[1].start, got[1].end, got[1].suggestion, got[1].labels, got[1].refs, got[1].n_absorbed) == (5.0, 85.0, "BLUR", ["logo", "text", "more"], ["a", "b"], 2)
    assert (got[4].labels, got[4].n_absorbed, got[4].suggestion) == (["later"], 0, None) and got[5].n_absorbed == 0
    assert absorption.reconciled(frame(spark, []), 9.0).count() == 0


OWNER = {"candidate": "persistent_overlay"}
READ = {"ocr": True}
# name, cards, then (method, support, box) of the first card or None
TRIMS = [
    ("two tight reads", [card(1, 0, 100, (0, 0, 100, 50), **OWNER), card(2, 10, 12, (10, 10, 70, 50), **READ), card(3, 20, 22, (10, 12, 72, 50), **READ)], ("repeated_tight_ocr_support", 2, (10, 10, 72, 50))),
    ("one read", [card(1, 0, 100, (0, 0, 100, 50), **OWNER), card(2, 10, 12, (10, 10, 70, 50), **READ)], None),
    ("another time", [card(1, 0, 100, (0, 0, 100, 50), **OWNER), card(2, 10, 12, (10, 10, 70, 50), **READ), card(3, 100, 102, (10, 12, 72, 50), **READ)], None),
    ("not by text", [card(1, 0, 100, (0, 0, 100, 50), **OWNER), card(2, 10, 12, (10, 10, 70, 50), **READ), card(3, 20, 22, (10, 12, 72, 50))], None),
    ("approved", [card(1, 0, 100, (0, 0, 100, 50), **OWNER, approved=True), card(2, 10, 12, (10, 10, 70, 50), **READ), card(3, 20, 22, (10, 12, 72, 50), **READ)], None),
    ("a title", [card(1, 0, 100, (0, 0, 100, 50), **OWNER), card(2, 10, 12, (10, 10, 70, 50), **READ), card(3, 20, 22, (10, 12, 72, 50), **READ, kind="title_overlay")], None),
    ("a word in an emblem", [card(1, 0, 100, (0, 0, 100, 60), **OWNER), card(2, 10, 12, (20, 20, 60, 40), **READ), card(3, 20, 22, (20, 20, 62, 40), **READ)], ("grounding_box_padding_trim", 2, (3, 3, 97, 57))),
    ("a text", [card(1, 0, 100, (0, 0, 100, 60), category="text", **OWNER), card(2, 10, 12, (20, 20, 60, 40), **READ), card(3, 20, 22, (20, 20, 62, 40), **READ)], ("repeated_visual_ocr_consensus", 2, (20, 20, 62, 40))),
    ("apart", [card(1, 0, 100, (0, 0, 200, 60), **OWNER), card(2, 10, 12, (0, 20, 60, 40), **READ), card(3, 20, 22, (120, 20, 190, 40), **READ)], None),
    ("a piece of a line", [card(1, 0, 100, (0, 0, 100, 24), **OWNER)] + [card(k, k, k + 1, (50, 2, 96, 22), **READ) for k in (2, 3)] + [card(k, k, k + 1, (2, 2, 98, 23), **READ) for k in (4, 5)], ("repeated_full_mark_ocr_support", 2, (2, 2, 98, 23))),
    ("too small to trim", [card(1, 0, 100, (0, 0, 30, 4), **OWNER), card(2, 10, 12, (2, 1, 8, 3), **READ), card(3, 20, 22, (2, 1, 8, 3), **READ)], None),
]


def test_trimmed_boxes(spark):
    cards = [c | {"source": name} for name, rows, _ in TRIMS for c in rows]
    got = {r.source: (r.method, r.support, tuple(r[s] for s in ("x1", "y1", "x2", "y2"))) for r in absorption.refined_regions(frame(spark, cards)).where("item_id = 1").collect()}
    assert got == {name: want for name, _, want in TRIMS if want}
    assert absorption.refined_regions(frame(spark, [])).count() == 0


def test_cards_in_tiles_are_not_broadcast(spark, tmp_path):
    """The size of a small file says little about its rows in tiles, which a driver can't hold."""
    frame(spark, crowd(random.Random(5), 40)).write.parquet(f"{tmp_path}/cards")
    cards = spark.read.parquet(f"{tmp_path}/cards")
    _, may = absorption.claims(cards, 128)
    plan = may._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert "labels" not in plan and "refs" not in plan
