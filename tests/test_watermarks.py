"""Marks at one place against brute force, and fuzzy joins against the comparison of all pairs."""

import random
import statistics
from difflib import SequenceMatcher

import pytest

from spanloom.operators import fuzzy, watermarks

TRACKS = "source string, track_id long, start double, end double, blur_end double, x1 double, y1 double, x2 double, y2 double, texts array<string>, routing string, candidate string, fixed boolean, observations long, confidence double, ad_probability double, policy_hits array<string>, persistent boolean"


def test_running_median():
    rng = random.Random(1)
    for spread in (3, 1000):
        middle, seen = watermarks.Middle(), []
        for _ in range(300):
            v = rng.randrange(spread)
            middle.add(v)
            seen.append(v)
            assert middle.median() == statistics.median(seen)


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    changed = [w[:k] + rng.choice(["", "x", "yz"]) + w[k + rng.randrange(2) :] for w in base for k in [rng.randrange(len(w) + 1)]]
    words = {("s", w) for w in base + changed if w} | {("t", w) for w in base[:9]}
    for least in (0.75, 0.9):
        want = {(s, a, b) for s, a in words for t, b in words if s == t and a != b and (a in b or b in a or SequenceMatcher(None, a, b, autojunk=False).ratio() >= least)}
        got = [tuple(r) for r in fuzzy.similar(spark.createDataFrame([*words, ("s", None), ("s", "")], "source string, word string"), "source", least).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError, match="two thirds"):
        fuzzy.similar(spark.createDataFrame([], "source string, word string"), "source", 0.6)


def sighting(i, start, box, texts, source="s", **changes):
    row = {"source": source, "track_id": i, "start": start, "end": start + 4, "blur_end": start + 4.5, **dict(zip(("x1", "y1", "x2", "y2"), map(float, box), strict=True)), "texts": texts, "routing": "LIKELY_SCENE_TEXT", "candidate": None, "fixed": None, "observations": 2, "confidence": 0.5, "ad_probability": 0.1, "policy_hits": None, "persistent": False}
    return tuple((row | changes)[c.split()[0]] for c in TRACKS.split(", "))


def test_groups_follow_the_first_that_accepts(spark):
    """Each sighting against all groups before it, whose medians are computed anew."""
    rng = random.Random(3)
    names = ["phimmoi", "phimm0i", "motphim", "bongda", "xemphim"]
    rows = []
    for i in range(160):
        x, y = rng.choice([0, 30, 300]) + rng.randrange(-9, 10), rng.randrange(-6, 7)
        rows.append(sighting(i, float(rng.randrange(300)), (x + 10, y + 10, x + 110 + rng.randrange(40), y + 40), [f"{rng.choice(names)}.{rng.choice(['net', 'com'])}" for _ in range(rng.randrange(1, 3))], source=rng.choice("st")))
    seen = watermarks.sightings(spark.createDataFrame(rows, TRACKS), spark.createDataFrame([], "key string")).cache()
    got = {(r.source, r.track_id): r.mark for r in watermarks.marked(seen).collect()}
    groups = []
    for r in sorted(seen.collect(), key=lambda r: (r.start, r.track_id)):
        box = (r.x1, r.y1, r.x2, r.y2)
        fits = [
            g for g in groups
            if g["source"] == r.source and watermarks.covers(box, tuple(map(statistics.median, zip(*g["boxes"], strict=True)))) >= 0.5
            and any(k in o or o in k or SequenceMatcher(None, k, o).ratio() >= 0.75 for k in r["keys"] for o in g["keys"])
        ]
        group = fits[0] if fits else {"source": r.source, "mark": r.track_id, "boxes": [], "keys": set()}
        if not fits:
            groups.append(group)
        group["boxes"].append(box)
        group["keys"].update(r["keys"])
        assert got[r.source, r.track_id] == group["mark"]
    assert 5 < len(groups) < 100 and len(got) == len(rows)


def test_what_a_mark_shows(spark):
    often = [sighting(i, 20.0 * i + 30, (100 + (40 if i == 5 else i % 3), 10, 200 + (90 if i == 7 else 0), 40), ["PHIMMOI.NET", f"read {i}"], source="often", observations=None if i == 1 else 2, confidence=i / 100, routing="" if i % 2 else None) for i in range(12)]
    twice = [sighting(1, 10.0, (0, 0, 50, 20), ["phimmoi.net"], "twice"), sighting(2, 11.0, (0, 0, 50, 22), ["PHIMM0I.NET"], "twice", persistent=True), sighting(3, 90.0, (2, 1, 50, 20), ["phimmoi.net"], "twice", blur_end=None)]
    alone = [sighting(1, 5.0, (0, 0, 50, 20), ["phimmoi.net"], "alone"), sighting(2, 9.0, (300, 0, 350, 20), ["phimmoi.net"], "alone"), sighting(3, 9.0, (0, 0, 50, 20), ["bongda.com"], "alone"), sighting(4, 9.0, (0, 0, 50, 20), ["no address"], "alone"), sighting(5, 9.0, (0, 0, 50, 20), None, "alone"), sighting(6, 9.0, (0, 0, 50, 20), ["phimmoi.net"], "alone", fixed=True), sighting(7, 9.0, (0, 0, 50, 20), ["phimmoi.net"], "alone", candidate="title_overlay"), sighting(8, 9.0, (50, 0, 50, 20), ["phimmoi.net"], "alone")]
    known = [sighting(1, 5.0, (0, 0, 50, 20), ["my film page"], "known"), sighting(2, 50.0, (0, 0, 50, 20), ["See My-Film Page"], "known")]
    memory = spark.createDataFrame([("filmpage",)], "key string")
    found = watermarks.repeated_marks(spark.createDataFrame(often + twice + alone + known, TRACKS), memory, 3.0, 0.0, 300.0)
    got = {r.source: r for r in found.collect()}
    assert set(got) == {"often", "twice", "known"}
    r = got["often"]
    # twelve readings: one moment, to both ends of the scan, the odd edges of two readings left out
    assert [tuple(m) for m in r.moments] == [(0.0, 300.0)] and (r.start, r.blur_end, r.end) == (0.0, 300.0, 254.0)
    assert (r.x1, r.y1, r.x2, r.y2) == (100.0, 10.0, 200.0, 40.0) and (r.read_start, r.read_end) == (27.0, 254.5)
    assert (r.track_id, r.sightings, r.observations, r.confidence, r.grouped_track_ids) == (0, 12, 22, 0.11, list(range(12)))
    assert r.texts == ["PHIMMOI.NET", *[f"read {i}" for i in range(7)]] and r.tokens == ["PHIMMOI.NET"] and r.previous_routings == [""]
    r = got["twice"]
    assert [tuple(m) for m in r.moments] == [(7.0, 15.5), (87.0, 94.0)] and (r.x1, r.y1, r.x2, r.y2) == (0.0, 0.0, 50.0, 22.0)
    assert r.persistent and r.tokens == ["phimmoi.net", "PHIMM0I.NET"] and r.policy_hits == [] and r.remembered == []
    assert got["known"].remembered == ["filmpage"] and got["known"].tokens == []
    assert watermarks.repeated_marks(found.sparkSession.createDataFrame([], TRACKS), memory, 3.0).count() == 0
