"""Scrolling lines: alignment, contests and whole crossings with the values that they must give."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph, scrolling
from spanloom.operators.scrolling import Scan, line_up

SCHEMA = "source string, track_id long, start double, end double, blur_end double, x1 double, y1 double, x2 double, y2 double, texts array<string>, routing string, candidate string, grouped boolean, observations long, ad_probability double, policy_hits array<string>"
SCAN = Scan(960, 540, 3.0)
LINE = "watch new films every day on our free site without any waiting at all"


def track(i, start, end, texts, box, routing="LIKELY_SCENE_TEXT", candidate=None, grouped=None, source="s", n=1, ad=0.1, hits=None):
    return (source, i, float(start), float(end), end + 0.5, *map(float, box), texts, routing, candidate, grouped, n, ad, hits)


def crossing(t, first, top=30, source="s", line=LINE):
    """A line that enters at the right, fills the band and leaves at the left."""
    return [
        track(first, t, t + 3, [line[:20]], (600, top, 960, top + 40), source=source, ad=0.2),
        track(first + 1, t + 3, t + 9, [line[:48], line[14:60]], (0, top - 4, 960, top + 44), source=source, n=2, ad=0.6, hits=["free"]),
        track(first + 2, t + 9, t + 12, [line[44:]], (0, top, 300, top + 40), source=source),
    ]


@pytest.mark.parametrize(
    ("a", "b", "related", "moved"),
    [
        ("watchnewfilms", "watchnewfilms", True, False),
        ("watchnewfilmseveryday", "filmseverydayonoursite", True, True),
        ("filmseverydayonoursite", "watchnewfilmseveryday", True, True),
        ("studio", "estudiodedoblaje", True, False),
        ("watchnewfilmseveryday", "wztchnewfi1mseverydoy", True, False),
        ("watch", "watch", False, False),
        ("watchnewfilms", "somethingelse", False, False),
        ("abcwatchdef", "xyzwatchuvw", False, False),
        ("onefilmtwofilm", "film", False, False),
    ],
)
def test_alignment(a, b, related, moved):
    assert line_up(a, b) == (related, moved)


def without(i, *rows):
    return [r for r in rows if r[1] != i]


STILL, PIECE = (0, 30, 960, 70), (300, 32, 420, 68)
ODD = [track(20, 106, 109, ["hello there friend"], (602, 186, 673, 235)), track(21, 300, 301, None, (0, 30, 10, 60)), ("s", 22, *[None] * 14)]
SCENES = {
    "crossing": crossing(100, 1) + ODD,
    "nearly left": without(3, *crossing(100, 1)) + [track(3, 109, 112, [LINE[44:]], (0, 30, 200, 70))],
    "moved on": [track(1, 50, 53, [LINE[:40]], STILL), track(2, 53, 56, [LINE[12:52]], STILL)],
    "only grew": [track(1, 50, 53, [LINE[:40]], STILL), track(2, 53, 56, [LINE[:46]], STILL)],
    "narrow": [track(1, 50, 53, [LINE[:40]], (0, 30, 400, 70)), track(2, 53, 56, [LINE[12:52]], (0, 30, 400, 70))],
    "rightwards": [track(1, 50, 53, [LINE[44:]], (0, 480, 300, 520)), track(2, 53, 59, [LINE[20:], LINE[:48]], (0, 480, 960, 520)), track(3, 59, 62, [LINE[:20]], (700, 480, 960, 520))],
    "title": without(2, *crossing(100, 1)) + [track(2, 103, 109, [LINE[:48], LINE[14:60]], (0, 26, 960, 74), routing="LIKELY_TITLE_OVERLAY")],
    "overlay": without(2, *crossing(100, 1)) + [track(2, 103, 109, [LINE[:48], LINE[14:60]], (0, 26, 960, 74), candidate="persistent_overlay")],
    "grouped": without(2, *crossing(100, 1)) + [track(2, 103, 109, [LINE[:48], LINE[14:60]], (0, 26, 960, 74), grouped=True)],
    "long": [track(1, 0, 46, [LINE[:40]], (600, 30, 960, 70)), track(2, 46, 92, [LINE[:40]], (0, 30, 300, 70))],
    "middle": crossing(100, 1, top=250),
    "eight letters": [track(1, 10, 13, ["free site"], (600, 30, 960, 70)), track(2, 13, 16, ["free site"], (0, 30, 300, 70))],
    "halves": crossing(100, 1) + crossing(109, 11, line="a quite different sentence about the weather in the mountains today") + crossing(200, 31),
    "absorbing": crossing(100, 1)
    + [
        track(4, 104, 106, ["xx"], PIECE),  # goes along, though its reading is short
        track(5, 104, 106, [None], (300, 32, 420, 40)),  # too low
        track(6, 104, 106, ["spoken words here"], PIECE, routing="LIKELY_SUBTITLE"),
        track(7, 104, 140, ["stays for longer"], PIECE),
        track(8, 104, 106, ["below it"], (300, 90, 420, 120)),
    ],
}


@pytest.fixture(scope="module")
def told(spark):
    rows = [(name, *r[1:]) for name, scene in SCENES.items() for r in scene]
    df = spark.createDataFrame(rows, SCHEMA)
    found = scrolling.scrolling_lines(df, SCAN).cache()
    out = {}
    for r in found.collect():
        out.setdefault(r.source, []).append(r)
    return out, [tuple(r) for r in scrolling.regrouped(df, found).where("source = 'absorbing'").select("track_id", "routing", "suggestion").collect()]


def test_a_crossing_is_one_line(told):
    (r,) = told[0]["crossing"]
    assert (r.grouped_track_ids, r.track_id, r.side, r.direction) == ([1, 2, 3], 2, "top", "right_to_left")
    assert (r.start, r.end, r.blur_end, r.first_read, r.last_read) == (97.0, 115.0, 115.5, 100.0, 109.0)
    assert (r.lead, r.tail, r.x1, r.y1, r.x2, r.y2) == (3.0, 6.0, 0.0, 26.0, 960.0, 74.0)
    assert (r.observations, r.ad_probability, r.policy_hits) == (4, 0.6, ["free"])
    assert r.texts == [LINE[:20], LINE[:48], LINE[14:60], LINE[44:]]


def test_lead_and_tail_by_what_was_seen(told):
    (r,) = told[0]["nearly left"]
    assert r.tail == 3.0
    (r,) = told[0]["moved on"]
    assert (r.direction, r.lead, r.tail, r.start) == (None, 6.0, 6.0, 44.0)
    (r,) = told[0]["rightwards"]
    assert (r.side, r.direction, r.lead, r.tail) == ("bottom", "left_to_right", 3.0, 3.0)


def test_what_is_fixed_long_short_or_elsewhere_is_no_line(spark, told):
    assert set(told[0]) == {"crossing", "nearly left", "moved on", "rightwards", "halves", "absorbing"}
    assert scrolling.scrolling_lines(spark.createDataFrame([], SCHEMA), SCAN).collect() == []


def test_halves_that_meet_are_one_and_others_apart(told):
    assert sorted(sorted(r.grouped_track_ids) for r in told[0]["halves"]) == [[1, 2, 3, 11, 12, 13], [31, 32, 33]]


def test_pieces_in_the_band_go_with_the_line(told):
    (r,) = told[0]["absorbing"]
    assert r.grouped_track_ids == [1, 2, 4, 3]
    assert sorted(told[1]) == [(2, "REVIEW_SCROLLING_TEXT", "BLUR"), (5, "LIKELY_SCENE_TEXT", None), (6, "LIKELY_SUBTITLE", None), (7, "LIKELY_SCENE_TEXT", None), (8, "LIKELY_SCENE_TEXT", None)]


def test_the_earlier_crossing_has_contested_pieces(spark):
    """A wide line absorbs all pieces of a thin one inside its band that doesn't meet it by half of its height."""
    own = spark.createDataFrame([("s", "top", i, (float(t), float(t + 2), y1, y2, "x")) for i, t, y1, y2 in ((1, 10, 0.0, 40.0), (2, 12, 0.0, 40.0), (3, 11, 10.0, 40.0), (4, 14, 10.0, 40.0), (5, 15, 10.0, 40.0))], "source string, side string, track_id long, p struct<start: double, end: double, y1: double, y2: double, routing: string>")
    runs = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2), (4, 2), (5, 3)], "track_id long, run long").distinct()
    got = scrolling.absorbed(own.join(runs, "track_id"), own, Scan(960, 540, 1.0)).select("run", "track_id").collect()
    # run 1 takes piece 3, so run 2 is none; piece 4 is out of run 1's time and goes to run 3
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (1, 3), (3, 4), (3, 5)]


def test_contests_against_the_order(spark):
    rng = random.Random(5)
    for n, m in ((12, 15), (60, 90)):
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        down = set()
        for b in range(n):
            if any(y == b and x not in down for x, y in edges):
                down.add(b)
        got = [r.id for r in graph.fallen(spark.createDataFrame(sorted(edges), "a long, b long")).collect()]
        assert sorted(got) == sorted(down)
    assert graph.fallen(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        graph.fallen(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"), rounds=2)


def test_components_of_structs(spark):
    edges = spark.createDataFrame([(("a", 1), ("a", 2)), (("a", 2), ("a", 5)), (("b", 1), ("b", 2))], "a struct<s: string, i: long>, b struct<s: string, i: long>")
    got = {tuple(r.id): tuple(r.component) for r in graph.connected(edges).collect()}
    assert got == {("a", 1): ("a", 1), ("a", 2): ("a", 1), ("a", 5): ("a", 1), ("b", 1): ("b", 1), ("b", 2): ("b", 1)}


def test_query_finds_the_lines_it_was_given(spark):
    from spanloom.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    got = QUERIES["scrolling_lines"](spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    long = turns.where(F.length(F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")) > 60).where("turn % 5 <> 4")
    assert got.select("source", "line").distinct().count() >= 0.9 * long.count()


def test_components_that_moved_are_mostly_told_by_readings_that_follow_each_other(spark, monkeypatch):
    """One moved between readings that aren't neighbours, one only stands still; the rest isn't compared whole."""
    line = "watchnewfilmseverydayonourfreesitewithoutanywaitingatall"
    other = "aquitedifferentsentenceabouttheweather"
    told = {1: [line[:36], line[12:48], line[20:]], 2: [line[:36], other, line[12:48]], 3: [line[:36]] * 3, 4: [line[:17], line[8:25]]}
    rows = [("s", "top", c, (2.0 * k, 0.0, 960.0, [r])) for c, each in told.items() for k, r in enumerate(each)]
    members = spark.createDataFrame(rows, "source string, side string, component long, p struct<start: double, x1: double, x2: double, readings: array<string>>")
    graph.checkpointed(spark)
    held, dealing = [], scrolling.dealt
    monkeypatch.setattr(scrolling, "dealt", lambda df, *by: held.append(df) or dealing(df, *by))
    assert sorted(r.component for r in scrolling.slid(members, SCAN).collect()) == [1, 2]
    assert {r.component for r in held[0].collect()} == {1, 2} and {r.component for r in held[1].collect()} == {2}


def test_the_longest_run_is_that_of_difflib():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 14))) for _ in range(2))
        m = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert scrolling.longest_run(a, b) == (m.a, m.b, m.size)


def scattered(seed=11, films=12):
    """Films of pieces of few texts that meet, contest each other's pieces and pause, some without boxes, readings or letters."""
    rng = random.Random(seed)
    words = [LINE, "a quite different sentence about the weather in the mountains today", LINE[30:] + " and more of it"]
    rows = []
    for f in range(films):
        t = 0.0
        for i in range(1, 31):
            t += rng.choice((0.0, 1.0, 2.0, 3.0, 3.0, 3.0, 5.0, 14.0))
            line, at = rng.choice(words), rng.randint(0, 40)
            texts = rng.choice(([line[at : at + 30]], [line[at : at + 30]], [line[at : at + 30], line[at + 8 : at + 40]], ["xx"], None))
            left = rng.choice((0, 0, 300, 700))
            box = (left, 30 + rng.choice((0, 2, 14, 30)), rng.choice((960, 960, left + 200)), 70 + rng.choice((0, 3, 20)))
            row = track(i, t, t + rng.choice((1.0, 3.0, 6.0, 20.0)), texts, box, source=f"f{f}", routing=rng.choice(("LIKELY_SCENE_TEXT",) * 4 + ("LIKELY_SUBTITLE",)))
            rows.append(row if i % 29 else (*row[:5], None, row[6], float("nan") if f % 2 else None, *row[8:]))
    return rows


def test_short_runs_are_folded_and_give_what_rounds_give(spark, monkeypatch):
    """Runs of more than a few readings go through joins and rounds here, those below are folded; the lines are the same."""
    df = spark.createDataFrame(scattered(), SCHEMA)
    asked, real = [], scrolling.connected
    monkeypatch.setattr(scrolling, "connected", lambda edges: asked.append(edges) or real(edges))
    folded = sorted(map(repr, scrolling.scrolling_lines(df, SCAN).collect()))
    before = len(asked)
    monkeypatch.setattr(scrolling, "SHORT", 4)
    mixed = sorted(map(repr, scrolling.scrolling_lines(df, SCAN).collect()))
    assert folded == mixed and len(folded) > 12
    assert len(asked) == before + 1


def test_a_band_without_long_runs_needs_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(scrolling, "connected", None)
    (r,) = scrolling.scrolling_lines(spark.createDataFrame(crossing(100, 1), SCHEMA), SCAN).collect()
    assert r.grouped_track_ids == [1, 2, 3]
