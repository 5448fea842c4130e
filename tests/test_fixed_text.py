"""Text that stays at one place: joins of pieces and lines against all pairs, overlays with the values that they must have."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from spanloom.operators import boxes, fixed_text, fuzzy
from spanloom.operators.fixed_text import Film

TRACKS = "source string, track_id long, start double, end double, blur_end double, x1 double, y1 double, x2 double, y2 double, texts array<string>, routing string, candidate string, persistent boolean, observations long, ad_probability double, platform string"
FILM = Film(1000.0, 500.0, 2.0, 0.0, 1000.0, 1000.0)


def stretch(a, b):
    """Best likeness of a with a stretch of b of its own length."""
    return 1.0 if a in b else max(SequenceMatcher(None, a, b[k : k + len(a)], autojunk=False).ratio() for k in range(max(1, len(b) - len(a) + 1)))


def noisy(rng, word):
    return "".join(rng.choice(["", c, c + "q", "z"]) if rng.random() < 0.12 else c for c in word)


def test_pieces_against_all_pairs(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(8, 30))) for _ in range(20)]
    words = {w for line in lines for _ in range(4) for a in [rng.randrange(len(line) - 5)] for w in [noisy(rng, line[a : a + rng.randrange(6, 30)])]} | set(lines) | {"aaaaaaaaaa", "aaaaaaaabb", "abababab", "abcd", "aaaaa"}
    words = {w for w in words if w}
    want = {(a, b) for a in words for b in words if a != b and 4 < len(a) <= len(b) and stretch(a, b) >= 0.75}
    rows = spark.createDataFrame([("s", w) for w in words] + [("s", None), ("s", ""), ("t", lines[0])], "source string, word string")
    got = [(r.a, r.b) for r in fuzzy.fragments(rows, ["source"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_known_reads_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ABCDE1") for _ in range(rng.randrange(1, 16))) for _ in range(40)]
    reads = {w for w in [*base[:5], *(noisy(rng, b) for b in base for _ in range(4)), *(b + "XY" for b in base), "", "A", "AB"]}

    def plain(x):
        def one(y):
            m = SequenceMatcher(None, x, y, autojunk=False)
            return x == y or (len(x) >= 3 and x in y) or (len(x) - sum(k.size for k in m.get_matching_blocks()) <= 1 and m.ratio() >= 0.8)

        return len(x) < 2 or any(one(y) for y in base)

    got = fuzzy.known(spark.createDataFrame([("s", r) for r in reads], "source string, read string"), spark.createDataFrame([("s", b) for b in base] + [("s", ""), ("t", "ABCDEABCDE")], "source string, word string"), ["source"]).collect()
    assert sorted(r.read for r in got) == sorted(r for r in reads if plain(r)) and 0 < len(got) < len(reads)


def track(i, start, texts, box=(100, 10, 400, 40), source="s", **changes):
    row = {"source": source, "track_id": i, "start": float(start), "end": start + 4.0, "blur_end": start + 5.0, **dict(zip(("x1", "y1", "x2", "y2"), map(float, box), strict=True)), "texts": texts, "routing": "LIKELY_SCENE_TEXT", "candidate": None, "persistent": False, "observations": 2, "ad_probability": 0.1, "platform": None}
    return tuple((row | changes)[c.split()[0]] for c in TRACKS.split(", "))


def test_lines_against_all_pairs(spark):
    rng = random.Random(6)
    lines = ["watch new films online here", "copyright of the studio", "good evening everybody now"]
    rows = []
    for i in range(90):
        line = rng.choice(lines)
        a = rng.randrange(len(line) - 8)
        x, y = rng.choice([0, 250]) + rng.randrange(20), rng.choice([0, 24, 200]) + rng.randrange(6)
        rows.append(track(i, i, [noisy(rng, line[a : a + rng.randrange(8, 28)])], (x, y, x + 200, y + 30), source=rng.choice("st")))
    fold = lambda t: "".join(c for c in t.lower() if c.isalnum())
    top = {r: r for r in range(90)}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i, p in enumerate(rows):
        for j, q in enumerate(rows[:i]):
            x, y = fold(q[9][0]), fold(p[9][0])
            tall = min(p[8] - p[6], q[8] - q[6])
            if p[0] == q[0] and min(len(x), len(y)) >= 6 and min(p[8], q[8]) - max(p[6], q[6]) >= tall / 2 and min(p[7], q[7]) > max(p[5], q[5]) and stretch(*sorted((x, y), key=len)) >= 0.75:
                top[find(i)] = find(j)
    groups = {}
    for i, p in enumerate(rows):
        if len(fold(p[9][0])) >= 6:
            groups.setdefault(find(i), []).append(i)
    want = {tuple(g) for g in groups.values() if len(g) >= 4 and sum(len(fold(rows[i][9][0])) >= 12 for i in g) >= 3}
    got = {}
    for r in fixed_text.recurring(spark.createDataFrame(rows, TRACKS), 4).collect():
        got.setdefault((r.source, r.line), []).append(r.track_id)
    assert {tuple(sorted(g)) for g in got.values()} == want and len(want) >= 3


LINE = "watch all the new films on motchillv today"
PARTS = [LINE, LINE[:20], LINE[18:], LINE, LINE[5:30], LINE[:24], LINE[10:], LINE[20:], LINE[:30]]
TALK = ["where did you go last night", "last night we went to the hill", "to the hill where nobody lives", "nobody lives in that old house", "that old house belongs to them", "belongs to them or so they say", "so they say it is a long way", "a long way from here to there", "here to there and back again"]
NEXT = ["last night", "to the hill", "nobody lives", "that old house", "belongs to them", "so they say", "a long way", "here to there", "back again"]
SCENES = {
    # a mark that is read most of the time, a piece of it, and a faint line that names its site
    "site": [track(1, 10, ["Motchillv.ph", "other"], (700, 10, 900, 40), end=700.0, blur_end=None, persistent=True, observations=400), track(2, 20, ["Motchillv"], (710, 12, 890, 38))] + [track(10 + k, 100 * k, [p]) for k, p in enumerate(PARTS)],
    "faint": [track(k, 100 * k, [p]) for k, p in enumerate(PARTS)] + [track(20, 5, None), track(21, 5, ["abc"], candidate="persistent_overlay"), ("faint", 22, *[None] * 14)],
    "short": [track(k, 10 * k, [p]) for k, p in enumerate(PARTS)],
    "few": [track(k, 100 * k, [p]) for k, p in enumerate(PARTS[:7])],
    "routing": [track(k, 100 * k, [p], routing="REVIEW_AD_LIKELY" if k == 3 else "", ad_probability=0.5 if k == 4 else None, platform="WeTV" if k == 8 else None) for k, p in enumerate(PARTS)],
    # each line of dialogue shares some words with the next, which are read alone as well
    "talk": [track(k, 100 * k, [p, NEXT[k]], (300, 400, 700, 440)) for k, p in enumerate(TALK)],
    "talk above": [track(k, 100 * k, [p, NEXT[k]], (300, 100, 700, 140)) for k, p in enumerate(TALK)],
    "one line below": [track(k, 100 * k, [p], (300, 400, 700, 440)) for k, p in enumerate(PARTS)],
    "skipped": [track(k, 100 * k, [p], routing="LIKELY_TITLE_OVERLAY" if k < 3 else "") for k, p in enumerate(PARTS)],
    "rarely": [track(1, 10, ["Motchillv.ph"], end=700.0, persistent=True, observations=200)],
}


@pytest.fixture(scope="module")
def told(spark):
    out = {}
    for r in fixed_text.fixed_overlays(spark.createDataFrame([(name, *r[1:]) for name, rows in SCENES.items() for r in rows], TRACKS), FILM).collect():
        out.setdefault(r.source, []).append(r)
    return out


def test_which_texts_are_fixed(told):
    assert {k: sorted((r.rule, r.n_tracks) for r in v) for k, v in told.items()} == {
        "site": [("recurring_fixed_text", 9), ("whole_film_text", 1)], "faint": [("recurring_fixed_text", 9)], "routing": [("recurring_fixed_text", 9)],
        "talk": [("recurring_fixed_text", 9)], "talk above": [("recurring_fixed_text", 9)], "one line below": [("recurring_fixed_text", 9)],
    }


def test_what_a_fixed_text_shows(told):
    whole, line = sorted(told["site"], key=lambda r: r.rule, reverse=True)
    assert (whole.track_id, whole.start, whole.end, whole.observed_start, whole.observed_end, whole.coverage) == (1, 0.0, 1000.0, 10.0, 700.0, 0.8)
    assert whole.evidence == ["address Motchillv.ph"] and whole.suggestion == "BLUR" and whole.grouped_track_ids == [1]
    assert line.evidence == ["site motchillv"] and line.suggestion == "BLUR"
    (r,) = told["faint"]
    assert (r.track_id, r.whole_film, r.start, r.end, r.observed_start, r.observed_end, r.coverage) == (0, True, 0.0, 1000.0, 0.0, 805.0, None)
    assert r.evidence == [] and r.suggestion is None and r.consensus is None and r.observations == 18
    assert r.texts == [x for n, _, x in sorted({(-len(p), min(k for k, q in enumerate(PARTS) if q == p), p) for p in PARTS})][:8]
    (r,) = told["routing"]
    assert r.evidence == ["routing REVIEW_AD_LIKELY", "score 0.50", "platform WeTV"] and r.suggestion == "BLUR"


def test_dialogue_under_the_picture_is_no_line(told):
    (talk,), (above,), (line,) = told["talk"], told["talk above"], told["one line below"]
    assert talk.consensus is not None and talk.consensus < 0.6 and above.consensus is None and line.consensus is None


def test_consensus_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [("s", k % 3, [None, noisy(rng, rng.choice(TALK))[: rng.randrange(5, 30)], "ab"]) for k in range(60)] + [("s", 9, None), ("t", 1, ["short", "abcdefg"]), ("t", 1, ["bcdefg"])]
    got = {(r.source, r.line): r.consensus for r in fixed_text.line_consensus(spark.createDataFrame(rows, "source string, line long, texts array<string>")).collect()}
    by = {}
    for s, line, texts in rows:
        best = max(("".join(c for c in t.lower() if c.isalnum()) for t in texts or [] if t), key=len, default="")
        if best:
            by.setdefault((s, line), []).append(best)
    for key, words in by.items():
        refs = {w for w in words if len(w) >= 12} or {max(words, key=lambda w: (len(w), w))}
        alike = lambda w, r: w == r or min(len(w), len(r)) > 4 and stretch(*sorted((w, r), key=len)) >= 0.75
        want = max(sum(n for w, n in Counter(words).items() if alike(w, r)) for r in refs) / len(words)
        assert got[key] == pytest.approx(want)
    assert set(got) == set(by)


def test_fragments_of_lines(spark):
    cases = [((10, 0, 60, 20), (0, 0, 100, 20), True), ((10, 0, 96, 20), (0, 0, 100, 20), False), ((20, 0, 60, 20), (15, 0, 65, 20), False), ((10, 0, 60, 20), (0, 0, 100, 40), False), ((0, 10, 20, 60), (0, 0, 20, 100), True), ((0, 0, 85, 20), (0, 0, 100, 20), True)]
    rows = [(i, *map(float, p), *map(float, w)) for i, (p, w, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{p}{s} double" for p in ("p_", "w_") for s in ("x1", "y1", "x2", "y2")))
    assert [r.f for r in df.orderBy("i").select(boxes.line_fragment("p_", "w_").alias("f")).collect()] == [c[2] for c in cases]
    assert df.where(F.col("i") < 0).count() == 0
