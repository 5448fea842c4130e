"""Findings about decisions, case by case; the query holds them against SQL."""

from spanloom.operators import quality

NAMES = "source item_id category candidate start end labels reasons decision ident x1 y1 x2 y2 dx1 dy1 dx2 dy2 trusted".split()
TYPES = "string long string string double double array<string> array<string> string boolean double double double double double double double double boolean".split()
BASE = dict.fromkeys(NAMES) | {"category": "text"}


def card(i, start, end, box=None, blur=None, **changes):
    sides = dict(zip(("x1", "y1", "x2", "y2"), map(float, box), strict=True)) if box else {}
    blurred = dict(zip(("dx1", "dy1", "dx2", "dy2"), map(float, blur), strict=True)) if blur else {}
    return BASE | {"item_id": i, "start": float(start), "end": float(end)} | sides | blurred | changes


def mark(blur, **changes):
    return card(1, 100, 200, (0, 0, 100, 50), blur, candidate="persistent_overlay", decision="BLUR", **changes)


def read(i, box):
    return card(i, 120 + i, 121 + i, box, trusted=True)


SCENES = {
    "not cut": ([card(1, 5, 9, candidate="opening_promotion", decision="BLUR"), card(2, 31, 33, candidate="opening_promotion", decision="BLUR"), card(3, 5, 6, decision="KEEP", labels=["An ADVERTISEMENT"]), card(4, 5, 6, decision="KEEP", ident=True, reasons=["promotion"]), card(5, 5, 6, reasons=["promotion"])], [(1, "opening_not_cut", None), (3, "opening_not_cut", None)]),
    "shows on": ([card(1, 0, 9.5, candidate="opening_promotion", decision="CUT"), card(3, 10.5, 12, category="visual_logo", decision="BLUR"), card(2, 9.5, 12, category="visual_logo", decision="BLUR"), card(4, 10.6, 12, category="visual_logo", decision="BLUR"), card(5, 9.5, 12, decision="BLUR")], [(1, "opening_shows_on", 2)]),
    "gap": ([card(1, 0, 9.5, candidate="opening_promotion", decision="CUT"), card(4, 10.6, 12, category="visual_logo", decision="BLUR"), card(5, 9, 12, category="visual_logo", decision="BLUR")], []),
    "small": ([mark((0, 0, 50, 50)), read(2, (10, 10, 50, 40)), read(3, (12, 10, 52, 40))], [(1, "blur_too_small", None)]),
    "untrimmed": ([mark((0, 0, 100, 50)), read(2, (10, 10, 50, 40)), read(3, (12, 10, 52, 40))], [(1, "blur_untrimmed", None)]),
    "wide": ([mark((0, 0, 100, 50)), read(2, (0, 0, 58, 50)), read(3, (2, 0, 60, 50))], [(1, "blur_too_wide", None)]),
    "one read": ([mark((0, 0, 100, 50)), read(2, (10, 10, 50, 40)), card(3, 120, 121, (12, 10, 52, 40))], []),
    "unknown": ([mark(None), read(2, (10, 10, 50, 40)), read(3, (12, 10, 52, 40))], []),
}


def test_findings(spark):
    rows = [tuple((c | {"source": name})[n] for n in NAMES) for name, (cards, _) in SCENES.items() for c in cards]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(NAMES, TYPES, strict=True)))
    got = {}
    for r in quality.findings(df).collect():
        got.setdefault(r.source, []).append((r.item_id, r.finding, r.other_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, (_, want) in SCENES.items() if want}
    assert quality.findings(df.limit(0)).count() == 0
