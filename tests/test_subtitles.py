"""Subtitle lines that leave the main list, case by case."""

from spanloom.operators import subtitles

NAMES = "source track_id zone review_candidate routing candidate persistent fixed named observations x1 y1 x2 y2 texts policy_hits top_label ad_probability".split()
TYPES = "string long string boolean string string boolean boolean boolean long double double double double array<string> array<string> string double".split()
SCHEMA = ", ".join(f"{n} {t}" for n, t in zip(NAMES, TYPES, strict=True))
BASE = {"source": "s", "zone": "subtitle", "review_candidate": True, "routing": "REVIEW_UNCERTAIN", "candidate": None, "persistent": None, "fixed": None, "named": None, "observations": 1, "x1": 300.0, "y1": 400.0, "x2": 660.0, "y2": 430.0, "texts": ["we go home"], "policy_hits": None, "top_label": None, "ad_probability": 0.1}
STAY = [
    {"zone": "top-left"}, {"review_candidate": False}, {"routing": "REVIEW_AD_LIKELY"}, {"routing": None}, {"candidate": "scrolling_text"}, {"persistent": True}, {"fixed": True}, {"observations": 3}, {"observations": None}, {"x1": None}, {"x1": 600.0, "x2": 660.0}, {"x2": 300.0},
    {"policy_hits": ["hit"]}, {"named": True}, {"top_label": "advertisement"}, {"ad_probability": 0.4}, {"texts": ["see motphim.tv"]}, {"texts": ["x", "call 0912 345 678"]}, {"texts": ["@name"]}, {"texts": ["our film page here"]},
]
MOVE = [{}, {"texts": None}, {"texts": [None, ""]}, {"ad_probability": None}, {"observations": 2}, {"review_candidate": None}, {"x1": 200.0, "x2": 480.0 + 136.0}]


def test_lines_that_move(spark):
    rows = [BASE | c | {"track_id": i} for i, c in enumerate(STAY)] + [BASE | c | {"track_id": 100 + i} for i, c in enumerate(MOVE)]
    rows += [BASE | {"track_id": 200 + i, "routing": "LIKELY_SUBTITLE"} for i in range(20)]
    rows += [BASE | {"source": "few", "track_id": i} for i in range(19)]
    df = spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], SCHEMA)
    out = {(r.source, r.track_id): r for r in subtitles.moved_lines(df, spark.createDataFrame([("filmpage",)], "key string"), 960.0).collect()}
    assert len(out) == len(rows)
    assert {i for (s, i), r in out.items() if r.subtitle_line} == {100 + i for i in range(len(MOVE))}
    assert out["s", 100].review_candidate is False and out["s", 100].previous_routing == "REVIEW_UNCERTAIN" and out["s", 0].review_candidate is True and out["s", 0].previous_routing is None
    assert subtitles.moved_lines(df.limit(0), spark.createDataFrame([], "key string"), 960.0).count() == 0
