"""Triage of cards and cards of reports on small cases."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import triage

ITEM = "item_id int, category string, decision string, job_style string, start double, end double, refs array<string>"
SEEN = "struct<blood_family_max double, injury_max double, corpse_max double, confirmed_frames int, strongest_blood_label string, strongest_blood_label_score double>"


def gore_intervals(spark, rows):
    """rows: (report, n, payload, begin, finish, blood, injury, corpse or None, window_frames)."""
    df = spark.createDataFrame(rows, "report string, n long, payload string, begin double, finish double, b double, i double, c double, w int")
    scan = F.struct(*[(F.col("w") if k == "window_frames" else F.lit(v)).alias(k) for k, v in triage.TAGGER_SCAN.items()])
    seen = F.struct(F.col("b").alias("blood_family_max"), F.col("i").alias("injury_max"), F.col("c").alias("corpse_max"), F.lit(2).alias("confirmed_frames"), F.concat(F.lit("blood"), "n").alias("strongest_blood_label"), F.col("b").alias("strongest_blood_label_score"))
    return df.select("report", "n", "payload", F.lit("gore").alias("scan_type"), F.lit("animation").alias("style"), "begin", "finish", scan.alias("scan"), F.when(F.col("b").isNotNull(), seen).alias("evidence"))


def test_gore_cards_move_only_if_every_interval_is_clear(spark):
    rows = [("a.json", 0, "a", 0.0, 5.0, 0.05, 0.3, 0.0, 5), ("a.json", 1, "a", 3.0, 8.0, 0.9, 0.1, 0.06, 5), ("b.json", 0, "b", 0.0, 5.0, 0.0, 0.0, 0.0, 4), ("c.json", 0, "c", 0.0, 5.0, None, None, None, 5), ("alias/a.json", 0, "a", 0.0, 5.0, 0.05, 0.3, 0.0, 5), ("d.json", 0, "d", 0.0, 5.0, float("nan"), 0.0, 0.0, 5)]
    def card(i, *refs, **over):
        return (i, over.get("category", "gore"), over.get("decision"), over.get("style", "animation"), over.get("start", 0.0), over.get("end", 6.0), list(refs))
    cards = [
        card(1, "a.json#interval:0"), card(2, "a.json#interval:0", "a.json#interval:1"), card(3, "b.json#interval:0"), card(4, "c.json#interval:0"), card(5), card(6, "a.json#interval:0", "x.json#interval:0"),
        card(7, "a.json#interval:0", start=50.0, end=60.0), card(8, "a.json#interval:0", decision="KEEP"), card(9, "a.json#interval:0", style="live_action"), card(10, "a.json#interval:0", category="adult"),
        card(11, "a.json#interval:0", "alias\\a.json#interval:0"), card(12, "a.json#interval:0", start=None), card(13, "d.json#interval:0"), card(14, "a.json#interval:-1"), card(15, "a.json#interval:0", style=None),
    ]
    items = spark.createDataFrame(cards, ITEM)
    got = {r.item_id: (r.outcome, r.reason, r.n_intervals) for r in triage.triage_tagged(items, gore_intervals(spark, rows)).collect()}
    assert got == {
        1: ("advisory", None, 1), 2: ("kept", "blood_or_corpse_seen", 2), 3: ("kept", "uncalibrated_scan", 1), 4: ("kept", "evidence_missing", 1), 5: ("kept", "no_source_refs", 0), 6: ("kept", "unresolved_source_refs", 0),
        7: ("kept", "stale_source_refs", 0), 8: ("kept", "decided", 0), 9: ("kept", "content_style_not_animation", 0), 10: ("kept", None, 0), 11: ("advisory", None, 1), 12: ("kept", "stale_source_refs", 0), 13: ("kept", "evidence_missing", 1),
        14: ("kept", "unresolved_source_refs", 0), 15: ("kept", "content_style_missing", 0),
    }
    seen = {r.item_id: r for r in triage.tag_evidence(items, gore_intervals(spark, rows)).collect()}
    assert set(seen) == {1, 2, 3, 8, 9, 11, 15}
    assert (seen[1].hint, seen[2].hint) == ("Tagger: chỉ vết thương, không thấy máu", "Tagger: thấy máu · có thể là xác")
    assert (seen[2].strongest_blood_label, seen[2].confirmed_frames, seen[11].confirmed_frames) == ("blood1", 4, 2)
    empty = triage.triage_tagged(items.limit(0), gore_intervals(spark, rows))
    assert empty.count() == 0
    assert {r.reason for r in triage.triage_tagged(items, gore_intervals(spark, rows).limit(0)).where("item_id < 5").collect()} == {"unresolved_source_refs"}


@pytest.mark.parametrize("level", list(triage.LEVELS))
def test_explicit_cards_by_level(spark, level):
    fixed = {"model": triage.VERIFIER["model"], "target_label": "NSFW", "revision": triage.VERIFIER["revision"]}
    rows = [  # n, label, samples, state, most, frames, threshold
        (0, " HENTAI", 9, "SCORED", 0.1, 3, 0.95), (1, "hentai", 1, "SCORED", 0.9, 3, 0.95), (2, "porn", 1, "SCORED", 0.2, 3, 0.95), (3, "porn", 3, "SCORED", 0.2, 3, 0.95), (4, "porn", 1, None, None, None, 0.95), (5, "porn", 1, "FAILED", None, 0, 0.95),
        (6, "porn", 1, "SCORED", 0.2, 0, 0.95), (7, "hentai", 1, "SCORED", 0.1, 3, 0.9), (8, "hentai", 1, None, None, None, 0.95),
    ]
    df = spark.createDataFrame(rows, "n long, label string, sample_count int, state string, most double, frames int, threshold double")
    seen = F.struct("state", F.col("most").alias("nsfw_max"), F.lit(2.0).alias("sample_fps"), F.col("frames").alias("nsfw_frames"), F.lit(448).alias("frame_size"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    intervals = df.select(F.lit("s").alias("report"), "n", F.lit("s").alias("payload"), F.lit("nsfw").alias("scan_type"), F.lit("live_action").alias("style"), F.lit(0.0).alias("begin"), F.lit(5.0).alias("finish"), "label", "sample_count", F.struct(F.lit(2.0).alias("sample_fps"), "threshold").alias("scan"), F.when(F.col("state").isNotNull(), seen).alias("verification"))
    items = spark.createDataFrame([(n, "adult", None, "live_action", 0.0, 5.0, [f"s#interval:{n}", f"s#interval:{n}"]) for n in range(9)] + [(20, "adult", None, "live_action", 0.0, 5.0, ["s#interval:2", "s#interval:3"])], ITEM)
    got = {r.item_id: r.rule or r.reason for r in triage.triage_explicit(items, intervals, level).collect()}
    titles = {0: "credits", 7: "uncalibrated_scan", 8: "credits"}
    strict = {1: "strong_evidence", 2: "two_signal", 3: "strong_evidence", 4: "verification_missing", 5: "verification_failed", 6: "verification_uncalibrated", 20: "strong_evidence"}
    assert got == {
        "off": dict.fromkeys(got, "level_off"),
        "credits": dict.fromkeys(strict, "no_rule_for_level") | titles,
        "conservative": strict | titles,
        "balanced": strict | titles | {3: "two_signal", 20: "two_signal"},
    }[level]


def test_cards_of_a_report(spark):
    box = "array<struct<box: array<int>, suggestion: string, classification: string, labels: array<string>>>"
    rows = [
        ("r", 0, "visual_logo", 0.0, 9.0, "Brand", None, None, None, "BLUR", True, None, 0.7, [([1, 2, 3, 4], None, None, [])]),
        ("r", 1, "visual_logo", 40.0, 49.0, "Brand", None, None, None, "BLUR", False, None, 0.0, [([-1, 2, 3, 4], None, "external_brand", ["x", " ", "Brand"]), ([1, 2, 3], None, None, []), ([5, 5, 5, 5], None, "subtitle", None), ([5, 5, 0, 5], "BLUR", None, None)]),
        ("r", 2, "nsfw", 1.0, 2.0, " ", "high", "why", None, "blur", None, None, None, None),
        ("r", 3, "visual_logo", 90.0, 99.0, "The actual  brand name", None, "High", "ending_boundary", "CUT", None, None, None, []),
    ]
    schema = f"report string, n long, scan_type string, start double, end double, label string, priority string, reason string, candidate string, suggestion string, boundary_window boolean, boundary_state string, full_frame_score double, proposals {box}"
    got = triage.report_cards(spark.createDataFrame(rows, schema)).orderBy("ref", "card_id").collect()
    by_ref = {}
    for r in got:
        by_ref.setdefault(r.ref, []).append((r.category, r.kind, r.region, r.suggestion, r.priority, r.labels))
    assert by_ref["r#interval:0"] == [("visual_logo", "opening_promotion", None, "CUT", "context", ["Brand"])]
    assert sorted(by_ref["r#interval:1"], key=str) == sorted([
        ("visual_logo", "logo_overlay", [0, 2, 3, 4], "BLUR", "context", ["Brand", "x"]), ("visual_logo", "logo_overlay", [5, 5, 5, 5], "KEEP", "context", ["Brand"]), ("visual_logo", "logo_overlay", None, None, "context", ["Brand"]),
    ], key=str)
    assert by_ref["r#interval:2"] == [("adult", "adult", None, None, "high", [])]
    assert by_ref["r#interval:3"] == [("visual_logo", "logo_overlay", None, None, "high", [])]
    assert len({r.card_id for r in got}) == len(got)
