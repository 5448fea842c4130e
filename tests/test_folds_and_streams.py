import datetime as dt
import random

from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.operators import cards, folds
from spanloom.operators.graph import connected
from spanloom.streaming import sessions


def test_bounded_sessions(spark):
    rows = [(1, "a", 0.0, 1.0, None), (1, "a", 2.0, 3.0, "cut"), (1, "a", 4.0, 5.0, "keep"), (1, "a", 6.0, 7.0, None), (1, "a", 9.5, 20.0, None), (1, "b", 0.0, 1.0, None)]
    out = folds.bounded_sessions(spark.createDataFrame(rows, "source long, category string, start double, end double, suggestion string"), 2.0, 10.0)
    got = sorted((r.category, r.start, r.end, r.suggestion, r.n) for r in out.collect())
    assert got == [("a", 0.0, 3.0, "cut", 2), ("a", 4.0, 7.0, "keep", 2), ("a", 9.5, 20.0, None, 1), ("b", 0.0, 1.0, None, 1)]


def test_tracks_follow_boxes(spark):
    rows = [(1, 0.0, 0.9, 0, 0, 10, 10), (1, 1.0, 0.9, 1, 0, 11, 10), (1, 1.0, 0.8, 50, 50, 60, 60), (1, 2.0, 0.5, 2, 0, 12, 10), (1, 30.0, 0.9, 0, 0, 10, 10)]
    df = spark.createDataFrame([(s, t, c, *map(float, b)) for s, t, c, *b in rows], "source long, t double, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.start, r.end, r.observations, r.x1, r.x2) for r in folds.tracks(df, 2.5, 0.3).collect())
    assert got == [(0.0, 2.0, 3, 0.0, 12.0), (1.0, 1.0, 1, 50.0, 60.0), (30.0, 30.0, 1, 0.0, 10.0)]


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 90: 90, 95: 90, 100: 90}


def stream(spark, tmp_path, rows, schema):
    """A stream that reads each row's file in order."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_session_stream_agrees_with_the_table(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [[(1, at(0), 1.0), (1, at(10), 3.0)], [(1, at(20), 2.0), (1, at(31), 1.0)], [(1, at(10_000), 0.0)]]
    schema = "source long, ts timestamp, score double"
    out = sessions.session_stream(stream(spark, tmp_path, rows, schema), "10 seconds", "1 minute")
    run = out.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["last"], r.max_score, r.sample_count) for r in spark.table("sessions").collect())
    table = sessions.session_stream(spark.createDataFrame(sum(rows, []), schema), "10 seconds", "1 minute").where(F.col("last") < F.lit(at(9_000)))
    assert got == sorted((r["last"], r.max_score, r.sample_count) for r in table.collect()) == [(at(20), 3.0, 3), (at(31), 1.0, 1)]


def test_settled_files_are_told_once(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    seen = lambda s, size: [("f", size, 5, t0 + dt.timedelta(seconds=s))]
    rows = [seen(0, 10), seen(5, 20), seen(10, 20), seen(16, 20), seen(30, 20), seen(40, 21), seen(60, 21)]
    df = stream(spark, tmp_path, [sum(rows, [])], "path string, size long, mtime long, ts timestamp")
    run = sessions.settled(df, 10).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r.path, r["size"]) for r in spark.table("settled").collect()) == [("f", 20), ("f", 21)]


def plain_merge(cards, gap, least_iou):
    """merge_cards row by row over one group's cards: dicts in order."""
    out, latest, suggestion, box = [], None, None, None
    for c in cards:
        opens = not out or c["start"] - latest > gap or (c["suggestion"] and suggestion and c["suggestion"] != suggestion) or (c["box"] and box and folds._iou(c["box"], box) < least_iou)
        if opens:
            out.append([])
        out[-1].append(c)
        latest = max(c["end"], latest or c["end"])
        suggestion, box = c["suggestion"] or suggestion, c["box"] or box
    return out


def test_merged_cards_against_a_plain_merge(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        start = float(rng.randrange(0, 300))
        x = rng.randrange(0, 40)
        box = (x, 0, x + 40, 20) if rng.random() < 0.7 else None
        rows.append({"source": rng.randrange(2), "category": rng.choice("ab"), "start": start, "end": start + rng.randrange(1, 20), "max_score": rng.random(), "priority": rng.choice(["high", "context", "normal"]), "kind": rng.choice(["logo", "text"]), "suggestion": rng.choice([None, None, "BLUR", "CUT"]), "refs": [f"r{i % 50}"], "card_id": i, "box": box})
    want = set()
    for key in {(r["source"], r["category"], r["kind"]) for r in rows}:
        own = sorted((r for r in rows if (r["source"], r["category"], r["kind"]) == key), key=lambda r: (r["start"], r["end"], r["card_id"]))
        for g in plain_merge(own, 3.0, 0.5):
            box = next((c["box"] for c in g if c["box"]), None)
            refs = tuple(dict.fromkeys(r for c in g for r in c["refs"]))
            want.add((*key, min(c["start"] for c in g), max(c["end"] for c in g), max(c["max_score"] for c in g), min((c["priority"] for c in g), key=["high", "context", "normal"].index), next((c["suggestion"] for c in g if c["suggestion"]), None), refs, len(g), box and box[0]))
    schema = "source long, category string, start double, end double, max_score double, priority string, kind string, suggestion string, refs array<string>, card_id long, x1 long, y1 long, x2 long, y2 long"
    df = spark.createDataFrame([(r["source"], r["category"], r["start"], float(r["end"]), r["max_score"], r["priority"], r["kind"], r["suggestion"], r["refs"], r["card_id"], *(r["box"] or (None,) * 4)) for r in rows], schema)
    got = {(r.source, r.category, r.kind, r.start, r.end, r.max_score, r.priority, r.suggestion, tuple(r.refs), r.n, r.x1) for r in folds.merge_cards(df, 3.0).collect()}
    assert got == want and len(want) > 50


def test_letters_with_marks_fold(spark):
    df = spark.createDataFrame([("Điện Ảnh ƠƯẠ ả ầ ž ő ẽ ỹ ß",)], "t string")
    assert df.select(text.fold(F.col("t"))).first()[0] == "dien anh oua a a z o e y ß"


def test_priorities(spark):
    rows = [("High", None), ("normal", "very high"), ("context", "high"), ("low", "a HIGH score"), (None, None), ("medium", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string, r string").select(cards.priority(F.col("p"), F.col("r"))).collect()]
    assert got == ["high", "normal", "context", "high", "context", "context"]


def test_words_within_one_edit_share_a_deletion(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in set(words)], "w string").select("w", text.deletions(F.col("w")).alias("k"))
    keys = {r.w: set(r.k) for r in df.collect()}
    near = spark.createDataFrame([(a, b) for a in keys for b in keys], "a string, b string").where(F.levenshtein("a", "b") <= 1).collect()
    assert len(near) > 60 and all(keys[r.a] & keys[r.b] for r in near)
