"""Text tracks on tables and streams, and the merged table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import sinks, tracks

READINGS = "source string, t double, confidence double, x1 double, y1 double, x2 double, y2 double, zone string, text string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Hello there", "HELLO  THERE!", True), ("PHIMMOI.NET", "PHIMM0I NET", True), ("watch", "watch this", True), ("ab", "abc", True), ("good morning", "see you", False), ("", "x", False), (None, "x", False), ("...", "...", False), ("abcdefghijkl", "abz", False)],
)
def test_continuity(a, b, same):
    assert tracks.goes_on(a, b) is same


def readings(seed):
    rng = random.Random(seed)
    out = []
    for source in "ab":
        for t in range(0, 120, 2):
            for text, x, zone in (("PHIMMOI.NET", 10, "top-left"), (f"line {t // 10} spoken here", 200, "subtitle"), ("logo tv", 14, "top-left")):
                if rng.random() < 0.55:
                    out.append((source, float(t), round(rng.random(), 3), float(x + rng.randrange(4)), 10.0, float(x + 100), 40.0, zone, text if rng.random() < 0.8 else text[:-2]))
    return out


def test_tracks_of_a_table(spark):
    rows = [("s", float(t), 0.5 + t / 100, 10.0 + t, 10.0, 110.0, 40.0, "top-left", "PHIMMOI.NET"[: 11 - t // 4]) for t in (0, 2, 4, 8)]
    rows += [("s", 4.0, 0.9, 10.0, 10.0, 110.0, 40.0, "subtitle", "PHIMMOI.NET"), ("s", 8.0, 0.4, 400.0, 10.0, 500.0, 40.0, "top-left", "PHIMMOI.NET"), ("s", 30.0, 0.5, 10.0, 10.0, 110.0, 40.0, "top-left", "PHIMMOI.NET"), ("s", 32.0, 0.5, 0.0, 0.0, 1.0, 1.0, "x", None)]
    got = [tuple(r)[1:] for r in tracks.text_tracks(spark.createDataFrame(rows, READINGS), 2.0).orderBy("start", "zone", "x1").collect()]
    assert got == [
        (0.0, 10.0, 10.5, True, 4, "top-left", 10.0, 10.0, 110.0, 40.0, "PHIMMOI.N", 0.58, True, "high"),
        (4.0, 6.0, 6.5, True, 1, "subtitle", 10.0, 10.0, 110.0, 40.0, "PHIMMOI.NET", 0.9, False, "low"),
        (8.0, 10.0, 10.5, True, 1, "top-left", 400.0, 10.0, 500.0, 40.0, "PHIMMOI.NET", 0.4, False, "low"),
        (30.0, 32.0, 35.0, False, 1, "top-left", 10.0, 10.0, 110.0, 40.0, "PHIMMOI.NET", 0.5, False, "low"),
        (32.0, 34.0, 37.0, False, 1, "x", 0.0, 0.0, 1.0, 1.0, "", 0.5, False, "low"),
    ]


def test_a_stream_agrees_with_the_table(spark, tmp_path):
    """Readings come late and out of order; the last ones push the watermark over all others."""
    rows = readings(7)
    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(1)
    parts = [[], [], []]
    for r in rows:
        k = min(2, int(r[1] // 40))
        parts[max(0, k - (rng.random() < 0.2)) if r[1] % 40 > 30 else k].append(r)
    schema = READINGS.replace("t double", "ts timestamp", 1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for k, part in enumerate([*parts, [("end", 1e4, 0.0, 0.0, 0.0, 1.0, 1.0, "z", "end")], [("end", 2e4, 0.0, 0.0, 0.0, 1.0, 1.0, "z", "end")]]):
            rng.shuffle(part)
            spark.createDataFrame([(r[0], t0 + dt.timedelta(seconds=r[1]), *r[2:]) for r in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        run = tracks.text_track_stream(stream, 2.0, "60 seconds").writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        got = spark.table("tracks").where("source <> 'end'").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    since = t0.replace(tzinfo=dt.timezone.utc).timestamp()
    want = tracks.text_tracks(spark.createDataFrame([*rows, *[(s, 1e4, 0.0, 0.0, 0.0, 1.0, 1.0, "z", "end") for s in "ab"]], READINGS), 2.0).where("start < 9000").collect()
    plain = lambda r, by: (r.source, round(r.start - by, 3), round(r.end - by, 3), round(r.blur_end - by, 3), r.confirmed, r.observations, r.zone, r.x1, r.x2, r.text, r.persistent, r.priority)
    assert sorted(plain(r, since) for r in got) == sorted(plain(r, 0) for r in want) and len(want) > 20


def test_batches_are_merged_once(spark, tmp_path):
    table = sinks.MergedTable(spark, f"{tmp_path}/jobs", ["job"], "at")
    assert table.read() is None
    frame = lambda rows: spark.createDataFrame(rows, "job int, at int, state string")
    table.merge(frame([(1, 1, "a"), (2, 1, "a"), (1, 3, "c")]), 0)
    table.merge(frame([(1, 2, "late"), (2, 1, "again"), (3, None, "x")]), 1)
    table.merge(frame([(1, 9, "twice")]), 1)
    assert sorted(map(tuple, table.read().collect())) == [(1, 3, "c"), (2, 1, "again"), (3, None, "x")]
    log = sinks.MergedTable(spark, f"{tmp_path}/log", ["job"], "at", log=2)
    for k in range(4):
        log.merge(frame([(1, k, f"s{k}"), (2, -k, f"s{k}")]), k)
    assert sorted(map(tuple, log.read().collect())) == [(1, 2, "s2"), (1, 3, "s3"), (2, -1, "s1"), (2, 0, "s0")] and log.versions() == [2, 3]


def test_a_stream_into_the_merged_table(spark, tmp_path):
    schema = "job int, at int, state string"
    for k, part in enumerate([[(1, 1, "a")], [(1, 2, "b"), (2, 1, "a")], [(2, 0, "old")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    table = sinks.MergedTable(spark, f"{tmp_path}/t", ["job"], "at")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(table.sink()).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    run()
    run()
    assert sorted(map(tuple, table.read().collect())) == [(1, 2, "b"), (2, 1, "a")] and table.read().where(F.col("job") > 2).count() == 0
