import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import sharding
from spanloom.llm.sharding import shard_rows

SCHEMA = "doc_id long, text string, source string, shard string, u string"


def held(rows, shards):
    """The law and the slots, whatever the order."""
    counts = Counter(r.shard for r in rows)
    assert all(0 <= s < shards for s in counts)
    assert max(counts.values()) - min([counts.get(s, 0) for s in range(shards)]) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_shards_hold_the_mixture(spark):
    sources = ["a"] * 700 + ["b"] * 200 + [None] * 60 + ["c"] * 40
    docs = spark.createDataFrame([(i, f"text {i} é", s, "x", "y") for i, s in enumerate(sources)], SCHEMA)
    rows = shard_rows(docs, 8).collect()
    held(rows, 8)
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    assert all(r.size == len(f"text {r.doc_id} é".encode()) + 1 and r.text_crc32 == zlib.crc32(f"text {r.doc_id} é".encode()) for r in rows)
    per = Counter((r.shard, sources[r.doc_id]) for r in rows)
    whole = Counter(sources)
    assert all(abs(per[s, k] - n / 8) < 1.5 for s in range(8) for k, n in whole.items())
    again = shard_rows(docs.repartition(7, "text"), 8).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    other = shard_rows(docs, 8, seed=1).collect()
    held(other, 8)
    assert sum(a.shard == b.shard for a, b in zip(sorted(rows), sorted(other), strict=True)) < 300


def test_odd_rows(spark):
    long = "wörd " * 200_000
    odd = [(None, None, None, "x", "y")] * 30 + [(1, "", "a", "x", "y"), (2, long, "a", "x", "y"), (3, None, "a", "x", "y"), (3, None, "a", "x", "y"), (None, "t", "b", None, None)]
    rows = shard_rows(spark.createDataFrame(odd, SCHEMA)).collect()
    assert len(rows) == 35
    held(rows, 16)
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in rows if r.doc_id}
    assert sizes == {1: (1, 0), 2: (len(long.encode()) + 1, zlib.crc32(long.encode())), 3: (1, 0)}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert shard_rows(spark.createDataFrame([], SCHEMA)).collect() == []
    few = shard_rows(spark.createDataFrame(odd[30:33], SCHEMA), keep=("source",)).collect()
    assert sorted(r.source for r in few) == ["a", "a", "a"]
    held(few, 16)


def test_a_repeated_row_and_many_sources_need_no_large_bin(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 100)
    hot = spark.range(20_000).selectExpr("null as doc_id", "'same' as text", "'hot' as source")
    rest = spark.range(20_000).selectExpr("id as doc_id", "string(id) as text", "if(id % 2 = 0, concat('s', id), 'big') as source")
    rows = shard_rows(hot.unionByName(rest)).cache()
    counts = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert counts == [2500] * 16
    assert rows.groupBy("shard").agg(F.countDistinct("slot").alias("n"), F.max("slot").alias("m")).where("n <> 2500 or m <> 2499").count() == 0
    same = [r["count"] for r in rows.where("doc_id is null").groupBy("shard").count().collect()]
    assert len(same) == 16 and max(same) - min(same) <= 60


@pytest.mark.parametrize("bins", [3, 100])
def test_starts_of_bins(spark, monkeypatch, bins):
    monkeypatch.setattr(sharding, "GROUP_BINS", 4)
    table = spark.range(bins).selectExpr("'k' as key", "id * 3 as bin", "id + 1 as n")
    got = {r.bin: (r.start, r.total) for r in sharding.begun(table, "key").collect()}
    assert got == {3 * i: (i * (i + 1) // 2, bins * (bins + 1) // 2) for i in range(bins)}
