import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import lexical
from spanloom.llm.common import Staged

DOCS = "doc_id long, text string, item_id string, score long"
ITEMS = "item_id long, text string, doc_id long, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    """All scores, computed for each pair."""
    bags = [(d[0], Counter(terms(d[1]))) for d in docs if terms(d[1])]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = set()
    for item, text in {(i[0], i[1]) for i in items}:
        scored = []
        for doc, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(terms(text)) if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])}
    return out


def corpus(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(80)] + ["Été", "ñ", "日本"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    return [(i * 3 % n, " ".join(rng.choice(vocabulary, rng.integers(1, 40), p=weights / weights.sum())), "x", 1) for i in range(n)]


@pytest.mark.parametrize("shard_bytes", [700, 8 << 20])
def test_against_all_scores(spark, shard_bytes):
    docs = corpus(301)
    docs += [(1000, None, "x", 1), (1001, "", "x", 1), (1002, "..., !", "x", 1), (None, "w1 w2 W3 w70", "x", 1), (5, "w1 w2 w3 w70", "x", 1), (5, "w1 w2 w3 w70", "x", 1), (1003, "w9 " * 30_000, "x", 1), (-7, "w1,w2;w3\nw70", "x", 1)]
    items = [(0, "w1 w2 w3 w70 w70", 1, 1), (1, None, 1, 1), (2, "", 1, 1), (3, "nothing here", 1, 1), (4, "Été W9 ñ 日本 w0", 1, 1), (4, "w50", 1, 1), (4, "w50", 1, 1), (None, "w60-w61", 1, 1), (6, "w0", 1, 1)]
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    got = lexical.ranked(df, spark.createDataFrame(items, ITEMS), shard_bytes=shard_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == plain(docs, items)
    # of two rows with one id and one text both are found
    assert len(rows) == len(set(rows)) and sum(r[0] == 0 and r[2] == 5 for r in rows) >= 2


def test_many_equal_scores(spark):
    docs = [(i, "same words here" if i % 2 else "other text", "x", 1) for i in range(400, 0, -1)]
    got = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "same", 1, 1)], ITEMS), shard_bytes=500)
    assert [(r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(i + 1, 2 * i + 1) for i in range(50)]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(corpus(5), DOCS), spark.createDataFrame([(1, "w0", 1, 1)], ITEMS)
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert lexical.ranked(a, b).collect() == []
    assert lexical.ranked(spark.createDataFrame([(1, None, "x", 1)], DOCS), items).collect() == []


def test_items_in_blocks_and_shards_in_lots(spark, monkeypatch):
    docs, items = corpus(120), [(i, f"w{i} w{i + 1} w{i % 7}", 1, 1) for i in range(60)]
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(lexical, "LOT_SHARDS", 2)
    got = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=9, shard_bytes=600)
    assert {tuple(r) for r in got.collect()} == plain(docs, items, 9)


def tree_of(docs):
    hashes, rows = lexical.hashed_terms(pa.array([d[1] for d in docs]))
    lists = lexical.posting_lists(hashes, rows, pa.array([d[0] for d in docs], pa.int64()), 0)
    return lists, hashes


def test_a_tree_gives_back_its_lists(spark):
    docs = [(i, t, "x", 1) for i, (_, t, _, _) in enumerate(corpus(90, 8))]
    index = lexical.build_index(spark.createDataFrame(docs, DOCS).coalesce(1), Staged(spark))
    row = index.shards.first().asDict()
    tree = lexical.Tree({**row, "doc_ids": np.array(row["doc_ids"])})
    bags = [Counter(terms(d[1])) for d in docs]
    for word in ("w0", "w7", "w60", "ñ"):
        term = lexical.hashed_terms(pa.array([word]))[0]
        start, end = (int(x[0]) for x in tree.stretches(term))
        assert list(tree.impacts[0, start:end]) == sorted(tree.impacts[0, start:end], reverse=True)
        found = []
        for place in range(start, end):  # down the tree, bit by bit
            doc, at = 0, place
            for level in range(tree.depth):
                one = int(tree.ones[level, at + 1] - tree.ones[level, at])
                at = int(tree.zeros[level] + tree.ones[level, at]) if one else int(at - tree.ones[level, at])
                doc = 2 * doc + one
            found.append(int(tree.doc_ids[doc]))
        assert sorted(found) == [i for i, b in enumerate(bags) if word in b]


def test_bounds_leave_most_of_a_shard_unopened(spark, monkeypatch):
    docs = [(i, "common " * (1 + i % 5) + (f"rare{i}" if i % 50 else "rare"), "x", 1) for i in range(2000)]
    index = lexical.build_index(spark.createDataFrame(docs, DOCS).coalesce(1), Staged(spark))
    row = index.shards.first().asDict()
    tree, seen = lexical.Tree({**row, "doc_ids": np.array(row["doc_ids"])}), []
    real = tree.ones

    class Watched:
        def __getitem__(self, key):
            seen.append(len(np.atleast_1d(key[0])))
            return real[key]

    tree.ones = Watched()
    none = np.zeros(0, np.int64)
    word = lexical.hashed_terms(pa.array(["rare common"]))[0]
    found = lexical.search_shard(tree, np.zeros(2, np.int64), word, np.array([9000, 1]), (none, none, none), 10, 1)
    assert len(found[0]) == 10 and all(d % 50 == 0 for d in found[2])
    assert sum(seen) < 4 * 2000  # about 16,000 with all nodes, for both terms at both ends


def test_few_shards_are_held_at_once(spark, tmp_path):
    """Row groups of few shards, and lots that come to the search in parts."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * 7) % 5000}" for j in range(400))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    staged = Staged(spark)
    index = lexical.build_index(docs, staged, 300_000)
    files = [f for f in spark.read.parquet(f"{staged.root}/index").inputFiles()]
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    assert index.n_shards > 20 and sum(g.num_rows for g in groups) == index.n_shards

    def noise(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(i).bytes(9_000_000)])], ["b"])

    staged.write(spark.range(0, 12, 1, 1).mapInArrow(noise, "b binary"), "large", wide=True)
    (large,) = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in spark.read.parquet(f"{staged.root}/large").inputFiles()]
    assert max(large.row_group(i).num_rows for i in range(large.num_row_groups)) <= 3
    items = spark.createDataFrame([(1, "w1 w8 w4321"), (2, "w77 nothing")], "item_id long, text string")
    hits = lexical.search(index, items, staged, 10)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroups" not in plan
    few = lexical.ranked(docs, items, 10)  # one shard
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, few.collect()))
