import random

import numpy as np
import xxhash

from spanloom.llm import simhash


def brute(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 50)}" for _ in range(900)]
    texts = [None, "", " \n", "One", "one two", "ONE TWO three", "É one two"]
    for _ in range(60):
        words = list(base)
        words[rng.randrange(900)] = "changed"
        texts.append(" ".join(words))
    texts += [" ".join(f"v{rng.random()}" for _ in range(30)) for _ in range(40)] + [texts[-1]] * 3
    rows = [(i * 3 % 997, t, "src") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    prints = {i: brute(t) for i, t, _ in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    ids = sorted(prints)
    least = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    least[a] = min(least[a], least[b])
    assert {i: r.component_id for i, r in got.items()} == least


def test_pairs_of_one_node_within_the_budget():
    value = np.unique(np.random.default_rng(2).integers(0, 1 << 12, 300).astype(np.uint64))
    node = np.zeros(len(value), np.int64)
    node[100:] = 1
    a, b = simhash.near_pairs(node, value, 12, 2)
    want = {(i, j) for i in range(len(value)) for j in range(i) if node[i] == node[j] and int(value[i] ^ value[j]).bit_count() <= 2}
    assert {(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want


def test_near_copies_keep_one_of_each_group(spark):
    rng = random.Random(3)
    fresh = lambda: [f"w{rng.random()}" for _ in range(300)]
    base, rows = fresh(), []
    for i in range(20):
        words = list(base)
        if i:
            words[rng.randrange(300)] = "changed"
        rows.append((i + 10, " ".join(words), i))
    rows += [(100 + i, " ".join(fresh()), i) for i in range(30)] + [(5, "", 0), (6, None, 0), (100, rows[0][1], 9), (None, rows[0][1], 9)]
    kept = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string, row long")).collect()
    assert sorted(r.doc_id for r in kept) == [5, 10, *range(100, 130)]
    assert simhash.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def jaccard(a, b, shingle=5):
    sets = [{tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_in_a_crowd_on_one_template_are_all_found(spark):
    rng = random.Random(4)
    boiler = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(1200):  # alike by about 0.6, so that all crowd the same nodes and none links
        words = [*boiler[:100], *(f"x{i}-{k}" for k in range(45)), *boiler[100:]]
        rows.append((i, " ".join(words)))
        if i % 3 == 0:  # a near copy a little above or below the bound
            for k in rng.sample(range(len(words)), 5 if i % 2 else 7):
                words[k] = f"y{i}-{k}"
            rows.append((10_000 + i, " ".join(words)))
    assert 0.5 < jaccard(rows[0][1], rows[2][1]) < 0.75
    texts = dict(rows)
    near = {i for i in texts if i >= 10_000 and jaccard(texts[i], texts[i - 10_000]) >= 0.8}
    assert 100 < len(near) < 400
    kept = {r.doc_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == texts.keys() - near


def test_a_dominating_run_or_a_repeated_passage_does_not_decide(spark):
    rng = random.Random(5)
    run = " ha" * 400
    rows = [(i, " ".join(f"w{i}-{k}" for k in range(60)) + run) for i in range(4)]  # one shingle is over half of each text
    passage = " ".join(f"p{rng.random()}" for _ in range(50))
    for i in range(10, 14):  # the same distinct shingles but for the seams
        other = " ".join(f"q{i}-{k}" for k in range(200))
        rows += [(i, f"{passage} {other} {passage}"), (i + 100, f"{passage} {other}{f' {passage}' * 40}")]
    assert all(jaccard(rows[k][1], rows[k + 1][1]) > 0.95 for k in range(4, 12, 2)) and jaccard(rows[0][1], rows[1][1]) < 0.05
    kept = {r.doc_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 1, 2, 3, 10, 11, 12, 13}


def test_very_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{i % 977} x{i % 13}" for i in range(120_000))
    docs = spark.createDataFrame([(5, long, "f", 1), (3, long.upper(), "f", 1), (9, None, "f", 1), (8, "", "f", 1), (None, "other words of a text", "f", 1)], "doc_id long, text string, fingerprint string, fp int")
    got = {r.doc_id: r for r in simhash.simhash_dedup(docs).collect()}
    assert got[5].component_id == got[3].component_id == 3 and got[5].fingerprint == got[3].fingerprint
    assert got[9].component_id == got[8].component_id == 8 and got[9].fingerprint == "0" * 16 and got[None].component_id is None
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


def test_near_copies_are_linked_by_the_trie_of_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base + ["end"]), " ".join(f"v{rng.randrange(10**6)}" for _ in range(400))]
    seen, real = [], simhash.trie_links
    monkeypatch.setattr(simhash, "trie_links", lambda *a, **b: seen.append(out := real(*a, **b)) or out)
    kept = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    fp = [int(np.array([simhash.majority(np.unique(simhash.shingle_hashes(t.encode(), 5))[:, None])[0]], np.uint64).view(np.int64)[0]) for t in texts]
    assert len(seen) == 1 and {frozenset(r) for r in seen[0].collect()} == {frozenset(fp[:2])}
