import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import bwt_merge, fm_index, repeats
from spanloom.llm.common import Staged

DOCS = "doc_id long, text string, extra string"


def make(seed):
    """Documents with shared passages, copies, periodic text, nulls and odd white space."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 6)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [word() for _ in range(rng.randint(0, 40))] + rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "\t  "]).join(words), "x"))
    rows += [(100 + k, rows[3][1], None) for k in range(70)]  # a hot text
    rows += [(200, None, "a"), (201, "", "a"), (202, "one two", "a"), (203, "ab " * 300, "a"), (204, "abcabc" * 100, "a"), (None, rows[5][1], "a"), (5, rows[5][1], "a"), (205, "nul\x00 " * 60, "a")]
    return rows


def brute_words(rows, window=50):
    """Rows by doc_id and text, as (n_words, n_removed, sha256)."""
    split = [(i, (t or "").encode().split()) for i, t, _ in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows, window=200):
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    count = Counter(b[k : k + window] for _, b in raw for k in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_words_against_brute_force(spark, seed):
    rows = make(seed)
    got = fm_index.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_against_brute_force(spark, seed):
    rows = make(seed)
    got = bwt_merge.suffix_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_full_keys_are_refined_without_loss(spark, seed):
    """A bound of some hundred bytes makes nearly every key too large, so all levels are in use."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(70)]
    rows = [(i, " ".join([f"w{rng.random()}" for _ in range(30)] + passage[: rng.randint(40, 70)] + [f"w{rng.random()}" for _ in range(30)]), "") for i in range(300)]
    rows += make(seed)[:40]
    df = spark.createDataFrame(rows, DOCS)
    got = fm_index.substring_dedup(df, shard_bytes=500).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows)
    got = bwt_merge.suffix_dedup(df, bin_bytes=500).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)


def test_a_shared_passage_is_routed_by_pieces_not_by_windows(spark):
    """1,000 documents share 2,000 bytes: some 1,800 windows of each go in at most 60 segments."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(150)) + passage + "".join(rng.choice("ijklmnop ") for _ in range(150)), "") for i in range(1000)]
    staged = Staged(spark)
    found = repeats.repeated_segments(repeats.identified(spark.createDataFrame(rows, DOCS)), staged, repeats.BYTES, 200, 24)
    assert 1000 * 10 <= found.count() <= 1000 * 60
    bodies = staged.write(repeats.with_symbols(repeats.identified(spark.createDataFrame(rows, DOCS)), found, repeats.BYTES, 200), "bodies")
    assert bodies.groupBy("key", "digest").count().count() <= 1000 * 12  # what lies inside the passage counts once


def test_words_with_one_hash_are_told_apart(spark):
    """A Thue-Morse word and its complement collide in any polynomial hash modulo 2^64."""
    morse = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    values = [repeats.WORDS.values(np.frombuffer(x.encode(), np.uint8), np.array([0, 1024]))[0] for x in (morse, other)]
    assert values[0] == values[1]
    for first, second in ((morse, other), (other, morse)):
        rows = [(1, " ".join([first] + ["x%d" % k for k in range(49)]), ""), (2, " ".join([second] + ["x%d" % k for k in range(49)]), "")]
        rows += [(3, " ".join([first] * 50), ""), (4, " ".join([second] * 50), ""), (5, " ".join([first] * 50), "")]
        got = fm_index.substring_dedup(spark.createDataFrame(rows, DOCS)).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows)
        got = bwt_merge.suffix_dedup(spark.createDataFrame(rows, DOCS)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows)


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(30_000)]
    rows = [(1, " ".join(words), "r", 1), (2, "x " + " ".join(words[200:300]) + " y", "r", 2), (3, "y" * 300_000, "s", 3), (4, " ".join(words[29_900:] + words[:100]), "s", 4)]
    df = spark.createDataFrame([(a, b, c, d, d, c) for a, b, c, d in rows], "doc_id long, text string, spans string, rid int, id int, `row` string")
    got = fm_index.substring_dedup(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words([r[:3] for r in rows])
    got = bwt_merge.suffix_dedup(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes([r[:3] for r in rows])
    kept = bwt_merge.cut_rows(df).select("row.*").columns
    assert kept == ["doc_id", "spans", "rid", "id", "row"]


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert fm_index.substring_dedup(df).count() == 0
    assert bwt_merge.suffix_dedup(df).count() == 0


def test_wavelet_rank():
    x = np.random.default_rng(1).integers(0, 37, 500)
    w = fm_index.WaveletMatrix(x, 6)
    symbols, places = np.random.default_rng(2).integers(0, 37, 300), np.random.default_rng(3).integers(0, 501, 300)
    assert w.rank(symbols, places).tolist() == [int((x[:p] == s).sum()) for s, p in zip(symbols, places)]


def test_index_finds_windows_of_texts_that_are_not_in_it():
    rng = np.random.default_rng(4)
    contents = [rng.integers(1, 5, n).astype(np.uint64) for n in (30, 12, 40)]
    index, alphabet = fm_index.index_of(contents, np.array([7, 3, 9]), 6)
    query = rng.integers(1, 6, 400).astype(np.uint64)
    coded = np.searchsorted(alphabet, query) + 1
    coded[~np.isin(query, alphabet)] = 0
    found = index.windows(coded, np.array([0, 150, 400]))
    for k in range(400):
        own = query[k : k + 6].tolist()
        inside = (k + 6 <= 150) if k < 150 else k + 6 <= 400
        owners = [o for c, o in zip(contents, (7, 3, 9)) if any(c[j : j + 6].tolist() == own for j in range(len(c) - 5))]
        assert found[k] == (min(owners) if inside and owners else fm_index.NO_OWNER)


def test_merged_order_is_the_order_of_all_suffixes():
    rng = np.random.default_rng(5)
    shards = [np.append(rng.integers(1, 4, n), 0) for n in (40, 25, 60)]
    where, block = bwt_merge.merge_shards(shards, 9)
    whole, first, texts = np.concatenate(shards), 0, {}
    for t in shards:
        for k in range(len(t)):
            texts[first + k] = tuple(np.roll(t, -k)[:9].tolist())
        first += len(t)
    order = [texts[int(p)] for p in where]
    assert order == sorted(order) and sorted(where.tolist()) == list(range(len(whole)))
    assert all((block[k] == block[k + 1]) == (order[k] == order[k + 1]) for k in range(len(order) - 1))
