"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words of a document, its word pairs, pairs with one word between, and
word stems (the first bytes of longer words, an n-gram backoff for inflected forms), each hashed to
64 bits. Learning rates are per coordinate; L1 leaves few weights other than zero, which every
task gets as two short arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_values, chunks, lowest, mix, prefix_sums, span_hash, utf8, word_spans
from spanloom.sources.shipping import ship

STEMS = (4, 5, 6)
_PARTS = np.ones(256, bool)
_PARTS[128:] = False
_PARTS[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'", np.uint8)] = False
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_U = np.uint64
MODEL = "feature long, weight double"


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features, repeats included, and the row of each."""
    data = _LOWER[data]
    starts, ends, rows = word_spans(data, offs, _PARTS)
    sums = prefix_sums(byte_values(data))
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    words = span_hash(sums, starts, ends)
    out, where = [words], [row]
    for gap in (1, 2):  # word pairs; with one word between
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            out.append(mix(words[:-gap][same] * _U(2 * gap + 1) + words[gap:][same] * _U(0xD6E8FEB86659FD93)))
            where.append(row[gap:][same])
    for size in STEMS:
        longer = ends - starts > size
        out.append(span_hash(sums, starts[longer], starts[longer] + size) ^ _U(size))
        where.append(row[longer])
    return np.concatenate(out), np.concatenate(where)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights of ``size`` binary features and the bias. rows: the feature numbers of each document."""
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    shuffle = np.random.default_rng(7)
    bias = 0.0
    for _ in range(epochs):
        for d in shuffle.permutation(len(rows)):
            i = rows[d]
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[d]
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[i] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, bias


def train(sample: DataFrame, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0, epochs: int = 8, least: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits the model to a bounded sample (text, toxic): feature hashes in order, weights, bias."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, labels = [], [], []
        for whole in batches:
            for batch in chunks(whole, "text"):
                labels += batch.column("toxic").to_pylist()
                h, row = features(*utf8(batch.column("text")))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                rows += np.split(h[new], np.searchsorted(row[new], np.arange(1, len(batch))))
        if not rows or len(set(labels)) < 2:
            return
        known, count = np.unique(np.concatenate(rows), return_counts=True)
        known = known[count >= least]
        for h in rows:
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hashes.append(at[known[at] == h] if len(known) else at[:0])
        y = np.array(labels, float)
        w, bias = ftrl(hashes, y, len(known), alpha, beta, l1, l2, epochs)
        kept = np.flatnonzero(w)
        feature = np.append(known[kept].view(np.int64), 0)
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(np.append(w[kept], bias))], ["feature", "weight"])

    # rows arrive in any order and the updates depend on it, so they are put in one order first
    order = sample.select("text", "toxic").repartition(1).sortWithinPartitions(F.xxhash64("text"), "toxic", "text")
    got = order.mapInArrow(fit, MODEL).toPandas()
    bias = float(got.weight.iloc[-1]) if len(got) else -35.0
    hashes = got.feature.to_numpy(np.int64)[:-1].view(np.uint64) if len(got) else np.zeros(0, np.uint64)
    order = np.argsort(hashes)
    return hashes[order], got.weight.to_numpy(float)[:-1][order] if len(got) else np.zeros(0), bias


def training_sample(docs: DataFrame, labels: DataFrame, positives: int, negatives: int, longest: int) -> tuple[DataFrame, float]:
    """A sample (text, toxic) of labelled rows, at most ``positives`` and ``negatives`` of either class, and how the log-odds of class 1 among all of them differ from the sample's.

    Rows whose crc32(doc_id as text) leaves 2 modulo 4 are held out. The rows of lowest hash are
    taken, so reruns agree. The ids are broadcast: the two parameters bound their number. Each id
    gives one row, of those of up to ``longest`` characters, so the texts are bounded as well.
    """
    usable = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    n = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [lowest(usable.where(F.col("toxic") == k), "doc_id", most, n.get(k, 0)) for k, most in ((1, positives), (0, negatives))]
    ids = parts[0].unionByName(parts[1])
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest).join(F.broadcast(ids), "doc_id")
    some = some.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    shares = [max(1, n.get(k, 0)) / max(1, min(n.get(k, 0), most)) for k, most in ((1, positives), (0, negatives))]
    return some, float(np.log(shares[0] / shares[1]))


def scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., score): the probability of class 1 for each whole text."""
    hashes, weights, bias = model
    sieve = np.zeros(1 << 20, bool)
    sieve[(hashes >> _U(44)).astype(np.int64)] = True
    sieve = np.packbits(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(sieve).astype(bool)
        for whole in batches:
            for batch in chunks(whole, "text"):
                h, row = features(*utf8(batch.column("text")))
                hit = np.flatnonzero(maybe[(h >> _U(44)).astype(np.int64)])
                total = np.full(len(batch), bias)
                if len(hit) and len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h[hit]), len(hashes) - 1)
                    true = hashes[at] == h[hit]
                    pairs = np.unique(row[hit][true] * len(hashes) + at[true])
                    total += np.bincount(pairs // len(hashes), weights=weights[pairs % len(hashes)], minlength=len(batch))
                p = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(p)], [*keep, "score"])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, positives: int = 4000, negatives: int = 8000, longest: int = 50_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Scores every whole text for toxicity after learning from the labelled rows that aren't held out.

    Returns (keep..., held_out, score, predicted), a row for each row of docs. Null and empty texts
    get the score of no features. Without rows of both classes all scores are near 0. Ids without a
    document, null labels and labels other than 0 and 1 are ignored, as are other columns, whatever
    their names; of several labels of one id the highest counts. Where the bounds of the sample
    (``positives``, ``negatives``; texts of up to ``longest`` characters) change the share of class
    1, the bias is set back to the share among all usable labels. Texts of any length are scored
    whole. An empty table of documents gives no rows.
    """
    ship(docs.sparkSession)
    sample, shift = training_sample(docs, labels, positives, negatives, longest)
    hashes, weights, bias = train(sample)
    scored = scores(docs, (hashes, weights, bias + shift), keep)
    return scored.select(*keep, F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
