"""Substring deduplication with a compressed FM-index per shard.

Each shard holds the distinct segments routed to it (see ``repeats``). Its index is the
Burrows-Wheeler transform of their word numbers in a wavelet matrix of packed bits with counts
per 64 bits. Documents' segments stream through it by backward search, all in step; the matching
statistics, cut at the window length T, tell for each position whether T words match and the
range of suffixes that match, whose smallest doc_id owns the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Staged, chunks, partitions, ranges, utf8, word_spans
from spanloom.llm.repeats import SPAN, WORDS, binary, identified, lone, marked, repeats

NO_OWNER = np.int64(np.iinfo(np.int64).max)


class WaveletMatrix:
    """Rank over a sequence of small integers, one packed bit row per level."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, now = bits, [], symbols.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words))[:-1])).astype(np.int64)
            self.levels.append((level, words, before, int(len(bit) - bit.sum())))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.origin = self._descend(np.arange(1 << bits) if bits <= 22 else np.unique(symbols), 0)

    def _descend(self, symbol: np.ndarray, at) -> np.ndarray:
        i = np.full(len(symbol), at, np.int64) if np.isscalar(at) else at
        for level, words, before, zeros in self.levels:
            ones = before[i >> 6] + np.bitwise_count(words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.origin[symbol]


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first ``depth`` symbols, a power of two, by prefix doubling."""
    rank, step = text.astype(np.int64), 1
    while step < depth:
        second = np.zeros_like(rank)
        second[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + second, return_inverse=True)[1]
        step *= 2
    return rank


class FMIndex:
    """Index of segments of symbols 1.. parted by 0, exact for patterns of up to ``window`` symbols."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, window: int):
        """owner: for each position the number that the best (smallest) one of a match is asked for."""
        self.window, n = window, len(text)
        half = 1 << ((window - 1).bit_length() - 1) if window > 1 else 1
        rank = suffix_ranks(text, half)

        def at(depth: int) -> np.ndarray:
            shifted = np.zeros_like(rank)
            if n > depth - half:
                shifted[: n - (depth - half)] = rank[depth - half :] + 1
            return rank * (n + 2) + shifted

        full, less = at(window), at(max(window - 1, half))
        order = np.argsort(full, kind="stable")
        new = np.ones(n + 1, bool)
        new[1:n] = full[order[1:]] != full[order[:-1]]
        self.group = np.cumsum(new[:n]) - 1
        firsts = np.flatnonzero(new[:n])
        self.owner = np.minimum.reduceat(owner[order], firsts)
        new[1:n] = less[order[1:]] != less[order[:-1]]
        edges = np.append(np.flatnonzero(new[:n]), n)
        parent = np.cumsum(new[:n]) - 1
        self.low, self.high = edges[parent], edges[parent + 1]
        bwt = text[order - 1]
        sigma = int(text.max()) + 1
        self.sigma, self.size = sigma, n
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.wavelet = WaveletMatrix(bwt, max(1, (sigma - 1).bit_length()))

    def windows(self, queries: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each position of the queries the owner of the window that starts there, NO_OWNER if none.

        Matching statistics by backward search: a match grows to the left; at full length it
        first drops its last symbol. Where it can't grow, no window holds the whole of it and
        the symbol before, so the search goes on from one symbol less on the right.
        """
        window, out = self.window, np.full(len(queries), NO_OWNER)
        left = offs[1:].astype(np.int64).copy()
        base = offs[:-1]
        lane = np.flatnonzero(left - base >= window)
        left, base = left[lane], base[lane]
        depth, lo, hi = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64), np.full(len(lane), self.size)
        while len(lane):
            c = queries[left - 1]
            full = depth == window
            if full.any():
                lo, hi, depth = np.where(full, self.low[np.minimum(lo, self.size - 1)], lo), np.where(full, self.high[np.minimum(lo, self.size - 1)], hi), depth - full
            known = (c > 0) & (c < self.sigma)
            s = np.where(known, c, 0)
            new_lo = self.before[s] + self.wavelet.rank(s, lo)
            new_hi = self.before[s] + self.wavelet.rank(s, hi)
            grew = known & (new_lo < new_hi)
            end = np.where(grew, left + depth, left + depth - 1)
            left = np.where(grew, left - 1, end)
            depth = np.where(grew, depth + 1, 0)
            lo, hi = np.where(grew, new_lo, 0), np.where(grew, new_hi, self.size)
            got = depth == window
            out[left[got]] = self.owner[self.group[lo[got]]]
            stay = (end - base >= window) & ~(got & (left == base)) & (left > base)
            if not stay.all():
                lane, left, base, depth, lo, hi = (x[stay] for x in (lane, left, base, depth, lo, hi))
        return out


def index_of(contents: list[np.ndarray], owners: np.ndarray, window: int) -> tuple[FMIndex, np.ndarray]:
    """Index of segments and its alphabet (sorted values; number 0 parts segments)."""
    alphabet = np.unique(np.concatenate(contents))
    lengths = np.array([len(x) for x in contents])
    text = np.zeros(int(lengths.sum() + len(contents)) + 1, np.int64)
    at = 1 + np.cumsum(lengths + 1) - lengths - 1
    owner = np.full(len(text), NO_OWNER)
    for x, a, o in zip(contents, at, owners, strict=True):
        text[a : a + len(x)] = np.searchsorted(alphabet, x) + 1
        owner[a : a + len(x)] = o
    return FMIndex(text, owner, window), alphabet


def spans_of(owner: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of equal owners within each segment: segment, first and last window, owner."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = np.flatnonzero(owner != NO_OWNER)
    if not len(keep):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(keep), bool)
    new[1:] = (np.diff(keep) != 1) | (np.diff(row[keep]) != 0) | (np.diff(owner[keep]) != 0)
    first = keep[new]
    last = np.append(keep[np.flatnonzero(new)[1:] - 1], keep[-1])
    return row[first], at[first], at[last], owner[first]


def word_numbers(contents: pa.Array) -> list[np.ndarray]:
    """Words of each content as numbers from 1, told apart by their bytes."""
    data, offs = utf8(contents)
    starts, ends, rows = word_spans(data, offs)
    words = binary(data[ranges(starts, ends - starts)], np.cumsum(ends - starts))
    return np.split(words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1, rows[1:-1])


def repeated_words(rows: DataFrame, staged: Staged, window: int = 50, gram: int = 12, shard_bytes: int = 1_400_000) -> DataFrame:
    """Word ranges (id, rid, start, end) of windows of rows (id, rid, doc_id, text) that a document with a smaller id holds."""

    def search(table: pa.Table) -> pa.Table:
        owners, key, digest = (table.column(c).to_numpy() for c in ("owner", "key", "digest"))
        words = word_numbers(table.column("content").combine_chunks())
        alone = lone(key)  # all windows of a lone content have its owner
        own = np.flatnonzero(alone)
        out = [(own, np.zeros(len(own), np.int64), np.array([len(words[i]) - window for i in own], np.int64), owners[own])]
        rest = np.flatnonzero(~alone)
        if len(rest):
            some = [words[i] for i in rest]
            index, alphabet = index_of(some, owners[rest], window)
            lengths = np.array([len(x) for x in some])
            queries = np.searchsorted(alphabet, np.concatenate(some)) + 1
            row, first, last, owner = spans_of(index.windows(queries, np.concatenate(([0], np.cumsum(lengths)))), lengths)
            out.append((rest[row], first, last, owner))
        row, first, last, owner = (np.concatenate([x[k] for x in out]) for k in range(4))
        return pa.table({"key": pa.array(key[row]), "digest": pa.array(digest[row]), "first": pa.array(first), "last": pa.array(last), "owner": pa.array(owner)})

    def solve(contents: DataFrame, size: int) -> DataFrame:
        shards = max(4 * partitions(rows.sparkSession), size // shard_bytes + 1)
        return contents.withColumn("shard", F.expr(f"pmod(xxhash64(key), {shards})")).groupBy("shard").applyInArrow(search, SPAN)

    # only spans that someone else may lose matter; the smallest document of a window keeps it
    return repeats(rows, staged, WORDS, window, gram, shard_bytes, solve).where("owner < id").select("id", "rid", "start", "end")


def cut_words(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Removes the word ranges from each document, all words from a copy, and digests what is left."""
    for whole in batches:
        for batch in chunks(whole, "text"):
            data, offs = utf8(batch.column("text"))
            starts, ends, rows = word_spans(data, offs)
            raw, spans, copies = data.tobytes(), batch.column("spans").to_pylist(), batch.column("copy").to_pylist()
            n, removed, digests, kept = [], [], [], []
            for i in range(len(batch)):
                low, high = int(rows[i]), int(rows[i + 1])
                gone = np.zeros(high - low + 1, np.int32)
                if copies[i] and high - low >= window:
                    gone[0] = 1
                for x in spans[i] or ():
                    gone[x["start"]] += 1
                    gone[x["end"]] -= 1
                left = np.flatnonzero(np.cumsum(gone)[: high - low] == 0) + low
                text = b" ".join([raw[a:b] for a, b in zip(starts[left].tolist(), ends[left].tolist(), strict=True)])
                n.append(high - low)
                removed.append(high - low - len(left))
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, window: int = 50, shard_bytes: int = 1_400_000) -> DataFrame:
    """Removes words covered by a window of ``window`` words that a document with a smaller doc_id holds.

    Returns (doc_id, n_words, n_removed, kept_sha256, kept), a row for each row of docs.
    A null text has no words. A null doc_id is no smaller one and loses nothing. Rows that repeat
    a doc_id are kept as they are, since none has the smaller id. Words are compared by their bytes.
    Texts of any length are searched whole, in pieces of some ``window`` words; a document itself is
    cut in one task. Empty tables give no rows; columns other than doc_id and text are ignored,
    whatever their names. shard_bytes: about what one index holds, and the most that a key may hold
    before it is refined.
    """
    staged = Staged(docs.sparkSession)
    rows = marked(identified(docs)).withColumn("copy", F.coalesce(F.expr("first_id < doc_id"), F.lit(False)))
    spans = repeated_words(rows.where("doc_id is not null and not copy"), staged, window, shard_bytes=shard_bytes).groupBy("id", "rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, ["id", "rid"], "left").select("doc_id", "text", "copy", F.expr("if(doc_id is null, null, spans)").alias("spans"))
    return joined.mapInArrow(lambda batches: cut_words(batches, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
