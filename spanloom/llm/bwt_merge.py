"""Substring deduplication by merging the Burrows-Wheeler transforms of shards.

The distinct segments routed to a bin (see ``repeats``) are cut into shards, and each shard sorts
its own suffixes. The merged order is then found without sorting all suffixes again: an interleave
says for each place of the merged order which shard's next suffix stands there. Starting from the
concatenation of the shards, each round moves every place by the symbols that stand to the left of
its suffix (the transform's column), stably, which makes an interleave that is right for h symbols
right for h + q. Places that agree on all symbols so far share a block; after T symbols the blocks
are the sets of suffixes with a common prefix of T or more, and the blocks of two or more the
repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Staged, chunks, partitions, utf8
from spanloom.llm.fm_index import NO_OWNER, spans_of
from spanloom.llm.repeats import BYTES, SPAN, identified, lone, marked, repeats


def numbered(code: np.ndarray) -> np.ndarray:
    """Numbers codes from 0 in their order; codes leave room for a position in 63 bits."""
    shift = max(1, len(code).bit_length())
    packed = np.sort((code << shift) | np.arange(len(code)))
    order, value = packed & ((1 << shift) - 1), packed >> shift
    new = np.zeros(len(code), np.int64)
    new[1:] = value[1:] != value[:-1]
    out = np.empty(len(code), np.int64)
    out[order] = np.cumsum(new)
    return out


def paired(number: np.ndarray, step: int, turned: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Numbers the strings of a position's string and the one ``step`` places on."""
    return numbered(number * (int(number.max()) + 1) + turned(number, step))


def extended(number: np.ndarray, length: int, depth: int, turned: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Numbers the strings of ``depth`` symbols at each position, from those of ``length`` (prefix doubling)."""
    while length < depth:
        step = min(length, depth - length)
        number, length = paired(number, step, turned), length + step
    return number


def merge_shards(shards: list[np.ndarray], depth: int, stride: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Merged order of all suffixes of the shards by ``depth`` symbols.

    shards: texts of dense symbols. Returns for each place of the merged order the position in the
    concatenation of the texts, and the number of its block of suffixes that share ``depth`` symbols.
    A round of the refinement takes up to ``stride`` symbols, so strings of that length are numbered
    first; each shard sorts its own suffixes from these numbers.
    """
    total, text = sum(map(len, shards)), np.concatenate(shards)
    shift = max(1, total.bit_length())
    lengths = np.array([len(t) for t in shards])
    first = np.concatenate(([0], np.cumsum(lengths)))
    base, size, place = np.repeat(first[:-1], lengths), np.repeat(lengths, lengths), np.arange(total)

    def turned(x: np.ndarray, k: int) -> np.ndarray:
        """The value k places on in the own shard, round its end."""
        return x[base + (place - base + k) % size]

    bits = max(1, int(text.max()).bit_length())
    length = base_length = min(depth, (62 - shift) // bits)
    code = np.zeros(total, np.int64)
    for k in range(length):
        code = (code << bits) | turned(text, k)
    numbers = {length: numbered(code)}
    while length * 2 <= min(stride, depth):
        numbers[length * 2] = paired(numbers[length], length, turned)
        length *= 2
    orders = [np.argsort(extended(numbers[length][a : a + n], length, depth, lambda x, k: np.roll(x, -k)), kind="stable") for a, n in zip(first, lengths, strict=False)]
    suffix = np.concatenate([o + a for o, a in zip(orders, first, strict=False)])
    rest = depth % length
    if 0 < rest < base_length:
        numbers[rest] = numbered(code >> (bits * (base_length - rest)))
    elif rest:
        short = max(k for k in numbers if k <= rest)
        numbers[rest] = extended(numbers[short], short, rest, turned)
    strides = [length] * (depth // length) + [rest] * (rest > 0)
    columns = {s: turned(numbers[s], -s)[suffix] for s in set(strides)}  # what stands to the left of each suffix
    mask = (1 << shift) - 1
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), lengths)
    taken, block = place.copy(), np.zeros(total, np.int64)  # taken: which suffix, by shard and local rank, stands at a place
    for s in strides:
        moved = np.sort((columns[s][taken] << shift) | place)
        order, code = moved & mask, moved >> shift
        shard, block = shard[order], block[order]
        new = np.ones(total, bool)
        new[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new) - 1
        taken = np.empty(total, np.int64)
        taken[np.argsort(shard, kind="stable")] = place  # each shard's suffixes stand in their own order
    return suffix[taken], block


def repeated_windows(contents: list[bytes], copies: np.ndarray, window: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the concatenated contents whether its window occurs twice or more."""
    lengths = np.array([len(x) for x in contents])
    raw = np.frombuffer(b"".join(contents), np.uint8)
    dense = np.zeros(256, np.int64)
    used = np.unique(raw)
    dense[used] = np.arange(1, len(used) + 1)
    row = np.repeat(np.arange(len(contents)), lengths)
    spot = np.arange(len(raw)) + row  # a 0 stands after each content
    text = np.zeros(len(raw) + len(contents), np.int64)
    text[spot] = dense[raw]
    ends = np.cumsum(lengths + 1)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(shard_bytes, ends[-1], shard_bytes)) + 1, len(ends)))
    where, block = merge_shards(np.split(text, ends[cuts[cuts < len(ends)] - 1]), window)
    weight = np.zeros(len(text), np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(raw))
    weight[spot] = np.where(left >= window, copies[row], 0)
    often = np.bincount(block, weights=weight[where]) >= 2
    hit = np.zeros(len(text), bool)
    hit[where] = often[block] & (weight[where] > 0)
    return hit[spot], lengths


def repeated_bytes(rows: DataFrame, staged: Staged, window: int = 200, gram: int = 24, bin_bytes: int = 400_000, shard_bytes: int = 65_536) -> DataFrame:
    """Byte ranges (id, rid, start, end) of windows of rows (id, rid, doc_id, text) that occur anywhere else too."""

    def merge(table: pa.Table) -> pa.Table:
        contents = table.column("content").to_pylist()
        key, digest, copies = (table.column(c).to_numpy() for c in ("key", "digest", "copies"))
        alone = lone(key)  # windows of a lone content occur as often as it does
        own = np.flatnonzero(alone & (copies > 1))
        out = [(own, np.zeros(len(own), np.int64), np.array([len(contents[i]) - window for i in own], np.int64))]
        rest = np.flatnonzero(~alone)
        if len(rest):
            hit, lengths = repeated_windows([contents[i] for i in rest], copies[rest], window, shard_bytes)
            row, first, last, _ = spans_of(np.where(hit, 0, NO_OWNER), lengths)
            out.append((rest[row], first, last))
        row, first, last = (np.concatenate([x[k] for x in out]) for k in range(3))
        return pa.table({"key": pa.array(key[row]), "digest": pa.array(digest[row]), "first": pa.array(first), "last": pa.array(last), "owner": pa.array(np.zeros(len(row), np.int64))})

    def solve(contents: DataFrame, size: int) -> DataFrame:
        bins = max(4 * partitions(rows.sparkSession), size // bin_bytes + 1)
        return contents.withColumn("bin", F.expr(f"pmod(xxhash64(key), {bins})")).groupBy("bin").applyInArrow(merge, SPAN)

    return repeats(rows, staged, BYTES, window, gram, 2 * bin_bytes, solve).select("id", "rid", "start", "end")


def cut(spans: list[tuple[int, int]], own: np.ndarray) -> tuple[bytes, int]:
    """What is left of a text without the byte ranges, and the number of maximal ranges."""
    at, pieces, runs, end = 0, [], 0, -1
    for start, stop in sorted(spans):
        if start > end:
            runs += 1
            pieces.append(own[at:start])
        end = max(end, stop)
        at = end
    pieces.append(own[at:])
    return b"".join(p.tobytes() for p in pieces), runs


def cut_rows(docs: DataFrame, window: int = 200, as_text: bool = False, bin_bytes: int = 400_000) -> DataFrame:
    """suffix_dedup for whole rows: (row, n_bytes, n_removed, n_spans, kept_sha256, kept), row a struct of the other columns.

    as_text: kept is a string; a character that a cut splits goes as a whole. bin_bytes: about what
    one task merges; a key may hold twice that before it is refined.
    """
    staged = Staged(docs.sparkSession)
    rows = marked(identified(docs, F.struct(*[c for c in docs.columns if c != "text"]).alias("row")))
    # of a hot text one row is routed, the smallest; all copies lose all of it
    routed = rows.where("first_id is null or first_id <=> doc_id").select("id", "rid", "doc_id", "text")
    spans = repeated_bytes(routed, staged, window, bin_bytes=bin_bytes).groupBy("id", "rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, ["id", "rid"], "left").select("row", "text", F.col("first_id").isNotNull().alias("copy"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                data, offs = utf8(batch.column("text"))
                spans, copies = batch.column("spans").to_pylist(), batch.column("copy").to_pylist()
                n, runs, digests, kept, removed = [], [], [], [], []
                for i in range(len(batch)):
                    own = data[offs[i] : offs[i + 1]]
                    left, count = cut([(0, len(own))] if copies[i] and len(own) >= window else [(x["start"], x["end"]) for x in spans[i] or ()], own)
                    n.append(len(own))
                    removed.append(len(own) - len(left))
                    runs.append(count)
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode("utf-8", "ignore") if as_text else left)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string() if as_text else pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}")


def suffix_dedup(docs: DataFrame, window: int = 200, bin_bytes: int = 400_000) -> DataFrame:
    """Removes bytes covered by a ``window``-byte string that also starts anywhere else in the table.

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row for each row of docs;
    kept is binary, as a cut may split a character. Null texts are empty; repeated rows hold each
    other's strings and so lose them; matches never cross rows. Texts of any length are searched
    whole, in pieces of some ``window`` bytes; a document itself is cut in one task. Other columns
    are ignored, whatever their names. Empty tables give no rows.
    """
    return cut_rows(docs.select("doc_id", "text"), window, bin_bytes=bin_bytes).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
