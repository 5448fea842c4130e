"""Routing of repeated windows to shards, shared by the two substring operators.

A window is T consecutive symbols (words or bytes) of one document. Each window is keyed by the
smallest hash among its k-symbol grams, so equal windows always carry equal keys, and a run of
neighbouring windows with one key and one gram forms a segment of some T + T/2 symbols. Only
segments whose key occurs more than once can hold a repeated window; their symbols go to the shard
of the key. Equal contents become one row first, so a passage that many documents share is routed
once for each surrounding that differs.

Different contents of one key can still be too many for a task (a common line in surroundings of
their own). A key with more than ``key_bytes`` of them is refined: its segments are aligned at the
gram, and equal windows stand at equal places beside it, so the windows are split into halves by
that place, and each half is keyed anew by all symbols that its windows have in common. Halves that
occur once are dropped, the others are split again while they are too many. The bound is an amount
of data, whatever the size of the table; each content has at most two halves a round, and there are
at most log2(T) + 1 rounds. The spans found in halves are carried back to the contents they are of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Staged, byte_values, chunks, gram_hash, mix, prefix_sums, ranges, span_hash, utf8, word_spans

HOT_TEXTS = 1000
SEGMENT = "key long, id long, rid long, start long, n long, place long"
SPAN = "key long, digest long, first long, last long, owner long"
CONTENT = ["key", "digest", "content", "place", "owner", "copies"]


@dataclass(frozen=True)
class Units:
    """What windows count. values: (bytes, offsets) of texts to symbol hashes and the symbol offsets of the rows.

    packed: (bytes, offsets) to bytes and the place of each symbol in them; symbols a to b are the
    bytes from place[a] to place[b] without the last ``gap``.
    """

    values: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    packed: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    gap: int
    limit: int


def _word_values(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, offs)
    return span_hash(prefix_sums(byte_values(data)), starts, ends), rows


def _words_packed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, each with one space after it."""
    starts, ends, rows = word_spans(data, offs)
    place = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    raw = np.append(data, np.uint8(32))[ranges(starts, ends - starts + 1)]
    raw[place[1:] - 1] = 32
    return raw, place, rows


def _bytes_packed(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return data, np.arange(len(data) + 1), offs


WORDS = Units(_word_values, _words_packed, 1, 1 << 20)
BYTES = Units(lambda data, offs: (byte_values(data), offs), _bytes_packed, 0, 1 << 18)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    done, out = 1, a
    while done * 2 <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = w - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def window_keys(values: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each window of the sequence, its smallest gram hash, and the gram's leftmost position."""
    grams = gram_hash(values, gram)
    if len(grams) < window - gram + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(len(grams).bit_length())
    packed = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(packed, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    return grams[at].view(np.int64), at


def segments(values: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of all rows: key, row, start in the row, number of windows, place of the gram in the segment."""
    n = len(values) - window + 1
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    valid = np.flatnonzero(row[:n] == row[window - 1 :]) if n > 0 else row[:0]
    if not len(valid):
        return (np.zeros(0, np.int64),) * 5
    keys, place = (x[valid] for x in window_keys(values, window, gram))
    cut = np.ones(len(valid), bool)
    cut[1:] = (np.diff(valid) != 1) | (np.diff(place) != 0) | (np.diff(row[valid]) != 0)
    at = np.flatnonzero(cut)
    return keys[at], row[valid[at]], valid[at] - offs[row[valid[at]]], np.diff(np.append(at, len(valid))), place[at] - valid[at]


def marked(docs: DataFrame) -> DataFrame:
    """Adds first_id: for a text that is hot, the smallest doc_id of its copies, else null.

    A text is hot if it makes up more than a HOT_TEXTS-th of the rows, so the list that is broadcast
    has fewer than HOT_TEXTS rows. Exact copies of a hot text need no search: they are routed once.
    """
    keyed = docs.withColumn("text_key", F.xxhash64("text")).withColumn("text_key2", F.xxhash64(F.lit(1), "text"))
    counts = keyed.groupBy("text_key", "text_key2").agg(F.count("*").alias("c"), F.min("doc_id").alias("first_id"))
    total = docs.count()
    hot = counts.where(F.col("c") > max(50, total // HOT_TEXTS)).drop("c")
    return keyed.join(F.broadcast(hot), ["text_key", "text_key2"], "left").drop("text_key", "text_key2")


def lone(key: np.ndarray) -> np.ndarray:
    """Whether a content is the only one of its key, whose windows then occur nowhere else."""
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    return count[inverse] == 1


def route(docs: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """Segments of documents (id, rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", units.limit):
                key, row, start, n, place = segments(*units.values(*utf8(batch.column("text"))), window, gram)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("id").take(rows), batch.column("rid").take(rows), *(pa.array(x.astype(np.int64)) for x in (start, n, place))], ["key", "id", "rid", "start", "n", "place"])

    return docs.select("id", "rid", "text").mapInArrow(run, SEGMENT)


def repeated_segments(docs: DataFrame, staged: Staged, units: Units, window: int, gram: int) -> DataFrame:
    """Segments whose key occurs more than once."""
    rows = staged.write(route(docs, units, window, gram), "segments")
    # staged, so both sides of the join are plain exchanges and a hot key's rows can be split
    counts = staged.write(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "counts")
    found = staged.write(rows.join(counts, "key", "left_semi"), "repeated")
    staged.drop("segments")
    staged.drop("counts")
    return found


def binary(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that stand one after another in raw."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def slices(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    return binary(raw[ranges(low, high - low)], np.cumsum(high - low))


def with_symbols(docs: DataFrame, found: DataFrame, units: Units, window: int) -> DataFrame:
    """Adds the symbols of each segment: (key, digest, id, rid, start, place, content, bytes)."""
    per_doc = found.groupBy("id", "rid").agg(F.collect_set(F.struct("key", "start", "n", "place")).alias("segments"))
    joined = docs.join(per_doc, ["id", "rid"]).select("id", "rid", "text", "segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", units.limit):
                lists = batch.column("segments")
                parts, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(batch)), count)
                key, start, n, place = (parts.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                raw, spots, offs = units.packed(*utf8(batch.column("text")))
                at = offs[row] + start
                for low in range(0, len(at), 20_000):  # bounds the size of one output batch
                    part = slice(low, low + 20_000)
                    content = slices(raw, spots[at[part]], spots[at[part] + n[part] + window - 1] - units.gap)
                    r = pa.array(row[part])
                    yield pa.RecordBatch.from_arrays([pa.array(key[part]), batch.column("id").take(r), batch.column("rid").take(r), pa.array(start[part]), pa.array(place[part]), content], ["key", "id", "rid", "start", "place", "content"])

    out = joined.mapInArrow(run, "key long, id long, rid long, start long, place long, content binary")
    return out.withColumn("digest", F.xxhash64("key", "content")).withColumn("bytes", F.length("content"))


def halves(contents: DataFrame, units: Units, window: int, gram: int, level: int) -> DataFrame:
    """Splits the windows of contents (see CONTENT) by their distance to the gram into ranges half as wide as the level before.

    Returns (parent, parent_digest, shift, key, digest, content, bytes, place, owner, copies).
    """
    most = window - gram
    wide = max(1, 1 << (max(0, most.bit_length() - level)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "content", units.limit):
                data, offs = utf8(batch.column("content"))
                values, rows = units.values(data, offs)
                raw, spots, _ = units.packed(data, offs)
                place = batch.column("place").to_numpy()
                n = np.diff(rows) - window + 1
                low, high = (place - n + 1) // wide, place // wide
                row = np.repeat(np.arange(len(batch)), high - low + 1)
                part = ranges(low, high - low + 1)
                nearest, farthest = part * wide, np.minimum((part + 1) * wide - 1, most)
                a, b = np.maximum(nearest, (place - n + 1)[row]), np.minimum(farthest, place[row])
                shift, base = place[row] - b, rows[:-1][row]
                core = span_hash(prefix_sums(values), base + place[row] - nearest, base + place[row] - farthest + window)
                key = mix(core ^ mix((part * 64 + level).astype(np.uint64))).view(np.int64)
                content = slices(raw, spots[base + shift], spots[base + shift + (b - a) + window] - units.gap)
                r = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(r), batch.column("digest").take(r), pa.array(shift), pa.array(key), content, pa.array(b), batch.column("owner").take(r), batch.column("copies").take(r)],
                    ["parent", "parent_digest", "shift", "key", "content", "place", "owner", "copies"],
                )

    out = contents.select(*CONTENT).mapInArrow(run, "parent long, parent_digest long, shift long, key long, content binary, place long, owner long, copies long")
    return out.withColumn("digest", F.xxhash64("key", "content")).withColumn("bytes", F.length("content"))


def solved(bodies: DataFrame, staged: Staged, units: Units, window: int, gram: int, key_bytes: int, solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Spans (see SPAN) of the contents of bodies, where ``solve`` finds those of keys that fit in a task."""
    now = bodies.groupBy("key", "digest", "content").agg(F.min("place").alias("place"), F.min("owner").alias("owner"), F.sum("copies").alias("copies"))
    sizes, found, split = bodies, [], []
    while True:
        level = len(found)
        wide = sizes.groupBy("key", "digest").agg(F.max("bytes").alias("bytes")).groupBy("key").agg(F.sum("bytes").alias("bytes"))
        hot = staged.write(wide.where(F.col("bytes") > key_bytes).select("key"), f"hot{level}")
        last = level >= (window - gram).bit_length() or hot.isEmpty()
        cold = now if last else now.join(hot, "key", "left_anti")
        found.append(staged.write(solve(cold), f"spans{level}"))
        if last:
            break
        many = now.join(hot, "key", "left_semi")
        children = staged.write(halves(many, units, window, gram, level + 1), f"halves{level + 1}")
        split.append(children)
        merged = children.groupBy("key", "digest", "content").agg(F.min("place").alias("place"), F.min("owner").alias("owner"), F.sum("copies").alias("copies"))
        again = children.groupBy("key").agg(F.sum("copies").alias("c")).where("c > 1").select("key")
        now, sizes = staged.write(merged.join(again, "key", "left_semi"), f"contents{level + 1}"), children
        if level:
            staged.drop(f"contents{level}")
    spans = found.pop()
    while split:
        up = spans.join(split.pop().select("parent", "parent_digest", "shift", "key", "digest"), ["key", "digest"])
        up = up.select(F.col("parent").alias("key"), F.col("parent_digest").alias("digest"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"), "owner")
        spans = found.pop().unionByName(up)
    return spans


def repeats(docs: DataFrame, staged: Staged, units: Units, window: int, gram: int, key_bytes: int, solve: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Ranges (id, rid, start, end, owner) of documents (id, rid, doc_id, text) that hold repeated windows.

    solve: finds the spans (see SPAN) of contents (see CONTENT); it is also told about how many
    bytes of contents there are. owner is the smallest doc_id of those that hold a content.
    """
    found = repeated_segments(docs, staged, units, window, gram)
    bodies = staged.write(with_symbols(docs, found, units, window), "bodies")
    staged.drop("repeated")
    size = bodies.agg(F.sum("bytes")).first()[0] or 0
    counted = bodies.select("key", "digest", "content", "bytes", "place", F.col("id").alias("owner"), F.lit(1).cast("long").alias("copies"))
    spans = solved(counted, staged, units, window, gram, key_bytes, lambda contents: solve(contents, int(size)))
    placed = staged.write(bodies.select("key", "digest", "id", "rid", "start"), "places")
    staged.drop("bodies")
    return placed.join(spans, ["key", "digest"]).select("id", "rid", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + window).alias("end"), "owner")


def identified(docs: DataFrame, *more: F.Column) -> DataFrame:
    """(id, rid, doc_id, text, more...): id is the doc_id or, where it is null, a hash; with rid, another hash, it tells rows apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(7), text)).alias("id"), F.xxhash64(text).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)
