"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, runs of one placeholder a single one, so that
a question keeps its template when its parameters change. Windows of template tokens of documents
and benchmark items are joined on their hash. Along each alignment of a document with an item the
slots must be consistent: a value of the item always stands for one value in the document. Items
covered by consistent windows to a given share, or by a run of them, are reported, exact or
re-parameterised. Windows of the case-folded words beside the templates find whatever is verbatim.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Staged, byte_values, chunks, gram_hash, mix, prefix_sums, span_hash, utf8, word_spans

WINDOW = 8
LITERALS = 4
TEMPLATE, NAMED, VERBATIM = 0, 1, 2
SIEVE_BITS = 22
# Units that follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollars dollar euros euro cents usd eur km/h mph kmh w kw v a hz c f k mile miles meter meters metre metres inch inches foot feet gram grams liter liters litre litres".split()
_PARTS = np.ones(256, bool)
_PARTS[128:] = False
_PARTS[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'", np.uint8)] = False
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_STOP = np.zeros(256, np.int64)
_STOP[np.frombuffer(b".!?\n", np.uint8)] = 1
NUMBER, NAME, UNIT = (np.uint64(0x1000003 * k) for k in (1, 2, 3))
_U = np.uint64


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), _PARTS)
    return np.unique(span_hash(prefix_sums(byte_values(data)), starts, ends))


def canonical(data: np.ndarray, offs: np.ndarray, named: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens of all rows, the value in each slot (0 for literal words), token offsets of the rows.

    named: a capitalised first word of a row is a name, as where a document quotes it mid-sentence.
    """
    starts, ends, rows = word_spans(data, offs, _PARTS)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), rows
    words = span_hash(prefix_sums(byte_values(_LOWER[data])), starts, ends)
    first = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    number = (first >= 48) & (first <= 57)
    upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    opens = np.ones(n, bool)  # first of its row or sentence
    stops = np.concatenate(([0], np.cumsum(_STOP[data])))
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    head = np.zeros(n, bool)
    head[rows[:-1][rows[:-1] < n]] = True
    opens = opens & ~head if named else opens | head
    after_number = np.zeros(n, bool)
    after_number[1:] = number[:-1] & ~head[1:]
    unit = after_number & np.isin(words, _unit_hashes())
    name = upper & ~opens & ~unit
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, words)))
    slot = np.where(number | unit | name, words, _U(0))
    # a run of numbers (1,000.50) or names is one placeholder whose value is the whole run
    again = np.zeros(n, bool)
    again[1:] = (number[1:] & number[:-1] | name[1:] & name[:-1]) & ~head[1:]
    keep = np.flatnonzero(~again)
    rank = np.arange(n) - keep[np.searchsorted(keep, np.arange(n), side="right") - 1]
    value = np.add.reduceat(mix(slot + rank.astype(np.uint64)) * (slot != 0), keep)
    return token[keep], value, np.searchsorted(keep, rows)


def folded(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As canonical, but all words are literal."""
    data = _LOWER[data]
    after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[after] += 0x20
    starts, ends, rows = word_spans(data, offs, _PARTS)
    words = mix(span_hash(prefix_sums(byte_values(data)), starts, ends)) if len(starts) else np.zeros(0, np.uint64)
    return words, np.zeros(len(words), np.uint64), rows


def windows(data: np.ndarray, offs: np.ndarray, length: int, whole: bool = False, kind: int = TEMPLATE):
    """Hash, token position, row and slot values of the windows, of templates those with enough literal words.

    whole: only rows of exactly ``length`` tokens.
    """
    token, slot, rows = folded(data, offs) if kind == VERBATIM else canonical(data, offs, kind == NAMED)
    hashes = gram_hash(token, length)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    n = len(hashes)
    literal = np.concatenate(([0], np.cumsum(slot == 0)))
    ok = (row[:n] == row[length - 1 :]) if n else np.zeros(0, bool)
    ok = ok & (literal[length:] - literal[:-length] >= LITERALS) if n and kind != VERBATIM else ok
    if whole and n:
        ok &= np.diff(rows)[row[:n]] == length
    at = np.flatnonzero(ok)
    return hashes[at] + _U(length) + _U(kind == VERBATIM) * _U(1 << 32), at - rows[row[at]], row[at], at, slot


def _slots(slot: np.ndarray, at: np.ndarray, length: int) -> list[list[int]]:
    own = slot.view(np.int64)
    return [own[a : a + length][own[a : a + length] != 0].tolist() for a in at.tolist()]


def item_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """(item_id, variant, pos, hash, slots, length): windows of items; an item of fewer tokens is one window of its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                for kind, size in [(k, n) for k in (TEMPLATE, NAMED, VERBATIM) for n in range(1 if k == VERBATIM else LITERALS, length + 1)]:
                    h, pos, row, at, slot = windows(*utf8(batch.column("text")), size, size < length, kind)
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row)), pa.array(np.full(len(at), kind, np.int32)), pa.array(pos.astype(np.int64)), pa.array(h.view(np.int64)), pa.array(_slots(slot, at, size), pa.list_(pa.int64())), pa.array(np.full(len(at), size, np.int32))], ["item_id", "variant", "pos", "hash", "slots", "length"])

    return benchmark.select("item_id", "text").mapInArrow(run, "item_id long, variant int, pos long, hash long, slots array<long>, length int")


def contaminated(docs: DataFrame, benchmark: DataFrame, length: int = WINDOW, share: float = 0.3, run_windows: int = 13) -> DataFrame:
    """Documents that hold benchmark items, as they are or with other parameters.

    Returns (rid, doc_id, item_id, n_windows, n_matched, coverage, n_changed, kind): a row for each
    pair of a document and an item of whose windows at least ``share``, or ``run_windows`` in a row,
    occur in it with consistent slots. Windows are of templates, of templates with the item's first
    word as a name, and of words as they are; figures are of those with the largest coverage. n_changed counts item values that stand for others; kind is 'exact' without any, else
    'reparameterised'. rid is xxhash64(doc_id, text). Template windows
    with fewer than four literal words can't be told from chance and are not searched; such items
    are found where they stand verbatim, however short they are. Null texts hold nothing; a null
    item_id or doc_id is an id like any other; repeated items and documents are reported as often as
    they differ in id. Texts of any length are searched whole; an empty table of documents or items
    gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    items = staged.write(item_windows(benchmark, length).distinct(), "items")
    lengths = [(r.length, VERBATIM if r.v else TEMPLATE) for r in items.select("length", (F.col("variant") == VERBATIM).alias("v")).distinct().collect()]
    # the sieve has 2^22 bits however large the benchmark is; what passes it is joined on the hash
    marks = items.select(F.shiftrightunsigned("hash", 64 - SIEVE_BITS).cast("int").alias("m")).distinct().toPandas().m.to_numpy()
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[marks] = True
    packed = np.packbits(sieve)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(packed).astype(bool)
        for whole in batches:
            for batch in chunks(whole, "text"):
                for size, kind in lengths:
                    h, pos, row, at, slot = windows(*utf8(batch.column("text")), size, kind=kind)
                    hit = np.flatnonzero(maybe[(h >> _U(64 - SIEVE_BITS)).astype(np.int64)])
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row[hit])) for c in ("rid", "doc_id")] + [pa.array(pos[hit].astype(np.int64)), pa.array(h[hit].view(np.int64)), pa.array(_slots(slot, at[hit], size), pa.list_(pa.int64()))], ["rid", "doc_id", "at", "hash", "found"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = rows.mapInArrow(run, "rid long, doc_id long, at long, hash long, found array<long>").join(items, "hash")
    pairs = F.transform(F.arrays_zip("slots", "found"), lambda x: F.struct(x["slots"].alias("a"), x["found"].alias("b")))
    aligned = hits.groupBy("rid", "doc_id", "item_id", "variant", (F.col("at") - F.col("pos")).alias("shift")).agg(F.collect_set("pos").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    consistent = aligned.where("size(array_distinct(transform(pairs, x -> x.a))) = size(pairs)")
    consistent = consistent.withColumn("sorted", F.array_sort("places"))
    steps = run_windows - 1
    in_row = F.expr(f"size(sorted) > {steps} and exists(sequence({steps}, greatest({steps}, size(sorted) - 1)), i -> get(sorted, i) - get(sorted, i - {steps}) = {steps})")
    found = consistent.groupBy("rid", "doc_id", "item_id", "variant").agg(F.max(in_row).alias("in_row"), F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.min(F.expr("size(filter(pairs, x -> x.a <> x.b))")).alias("n_changed"))
    sizes = items.groupBy(F.col("item_id").alias("of"), F.col("variant").alias("way")).agg(F.countDistinct("pos").cast("long").alias("n_windows"))
    out = found.join(sizes, F.expr("item_id <=> of and variant = way")).drop("of", "way").withColumn("n_matched", F.size("places").cast("long")).withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    out = out.where((F.col("coverage") >= share) | F.col("in_row"))
    out = out.groupBy("rid", "doc_id", "item_id").agg(F.max(F.struct("coverage", (-F.col("n_changed")).alias("same"), (-F.col("variant")).alias("order"), "n_windows", "n_matched", "n_changed")).alias("best")).select("rid", "doc_id", "item_id", "best.*")
    return out.select("rid", "doc_id", "item_id", "n_windows", "n_matched", "coverage", F.col("n_changed").cast("long").alias("n_changed"), F.when(F.col("n_changed") == 0, "exact").otherwise("reparameterised").alias("kind"))
