"""Web addresses in the reads of text tracks and cards, and the memory of addresses that were blurred."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.sources.shipping import ship

# Routings of the main list, the routing of an address, the candidate that keeps its own, the letters of a key.
MAIN_LIST = ["REVIEW_AD_LIKELY", "REVIEW_PERSISTENT_OVERLAY", "REVIEW_POLICY_OVERRIDE", "REVIEW_SCROLLING_TEXT"]
ADDRESS_ROUTING, SCROLLING = "REVIEW_WEB_ADDRESS", "scrolling_text"
LETTERS = 6
SIEVE_BITS = 22


def track_addresses(texts: Column) -> Column:
    """Addresses in the reads of a track, each once."""
    return F.array_distinct(F.flatten(F.transform(texts, text.read_addresses)))


def card_keys(shown: Column, labels: Column) -> Column:
    """Memory keys of the addresses that a card shows (tokens and remembered keys) or whose labels hold them."""
    tokens = F.concat(F.coalesce(shown, F.array().cast("array<string>")), F.coalesce(track_addresses(labels), F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(F.transform(tokens, lambda x: text.memory_key(x, LETTERS))))


def anchor_hashes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all runs of 6, 12 and 24 letters, by length, at the places where they begin."""

    def joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        n = max(0, len(right) - shift)
        x = (left[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (right[shift:] + np.uint64(0x7F4A7C15))
        return x ^ (x >> np.uint64(29))

    one = codes.astype(np.uint64) + np.uint64(1)
    two = joined(one, one, 1)
    four = joined(two, two, 2)
    six = joined(four, two, 4)
    twelve = joined(six, six, 6)
    return {6: six, 12: twelve, 24: joined(twelve, twelve, 12)}


def _marks(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int32)


def remembered_in(tracks: DataFrame, memory: DataFrame) -> DataFrame:
    """The remembered keys that a track's folded reads hold: (track_id, remembered), sorted; tracks without one are left out.

    tracks: (track_id, texts); memory: (key) of six letters or more. A key's anchor is its first 24,
    12 or 6 letters, as many as it has. A sieve of 2^22 bits, however many keys there are, tells where
    a read may hold an anchor; only these places leave it, with as much as the longest key has, and meet
    the keys on the anchor.
    """
    ship(tracks.sparkSession)
    keys = memory.where(F.length("key") >= LETTERS).select("key").distinct()
    keys = keys.withColumn("anchor", F.expr("substring(key, 1, case when length(key) >= 24 then 24 when length(key) >= 12 then 12 else 6 end)"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_marks(anchor_hashes(np.frombuffer(x.encode(), np.uint8))[len(x)][:1]) for x in batch.column("anchor").to_pylist()]
            sizes = [len(x) for x in batch.column("anchor").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))], ["n", "m"])

    marks = keys.select("anchor").distinct().mapInArrow(marked, "n int, m int").distinct().toPandas()
    longest = keys.agg(F.max(F.length("key"))).first()[0] or 0
    sieves = {}
    for n, m in marks.groupby("n").m:
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[m.to_numpy()] = True
        sieves[n] = np.packbits(sieve)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {n: np.unpackbits(x).astype(bool) for n, x in sieves.items()}
        for batch in batches:
            who, anchors, ahead = [], [], []
            for i, read in enumerate(batch.column("read").to_pylist()):
                hashes = anchor_hashes(np.frombuffer(read.encode(), np.uint8))
                some = {(n, read[at : at + longest]) for n, sieve in open_.items() for at in np.flatnonzero(sieve[_marks(hashes[n])]).tolist()}
                who += [i] * len(some)
                anchors += [x[:n] for n, x in some]
                ahead += [x for _, x in some]
            yield pa.RecordBatch.from_arrays([batch.column("track_id").take(pa.array(who, pa.int64())), pa.array(anchors, pa.string()), pa.array(ahead, pa.string())], ["track_id", "anchor", "ahead"])

    reads = tracks.select("track_id", F.explode("texts").alias("read")).select("track_id", text.fold_alnum(F.col("read")).alias("read")).where(F.length("read") >= LETTERS)
    kind = reads.schema["track_id"].dataType.simpleString()
    held = reads.mapInArrow(places, f"track_id {kind}, anchor string, ahead string").join(keys, "anchor").where(F.startswith("ahead", "key"))
    return held.groupBy("track_id").agg(F.array_sort(F.collect_set("key")).alias("remembered"))


def promoted(tracks: DataFrame, memory: DataFrame) -> DataFrame:
    """Tracks with an address, or one that is remembered, go to the main list with a suggestion to blur.

    tracks: (track_id, candidate, routing, priority, suggestion, named, texts); scrolling lines and
    tracks that name their address already stay as they are. Returns (track_id, promoted, routing,
    previous, priority, suggestion, tokens, remembered), five tokens and keys at most, as a card shows.
    """
    free = (F.coalesce(F.col("candidate") != SCROLLING, F.lit(True))) & ~F.coalesce("named", F.lit(False))
    nothing = F.array().cast("array<string>")
    # texts are read where they lie and stay there
    told = tracks.withColumn("tokens", F.when(free, F.coalesce(track_addresses(F.col("texts")), nothing)).otherwise(nothing)).drop("texts")
    rows = told.join(remembered_in(tracks.where(free), memory), "track_id", "left")
    moves = (F.size("tokens") > 0) | F.col("remembered").isNotNull()
    five = lambda c: F.slice(F.coalesce(c, nothing), 1, 5)
    routing = F.when(F.col("routing").isin(MAIN_LIST), F.col("routing")).otherwise(ADDRESS_ROUTING)
    return rows.select(
        "track_id", moves.alias("promoted"), F.when(moves, routing).otherwise(F.col("routing")).alias("routing"), F.when(moves & (F.col("routing") != ""), F.col("routing")).alias("previous"), F.when(moves, "high").otherwise(F.col("priority")).alias("priority"),
        F.when(moves, "BLUR").otherwise(F.col("suggestion")).alias("suggestion"), five(F.col("tokens")).alias("tokens"), five(F.col("remembered")).alias("remembered"),
    )


def readmitted(omitted: DataFrame, memory: DataFrame) -> DataFrame:
    """Tracks that were left out past a limit and hold a remembered address."""
    return omitted.join(remembered_in(omitted, memory), "track_id", "left_semi")
