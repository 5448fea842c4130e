"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are distinct before the join. Split into budget + 2 blocks, two fingerprints within
the budget agree in two blocks at least, so for each choice of two blocks a fingerprint, turned so
that these lead, is sent to the trie node of their value. Below such a node pairs of trie nodes are
walked together, from the node with itself down; a pair whose prefixes differ in more bits than the
budget is dropped with all that lies under it. A node's links leave as a star around the smallest
member of each linked set, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Staged, chunks, components, mix, partitions, utf8


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 for no words."""
    hashes = shingle_hashes(text, shingle, seed)
    if not len(hashes):
        return 0
    return int(majority(hashes[:, None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half the rows of 64-bit words, for each column of words."""
    octets = np.ascontiguousarray(hashes).view(np.uint8)
    total = np.zeros(octets.shape[1] * 8, np.int64)
    for low in range(0, len(octets), 255):  # sums of 255 bits fit a byte
        total += np.add.reduce(np.unpackbits(octets[low : low + 255], axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(octets), bitorder="little").view(np.uint64)


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, of the whole text if it has fewer, none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)], np.uint64)


def fingerprints(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 22):
                data, offs = utf8(batch.column("text"))
                raw = data.tobytes()
                fp = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    rows = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, fp long")


def near_pairs(node: np.ndarray, value: np.ndarray, bits: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of one root node whose values differ in ``budget`` bits or fewer.

    node and value are sorted together and distinct. All node pairs of one depth are walked at once.
    """
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(node))
    a_lo, a_hi, b_lo, b_hi, err = first, ends, first, ends, np.zeros(len(first), np.int64)
    found_a, found_b = [], []
    for level in range(bits - 1, -1, -1):
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if single.any():  # nothing left to split: compare the whole values
            a, b = a_lo[single], b_lo[single]
            near = (a != b) & (np.bitwise_count(value[a] ^ value[b]) <= budget)
            found_a.append(a[near])
            found_b.append(b[near])
            a_lo, a_hi, b_lo, b_hi, err = (x[~single] for x in (a_lo, a_hi, b_lo, b_hi, err))
        if not len(a_lo):
            break
        zeros = np.concatenate(([0], np.cumsum((value >> np.uint64(level)) & np.uint64(1) == 0)))
        a_mid, b_mid = a_lo + zeros[a_hi] - zeros[a_lo], b_lo + zeros[b_hi] - zeros[b_lo]
        same = a_lo == b_lo  # nodes of one depth are the same or apart
        other = ~same
        parts = [(a_lo, a_mid, b_lo, b_mid, err), (a_mid, a_hi, b_mid, b_hi, err), (a_lo, a_mid, b_mid, b_hi, err + 1), tuple(x[other] for x in (a_mid, a_hi, b_lo, b_mid, err + 1))]
        a_lo, a_hi, b_lo, b_hi, err = (np.concatenate([p[i] for p in parts]) for i in range(5))
        stay = (a_lo < a_hi) & (b_lo < b_hi) & (err <= budget) & ~((a_lo == b_lo) & (a_hi - a_lo == 1))
        a_lo, a_hi, b_lo, b_hi, err = (x[stay] for x in (a_lo, a_hi, b_lo, b_hi, err))
    different = a_lo != b_lo
    found_a.append(a_lo[different])
    found_b.append(b_lo[different])
    return np.concatenate(found_a), np.concatenate(found_b)


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each of n places over the links."""
    label = np.arange(n)
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    return label


def trie_links(values: DataFrame, budget: int, staged: Staged, node_rows: int = 20_000, direct: bool = False) -> DataFrame:
    """Links (a, b) that join all values (fp, distinct) within ``budget`` bits of each other.

    With ``direct``, a is linked to the first b that is itself within the budget, not to the first that is reachable.
    """
    blocks = budget + 2
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    turned = []
    for choice, (i, j) in enumerate(combinations(range(blocks), 2)):
        lead = [(edges[k], edges[k + 1]) for k in (i, j)]
        rest = [(edges[k], edges[k + 1]) for k in range(blocks) if k not in (i, j)]

        def packed(spans):
            return reduce(lambda x, s: f"shiftleft({x}, {s[1] - s[0]}) | (shiftrightunsigned(fp, {s[0]}) & {(1 << (s[1] - s[0])) - 1}L)", spans, "0L")

        turned.append(F.struct(F.expr(f"shiftleft(({packed(lead)}), 4) | {choice}L").alias("node"), F.expr(packed(rest)).alias("rest")))
    # 64 bits less two blocks, and 4 bits for the choice beside two blocks, fit a long
    width = 64 - min((edges[i + 1] - edges[i]) + (edges[j + 1] - edges[j]) for i, j in combinations(range(blocks), 2))
    nodes = staged.write(values.select("fp", F.explode(F.array(*turned)).alias("t")).select("fp", "t.node", "t.rest"), "nodes")
    full = nodes.groupBy("node").agg(F.count("*").alias("c")).where("c > 1").select("node")
    shared = staged.write(nodes.join(full, "node", "left_semi"), "shared")
    bins = max(8 * partitions(values.sparkSession), shared.count() // node_rows + 1)

    def join(table: pa.Table) -> pa.Table:
        fp, node, rest = (table.column(c).to_numpy() for c in ("fp", "node", "rest"))
        order = np.lexsort((rest, node))
        a, b = near_pairs(node[order], rest[order].view(np.uint64), width, budget)
        if direct:
            label = np.arange(len(order))
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        else:
            label = stars(len(order), a, b)
        out = np.flatnonzero(label != np.arange(len(order)))
        return pa.table({"a": pa.array(fp[order][out]), "b": pa.array(fp[order][label[out]])})

    return shared.withColumn("bin", F.expr(f"pmod(xxhash64(node), {bins})")).groupBy("bin").applyInArrow(join, "a long, b long").distinct()


def classes(prints: DataFrame, budget: int, staged: Staged) -> DataFrame:
    """(fp, component_id): the smallest doc_id reachable from each fingerprint of prints (doc_id, fp)."""
    spark = prints.sparkSession
    values = staged.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    linked = components(spark, trie_links(values.select("fp"), budget, staged), staged)
    grouped = values.join(linked, values.fp == linked.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    grouped = staged.write(grouped, "grouped")
    least = staged.write(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    return staged.write(grouped.join(least, "component").select("fp", "component_id"), "classes")


def simhash_dedup(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """Components of documents whose SimHash fingerprints differ in ``budget`` bits or fewer.

    Returns (doc_id, fingerprint, component_id), a row for each row of docs. Null and empty texts
    have fingerprint zero and link like any other. component_id is the smallest doc_id of the
    component (null where it has none). Repeated rows stay, and rows of equal fingerprints are one
    component. Texts of any length count whole; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    staged = Staged(docs.sparkSession)
    prints = staged.write(fingerprints(docs, shingle), "prints")
    found = classes(prints, budget, staged)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text."""
    data, offs = utf8(column)
    raw = data.tobytes()
    return [np.unique(shingle_hashes(raw[a:b], shingle)) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


HEAD = np.dtype([("id", "<i8"), ("n", "<u4"), ("own", "<u4")])
SHARED = np.dtype([("id", "<i8"), ("n", "<u4"), ("df", "<u4"), ("low", "<u4")])
BIN_SHINGLES = 1_500_000


def packed(table: pa.Table, column: str, kind: np.dtype | type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def prefixes(firsts: DataFrame, shingle: int, least: float) -> DataFrame:
    """(key, id, n, p, short): the shingles of firsts (id, n, text) by which near copies must meet.

    The n shingles of a text are ordered by the number of texts that have them, rarest first, and p is
    a shingle's place. Two sets of a Jaccard similarity of ``least`` share one within the first
    n - ceil(least * n) + 1 of the larger set and, of the smaller, within the shorter prefix that
    ``short`` marks. Shingles of one text take up places but meet nobody, and are left out. A key is
    a bin and 32 bits of the hash; keys that are equal by chance only cost candidates.
    """
    spark = firsts.sparkSession
    total = firsts.agg(F.sum("n")).first()[0] or 0
    bins = max(2 * partitions(spark), int(total) // BIN_SHINGLES + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 22):
                ids, sets = batch.column("id").to_numpy(), shingle_sets(batch.column("text"), shingle)
                sizes = np.array([len(x) for x in sets])
                flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                home = ((flat >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
                order = np.argsort(home, kind="stable")
                low, cell = (flat[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), home[order] * len(sets) + doc[order]
                cells, start, own = np.unique(cell, return_index=True, return_counts=True)
                heads = np.zeros(len(cells), HEAD)
                who = cells % max(1, len(sets))
                heads["id"], heads["n"], heads["own"] = ids[who], sizes[who], own
                at = cells // max(1, len(sets))
                used, first = np.unique(at, return_index=True)
                ends = [*first[1:].tolist(), len(at)]
                edge = np.append(start, len(low))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array([heads[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()),
                        pa.array([low[edge[a] : edge[b]].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary()),
                    ],
                    ["bin", "heads", "lows"],
                )

    def count(table: pa.Table) -> pa.Table:
        heads, low = packed(table, "heads", HEAD), packed(table, "lows", "<u4")
        _, back, df = np.unique(low, return_inverse=True, return_counts=True)
        some = np.flatnonzero(df[back] > 1)
        doc = np.repeat(np.arange(len(heads)), heads["own"])[some]
        out = np.zeros(len(some), SHARED)
        out["id"], out["n"], out["df"], out["low"] = heads["id"][doc], heads["n"][doc], df[back[some]], low[some]
        to = (mix(np.ascontiguousarray(out["id"]).view(np.uint64)) % np.uint64(bins)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        used, first = np.unique(to[order], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        out = out[order]
        return pa.table({"to": pa.array(used.astype(np.int32)), "bin": pa.array(np.full(len(used), table.column("bin")[0].as_py(), np.int32)), "shared": pa.array([out[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())})

    def places(table: pa.Table) -> pa.Table:
        x = packed(table, "shared", SHARED)
        sizes = np.array([len(b) // SHARED.itemsize for b in table.column("shared").to_pylist()])
        key = (np.repeat(table.column("bin").to_numpy().astype(np.int64), sizes) << 32) | x["low"].astype(np.int64)
        order = np.lexsort((key, x["df"], x["id"]))
        x, key = x[order], key[order]
        first = np.flatnonzero(np.append(True, x["id"][1:] != x["id"][:-1]))
        own = np.diff(np.append(first, len(x)))
        n = x["n"].astype(np.int64)
        p = n - np.repeat(own, own) + np.arange(len(x)) - np.repeat(first, own)
        longer, shorter = (n - np.ceil(f * n - 1e-9).astype(np.int64) + 1 for f in (least, 2 * least / (1 + least)))
        stay = np.flatnonzero(p < longer)
        return pa.table({"key": pa.array(key[stay]), "id": pa.array(x["id"][stay]), "n": pa.array(n[stay]), "p": pa.array(p[stay]), "short": pa.array((p < shorter)[stay])})

    dealt = firsts.select("id", "text").mapInArrow(deal, "bin int, heads binary, lows binary")
    shared = dealt.groupBy("bin").applyInArrow(count, "to int, bin int, shared binary")
    return shared.groupBy("to").applyInArrow(places, "key long, id long, n long, p long, short boolean")


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, budget: int = 3) -> DataFrame:
    """One document of each group of copies and near copies: the rows of docs that stay.

    Near copies share at least ``least`` of their distinct word shingles (Jaccard); all pairs of them
    are found. Texts with the same distinct shingles are one set. Sets are linked by the trie self-join of their
    fingerprints first, within ``budget`` bits, and each link is verified on the shingles. What is further apart than 64
    bits can tell is joined on the rarest shingles (``prefixes``), filtered by size and place, and verified too: first each
    with one set of a shingle, then all pairs of components that are different still. The row of smallest (doc_id, text) of a component stays; of rows that are
    the same in all columns one does. Documents without words are copies of each other.
    """
    spark = docs.sparkSession
    staged = Staged(spark)
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("row"), "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 22):
                sets = shingle_sets(batch.column("text"), shingle)
                ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64)
                # the fingerprint of the distinct shingles, so that a set has one
                fp = np.array([majority(x[:, None])[0] if len(x) else 0 for x in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids.view(np.int64)), pa.array([len(x) for x in sets], pa.int64()), pa.array(fp.view(np.int64))], ["row", "id", "n", "fp"])

    kind = rows.schema["row"].dataType.simpleString()
    prints = rows.mapInArrow(digest, f"row {kind}, id long, n long, fp long")
    order = F.struct(F.col("row.doc_id").isNull().alias("n"), F.col("row.doc_id").alias("d"), F.xxhash64("row.text").alias("t"))
    firsts = staged.write(prints.groupBy("id").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min_by("row", order).alias("row")), "firsts")
    texts = firsts.select("id", "n", F.col("row.text").alias("text"))
    entries = staged.write(prefixes(texts, shingle, least), "entries")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 22):
                sets = shingle_sets(batch.column("text"), shingle)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "own"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = staged.write(pairs.distinct(), f"{name}-pairs")
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = staged.write(texts.join(asked, "id", "left_semi").select("id", "text").mapInArrow(own, "id long, own array<long>"), f"{name}-sets")
        left, right = (sets.select(F.col("id").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
        both = F.size(F.array_intersect("own_a", "own_b"))
        share = both / (F.size("own_a") + F.size("own_b") - both)
        links = staged.write(pairs.join(left, "a").join(right, "b").where(share >= least).select("a", "b"), f"{name}-links")
        staged.drop(f"{name}-sets")
        return links

    def may(x: str, y: str) -> str:
        """Size and place filters: the overlap that the similarity needs is still to be had."""
        need = f"{least / (1 + least)!r} * ({x}.n + {y}.n) - 1e-6"
        return f"least({x}.n, {y}.n) >= {least!r} * greatest({x}.n, {y}.n) - 1e-6 and {x}.n - {x}.p >= {need} and {y}.n - {y}.p >= {need}"

    held = staged.write(firsts.groupBy("fp").agg(F.min("id").alias("id")), "held")
    close = trie_links(held.select("fp"), budget, staged, direct=True)
    ids = lambda c: held.select(F.col("fp").alias(c), F.col("id").alias(f"{c}_id"))
    close = close.join(ids("a"), "a").join(ids("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    same = firsts.join(held.select("fp", F.col("id").alias("b")), "fp").where("id <> b").select(F.col("id").alias("a"), "b")
    links = verified(close.union(same), "trie")
    told = staged.write(components(spark, links, staged), "told")
    known = staged.write(entries.join(told, "id", "left").select(*entries.columns, F.coalesce("component", "id").alias("part")), "known")
    first = known.groupBy("key").agg(F.min(F.struct("p", "id", "n", "part")).alias("x"), F.count("*").alias("c")).where("c > 1")
    near = known.alias("y").join(first, "key").where(f"x.part <> y.part and {may('x', 'y')}")
    links = staged.write(links.union(verified(near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), "first")), "links")
    linked = staged.write(components(spark, links, staged), "linked")
    placed = entries.join(linked, "id", "left").select("key", "id", "n", "p", "short", F.coalesce("component", "id").alias("component"))
    placed = staged.write(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("short").alias("some")).where("lo < hi and some").select("key")
    placed = staged.write(placed.join(open_keys, "key", "left_semi"), "open")
    across = placed.where("short").alias("x").join(placed.alias("y"), F.expr(f"x.key = y.key and x.component <> y.component and x.n <= y.n and {may('x', 'y')}"))
    more = verified(across.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")), "across")
    linked = components(spark, links.union(more), staged)
    leasts = firsts.select("id", order.alias("least")).join(linked, "id", "left").select("id", "least", F.coalesce("component", "id").alias("component"))
    keep = staged.write(leasts.groupBy("component").agg(F.min_by("id", "least").alias("id")).select("id"), "keep")
    return firsts.join(keep, "id", "left_semi").select("row.*")
