"""Ranked lexical search with a dual-sorted wavelet tree per shard.

A shard holds the postings of some megabytes of whole texts. The list of each term is sorted by falling
impact (what the term adds to a score, but for its weight), and all lists stand one after the other
as one sequence of documents in a wavelet matrix. Each node of the tree is a range of documents; the
part of a list that falls into a node is a stretch of the node's sequence and still in order of
impact, so the first posting of a stretch bounds all that the term can add below the node. Documents
are numbered by doc_id, so a path from the root spells the document, and the order of doc_id can be
walked as well as the order of impact.

A query starts with the root of every shard. The node with the largest sum of bounds over its terms
is opened next, terms that have no posting below a child are dropped there, and a leaf is a document
with its exact score. When no open node is above the k-th best score, the top k are exact. All
queries of a block advance together, some nodes each at a time, and keep their k-th score from one
shard of a lot to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import Staged, chunks, utf8, word_hashes, word_spans

SHARD_BYTES = 8 << 20
LOT_SHARDS = 8
BLOCK_ITEMS = 256
OPENED = 32
SIEVE_BITS = 22
# Terms are runs of ASCII letters, digits and non-ASCII characters; A-Z are lowered.
_PARTS = np.ones(256, bool)
_PARTS[128:] = False
_PARTS[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = False
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
POSTINGS = "shard long, doc_ids array<long>, lens binary, terms binary, offs binary, docs binary, tfs binary, n_docs long, n_terms long"
INDEX = "shard long, doc_ids array<long>, terms binary, offs binary, impacts binary, bits binary, zeros array<long>"


def hashed_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of all texts in their order, and the offsets of the texts."""
    data, offs = utf8(column)
    data = _LOWER[data]
    starts, ends, rows = word_spans(data, offs, _PARTS)
    return (word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), rows


def posting_lists(hashes: np.ndarray, rows: np.ndarray, doc_ids: pa.Array, shard: int) -> dict:
    """One row of POSTINGS: the documents with terms by doc_id, null last, and each term's documents and counts."""
    full = np.flatnonzero(np.diff(rows) > 0)
    ids = doc_ids.take(pa.array(full))
    by_id = np.asarray(pa.compute.sort_indices(ids, null_placement="at_end"), np.int64)
    number = np.zeros(len(rows) - 1, np.int64)
    number[full[by_id]] = np.arange(len(full))
    lens = np.diff(rows)
    doc = np.repeat(number, lens)
    order = np.argsort(hashes, kind="stable")
    term, doc = hashes[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = term[1:] != term[:-1]
    terms, which = term[new], np.cumsum(new) - 1
    pair, tf = np.unique(which * len(full) + doc, return_counts=True)
    offs = np.searchsorted(pair // len(full), np.arange(len(terms) + 1))
    return {
        "shard": shard, "doc_ids": ids.take(pa.array(by_id)), "lens": lens[full[by_id]].astype(np.int64), "terms": terms, "offs": offs.astype(np.int64),
        "docs": (pair % len(full)).astype(np.int32), "tfs": tf.astype(np.int32), "n_docs": len(full), "n_terms": len(hashes),
    }


def as_row(values: dict, names: list[str]) -> pa.RecordBatch:
    cells = []
    for v in (values[n] for n in names):
        if isinstance(v, np.ndarray):
            v = v.tobytes()
        cells.append(pa.array([v], pa.binary()) if isinstance(v, bytes) else pa.array([v.to_pylist()], pa.list_(pa.int64())) if isinstance(v, pa.Array) else pa.array([v], pa.list_(pa.int64()) if isinstance(v, list) else pa.int64()))
    return pa.RecordBatch.from_arrays(cells, names)


def field_names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def postings(docs: DataFrame, staged: Staged, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Posting lists of shards of about ``shard_bytes`` of whole texts, made where the texts are read."""
    names = field_names(POSTINGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        waiting, size, at = [], 0, TaskContext.get().partitionId() << 32

        def made():
            table = pa.Table.from_batches(waiting).combine_chunks()
            hashes, rows = hashed_terms(table.column("text"))
            if len(hashes):
                yield as_row(posting_lists(hashes, rows, table.column("doc_id").combine_chunks(), at), names)

        for whole in batches:
            for batch in chunks(whole, "text", shard_bytes):
                n = int(utf8(batch.column("text"))[1][-1])
                if waiting and size + n > shard_bytes:
                    yield from made()
                    waiting, size, at = [], 0, at + 1
                waiting.append(batch)
                size += n
        if waiting:
            yield from made()

    return staged.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, POSTINGS), "postings", wide=True)


@dataclass(frozen=True)
class Index:
    """shards: rows of INDEX; n_docs and n_terms of the corpus (N and L)."""

    shards: DataFrame
    n_shards: int
    n_docs: int
    n_terms: int


def impact(tf: np.ndarray, lens: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to a score for each unit of its weight, all in 64-bit integers."""
    m = 100 - 50 + (50 * lens.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


def build_index(docs: DataFrame, staged: Staged, shard_bytes: int = SHARD_BYTES) -> Index:
    """Wavelet trees of all documents; the counts of the corpus that impacts need come first."""
    lists = postings(docs, staged, shard_bytes)
    seen = lists.agg(F.count("*").alias("s"), F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = int(seen.n or 0), int(seen.l or 0)
    names = field_names(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                lens, terms, offs = (np.frombuffer(row.column(c)[0].as_py(), t) for c, t in (("lens", np.int64), ("terms", np.uint64), ("offs", np.int64)))
                doc, tf = (np.frombuffer(row.column(c)[0].as_py(), np.int32).astype(np.int64) for c in ("docs", "tfs"))
                value = impact(tf, lens[doc], n_docs, n_terms)
                order = np.lexsort((doc, -value, np.repeat(np.arange(len(terms)), np.diff(offs))))
                doc, value = doc[order], value[order]
                bits, zeros = [], []
                for level in range(max(1, (len(lens) - 1).bit_length()) - 1, -1, -1):
                    one = (doc >> level) & 1 == 1
                    bits.append(np.packbits(one).tobytes())
                    zeros.append(int(len(one) - one.sum()))
                    doc = np.concatenate((doc[~one], doc[one]))
                yield as_row({"shard": row.column("shard")[0].as_py(), "doc_ids": row.column("doc_ids")[0].values, "terms": terms, "offs": offs, "impacts": value.astype(np.int32), "bits": b"".join(bits), "zeros": zeros}, names)

    shards = staged.write(lists.mapInArrow(run, INDEX), "index", wide=True)
    staged.drop("postings")
    return Index(shards, seen.s, n_docs, n_terms)


class Tree:
    """A shard's wavelet matrix, ready to search: ones before each place and impacts of each level."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.terms, self.offs = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["offs"], np.int64)
        now = np.frombuffer(row["impacts"], np.int32)
        n, self.zeros = len(now), np.array(row["zeros"], np.int64)
        self.depth, raw = len(self.zeros), np.frombuffer(row["bits"], np.uint8).reshape(len(self.zeros), -1)
        self.ones = np.zeros((self.depth, n + 1), np.int32)
        self.impacts = np.zeros((self.depth + 1, n), np.int32)
        self.impacts[0] = now
        for level in range(self.depth):
            one = np.unpackbits(raw[level], count=n).astype(bool)
            np.cumsum(one, out=self.ones[level, 1:])
            now = np.concatenate((now[~one], now[one]))
            self.impacts[level + 1] = now

    def stretches(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each term begins and ends; equal for a term that isn't there."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return np.where(there, self.offs[at], 0), np.where(there, self.offs[at + 1], 0)


def top(query: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, equal scores by document."""
    order = np.lexsort((doc, -score, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < k]


def search_shard(tree: Tree, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, found: tuple[np.ndarray, ...], k: int, queries: int) -> tuple[np.ndarray, ...]:
    """Best-first search of one shard for all queries; found and the result are (query, score, doc_id) of the best so far.

    query, terms and weights have a row for each term of a query, sorted by query.
    """
    start, end = tree.stretches(terms)
    there = end > start
    lo, hi, w, q = start[there], end[there], weights[there], query[there]
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    owner = np.cumsum(new) - 1
    node_q, level, value = q[new], np.zeros(int(new.sum()), np.int64), np.zeros(int(new.sum()), np.int64)
    bound = np.add.reduceat(w * tree.impacts[0, lo], np.flatnonzero(new)) if len(q) else np.zeros(0, np.int64)
    while len(node_q):
        floor = np.full(queries, 1, np.int64)  # scores of 0 are no results
        fq, fs, fd = found
        count = np.bincount(fq, minlength=queries)
        if len(fq):
            least = np.minimum.reduceat(fs, np.flatnonzero(np.concatenate(([True], fq[1:] != fq[:-1]))))
            held = np.unique(fq)
            floor[held] = np.where(count[held] >= k, np.maximum(least, 1), 1)
        # an equal bound can still hold a smaller doc_id
        alive = bound >= floor[node_q]
        order = np.lexsort((-bound, node_q, ~alive))
        rank = np.arange(len(order)) - np.searchsorted(node_q[order][: int(alive.sum())], node_q[order], side="left")
        opened = np.zeros(len(order), bool)
        opened[order[: int(alive.sum())][rank[: int(alive.sum())] < OPENED]] = True
        rest = alive & ~opened
        # children of the opened nodes
        mine = opened[owner]
        number = np.cumsum(opened) - 1
        at, s, e, ww = level[owner[mine]], lo[mine], hi[mine], w[mine]
        ones_s, ones_e = tree.ones[at, s].astype(np.int64), tree.ones[at, e].astype(np.int64)
        child = np.concatenate((2 * number[owner[mine]], 2 * number[owner[mine]] + 1))
        s = np.concatenate((s - ones_s, tree.zeros[at] + ones_s))
        e = np.concatenate((e - ones_e, tree.zeros[at] + ones_e))
        at, ww = np.concatenate((at, at)) + 1, np.concatenate((ww, ww))
        some = np.flatnonzero(e > s)
        some = some[np.argsort(child[some], kind="stable")]
        child, s, e, at, ww = child[some], s[some], e[some], at[some], ww[some]
        new = np.ones(len(child), bool)
        new[1:] = child[1:] != child[:-1]
        firsts = np.flatnonzero(new)
        c_bound = np.add.reduceat(ww * tree.impacts[at, s], firsts) if len(child) else np.zeros(0, np.int64)
        parent = np.flatnonzero(opened)[child[firsts] >> 1]
        c_q, c_level, c_value = node_q[parent], level[parent] + 1, value[parent] * 2 + (child[firsts] & 1)
        c_owner = np.cumsum(new) - 1
        leaf = c_level == tree.depth
        good = leaf & (c_bound >= floor[c_q])
        if good.any():
            every = (np.concatenate((fq, c_q[good])), np.concatenate((fs, c_bound[good])), np.concatenate((fd, tree.doc_ids[c_value[good]])))
            kept = top(*every, k)
            found = tuple(x[kept] for x in every)
        stay = ~leaf & (c_bound >= floor[c_q])
        old, deep = rest[owner], stay[c_owner]
        number, c_number = np.cumsum(rest) - 1, np.cumsum(stay) - 1 + int(rest.sum())
        owner, lo, hi, w = np.concatenate((number[owner[old]], c_number[c_owner[deep]])), np.concatenate((lo[old], s[deep])), np.concatenate((hi[old], e[deep])), np.concatenate((w[old], ww[deep]))
        node_q, level, value, bound = (np.concatenate((a[rest], b[stay])) for a, b in ((node_q, c_q), (level, c_level), (value, c_value), (bound, c_bound)))
    return found


#: Stands for a null doc_id, which comes after all others.
NO_ID = np.iinfo(np.int64).max


def weighed_items(items: DataFrame, index: Index, staged: Staged) -> DataFrame:
    """(item_id, digest, terms, weights) of the different items with terms that the corpus holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                hashes, rows = hashed_terms(batch.column("text"))
                which = np.repeat(np.arange(len(batch)), np.diff(rows))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(which)) for c in ("item_id", "digest")] + [pa.array(hashes.view(np.int64))], ["item_id", "digest", "term"])

    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.sha2("text", 256).alias("digest")).where("text is not null")
    asked = staged.write(asked.mapInArrow(run, "item_id long, digest string, term long").distinct(), "asked")
    # the sieve has 2^22 bits however many terms are asked for; what passes it is joined on the term
    marks = asked.select(F.shiftrightunsigned("term", 64 - SIEVE_BITS).cast("int").alias("m")).distinct().toPandas().m.to_numpy()
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[marks] = True
    packed = np.packbits(sieve)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for terms, offs in zip(batch.column("terms"), batch.column("offs"), strict=True):
                t, n = np.frombuffer(terms.as_py(), np.uint64), np.diff(np.frombuffer(offs.as_py(), np.int64))
                hit = maybe[(t >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(t[hit].view(np.int64)), pa.array(n[hit])], ["term", "n"])

    df = index.shards.select("terms", "offs").mapInArrow(lengths, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return asked.join(df, "term").groupBy("item_id", "digest").agg(F.collect_list("term").alias("terms"), F.collect_list(weight).alias("weights"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The k best documents for each item by the terms that they share.

    Returns (item_id, rank, doc_id, score): rank from 1, score above 0, equal scores by ascending
    doc_id, a null one last. Null and empty texts have no terms, so such documents are never found
    and such items find nothing. Rows that repeat a doc_id are documents of their own; items equal in
    id and text are one, items of one id with different texts are ranked apart. Terms are told apart
    by 64-bit hashes. Texts of any length count whole, the longest are shards of their own. Empty
    tables give no rows; other columns are ignored, whatever their names.
    """
    staged = Staged(docs.sparkSession)
    index = build_index(docs, staged, shard_bytes)
    return search(index, items, staged, k)


def search(index: Index, items: DataFrame, staged: Staged, k: int = 50) -> DataFrame:
    """The k best documents of an index for each item; see ``ranked``."""
    asked = staged.write(weighed_items(items, index, staged), "items")
    lots = max(1, -(-index.n_shards // LOT_SHARDS))
    blocks = max(1, -(-asked.count() // BLOCK_ITEMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards of a lot as they come, each with the items of the block; one is held at a time."""
        none = np.zeros(0, np.int64)
        found, asking = (none, none, none), None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                if asking is None:
                    asking = pa.RecordBatch.from_struct_array(row.column("asking").flatten())
                    # a copy: the slices would hold the batch with its shards
                    asking = asking.take(pa.array(np.arange(len(asking))))
                    query = np.repeat(np.arange(len(asking)), np.diff(asking.column("terms").offsets.to_numpy()))
                    hashes, weights = asking.column("terms").flatten().to_numpy().view(np.uint64), asking.column("weights").flatten().to_numpy()
                values = {c: row.column(c)[0].as_py() for c in ("terms", "offs", "impacts", "bits", "zeros")}
                values["doc_ids"] = row.column("doc_ids")[0].values.fill_null(NO_ID).to_numpy()
                found = search_shard(Tree(values), query, hashes, weights, found, k, len(asking))
        if asking is not None:
            which = pa.array(found[0])
            doc = pa.array(found[2], mask=found[2] == NO_ID)
            yield pa.RecordBatch.from_arrays([asking.column("item_id").take(which), asking.column("digest").take(which), doc, pa.array(found[1])], ["item_id", "digest", "doc_id", "score"])

    dealt = index.shards.withColumn("lot", F.pmod(F.xxhash64("shard"), F.lit(lots))).withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    wanted = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "digest"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("item_id", "digest", "terms", "weights")).alias("asking"))
    wanted = wanted.withColumn("lot", F.explode(F.expr(f"sequence(0L, {lots - 1}L)")))
    hits = dealt.join(wanted, ["lot", "block"]).groupBy("lot", "block").applyInArrow(run, "item_id long, digest string, doc_id long, score long")
    order = W.partitionBy("item_id", "digest").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
lens AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lens),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN lens USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50
"""
