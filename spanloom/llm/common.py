"""Shared helpers: staged tables, vectorised text views, hashing and components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.shipping import ship

# The word rule of all contracts, words are runs of other bytes than these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

# Parquet looks at sizes after 100 rows at first.
WIDE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or one of our own in local tests."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


class Staged:
    """Tables written to the shared folder to cut lineage; a lost executor only costs its own tasks."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/staged-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str, wide: bool = False) -> DataFrame:
        """Writes a table and reads it again. The rows of a ``wide`` one have megabytes: writers look at the size
        of what they hold after each row, and readers, who take a row group at once, find few rows in one."""
        path = f"{self.root}/{name}"
        how = df.write.mode("overwrite").option("compression", "zstd")
        for option, value in WIDE_ROWS.items() if wide else ():
            how = how.option(option, value)
        how.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Frees a table that no pending plan reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        with contextlib.suppress(Exception):
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lowest(rows: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """About the ``most`` rows of lowest hash of the key, never more; reruns agree.

    The hash is cut first at twice the share that is wanted, so tasks don't each send ``most`` rows.
    """
    share = min(1.0, (2 * most + 100) / max(1, total))
    few = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000_007)) <= int(1_000_000_007 * share))
    return few.orderBy(F.pmod(F.xxhash64(key), F.lit(1_000_000_007)), key).limit(most)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, to bound the arrays built from it."""
    _, offs = utf8(batch.column(column))
    at, n = 0, len(batch)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(21, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base)
            p[0] = _U(1)
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values (SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes: out[j] covers values[:j]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(values)
    return mix((sums[k:] - sums[:-k]) * powers(len(sums))[1][:n])


def word_spans(data: np.ndarray, offs: np.ndarray, parts: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the word offsets of the rows.

    parts says for each of the 256 bytes whether it parts words.
    """
    n = len(data)
    gap = np.ones(n + 1, bool)
    gap[:n] = parts[data]
    before = np.empty(n, bool)
    before[1:] = gap[: n - 1]
    edge = offs[(offs < n)]
    if n:
        before[0] = True
        before[edge] = True
    after = gap[1:].copy()
    inner = offs[(offs > 0) & (offs <= n)] - 1
    after[inner] = True
    word = ~gap[:n]
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(byte_values(data)), starts, ends)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def components(spark: SparkSession, edges: DataFrame, staged: Staged, limit: int = 100) -> DataFrame:
    """Smallest reachable id of each node of the edges (a, b): alternating star contraction.

    Large-star links every larger neighbour of a node to its smallest neighbour, small-star
    links the smaller ones; the edges become stars around the smallest ids in a number of
    rounds logarithmic in the longest path. Ids stay in tables, a round is two groupings. Raises an
    error if the edges still change after ``limit`` rounds.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct()
    now = staged.write(pairs, "edges0")
    last = None
    for k in range(1, limit + 1):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select(F.col("x.a").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct()
        after = staged.write(small, f"edges{k}")
        sign = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        staged.drop(f"edges{k - 1}")
        now = after
        if sign == last or not sign.n:
            break
        last = sign
    else:
        raise RuntimeError(f"components unfinished after {limit} rounds")
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
