"""Fuzzy joins of short texts by the share of matching runs (2M / T), exact through shared grams.

M matched letters of two texts of T letters together lie in at most T - 2M + 1 runs. At a ratio of
r that is at most (1 - r) T + 1 runs for at least r T / 2 letters, so with r over two thirds and T
over 2 / (3 r - 2) one run has two letters or more: similar texts share a pair of letters, and the
few shorter ones a letter. The join on these is complete; lengths are checked next, and only what
is left is compared letter by letter.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from spanloom.functions import text
from spanloom.operators.dealing import dealt
from spanloom.sources.shipping import ship


def grams(word: Column, n: int) -> Column:
    """The runs of n letters of a text, each once; none of a shorter one."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(word) - (n - 1))), lambda i: F.substring(word, i, n))
    return F.when(F.length(word) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def alike(least: float):
    @F.pandas_udf(BooleanType())
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            m = SequenceMatcher(None, x, y, autojunk=False)
            return m.quick_ratio() >= least and m.ratio() >= least

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return of


def within(least: float):
    @F.pandas_udf(BooleanType())
    def of(short: pd.Series, long: pd.Series) -> pd.Series:
        """Whether a stretch of the long text, as long as the short one, is alike; common letters bound the ratio."""

        def one(x: str, y: str) -> bool:
            n, letters = len(x), Counter(x)
            if x in y or (Counter(y) & letters).total() < least * n:
                return x in y
            m = SequenceMatcher(None, autojunk=False)
            m.set_seq1(x)
            for k in range(max(1, len(y) - n + 1)):
                part = y[k : k + n]
                if (Counter(part) & letters).total() >= least * n:
                    m.set_seq2(part)
                    if m.ratio() >= least:
                        return True
            return False

        return pd.Series([one(x, y) for x, y in zip(short, long, strict=True)], dtype=bool)

    return of


def fragments(words: DataFrame, scope: list[str], least: float = 0.75) -> DataFrame:
    """(*scope, a, b): all pairs of different texts of which a is like a stretch of b as long as a is.

    a is no longer than b; of two texts of one length both orders are looked at. At a ratio of
    r, runs of two letters are certain from 1 / (3 r - 2) letters on; shorter texts are left out.
    """
    if least <= 2 / 3:
        raise ValueError("texts of a ratio of two thirds or less need not share any pair of letters")
    ship(words.sparkSession)
    own = words.select(*scope, "word").where(F.length("word") > 1 / (3 * least - 2)).distinct()
    cut = own.withColumn("gram", F.explode(grams(F.col("word"), 2)))
    a, b = cut.withColumnRenamed("word", "a"), cut.withColumnRenamed("word", "b")
    # m matched letters in r runs hold m - r pairs of letters, so this many are shared at least
    shared = F.ceil((3 * least - 2) * F.length("a")) - 1
    repeats = F.length("a") - 1 - F.size(grams(F.col("a"), 2))
    pairs = a.join(b, [*scope, "gram"]).where("a <> b and length(a) <= length(b)").groupBy(*scope, "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= shared - repeats).drop("n")
    told = pairs.select("a", "b").distinct().where(within(least)("a", "b"))
    return pairs.join(told, ["a", "b"]).select(*scope, "a", "b")


def known(reads: DataFrame, memory: DataFrame, scope: list[str], least: float = 0.8, missing: int = 1) -> DataFrame:
    """(*scope, read): the reads (scope, read) that repeat a text of the memory (scope, word), both of letters and digits alone.

    A read of fewer than two letters is noise and known; one is known if it equals a text, lies in it (from three letters), or is
    alike with at most ``missing`` letters of its own unmatched.
    """
    ship(reads.sparkSession)
    short = int(2 / (3 * least - 2))
    own, texts = reads.select(*scope, "read").where("read is not null").distinct(), memory.select(*scope, "word").where("length(word) > 0").distinct()
    cut = lambda rows, c: rows.withColumn("gram", F.explode(F.when(F.length(c) < short, F.concat(grams(F.col(c), 1), grams(F.col(c), 2))).otherwise(grams(F.col(c), 2))))

    @F.pandas_udf(BooleanType())
    def repeats(read: pd.Series, word: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> bool:
            m = SequenceMatcher(None, x, y, autojunk=False)
            return m.quick_ratio() >= least and m.ratio() >= least and len(x) - sum(b.size for b in m.get_matching_blocks()) <= missing

        return pd.Series([one(x, y) for x, y in zip(read, word, strict=True)], dtype=bool)

    pairs = cut(own.where("length(read) > 1"), "read").join(cut(texts, "word"), [*scope, "gram"]).select(*scope, "read", "word").distinct()
    same = (F.col("read") == F.col("word")) | ((F.length("read") >= 3) & F.contains("word", "read"))
    near = 2 * F.least(F.length("read"), F.length("word")) >= least * (F.length("read") + F.length("word"))
    held = pairs.where(same).select(*scope, "read")
    close = pairs.where(near).join(held.distinct(), [*scope, "read"], "left_anti")
    told = close.select("read", "word").distinct().where(repeats("read", "word"))
    alike_ = close.join(told, ["read", "word"]).select(*scope, "read")
    return own.where("length(read) < 2").unionByName(held).unionByName(alike_).distinct()


def similar(words: DataFrame, scope: str, least: float = 0.75) -> DataFrame:
    """(scope, a, b): all ordered pairs of different texts (scope, word) one of which holds the other or is alike by ``least``.

    The ratio of (a, b) isn't always that of (b, a), so both orders are looked at. Null and empty texts are like none.
    """
    if least <= 2 / 3:
        raise ValueError("texts of a ratio of two thirds or less need not share any pair of letters")
    ship(words.sparkSession)
    short = int(2 / (3 * least - 2))
    own = words.select(scope, "word").where("length(word) > 0").distinct()
    pieces = F.when(F.length("word") < short, F.concat(grams(F.col("word"), 1), grams(F.col("word"), 2))).otherwise(grams(F.col("word"), 2))
    cut = own.withColumn("gram", F.explode(pieces))
    # a single letter is held by a longer text without sharing a pair of letters with it
    letters = own.where("length(word) > 1").select(scope, F.col("word").alias("b"), F.explode(grams(F.col("word"), 1)).alias("a"))
    holds = own.where("length(word) = 1").withColumnRenamed("word", "a").join(letters, [scope, "a"]).select(scope, "a", "b")
    a, b = cut.withColumnRenamed("word", "a"), cut.withColumnRenamed("word", "b")
    inside = F.contains("a", "b") | F.contains("b", "a")
    near = 2 * F.least(F.length("a"), F.length("b")) >= least * (F.length("a") + F.length("b"))
    pairs = a.join(b, [scope, "gram"]).where("a <> b").where(inside | near).select(scope, "a", "b").distinct()
    held = pairs.where(inside).unionByName(holds).unionByName(holds.select(scope, F.col("b").alias("a"), F.col("a").alias("b")))
    rest = pairs.where(~inside)
    told = rest.select("a", "b").distinct().where(alike(least)("a", "b"))
    return held.unionByName(rest.join(told, ["a", "b"]).select(scope, "a", "b")).distinct()


def named_in(rows: DataFrame, names: DataFrame, key: str, said: str) -> DataFrame:
    """The names within one edit of a candidate of a folded text: (key, name, edits), the least edits.

    rows: (key, said); names: (name). Equal texts are taken apart once and equal candidates compared
    once; what a candidate becomes without a letter meets only what names become.
    """
    texts = dealt(rows.select(said).distinct(), said).select(said, F.explode(text.latin_candidates(F.col(said))).alias("cand"))
    known = names.select("name", F.explode(text.deletions(F.col("name"))).alias("k"))
    short = dealt(texts.select("cand").distinct(), "cand").select("cand", F.explode(text.deletions(F.col("cand"))).alias("k"))
    near = short.join(known, "k").select("cand", "name").distinct().withColumn("edits", F.levenshtein("cand", "name").cast("long")).where("edits <= 1")
    held = texts.join(near, "cand").groupBy(said, "name").agg(F.min("edits").alias("edits"))
    return rows.select(key, said).join(held, said).groupBy(key, "name").agg(F.min("edits").alias("edits"))
