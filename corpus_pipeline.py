"""A corpus pipeline of five stages; each works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, written as Parquet
and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bwt_merge, decontaminate, mixing, simhash, toxicity
from spanloom.llm.common import Staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects.

    Null and empty texts have no features and stay; repeated rows are judged alike; texts of any
    length are scored whole; an empty table stays empty; all columns are kept, whatever their names.
    """
    columns = docs.columns
    rows = docs.select("doc_id", "text", F.struct(*columns).alias("row"))
    return toxicity.toxicity(rows, _table(spark, sf_dir, "labels"), keep=("doc_id", "row")).where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies (five-word shingles, Jaccard 0.8).

    The one of smallest doc_id stays, null last. Texts without words are copies of each other;
    repeated rows are one; texts of any length count whole; an empty table stays empty.
    """
    return simhash.near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 200 that occur elsewhere too; a character cut in two goes as a whole.

    Every row stays, with what is left of its text and the new n_chars; null texts become empty;
    an empty table stays empty; all columns are kept, whatever their names.
    """
    cut = bwt_merge.cut_rows(docs, as_text=True)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items.

    Null and empty texts hold none and stay; repeated rows go or stay together; an empty table of
    documents or items drops nothing; all columns are kept, whatever their names.
    """
    found = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")).select(F.col("rid").alias("found_rid"), F.col("doc_id").alias("found_id")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("id"))
    return keyed.join(found, F.expr("rid = found_rid and id <=> found_id"), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each.

    Texts without words have a size of 0 and are not taken; a null source is a source; repeated rows
    are documents of their own; texts of any length count whole; an empty table stays empty. All
    columns are kept, whatever their names; size, source_size, target and taken are added, as mix_size and so on
    if the documents have such a column.
    """
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    mixed = mixing.mix_sources(rows, _table(spark, sf_dir, "labels"), keep=("row",)).where("taken > 0")
    added = [F.col(c).alias(f"mix_{c}" if c in docs.columns else c) for c in ("size", "source_size", "target", "taken")]
    return mixed.select("row.*", *added)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix),
]
#: Trained scores and similarity joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    staged = Staged(spark)
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = staged.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            staged.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
