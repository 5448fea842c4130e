"""Readers and adapters: the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; keys that are absent are null, malformed documents are null rows."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV manifest with a header; rows whose label isn't 0 or 1 are refused."""
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return rows.withColumn("label", F.when(F.col("label").isin(0, 1), F.col("label")).otherwise(F.raise_error(F.lit("label must be 0 or 1")).cast("int")))


def write_json_lines(df: DataFrame, path: str) -> None:
    """Committed JSON output: readers see all of it or none."""
    df.write.mode("overwrite").json(path)


def seconds(ts: str = "ts") -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / F.lit(1e6)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored samples: (source, t, score, label, sample_id)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), seconds().alias("t"), F.col("value").alias("score"), F.col("event_type").alias("label"), F.col("event_id").alias("sample_id"))
