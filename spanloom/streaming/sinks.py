"""A keyed table that streams write to: each batch is merged once, whatever is tried again.

The table is a sequence of whole versions; a batch reads the last one, merges and writes the next under its own
number, then a small marker names it. A batch that is tried again after a failure finds its marker, or
writes the same version anew, so nothing is merged twice and readers see all of a batch or none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class MergedTable:
    """Rows by key: of a key the row of the greatest order stays, of equal ones the later batch's; log keeps up to ``log`` rows of a key."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, log: int = 1):
        self.spark, self.path, self.keys, self.order, self.log = spark, path.rstrip("/"), keys, order, log
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Batches that are in the table, in order."""
        root = self._path(f"{self.path}/done")
        if not self._fs.exists(root):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(root))

    def read(self) -> DataFrame | None:
        """The table as of its last batch; None before the first."""
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{done[-1]}").drop("_batch") if done else None

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Merges a batch; one that is in the table already, or is older than it, changes nothing."""
        done = self.versions()
        if done and batch <= done[-1]:
            return
        new = rows.withColumn("_batch", F.lit(batch).cast("long"))
        if done:
            new = new.unionByName(self.spark.read.parquet(f"{self.path}/v{done[-1]}"))
        latest = W.partitionBy(*self.keys).orderBy(F.col(self.order).desc_nulls_last(), F.col("_batch").desc())
        kept = new.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= self.log).drop("_n")
        kept.write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        self._fs.create(self._path(f"{self.path}/done/{batch}"), True).close()
        # the version before stays for readers that have begun with it
        for old in done[:-1]:
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)
            self._fs.delete(self._path(f"{self.path}/done/{old}"), True)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch."""
        return lambda rows, batch: self.merge(rows, batch)
