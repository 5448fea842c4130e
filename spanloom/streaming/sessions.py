"""Streams: sessions under a watermark, content deduplication and files that have settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanloom.sources.shipping import ship


def session_stream(hits: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of (source, ts, score), equal gaps merge; the end is the last hit, without the gap.

    The same plan runs on a table. Hits later than the watermark are dropped.
    """
    windows = hits.withWatermark("ts", late).groupBy("source", F.session_window("ts", gap).alias("w"))
    out = windows.agg(F.max("ts").alias("last"), F.max("score").alias("max_score"), F.count("*").alias("sample_count"))
    return out.select("source", F.col("w.start").alias("first"), "last", "max_score", "sample_count")


def tumbling_counts(hits: DataFrame, width: str, late: str) -> DataFrame:
    """Hits of each label per fixed window."""
    out = hits.withWatermark("ts", late).groupBy("label", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.max("score").alias("max_score"))
    return out.select("label", F.col("w.start").alias("first"), "n", "max_score")


def first_by_content(rows: DataFrame, digest: str, late: str) -> DataFrame:
    """Rows whose content hasn't been seen within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([digest])


def settled(observations: DataFrame, stable_seconds: int) -> DataFrame:
    """Files (path, size, mtime) that stayed the same for ``stable_seconds`` of observation time ``ts``, each state of a file once.

    The state of a path is its size, mtime, when they were first seen and whether it was reported.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, mtime, since, told = state.get if state.exists else (None, None, None, False)
        out = []
        for pdf in batches:
            for r in pdf.sort_values("ts").itertuples():
                at = r.ts.timestamp()
                if (r.size, r.mtime) != (size, mtime):
                    size, mtime, since, told = int(r.size), int(r.mtime), at, False
                elif not told and at - since >= stable_seconds:
                    told = True
                    out.append((key[0], size, mtime))
        state.update((size, mtime, since, told))
        yield pd.DataFrame(out, columns=["path", "size", "mtime"])

    ship(observations.sparkSession)
    # `size` is also a DataFrame attribute, so the columns of a batch are renamed on the way in
    rows = observations.select("path", F.col("size").alias("n_bytes"), "mtime", "ts")

    def renamed(key, batches, state):
        return update(key, (pdf.rename(columns={"n_bytes": "size"}) for pdf in batches), state)

    grouped = rows.groupBy("path")
    return grouped.applyInPandasWithState(renamed, "path string, size long, mtime long", "size long, mtime long, since double, told boolean", "append", GroupStateTimeout.NoTimeout)
