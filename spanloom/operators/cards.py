"""Review cards: acceptance of reads, zones, priorities, evidence of several sources and balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import boxes
from spanloom.operators.intervals import overlap_join


# Fixed values in zone and accepted: the edges of zones, the letter class and the lengths of reads.
def zone(x: Column, y: Column) -> Column:
    """Zone of a box's centre, given as shares of the frame: the subtitle band or one of nine fields."""
    down = F.when(y < 0.28, "top").when(y > 0.72, "bottom").otherwise("middle")
    across = F.when(x < 0.30, "left").when(x > 0.70, "right").otherwise("center")
    return F.when((y >= 0.72) & x.between(0.18, 0.82), "subtitle").otherwise(F.concat_ws("-", down, across))


def accepted(text: Column, confidence: Column, where: Column, least: float, banner: float) -> Column:
    """A read of two or more letters or digits that is sure enough, or a long one at the top that is nearly so."""
    n = F.length(F.regexp_replace(text, "[^0-9A-Za-zÀ-ỹĐđ]+", ""))
    return (n >= 2) & ((confidence >= least) | ((confidence >= banner) & where.startswith("top-") & (n >= 12)))


def priority(explicit: Column, reason: Column, ranks: tuple[str, ...] = ("high", "context", "normal")) -> Column:
    named = F.lower(explicit)
    return F.when(named.isin(*ranks), named).when(F.coalesce(F.lower(reason), F.lit("")).contains("high"), "high").otherwise("context")


def trimmed_height(height: Column) -> Column:
    """Height without the padding below a row of text: a tenth, 2 to 8 pixels, of rows of 24 or more."""
    trim = F.least(F.lit(8), F.greatest(F.lit(2), F.round(height * 0.10).cast("int")))
    return F.when((height >= 24) & (height - trim >= 12), height - trim).otherwise(height)


def corroborated(cards: DataFrame, marks: DataFrame, key: str, width: float, share: float) -> DataFrame:
    """Number of marks at each card's time and place: (card_id, confirmations)."""
    met = overlap_join(cards, marks, key, width).where(boxes.over_smaller("l_", "r_") >= share)
    counted = met.groupBy(F.col("l_card_id").alias("card_id")).agg(F.count("*").alias("confirmations"))
    return cards.select("card_id").join(counted, "card_id", "left").fillna(0, ["confirmations"])


def window_evidence_tokens(windows: DataFrame, reads: DataFrame, scans: DataFrame, key: str, width: float) -> DataFrame:
    """Distinct tokens read in each window: null where no scan covers the window, empty where it holds none.

    windows: (key, window_id, start, end); reads: (key, start, end, token), null tokens are reads
    without evidence; scans: (key, start, end).
    """
    whole = overlap_join(windows, scans, key, width).where("r_start <= l_start and r_end >= l_end").select(F.col("l_window_id").alias("window_id")).distinct().withColumn("covered", F.lit(True))
    met = overlap_join(windows, reads.where("token is not null"), key, width)
    tokens = met.groupBy(F.col("l_window_id").alias("window_id")).agg(F.array_sort(F.collect_set("r_token")).alias("tokens"))
    joined = windows.select(key, "window_id").join(whole, "window_id", "left").join(tokens, "window_id", "left")
    return joined.select(key, "window_id", F.when(F.col("covered"), F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"))


def best_owner(cards: DataFrame, owners: DataFrame, key: str, width: float, least: float) -> DataFrame:
    """The owner that covers the largest share of each card, from ``least`` on: (card_id, owner_id, share)."""
    met = overlap_join(cards, owners, key, width)
    share = (F.least("l_end", "r_end") - F.greatest("l_start", "r_start")) / (F.col("l_end") - F.col("l_start"))
    best = met.groupBy(F.col("l_card_id").alias("card_id")).agg(F.max(F.struct(share.alias("share"), (-F.col("r_owner_id")).alias("n"))).alias("b")).where(F.col("b.share") >= least)
    found = best.select("card_id", (-F.col("b.n")).alias("owner_id"), F.round("b.share", 6).alias("share"))
    return cards.select("card_id").join(found, "card_id", "left")


def balanced(examples: DataFrame, once: str, expected: str, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` examples of either class, each image once (its first by order)."""
    first = examples.groupBy(once).agg(F.min(F.struct(*order, *[c for c in examples.columns if c not in (once, *order)])).alias("b"))
    rows = first.select(once, "b.*")
    parts = [rows.where(F.col(expected) == k).orderBy(*order, once).limit(limit) for k in (True, False)]
    return parts[0].unionByName(parts[1])


def bucket_of(status: Column, state: Column, last: Column) -> Column:
    """Where a member counts: by its own status, by its task's state, or by the last state of a task that is gone."""
    gone = state.isNull()
    now = F.coalesce(state, last)
    return F.when(status.isin("pending", "held", "cancelled"), status).when(now.isNull(), "removed").when(now == "active", F.when(gone, "removed").otherwise("running")).when(now.isin("completed", "failed", "expired"), now).otherwise(F.when(gone, "removed").otherwise("attention"))


def representatives(windows: DataFrame, bucket: str, kind: str, chosen: str) -> DataFrame:
    """Coverage of candidate windows per bucket: all regional ones and up to two full-frame ones are required."""
    regional = F.col(kind) == "regional"
    out = windows.groupBy(bucket).agg(F.count_if(regional).alias("regional"), F.count_if(regional & ~F.col(chosen)).alias("regional_omitted"), F.count_if(~regional).alias("full_frame"), F.count_if(~regional & F.col(chosen)).alias("full_frame_selected"))
    missing = F.greatest(F.lit(0), F.least(F.lit(2), "full_frame") - F.col("full_frame_selected"))
    return out.withColumn("missing", missing).withColumn("complete", (F.col("regional_omitted") == 0) & (F.col("missing") == 0))


def adopted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins: the newest non-null value of each column of a key."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others], F.max(order).alias(order))


def shared_keys(rows: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """Keys that stand for more than one identity."""
    return rows.groupBy(key).agg(F.countDistinct(F.struct(*identity)).alias("n")).where("n > 1")


def disjoint(rows: DataFrame, key: str) -> DataFrame:
    """Pairs of neighbours of a key that overlap: a check that is empty if the segments are disjoint."""
    order = W.partitionBy(key).orderBy("start", "end")
    return rows.withColumn("before", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))).where(F.col("start") < F.col("before"))


def recalled(asked: DataFrame, memory: DataFrame, identity: str, most: int) -> DataFrame:
    """The most similar record (label, record, bits) of each row (identity, bits) within ``most`` differing bits of 64: (identity, memory, similarity).

    64 bits fall into most + 1 blocks, one of which is equal in any two rows that near, so rows meet
    records by an equi-join on blocks. Of equally similar records the one of smallest number wins.
    """
    edges = [64 * k // (most + 1) for k in range(most + 2)]
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("bits", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    left = asked.select(identity, "bits", F.explode(blocks).alias("b")).select(identity, "bits", "b.*")
    right = memory.select("label", "record", F.col("bits").alias("own"), F.explode(blocks).alias("b")).select("label", "record", "own", "b.*")
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("own")))
    best = left.join(right, ["block", "value"]).withColumn("apart", apart).where(F.col("apart") <= most).groupBy(identity).agg(F.min(F.struct("apart", "record", "label")).alias("m"))
    found = best.select(identity, F.col("m.label").alias("memory"), (1 - F.col("m.apart") / F.lit(64.0)).alias("similarity"))
    return asked.select(identity).join(found, identity, "left")
