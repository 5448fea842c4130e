"""Evaluation: summaries, confusion metrics, scorecards and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions.scores import ratio


def quantiles(rows: DataFrame, key: str, value: str, shares: list[float], bins: int = 4096) -> DataFrame:
    """Exact linear quantiles of each key: (key, share, quantile).

    The ranks are found in counts of ``bins`` bins of equal width first; only the values of the bins
    that hold one are counted each, so no key's values meet in one task. Null and NaN values are left out.
    """
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, F.col(value).cast("double").alias("v"))
    ends = rows.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins))).otherwise(0)
    binned = rows.join(ends.select(key, "low", "high"), key).select(key, "v", at.cast("int").alias("bin"))
    order = W.partitionBy(key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    counts = binned.groupBy(key, "bin").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0)))
    wanted = ends.select(key, "n", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    ranks = wanted.select(key, "share", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("rank"))
    placed = ranks.join(counts, key).where("rank >= before and rank < before + c").select(key, "share", "at", "rank", "bin", "before")
    few = binned.join(placed.select(key, "bin").distinct(), [key, "bin"], "left_semi").groupBy(key, "bin", "v").agg(F.count("*").alias("m"))
    upto = few.withColumn("upto", F.sum("m").over(W.partitionBy(key, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    found = placed.join(upto, [key, "bin"]).where("before + upto > rank and before + upto - m <= rank")
    part = F.col("at") - F.floor("at")
    ends = found.groupBy(key, "share").agg(F.min_by("v", "rank").alias("lower"), F.max_by("v", "rank").alias("upper"), F.first(part).alias("part"))
    return ends.select(key, "share", (F.col("lower") + F.col("part") * (F.col("upper") - F.col("lower"))).alias("quantile"))


def score_summary(samples: DataFrame, key: str, score: str) -> DataFrame:
    """Minimum, mean, linear quantiles and maximum of each key's scores."""
    names = {0.5: "p50", 0.9: "p90", 0.95: "p95", 0.99: "p99"}
    cut = samples.groupBy(key).agg(F.min(score).alias("minimum"), F.round(F.avg(score), 6).alias("mean"), F.max(score).alias("maximum"))
    found = quantiles(samples, key, score, list(names)).groupBy(key).agg(*[F.round(F.max(F.when(F.col("share") == q, F.col("quantile"))), 6).alias(n) for q, n in names.items()])
    return cut.join(found, key, "left").select(key, "minimum", "mean", *names.values(), "maximum")


def top_k_mean(samples: DataFrame, key: str, score: str, identity: str, k: int) -> DataFrame:
    """Mean of the k largest scores of each key.

    A rank over the whole key would gather it in one task, so each of 16 slices ranks its own first.
    """
    slice_ = F.pmod(F.xxhash64(identity), F.lit(16))
    first = W.partitionBy(key, "slice").orderBy(F.col(score).desc(), identity)
    few = samples.select(key, score, identity, slice_.alias("slice")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    best = W.partitionBy(key).orderBy(F.col(score).desc(), identity)
    return few.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy(key).agg(F.round(F.avg(score), 6).alias("top_mean"), F.count("*").alias("n"))


def confusion(expected: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(expected & predicted).alias("tp"),
        F.count_if(~expected & ~predicted).alias("tn"),
        F.count_if(~expected & predicted).alias("fp"),
        F.count_if(expected & ~predicted).alias("fn"),
    ]


def rates() -> list[Column]:
    """Rates from tp, tn, fp and fn, null where nothing is counted."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    recall, specificity = F.try_divide(tp.cast("double"), tp + fn), F.try_divide(tn.cast("double"), tn + fp)
    return [
        ratio(tp, tp + fn).alias("recall"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tn, tn + fp).alias("specificity"),
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        F.round((recall + specificity) / 2, 4).alias("balanced_accuracy"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def scorecard(rows: DataFrame, group: str, split: str, expected: Column, predicted: Column) -> DataFrame:
    """Confusion rates for each group and split, and for each group over all splits (split 'all')."""
    sets = rows.withColumns({"e": expected, "p": predicted}).groupingSets([[group, split], [group]], group, split)
    counted = sets.agg(F.grouping(split).alias("g"), *confusion(F.col("e"), F.col("p")))
    return counted.select(group, F.when(F.col("g") == 1, "all").otherwise(F.col(split)).alias(split), "tp", "tn", "fp", "fn", *rates())


def compare(baseline: DataFrame, candidate: DataFrame, keys: list[str], metric: str, allowed: float) -> DataFrame:
    """Full outer comparison of a metric of two scorecards; a key that one side lacks, or a loss beyond ``allowed``, violates the gate."""
    b = baseline.select(*keys, F.col(metric).alias("before"), F.lit(True).alias("in_b"))
    c = candidate.select(*keys, F.col(metric).alias("after"), F.lit(True).alias("in_c"))
    both = b.join(c, keys, "full_outer").withColumn("delta", F.round(F.col("after") - F.col("before"), 4))
    status = F.when(F.col("in_c").isNull(), "missing").when(F.col("in_b").isNull(), "new").when(F.col("delta") < -allowed, "violation").when(F.col("delta").isNull(), "unknown").otherwise("ok")
    return both.select(*keys, "before", "after", "delta", status.alias("status"))
