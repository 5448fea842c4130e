"""Steps from reports to a review queue: context, guards, decisions carried over, triage, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import boxes
from spanloom.operators.intervals import overlap_join


def with_context(spans: DataFrame, samples: DataFrame, key: str, context: float, threshold: float) -> DataFrame:
    """Widens spans (key, span_id, start, end) to samples (key, t, score) of at least ``threshold`` up to ``context`` seconds before or after."""
    near = spans.select(key, "span_id", (F.col("start") - context).alias("start"), (F.col("end") + context).alias("end"))
    points = samples.where(F.col("score") >= threshold).select(key, F.col("t").alias("start"), (F.col("t") + 1e-6).alias("end"))
    met = overlap_join(near, points, key, 2 * context).groupBy(F.col("l_span_id").alias("span_id")).agg(F.min("r_start").alias("low"), F.max("r_start").alias("high"))
    return spans.join(met, "span_id", "left").select(key, "span_id", F.least("start", F.coalesce("low", "start")).alias("start"), F.greatest("end", F.coalesce("high", "end")).alias("end"))


def guarded(items: DataFrame, references: DataFrame, key: str, width: float, least_iou: float) -> DataFrame:
    """The first reference (by id) of each item that overlaps it in time and by box: (item_id, guard), null if none does."""
    met = overlap_join(items, references, key, width).where(boxes.iou("l_", "r_") >= least_iou)
    first = met.groupBy(F.col("l_item_id").alias("item_id")).agg(F.min("r_ref_id").alias("guard"))
    return items.select("item_id").join(first, "item_id", "left")


def same_thing(a: str, b: str, time_share: float = 0.8, box_share: float = 0.75) -> Column:
    """Two cards show one thing: enough of the shorter time and of the smaller box in common."""
    common = F.least(F.col(f"{a}end"), F.col(f"{b}end")) - F.greatest(F.col(f"{a}start"), F.col(f"{b}start"))
    shorter = F.least(F.col(f"{a}end") - F.col(f"{a}start"), F.col(f"{b}end") - F.col(f"{b}start"))
    return (common >= time_share * shorter) & (boxes.over_smaller(a, b) >= box_share)


def carry_decisions(old: DataFrame, new: DataFrame, key: str, width: float) -> DataFrame:
    """Decisions of old cards for new ones: by id, else by likeness; (card_id, decision, how).

    Old cards of different decisions that all look like a new card make a conflict, without a decision.
    """
    exact = new.select("card_id").join(old.select("card_id", "decision"), "card_id")
    open_ = new.join(exact.select("card_id"), "card_id", "left_anti")
    alike = overlap_join(open_, old, key, width).where((F.col("l_category") == F.col("r_category")) & same_thing("l_", "r_"))
    votes = alike.groupBy(F.col("l_card_id").alias("card_id")).agg(F.countDistinct("r_decision").alias("n"), F.min("r_decision").alias("d"))
    fuzzy = votes.select("card_id", F.when(F.col("n") == 1, F.col("d")).alias("decision"), F.when(F.col("n") == 1, "alike").otherwise("conflict").alias("how"))
    found = exact.withColumn("how", F.lit("same")).unionByName(fuzzy)
    return new.select("card_id").join(found, "card_id", "left").select("card_id", "decision", F.coalesce("how", F.lit("open")).alias("how"))


def complete_evidence(hits: DataFrame, key: str, score: str, evidence: str) -> DataFrame:
    """Maxima and the strongest evidence of each key, null as soon as one hit lacks evidence."""
    whole = F.bool_and(F.col(evidence).isNotNull())
    out = hits.groupBy(key).agg(whole.alias("whole"), F.max(score).alias("m"), F.max_by(evidence, F.struct(F.col(score), -F.col("sample_id"))).alias("e"), F.count("*").alias("n"))
    return out.select(key, F.when(F.col("whole"), F.col("m")).alias("score_max"), F.when(F.col("whole"), F.col("e")).alias("strongest"), "n")


def last_chain(spans: DataFrame, key: str, gap: float) -> DataFrame:
    """The last run of spans whose pauses are at most ``gap``: (key, start, end, n)."""
    order = W.partitionBy(key).orderBy(F.col("start").desc(), F.col("end").desc())
    breaks = F.coalesce((F.lag("start").over(order) - F.col("end") > gap).cast("int"), F.lit(0))
    chained = spans.withColumn("b", breaks).withColumn("chain", F.sum("b").over(order.rowsBetween(W.unboundedPreceding, 0))).where("chain = 0")
    return chained.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def steps_above(changes: DataFrame, key: str, time: str, value: str, reach: int, ratio: float, floor: float) -> DataFrame:
    """Frames that change ``ratio`` times as much as the mean of their ``reach`` neighbours on either side, and at least ``floor``."""
    order = W.partitionBy(key).orderBy(time)
    around = order.rowsBetween(-reach, reach)
    others = F.try_divide(F.sum(value).over(around) - F.col(value), (F.count(value).over(around) - 1).cast("double"))
    return changes.withColumn("others", others).where((F.col(value) >= floor) & (F.col(value) >= ratio * F.coalesce("others", F.lit(0.0))))


def ends_of(samples: DataFrame, key: str, score: str, time: str) -> DataFrame:
    """The strongest sample of each key, the earliest of equals, and the latest one."""
    s = F.struct(F.col(score), (-F.col(time)).alias("early"), F.col("sample_id"))
    return samples.groupBy(key).agg(F.max(s).getField("sample_id").alias("strongest"), F.max(F.struct(time, "sample_id")).getField("sample_id").alias("latest"))


def longest_texts(rows: DataFrame, key: str, text: str, n: int, slices: int = 16) -> DataFrame:
    """The ``n`` longest distinct texts of each key joined by ' | ', ties by text; ranked in slices first."""
    distinct = rows.select(key, text).distinct().withColumn("slice", F.pmod(F.xxhash64(text), F.lit(slices)))
    order = [F.length(text).desc(), F.col(text)]
    few = distinct.withColumn("r", F.row_number().over(W.partitionBy(key, "slice").orderBy(*order))).where(F.col("r") <= n)
    few = few.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("r") <= n)
    return few.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text))), lambda x: x[text]), " | ").alias("texts"))


def steady_choice(runs: DataFrame, key: str, least_share: float, least_gain: float) -> DataFrame:
    """The option that both of the last two runs favour by a share and an amount; null if they don't agree.

    runs: (key, run, option, seconds); less is better.
    """
    best = runs.groupBy(key, "run").agg(F.min(F.struct("seconds", "option")).alias("first"), F.slice(F.sort_array(F.collect_list("seconds")), 2, 1).alias("second"))
    clear = best.select(key, "run", F.col("first.option").alias("option"), ((F.get("second", F.lit(0)) - F.col("first.seconds") >= least_gain) & (F.col("first.seconds") <= (1 - least_share) * F.get("second", F.lit(0)))).alias("clear"))
    last = clear.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.col("run").desc()))).where("r <= 2")
    return last.groupBy(key).agg(F.when((F.count("*") == 2) & F.bool_and(F.coalesce("clear", F.lit(False))) & (F.min("option") == F.max("option")), F.min("option")).alias("choice"))
