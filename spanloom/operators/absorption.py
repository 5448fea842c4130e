"""Cards of one mark put together: boxes trimmed to what is read again and again, and owners that absorb their supporters.

Owners act in order, and what one absorbs the next can't have. That order is kept without going
through the cards one by one: an owner waits only for earlier ones that may want one of its cards
or the owner itself, and all owners that wait for none act at once. Rounds are as many as the
longest chain of owners that wait for each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import boxes
from spanloom.operators.graph import checkpointed
from spanloom.operators.watermarks import leaders

# Overlap of reads with a box, area of a tight and of a wider read, reads that are needed, the share of the area that a
# trimmed text and a trimmed logo keep, the margin that is cut off otherwise.
READ_OVERLAP, TIGHT, WIDER, READS, TRIMMED, LEAST_TRIMMED, MARGIN = 0.70, 0.65, 2.0, 2, 0.75, 0.45, 0.05
# Overlap of an owner with a text track (approved owners first), with a brand, with any other card, inside a joined
# track, and of an approved card that another owner absorbs.
TRACK, APPROVED_TRACK, BRAND, CARD, IN_TRACK, APPROVED = 0.75, 0.60, 0.60, 0.80, 0.80, 0.95
BRANDS = ["external_brand", "external_brand_candidate"]
OWN_CARDS = ["opening_promotion", "branded_end_card", "promotional_segment", "scene_text", "subtitle", "title_overlay", "repeated_watermark"]
PERSISTENT, TITLE = "persistent_overlay", "title_overlay"
SIDES = ["x1", "y1", "x2", "y2"]
# Rounds after which what owners have taken is put together.
MERGED = 16


def _tiled(rows: DataFrame, tile: int) -> DataFrame:
    span = lambda low, high: F.sequence(F.floor(F.col(low) / tile), F.floor(F.greatest(F.col(low), F.col(high)) / tile))
    return rows.withColumn("tx", F.explode(span("x1", "x2"))).withColumn("ty", F.explode(span("y1", "y2")))


def _beside(a: DataFrame, b: DataFrame, tile: int) -> DataFrame:
    """(source, a, b): pairs of rows of one source whose boxes share a tile, once each.

    The file that rows come from says little about their size in tiles, so neither side is collected to be broadcast.
    """
    pack = lambda rows, name: _tiled(rows, tile).select("source", "tx", "ty", F.struct(*[c for c in rows.columns if c != "source"]).alias(name))
    met = pack(a, "a").hint("merge").join(pack(b, "b"), ["source", "tx", "ty"])
    # of the tiles that both touch the first one counts
    first = (F.col("tx") == F.floor(F.greatest("a.x1", "b.x1") / tile)) & (F.col("ty") == F.floor(F.greatest("a.y1", "b.y1") / tile))
    return met.where(first & (F.col("a.item_id") != F.col("b.item_id"))).drop("tx", "ty")


def _dominant(reads: DataFrame, tile: int) -> DataFrame:
    """(k, n, x1, y1, x2, y2): the largest group of like boxes of each key and their union; of equal ones that of the least area, then the first."""
    area = boxes.area("")
    led = leaders(reads, "k", [area, "y1", "x1", F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")], boxes.same_blur_target, tile)
    groups = led.groupBy("k", "leader").agg(F.count("*").alias("n"), F.sum(area).alias("total"), *[(F.min if s in ("x1", "y1") else F.max)(s).alias(s) for s in SIDES])
    best = F.max_by(F.struct("n", *SIDES), F.struct("n", -F.col("total"), -F.col("leader")))
    return groups.groupBy("k").agg(best.alias("best")).select("k", "best.*")


def refined_regions(items: DataFrame, tile: int = 128) -> DataFrame:
    """(source, item_id, method, support, x1, y1, x2, y2): new boxes of persistent overlays that repeated reads show to be too wide.

    items: (source, item_id, category, candidate, kind, start, end, x1, y1, x2, y2, approved, ocr). Reads are logos found by text while the overlay
    is there and over most of its box. Two like ones that are clearly tighter trim it to their union; if wider reads go on
    with the line of that union the box is theirs, since only a piece was read. Boxes that a user approved stay; every overlay is judged
    by the boxes as they came.
    """
    owned = items.where(F.col("category").isin("visual_logo", "text") & (F.col("candidate") == PERSISTENT) & F.col("x1").isNotNull() & ~F.coalesce("approved", F.lit(False)))
    reads = items.where((F.col("category") == "visual_logo") & F.coalesce(F.col("kind") != TITLE, F.lit(True)) & F.col("x1").isNotNull() & F.coalesce("ocr", F.lit(False)))
    pairs = _beside(owned.select("source", "item_id", "category", "start", "end", *SIDES), reads.select("source", "item_id", "start", "end", *SIDES), tile)
    pairs = pairs.where("b.start < a.end and b.end > a.start").where(boxes.over_smaller("a.", "b.") >= READ_OVERLAP)
    k = F.struct("source", "a.item_id").alias("k")
    near = pairs.select(k, F.struct("a.category", *[f"a.{s}" for s in SIDES]).alias("own"), boxes.area("a.").alias("area"), *[f"b.{s}" for s in SIDES]).checkpoint()
    tight = _dominant(near.where(boxes.area("") <= TIGHT * F.col("area")).select("k", *SIDES), tile).where(F.col("n") >= READS)
    tight = tight.select("k", F.col("n").alias("support"), *[F.col(s).alias(f"t_{s}") for s in SIDES]).checkpoint()
    wide = near.where((boxes.area("") > TIGHT * F.col("area")) & (boxes.area("") <= WIDER * F.col("area"))).join(tight, "k")
    wide = wide.where((boxes.area("") > boxes.area("t_")) & (boxes.over_smaller("t_", "") >= READ_OVERLAP))
    full = _dominant(wide.select("k", *SIDES), tile).where(F.col("n") >= READS).select("k", F.col("n").alias("full"), *[F.col(s).alias(f"f_{s}") for s in SIDES])
    own = near.groupBy("k").agg(F.first("own").alias("own"), F.first("area").alias("area"))
    rows = tight.join(own, "k").join(full, "k", "left")
    continued = F.coalesce(boxes.line_fragment("t_", "f_"), F.lit(False))
    share = boxes.area("t_") / F.greatest(F.lit(1), F.col("area"))
    trim = F.greatest(F.lit(2), F.bround(F.least(F.col("own.x2") - F.col("own.x1"), F.col("own.y2") - F.col("own.y1")) * MARGIN))
    method = F.when(continued, "repeated_full_mark_ocr_support").when((F.col("own.category") == "text") & (share < TRIMMED), "repeated_visual_ocr_consensus").when((share >= LEAST_TRIMMED) & (share < TRIMMED), "repeated_tight_ocr_support").otherwise("grounding_box_padding_trim")
    rows = rows.withColumn("method", method).withColumn("trim", trim)
    padded = F.col("method") == "grounding_box_padding_trim"
    wider = lambda s: (F.least if s in ("x1", "y1") else F.greatest)(f"t_{s}", f"f_{s}")
    inner = lambda s: F.col(f"own.{s}") + F.col("trim") * (1 if s in ("x1", "y1") else -1)
    out = rows.select("k.*", "method", F.when(F.col("method") == "repeated_full_mark_ocr_support", F.col("full")).otherwise(F.col("support")).alias("support"), *[F.when(F.col("method") == "repeated_full_mark_ocr_support", wider(s)).when(padded, inner(s)).otherwise(F.col(f"t_{s}")).alias(s) for s in SIDES])
    return out.where("x2 > x1 and y2 > y1")


def claims(items: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Owners by rank, and what each may absorb: (source, o, i, text, card, inside) with the rules that no earlier owner changes."""
    approved = F.coalesce("approved", F.lit(False))
    rank = F.when((F.col("category") == "visual_logo") & approved, 0).when(F.col("category") == "visual_logo", 1).otherwise(2)
    whole = items.where(F.col("x1").isNotNull()).withColumn("approved", approved)
    owners = whole.where(F.col("category").isin("visual_logo", "text") & (F.col("candidate") == PERSISTENT)).withColumn("rank", F.struct(rank.alias("r"), F.col("item_id").alias("i")))
    cards = whole.where(F.col("category").isin("visual_logo", "text"))
    own, other = ["approved", "dialogue", "rank"], ["candidate", "kind", "approved", "absorbable", "classification", "suggestion"]
    both = ["source", "item_id", "category", "start", "end", *SIDES, "decision"]
    pairs = _beside(owners.select(*both, *own), cards.select(*both, *other), tile).withColumnsRenamed({"a": "o", "b": "i"}).withColumn("share", boxes.over_smaller("o.", "i."))
    text = (F.col("o.category") == "visual_logo") & (F.col("i.category") == "text") & F.coalesce(F.col("i.candidate") == PERSISTENT, F.lit(False)) & (F.col("share") >= F.when(F.col("o.approved"), APPROVED_TRACK).otherwise(TRACK)) & (F.col("i.start") < F.col("o.end")) & (F.col("i.end") > F.col("o.start"))
    kept = F.coalesce(F.col("i.candidate").isin(OWN_CARDS), F.lit(False)) | F.coalesce(F.col("i.kind") == TITLE, F.lit(False))
    covered = ~F.col("i.approved") | F.col("o.approved") | (boxes.coverage("i.", "o.") >= APPROVED)
    quiet = ~F.coalesce("o.dialogue", F.lit(False)) | F.coalesce("i.absorbable", F.lit(False))
    agreed = F.col("i.decision").isNull() | F.coalesce(F.col("i.decision") == F.col("o.decision"), F.lit(False))
    free = ~kept & covered & quiet & agreed
    needs = F.when(F.coalesce(F.col("i.classification").isin(BRANDS), F.lit(False)), BRAND).otherwise(CARD)
    may = pairs.withColumns({"text": text, "card": free & (F.col("share") >= needs), "inside": free & (F.col("share") >= BRAND) & F.col("i.suggestion").isNotNull()}).where("text or card or inside")
    return owners, may.select("source", "o", "i", "text", "card", "inside")


def absorbed(items: DataFrame, duration: float, tile: int = 128, rounds: int = 1000) -> DataFrame:
    """(source, owner, item_id, role, start, end): the cards that owners absorb, each once; start and end are the owner's times then.

    items: (source, item_id, category, candidate, kind, start, end, x1, y1, x2, y2, approved, classification, suggestion, decision, dialogue, absorbable).
    Owners are persistent overlays with a box, approved brands first, then other logos, then texts, each by item_id. A logo joins the
    first text track at its place ('track'), over whose time it then lasts. It absorbs cards in its time that overlap
    it enough, and cards inside the joined track that propose the same ('card').
    """
    checkpointed(items.sparkSession)
    owners, may = claims(items, tile)
    at = lambda c, *names: F.struct(*[f"{c}.{n}" for n in names]).alias(c)
    may = may.select("source", F.col("o.item_id").alias("owner"), F.col("o.rank").alias("rank"), F.col("i.item_id").alias("item_id"), at("o", "start", "end"), at("i", "item_id", "start", "end", "suggestion", *SIDES), "text", "card", "inside")
    # owners compete if one may absorb the other, or both the same card: an owner claims itself as well
    self_ = owners.select("source", F.col("item_id").alias("owner"), "rank", "item_id")
    left = may.unionByName(self_, allowMissingColumns=True).checkpoint()
    out = []
    for _ in range(rounds):
        if left.isEmpty():
            break
        # ready are those who come first for all that they claim; what they take now no other ready owner claims
        first = F.min("rank").over(W.partitionBy("source", "item_id"))
        ready = left.withColumn("first", first).groupBy("source", "owner").agg(F.bool_and(F.col("rank") == F.col("first")).alias("ready")).where("ready").select("source", "owner").checkpoint()
        taken = _turn(left.where("i is not null").join(ready, ["source", "owner"], "left_semi"), duration).checkpoint()
        # claims on what is gone hold nobody up
        gone = taken.select("source", "item_id")
        done = ready.unionByName(gone.withColumnRenamed("item_id", "owner"))
        left = left.join(done, ["source", "owner"], "left_anti").join(gone, ["source", "item_id"], "left_anti").checkpoint()
        out.append(taken)
        if len(out) == MERGED:
            out = [reduce(DataFrame.unionByName, out).checkpoint()]
    else:
        raise RuntimeError(f"owners unfinished after {rounds} rounds")
    return reduce(DataFrame.unionByName, out) if out else _turn(left.where("i is not null"), duration)


def _turn(turn: DataFrame, duration: float) -> DataFrame:
    """What owners take when it is their turn, from what they may still have."""
    key = ["source", "owner"]
    rows = turn
    track = rows.where("text").groupBy(*key).agg(F.min_by("i", "i.item_id").alias("t"))
    rows = rows.join(track, key, "left")
    joined = F.col("t").isNotNull()
    low = F.when(joined, F.round(F.greatest(F.lit(0.0), F.least("o.start", "t.start")), 3)).otherwise(F.col("o.start"))
    high = F.when(joined, F.round(F.least(F.lit(duration), F.greatest("o.end", "t.end")), 3)).otherwise(F.col("o.end"))
    rows = rows.withColumns({"start": low, "end": high})
    is_track = joined & (F.col("i.item_id") == F.col("t.item_id"))
    same = F.coalesce(F.col("inside") & (F.col("i.suggestion") == "BLUR") & (boxes.coverage("i.", "t.") >= IN_TRACK), F.lit(False))
    within = (F.col("i.start") >= F.col("start")) & (F.col("i.end") <= F.col("end")) & (F.col("card") | same)
    role = F.when(F.coalesce(is_track, F.lit(False)), "track").when(within, "card")
    return rows.select(*key, F.col("i.item_id").alias("item_id"), role.alias("role"), "start", "end").where("role is not null")


def reconciled(items: DataFrame, duration: float, tile: int = 128) -> DataFrame:
    """The cards that stay, with what they have absorbed: items and n_absorbed; owners of a text track last as long, suggest a blur, and have all labels and refs.

    items as for ``absorbed``, with labels and refs.
    """
    got = absorbed(items, duration, tile).checkpoint()
    key = ["source", "item_id"]
    lists = items.select(*key, "labels", "refs").join(got.select(*key, "owner", "role"), key)
    each = lists.groupBy("source", F.col("owner").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("role") == "card").alias("later"), "item_id", "labels", "refs"))).alias("l"), F.count("*").alias("n_absorbed"), F.bool_or(F.col("role") == "track").alias("joined"))
    times = got.where("role = 'track'").select("source", F.col("owner").alias("item_id"), F.col("start").alias("low"), F.col("end").alias("high"))
    rows = items.join(got.select(key), key, "left_anti").join(each, key, "left").join(times, key, "left")
    none = F.array().cast("array<string>")
    every = lambda c: F.array_distinct(F.concat(F.coalesce(c, none), F.coalesce(F.flatten(F.transform("l", lambda x: F.coalesce(x[c], none))), none)))
    joined = F.coalesce("joined", F.lit(False))
    new: dict[str, Column] = {"start": F.coalesce("low", "start"), "end": F.coalesce("high", "end"), "suggestion": F.when(joined, "BLUR").otherwise(F.col("suggestion")), "labels": every("labels"), "refs": every("refs"), "n_absorbed": F.coalesce("n_absorbed", F.lit(0))}
    return rows.withColumns(new).select(*items.columns, "n_absorbed")
