"""Box geometry as column expressions. Boxes are columns x1, y1, x2, y2 under a prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.dealing import dealt


def _c(p: str, name: str) -> Column:
    return F.col(f"{p}{name}")


def area(p: str) -> Column:
    return F.greatest(F.lit(0), _c(p, "x2") - _c(p, "x1")) * F.greatest(F.lit(0), _c(p, "y2") - _c(p, "y1"))


def intersection(a: str, b: str) -> Column:
    width = F.least(_c(a, "x2"), _c(b, "x2")) - F.greatest(_c(a, "x1"), _c(b, "x1"))
    height = F.least(_c(a, "y2"), _c(b, "y2")) - F.greatest(_c(a, "y1"), _c(b, "y1"))
    return F.greatest(F.lit(0), width) * F.greatest(F.lit(0), height)


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 for empty boxes."""
    common = intersection(a, b)
    return F.coalesce(F.try_divide(common.cast("double"), area(a) + area(b) - common), F.lit(0.0))


def over_smaller(a: str, b: str) -> Column:
    return intersection(a, b) / F.greatest(F.lit(1), F.least(area(a), area(b))).cast("double")


def coverage(inner: str, outer: str) -> Column:
    return F.coalesce(F.try_divide(intersection(inner, outer).cast("double"), area(inner)), F.lit(0.0))


def region_quality(item: str, label: str) -> Column:
    """'ok' if the item covers 85 % of the label and is at most four times as large."""
    fits = (coverage(label, item) >= 0.85) & (area(item) <= 4 * area(label))
    return F.when(area(label) <= 0, "no_region").when(fits, "ok").otherwise("fail")


def union_box(a: str, b: str) -> list[Column]:
    return [F.least(_c(a, n), _c(b, n)).alias(n) for n in ("x1", "y1")] + [F.greatest(_c(a, n), _c(b, n)).alias(n) for n in ("x2", "y2")]


def padded(p: str, by: int, width: int, height: int) -> list[Column]:
    """The box with a margin, clamped to the frame."""
    low = [F.greatest(F.lit(0), _c(p, n) - by).alias(n) for n in ("x1", "y1")]
    return low + [F.least(F.lit(m), _c(p, n) + by).alias(n) for n, m in (("x2", width), ("y2", height))]


def from_region(p: str) -> list[Column]:
    """Corners of a region given by x, y, width and height under the prefix; null unless both sizes are positive."""
    fits = (_c(p, "width") > 0) & (_c(p, "height") > 0)
    ends = {"x1": _c(p, "x"), "y1": _c(p, "y"), "x2": _c(p, "x") + _c(p, "width"), "y2": _c(p, "y") + _c(p, "height")}
    return [F.when(fits, c.cast("double")).alias(n) for n, c in ends.items()]


def to_pixels(p: str, width: Column, height: Column) -> list[Column]:
    """Pixels of a region given by shares of the frame (x, y, width, height), at least one and inside it; half pixels go to the even one."""
    x1 = F.greatest(F.lit(0), F.least(width - 1, F.bround(_c(p, "x") * width)))
    y1 = F.greatest(F.lit(0), F.least(height - 1, F.bround(_c(p, "y") * height)))
    x2 = F.greatest(x1 + 1, F.least(width, F.bround((_c(p, "x") + _c(p, "width")) * width)))
    y2 = F.greatest(y1 + 1, F.least(height, F.bround((_c(p, "y") + _c(p, "height")) * height)))
    return [c.cast("long").alias(n) for n, c in (("x", x1), ("y", y1), ("width", x2 - x1), ("height", y2 - y1))]


def _side(p: str, a: str, b: str) -> Column:
    return _c(p, b) - _c(p, a)


def _gap(a: str, b: str, low: str, high: str) -> Column:
    """Distance of two boxes along an axis, negative where they overlap."""
    return F.greatest(_c(a, low), _c(b, low)) - F.least(_c(a, high), _c(b, high))


def overlapping(rows: DataFrame, keys: list[str], least: float, tile: int) -> DataFrame:
    """Pairs of rows (id, keys, x1, y1, x2, y2) of equal keys with an IoU of at least ``least`` (above 0), once each: all columns under l_ and r_, l_id < r_id.

    What two such boxes have in common is ``least`` of either's side at least, so its low corner lies
    that far below both boxes' high ends; they meet in the tile of that corner.
    """
    span = lambda low, high: F.sequence(F.floor(F.col(low) / tile), F.floor(F.greatest(F.col(low), F.col(high) - least * (F.col(high) - F.col(low)) + 1e-6) / tile))
    tiled = rows.where("x2 > x1 and y2 > y1").withColumn("tx", F.explode(span("x1", "x2"))).withColumn("ty", F.explode(span("y1", "y2")))
    l, r = (tiled.select(*[F.col(c).alias(f"{p}_{c}") for c in tiled.columns]) for p in "lr")
    l = dealt(l, *[f"l_{c}" for c in (*keys, "tx", "ty")])
    same = reduce(lambda x, y: x & y, [F.col(f"l_{c}") == F.col(f"r_{c}") for c in (*keys, "tx", "ty")])
    corner = (F.col("l_tx") == F.floor(F.greatest("l_x1", "r_x1") / tile)) & (F.col("l_ty") == F.floor(F.greatest("l_y1", "r_y1") / tile))
    met = l.join(r, same & (F.col("l_id") < F.col("r_id")) & corner)
    return met.where(iou("l_", "r_") >= least).drop("l_tx", "l_ty", "r_tx", "r_ty")


# Rows of a block at most, about; rows of a right side that are run through for each left row, a multiple of 8.
BLOCK, STRIP = 4096, 120


def paired(rows: DataFrame, key: str, blocks: int = 8, near: tuple[list[str], list[str]] = ([], [])) -> DataFrame:
    """All pairs of rows (id, key, ...) of one key, once each: all columns under l_ and r_, l_id < r_id.

    The rows of a key stand in blocks of following ids (numbers), ``blocks`` of them or as many as ``BLOCK`` rows in one
    need. A block is one row that holds its rows in an array, and each two blocks of a key meet in a cell of their own, so
    a task holds a few thousand rows of a key, however many there are. Nothing is made and then thrown away but half of
    the cells of a block with itself.

    Pairs are all but only written, so their order says how much: the left rows are ordered by the columns ``near[0]``,
    the right ones by ``near[1]``, and a strip of right rows comes whole for one left row after the other. What the pairs of
    neighbours tell repeats, and column files hold it in few bytes.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col("id").isNotNull())
    most = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    parts = max(blocks, -(-most // BLOCK))
    ends = rows.groupBy(key).agg(F.greatest(F.lit(blocks), F.ceil(F.count("*") / BLOCK)).alias("own"), F.percentile_approx("id", [i / parts for i in range(1, parts)] or [1.0], F.lit(10000)).alias("ends"))
    # rounded down, so that the blocks stay in the order of ids
    block = F.floor(F.size(F.filter("ends", lambda e: e < F.col("id"))) * F.col("own") / parts)
    cut = rows.join(ends.hint("merge"), key).withColumn("block", F.least(block, F.col("own") - 1))

    def side(p: str, order: list[str]) -> DataFrame:
        each = F.struct(*order, *[c for c in rows.columns if c not in (key, *order)])
        return cut.groupBy(key, F.col("block").alias(p), "own").agg(F.array_sort(F.collect_list(each)).alias(f"{p}_rows"))

    l = side("l", near[0]).withColumn("r", F.explode(F.sequence("l", F.col("own") - 1))).drop("own")
    strips = F.transform(F.sequence(F.lit(0), F.floor((F.size("r_rows") - 1) / STRIP).cast("int")), lambda i: F.slice("r_rows", i * STRIP + 1, STRIP))
    r = side("r", near[1]).drop("own").withColumn("r_rows", F.explode(strips)).withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), "r")))
    # merged, since the copies of a small file would be more than its size lets expect
    met = dealt(l, key, "l", "r").join(r.hint("merge"), [key, "l", "r"])
    each = met.withColumn("a", F.explode("l_rows")).withColumn("b", F.explode("r_rows")).where((F.col("l") < F.col("r")) | (F.col("a.id") < F.col("b.id")))
    return each.select(*[F.col(key if c == key else f"{x}.{c}").alias(f"{p}_{c}") for p, x in (("l", "a"), ("r", "b")) for c in rows.columns])


# Fixed values in the rules below: the shares, ratios and pixels that decide them.
def same_region(a: str, b: str) -> Column:
    """Boxes that overlap by a fifth, or whose centres are near for the first one's size."""
    off = lambda low, high: F.abs((_c(a, low) + _c(a, high)) - (_c(b, low) + _c(b, high))) / 2
    reach = lambda least, share, low, high: F.greatest(F.lit(float(least)), share * F.greatest(F.lit(1), _side(a, low, high)))
    near = (off("x1", "x2") <= reach(24, 0.45, "x1", "x2")) & (off("y1", "y2") <= reach(18, 0.55, "y1", "y2"))
    return (iou(a, b) >= 0.20) | near


def touches_overlay(footprint: str, box: str) -> Column:
    """A footprint at most half its height away from an overlay's box, and not 2.5 times as tall."""
    height = F.greatest(F.lit(1), _side(footprint, "y1", "y2"))
    near = (_gap(footprint, box, "x1", "x2") <= height / 2) & (_gap(footprint, box, "y1", "y2") <= height / 2)
    return near & (height <= 2.5 * F.greatest(F.lit(1), _side(box, "y1", "y2")))


def lines_adjacent(a: str, b: str) -> Column:
    """Lines of text at most three times the lower one's height apart; a missing box is next to any."""
    return F.coalesce(_gap(a, b, "y1", "y2") <= 3.0 * F.least(_side(a, "y1", "y2"), _side(b, "y1", "y2")), F.lit(True))


def same_band(a: str, b: str) -> Column:
    return -_gap(a, b, "y1", "y2") >= 0.5 * F.least(_side(a, "y1", "y2"), _side(b, "y1", "y2"))


def same_blur_target(a: str, b: str) -> Column:
    """Areas within twice each other, seven tenths of the smaller in common."""
    sizes = [F.greatest(F.lit(1), area(p)) for p in (a, b)]
    return (F.greatest(*sizes) / F.least(*sizes) <= 2.0) & (over_smaller(a, b) >= 0.70)


def line_fragment(part: str, whole: str) -> Column:
    """A box that is clearly less of the line of text that another box reads on, by half the height of the text or more."""
    flat = _side(whole, "x1", "x2") >= _side(whole, "y1", "y2")

    def along(low: str, high: str, across: tuple[str, str]) -> Column:
        beyond = F.greatest(_c(part, low) - _c(whole, low), _c(whole, high) - _c(part, high))
        thin = _side(whole, *across) <= 1.5 * _side(part, *across)
        return thin & (_side(part, low, high) <= 0.85 * _side(whole, low, high)) & (beyond >= 0.5 * _side(part, *across))

    return F.when(flat, along("x1", "x2", ("y1", "y2"))).otherwise(along("y1", "y2", ("x1", "x2")))


def joins_logo(text: str, logo: str) -> Column:
    """A logo that belongs to a line of text: not inside it already, under or over half its width, close and not much taller."""
    columns = -_gap(text, logo, "x1", "x2") >= 0.5 * _side(logo, "x1", "x2")
    close = _gap(text, logo, "y1", "y2") <= F.greatest(F.lit(8.0), 0.5 * _side(logo, "y1", "y2"))
    inside = intersection(text, logo) >= 0.95 * area(logo)
    return ~inside & columns & close & (_side(logo, "y1", "y2") <= 2.5 * _side(text, "y1", "y2"))


def consensus(boxes: DataFrame, key: str) -> DataFrame:
    """The stable footprint of each key's boxes (x1, y1, x2, y2): (key, n, inliers, x1, y1, x2, y2).

    From four boxes on, those of about the median size that lie in the median box make it, unless
    they are fewer than three or than 55 % of all; then all do.
    """
    wide, tall = (F.greatest(F.lit(1), F.col(b) - F.col(a)) for a, b in (("x1", "x2"), ("y1", "y2")))
    middle = boxes.groupBy(key).agg(F.count("*").alias("n"), F.percentile(wide, F.lit(0.5)).alias("mw"), F.percentile(tall, F.lit(0.5)).alias("mh"), *[F.bround(F.percentile(c, F.lit(0.5))).alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2")])
    fits = (F.col("x2") - F.col("x1")).between(0.55 * F.col("mw"), 1.80 * F.col("mw")) & (F.col("y2") - F.col("y1")).between(0.55 * F.col("mh"), 1.80 * F.col("mh")) & (over_smaller("", "m_") >= 0.70)
    rows = boxes.join(middle, key).withColumn("fits", fits)
    ends = {"x1": F.min, "y1": F.min, "x2": F.max, "y2": F.max}
    both = rows.groupBy(key).agg(F.first("n").alias("n"), F.count_if("fits").alias("inliers"), *[f(c).alias(f"all_{c}") for c, f in ends.items()], *[f(F.when(F.col("fits"), F.col(c))).alias(f"in_{c}") for c, f in ends.items()])
    use = (F.col("n") >= 4) & (F.col("inliers") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.55)))
    return both.select(key, "n", "inliers", *[F.when(use, F.col(f"in_{c}")).otherwise(F.col(f"all_{c}")).alias(c) for c in ends])


# Readings of a track that is an overlay by itself, the share of it inside the common box from which it adds nothing.
ANCHOR_READS, ANCHOR_COVERED = 10, 0.95


def with_anchors(members: DataFrame, core: DataFrame, key: str, least_span: float) -> DataFrame:
    """The box of a group widened by members that are overlays of their own: (key, x1, y1, x2, y2, n_anchors, n_joined).

    A common box (key, x1, y1, x2, y2) gives each member one vote, so a mark read all the time beside a line read in pieces has
    little say. A member (key, track_id, start, end, observations, x1, y1, x2, y2) that is read often, lasts ``least_span`` and sticks out is an anchor, and joins the box if it touches it.
    """
    own = members.where((F.col("observations") >= ANCHOR_READS) & (F.col("end") - F.col("start") >= least_span) & F.col("x1").isNotNull())
    met = own.select(key, *[F.col(s).alias(f"f_{s}") for s in ("x1", "y1", "x2", "y2")]).join(core, key)
    size = F.greatest(F.lit(1), _side("f_", "x1", "x2")) * F.greatest(F.lit(1), _side("f_", "y1", "y2"))
    out = met.where(intersection("f_", "") / size < ANCHOR_COVERED).withColumn("joined", touches_overlay("f_", ""))
    wider = out.groupBy(key).agg(F.count("*").alias("n"), F.count_if("joined").alias("n_joined"), *[(F.min if s in ("x1", "y1") else F.max)(F.when(F.col("joined"), F.col(f"f_{s}"))).alias(f"w_{s}") for s in ("x1", "y1", "x2", "y2")])
    grown = [(F.least if s in ("x1", "y1") else F.greatest)(s, f"w_{s}").alias(s) for s in ("x1", "y1", "x2", "y2")]
    return core.join(wider, key, "left").select(key, *grown, F.coalesce("n", F.lit(0)).alias("n_anchors"), F.coalesce("n_joined", F.lit(0)).alias("n_joined"))
