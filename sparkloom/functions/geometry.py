"""Boxes, crops and intervals as column expressions over arrays [x1, y1, x2, y2]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def absolute_box(box: str, width: Column, height: Column, scale: float = 1000.0) -> Column:
    """A box of 0 to ``scale`` in pixels, clamped to the image, 4 digits; null if
    nothing is left of it."""
    w, h = width.cast("double"), height.cast("double")

    def at(k, side):
        return F.bround(F.greatest(F.lit(0.0), F.least(F.col(box)[k] * side / scale, side)), 4)

    out = F.array(at(0, w), at(1, h), at(2, w), at(3, h))
    return F.when((out[2] > out[0]) & (out[3] > out[1]), out)


def relative_box(box: str, width: Column, height: Column, scale: float = 1000.0) -> Column:
    return F.array(*[F.bround(F.col(box)[k] * scale / (width if k % 2 == 0 else height), 4) for k in range(4)])


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 for boxes without area."""
    return F.expr(f"""transform(array(greatest(0D, least({a}[2], {b}[2]) - greatest({a}[0], {b}[0])) * greatest(0D, least({a}[3], {b}[3]) - greatest({a}[1], {b}[1]))), i ->
      transform(array(({a}[2] - {a}[0]) * ({a}[3] - {a}[1]) + ({b}[2] - {b}[0]) * ({b}[3] - {b}[1]) - i), u -> case when u > 0 then i / u else 0D end)[0])[0]""")


def best_iou(a: str, boxes: str) -> Column:
    """The best IoU of a box with any of an array of boxes; 0 for none."""
    one = f"greatest(0D, least({a}[2], b[2]) - greatest({a}[0], b[0])) * greatest(0D, least({a}[3], b[3]) - greatest({a}[1], b[1]))"
    area = f"(({a}[2] - {a}[0]) * ({a}[3] - {a}[1]) + (b[2] - b[0]) * (b[3] - b[1]) - {one})"
    return F.expr(f"coalesce(array_max(transform({boxes}, b -> case when {area} > 0 then {one} / {area} else 0D end)), 0D)")


def center_inside(a: str, b: str) -> Column:
    """Whether the centre of a lies in b."""
    return F.expr(f"({a}[0] + {a}[2]) / 2 between {b}[0] and {b}[2] and ({a}[1] + {a}[3]) / 2 between {b}[1] and {b}[3]")


def square_crop(df: DataFrame, box: str, width: str, height: str, margin: float, least: float) -> DataFrame:
    """``crop``: the box's square with a margin, shifted back into the image from
    left, top, right and bottom in this order, then clamped."""
    b = F.col(box)
    w, h = F.greatest(b[2] - b[0], F.lit(1.0)), F.greatest(b[3] - b[1], F.lit(1.0))
    side = F.greatest(w * (1 + 2 * margin), h * (1 + 2 * margin), F.lit(least))
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    out = df.withColumn("_l", cx - side / 2).withColumn("_t", cy - side / 2).withColumn("_r", cx + side / 2).withColumn("_b", cy + side / 2)
    for low, high in (("_l", "_r"), ("_t", "_b")):
        out = out.withColumn(high, F.when(F.col(low) < 0, F.col(high) - F.col(low)).otherwise(F.col(high))).withColumn(low, F.when(F.col(low) < 0, 0.0).otherwise(F.col(low)))
    for low, high, size in (("_l", "_r", width), ("_t", "_b", height)):
        over = F.col(high) - F.col(size)
        out = out.withColumn(low, F.when(over > 0, F.col(low) - over).otherwise(F.col(low))).withColumn(high, F.when(over > 0, F.col(size).cast("double")).otherwise(F.col(high)))
    crop = F.array(*[F.bround(F.greatest(F.lit(0.0), F.least(F.col(c), F.col(s).cast("double"))), 4) for c, s in (("_l", width), ("_t", height), ("_r", width), ("_b", height))])
    return out.withColumn("crop", crop).drop("_l", "_t", "_r", "_b")


def merged_intervals(df: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Overlapping and touching intervals of a key as one (gaps and islands)."""
    w = W.partitionBy(by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    out = df.withColumn("_new", F.when(before >= F.col(start), 0).otherwise(1))
    out = out.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy(by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def interval_iou(left: DataFrame, right: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """IoU of two sets of intervals for each key that both have."""
    a = merged_intervals(left, by, start, end)
    b = merged_intervals(right, by, start, end).select(by, F.col(start).alias("_s"), F.col(end).alias("_e"))
    n = a.groupBy(by).agg(F.sum(F.col(end) - F.col(start)).alias("_la"))
    m = b.groupBy(by).agg(F.sum(F.col("_e") - F.col("_s")).alias("_lb"))
    inter = a.join(b, by).groupBy(by).agg(F.sum(F.greatest(F.lit(0.0), F.least(end, "_e") - F.greatest(start, "_s"))).alias("_i"))
    union = F.col("_la") + F.col("_lb") - F.col("_i")
    return n.join(m, by).join(inter, by).select(by, F.when(union > 0, F.col("_i") / union).otherwise(0.0).alias("iou"))


def crop_rect(box: str, width: Column, height: Column) -> Column:
    """The box in whole pixels, halves to even, within the image; null if nothing
    is left of it."""
    w, h = width.cast("long"), height.cast("long")
    at = [F.bround(F.col(box)[k], 0).cast("long") for k in range(4)]
    low = [F.greatest(F.lit(0), F.least(side - 1, x)) for x, side in zip(at[:2], (w, h), strict=True)]
    high = [F.greatest(F.lit(1), F.least(side, x)) for x, side in zip(at[2:], (w, h), strict=True)]
    return F.when((high[0] > low[0]) & (high[1] > low[1]), F.array(*low, *high))


def pixel_box(box: str, width: Column, height: Column, most: float = 1.5) -> Column:
    """A box whose numbers are all at most ``most`` is one of fractions of the
    image and becomes pixels; another stays."""
    small = F.array_max(F.transform(box, F.abs)) <= most
    return F.when(small, F.array(*[F.col(box)[k] * (width if k % 2 == 0 else height) for k in range(4)])).otherwise(F.col(box))


def segment_group(boxes: str, confidence: str) -> Column:
    """Boxes of a segment, how many, and the first one with its confidence."""
    return F.struct(F.size(boxes).cast("long").alias("count"), F.get(boxes, 0).alias("selected_box"), F.get(confidence, 0).alias("selected_confidence"))
