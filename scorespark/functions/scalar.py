"""Scalars: exact time, boxes, codes, bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks of a whole note: 2^10 * 9 * 5 * 7 * 11 * 13, so that every supported duration is a whole number.
WHOLE = 46_126_080


def tuplet_normal(n: Column) -> Column:
    """Normal count of a tuplet: 3 takes the time of 2, up to 7 that of 4, others that of 8."""
    return F.when(n <= 1, F.lit(1)).when(n == 3, F.lit(2)).when(n <= 7, F.lit(4)).otherwise(F.lit(8))


def duration_ticks(value: Column, dots: Column, enters: Column, times: Column) -> Column:
    """Ticks of a note value with dots in a tuplet of enters notes in the time of times; null if not whole."""
    top = F.lit(WHOLE) * F.when(dots == 1, F.lit(3)).when(dots == 2, F.lit(7)).otherwise(F.lit(1)) * times
    bottom = value * F.when(dots == 1, F.lit(2)).when(dots == 2, F.lit(4)).otherwise(F.lit(1)) * enters
    return F.when((bottom != 0) & (top % bottom == 0), F.floor(top / bottom)).cast("long")


def clamp_bin(v: Column, span: float, bins: int) -> Column:
    """Bin of v in 0..span, cut off at both ends; truncates toward zero."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), (v / span * bins).cast("int")))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def box_iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 where both are empty."""
    both = overlap(ax, ax + aw, bx, bx + bw) * overlap(ay, ay + ah, by, by + bh)
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def interval_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over hull of two intervals."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, overlap(a0, a1, b0, b1) / hull).otherwise(F.lit(0.0))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def hash_bucket(c: Column, buckets: int = 10) -> Column:
    """First 8 hex digits of the SHA-256, unsigned, modulo buckets."""
    return F.pmod(F.conv(F.substring(digest(c), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_split(c: Column) -> Column:
    b = hash_bucket(c)
    return F.when(b == 0, "test").when(b == 1, "validation").otherwise("train")


def ratio(text: Column) -> Column:
    """struct(num, den) of 'n/d', null where it is malformed or d is 0."""
    num = F.regexp_extract(text, r"^\s*(-?\d{1,9})\s*/\s*(\d{1,9})\s*$", 1).try_cast("long")
    den = F.regexp_extract(text, r"^\s*(-?\d{1,9})\s*/\s*(\d{1,9})\s*$", 2).try_cast("long")
    return F.when(num.isNotNull() & (den > 0), F.struct(num.alias("num"), den.alias("den")))


def precision_recall(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1 with a count of at least one below the line, and 1e-12 in F1."""
    p, r = tp / F.greatest(F.lit(1), tp + fp), tp / F.greatest(F.lit(1), tp + fn)
    return {"precision": p, "recall": r, "f1": 2 * p * r / F.greatest(F.lit(1e-12), p + r)}


def precision_recall_zero(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """The same with 0 where there is nothing below the line."""
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = zero(tp, tp + fp), zero(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": zero(2 * p * r, p + r)}
