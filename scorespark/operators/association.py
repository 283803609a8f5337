"""Spatial and temporal association."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, on: list[str], x: str, lo: str, hi: str, margin: float = 0) -> DataFrame:
    """Points joined to the spans lo - margin .. hi + margin that contain them; spans of any lengths.

    Each span belongs to a class, its length rounded up to a power of two, and is dealt into the cells of that width that it
    touches, two at most. A point probes one cell of each class that there is (a few dozen at most). So the join has equal
    keys, and a long span does not put short ones and all points into one cell. Spans that end before they begin hold
    nothing.
    """
    left, right = F.col(lo) - margin, F.col(hi) + margin
    kind = F.ceil(F.log2(F.greatest((right - left).cast("double"), F.lit(2.0**-20)))).cast("int")
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("_class"))).cast("long")
    s = spans.where(left <= right).withColumn("_class", kind)
    classes = s.agg(F.collect_set("_class").alias("_classes"))  # one row
    s = s.withColumn("_cell", F.explode(F.sequence(cell(left), cell(right))))
    p = points.crossJoin(F.broadcast(classes)).withColumn("_class", F.explode("_classes")).drop("_classes").withColumn("_cell", cell(F.col(x)))
    return p.join(s, [*on, "_class", "_cell"]).where(F.col(x).between(left, right)).drop("_class", "_cell")


def asof_or_nearest(markers: DataFrame, attacks: DataFrame, on: list[str], x: str, ident: str) -> DataFrame:
    """markers with match_id: the last attack at or before each, else the first after it; null without any.

    Both sides go through one window over their union, so no pairs are formed.
    """
    cols = [*on, x, ident]
    both = markers.select(*cols, F.lit(1).alias("_m")).unionByName(attacks.select(*cols, F.lit(0).alias("_m")))
    attack = F.when(F.col("_m") == 0, F.col(ident))
    w = W.partitionBy(*on).orderBy(x, "_m", ident)
    # Of attacks after the marker the nearest wins, of equals the smallest id, as the order has it.
    before = F.last(attack, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(attack, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return both.withColumn("match_id", F.coalesce(before, after)).where("_m = 1").drop("_m")


def islands(df: DataFrame, on: list[str], x: str, gap: float | Column, order: list[str] | None = None) -> DataFrame:
    """df with island: numbers from 0 of runs whose neighbours lie at most gap apart."""
    w = W.partitionBy(*on).orderBy(x, *(order or []))
    new = F.when(F.col(x) - F.lag(x).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def strips(df: DataFrame, by: list[str], lo: Column, hi: Column, out: str) -> DataFrame:
    """df with numbers of the strips of each group: rows whose spans lo .. hi overlap or touch, over others too, are in one."""
    w = W.partitionBy(*by).orderBy("_lo")
    new = F.when(F.col("_lo") > F.max("_hi").over(w.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0)
    marked = df.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_new", new)
    return marked.withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_lo", "_hi", "_new")
