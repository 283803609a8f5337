"""Operators on ordered timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.storage import written


def ordered(by: list[str], order: list) -> W:
    return W.partitionBy(*by).orderBy(*order)


def carry_forward(df: DataFrame, by: list[str], order: list, value: str, out: str = "carried", origin: str = "origin") -> DataFrame:
    """df with the last non-null value at or before each row, and whether it is printed, carried or unknown."""
    last = F.last(value, ignorenulls=True).over(ordered(by, order).rowsBetween(W.unboundedPreceding, 0))
    kind = F.when(F.col(value).isNotNull(), "printed").when(F.col(out).isNotNull(), "carried").otherwise("unknown")
    return df.withColumn(out, last).withColumn(origin, kind)


def running_onset(df: DataFrame, by: list[str], order: list, ticks: str) -> DataFrame:
    """df with onset and end; rows with null ticks get neither and do not advance the cursor."""
    before = F.coalesce(F.sum(ticks).over(ordered(by, order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onset = F.when(F.col(ticks).isNotNull(), before)
    return df.withColumn("onset", onset).withColumn("end", F.col("onset") + F.col(ticks))


def value_changes(value: str, by: list[str], order: list) -> Column:
    """True where a row's value differs from that of the row before; the first row of a group counts as a change."""
    w = ordered(by, order)
    return (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))


def renumber(df: DataFrame, by: list[str], order: list, keep: Column, out: str = "new_pos") -> DataFrame:
    """Rows that are kept, with dense numbers from 0."""
    return df.where(keep).withColumn(out, F.row_number().over(ordered(by, order)).cast("long") - 1)


def outlier_digits(df: DataFrame, by: list[str], order: list[str], value: str, reach: int = 3) -> DataFrame:
    """df with fixed: a value of 20 to 39 that looks like a digit joined to its neighbour's becomes its first digit.

    That needs two neighbours within `reach` rows (of 0 to 19) that differ from the first digit by 2 at most, or the digit
    itself at least 6 times in the group and 3 times as often as the value; without the latter a neighbour within 4 of the
    value keeps it. Original values count, not corrected ones.
    """
    w, g, v = ordered(by, order), W.partitionBy(*by), F.col(value)
    around = F.concat(F.collect_list(value).over(w.rowsBetween(-reach, -1)), F.collect_list(value).over(w.rowsBetween(1, reach)))
    digit = F.floor(v / 10).cast("long")
    times = F.when(digit == 2, F.count_if(v == 2).over(g)).otherwise(F.count_if(v == 3).over(g))
    out = df.withColumn("_near", around).withColumn("_digit", times).withColumn("_own", F.count(F.lit(1)).over(W.partitionBy(*by, value)))
    local = F.size(F.filter("_near", lambda n: n.between(0, 19) & (F.abs(n - digit) <= 2))) >= 2
    veto = F.exists("_near", lambda n: F.abs(n - v) <= 4)
    common = F.col("_digit") >= F.greatest(F.lit(6), 3 * F.col("_own"))
    fixed = F.when(v.between(20, 39) & (common | (local & ~veto)), digit).otherwise(v)
    return out.withColumn("fixed", fixed).drop("_near", "_digit", "_own")


def minmax(df: DataFrame, by: list[str], order: list, value: str, out: str = "scaled") -> DataFrame:
    """Value scaled to 0..1 within its group; a single row gets 0.5, equal values are spread evenly in order."""
    g = W.partitionBy(*by)
    low, high, n = F.min(value).over(g), F.max(value).over(g), F.count(F.lit(1)).over(g)
    pos = F.row_number().over(ordered(by, order)) - 1
    even = F.when(n <= 1, F.lit(0.5)).otherwise(pos / F.greatest(n - 1, F.lit(1)))
    return df.withColumn(out, F.when((n > 1) & (high > low), (F.col(value) - low) / F.greatest(high - low, F.lit(1e-300))).otherwise(even))


def running_total(df: DataFrame, order: list[str], value: Column, out: str = "before") -> DataFrame:
    """df with the sum of value over all rows before, in the order of columns that together are unique, without bringing
    all rows to one task.

    Rows are dealt by ranges of the order, a fixed number of them, and written with their range: each reader would
    otherwise plan the ranges anew, and adaptive execution merge them in other ways. Each range is summed, and the running
    sums of the ranges, one row each, are added to those within.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_v", value).repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id())
    parts = written(dealt, "ranges")
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    base = parts.groupBy("_p").agg(F.sum("_v").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(upto(W.orderBy("_p"))), F.lit(0)).alias("_b"))
    inner = F.coalesce(F.sum("_v").over(upto(ordered(["_p"], order))), F.lit(0))
    return parts.withColumn("_i", inner).join(F.broadcast(base), "_p").withColumn(out, F.col("_b") + F.col("_i")).drop("_p", "_v", "_i", "_b")


def global_rank(df: DataFrame, key: str, out: str = "rank") -> DataFrame:
    """df with its place, from 0, in the order of key (unique)."""
    return running_total(df, [key], F.lit(1), out)


def latest_by_key(df: DataFrame, by: list[str], key: str, order: list, value: str, most: int, out: str = "recent") -> DataFrame:
    """The value of the last earlier row with the same key, if that lies at most `most` rows of the group back."""
    numbered = df.withColumn("_n", F.row_number().over(ordered(by, order)))
    last = F.lag(F.struct(F.col("_n").alias("n"), F.col(value).alias("v"))).over(ordered([*by, key], ["_n"]))
    return numbered.withColumn("_l", last).withColumn(out, F.when(F.col("_n") - F.col("_l.n") <= most, F.col("_l.v"))).drop("_n", "_l")
