"""Draws with replacement by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.operators.timeline import running_total
from scorespark.storage import written


def uniform(number: Column, seed: int) -> Column:
    """A number in 0..1 for each integer, the same wherever it is computed: 52 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), number.cast("string")), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def weighted_draws(df: DataFrame, key: list[str], weight: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement from rows with unique keys, each row as likely as its weight says: draw (0 to n - 1), key.

    The weights' running sums lay the rows end to end; a draw is a place on that line, and takes the row that covers it.
    Rows and draws are sorted together by ranges of place, and each draw takes the last row before it; where that lies in
    an earlier range, one row for each range tells it. So neither a heavy row nor many light ones gather in a task. Rows
    whose weight is null or not above 0 are never drawn; without any other there are no draws.
    """
    spark = df.sparkSession
    rows = running_total(df.select(*key, weight).where(F.col(weight) > 0), key, F.col(weight), "_at")
    total = rows.agg(F.max(F.col("_at") + F.col(weight))).first()[0]
    if total is None:
        return df.select(F.lit(0).cast("long").alias("draw"), *key).where("false")
    places = spark.range(n).select(F.col("id").alias("draw"), F.least(uniform(F.col("id"), seed) * F.lit(total), F.lit(float(total))).alias("_at"))
    both = rows.select(F.col("_at").cast("double").alias("_at"), F.lit(None).cast("long").alias("draw"), F.struct(*key).alias("_row"))
    both = both.unionByName(places, allowMissingColumns=True)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["_at", F.col("draw").asc_nulls_first()]
    dealt = written(both.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()), "draws")
    ends = dealt.where("draw IS NULL").groupBy("_p").agg(F.max_by("_row", "_at").alias("_end"))
    ends = dealt.select("_p").distinct().join(ends, "_p", "left")
    ends = ends.select("_p", F.last("_end", ignorenulls=True).over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("_end"))
    last = F.last("_row", ignorenulls=True).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    drawn = dealt.withColumn("_row", last).where("draw IS NOT NULL").join(F.broadcast(ends), "_p")  # one row a range
    return drawn.select("draw", F.coalesce("_row", "_end").alias("_row")).select("draw", "_row.*")
