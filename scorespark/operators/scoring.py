"""Threshold sweeps and multiset comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorespark.functions import scalar as S

#: Thresholds of a sweep, in hundredths.
THRESHOLDS = tuple(range(5, 100, 5))


def sweep(df: DataFrame, by: list[str], score: str, truth: str, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """Counts, precision, recall and F1 of each group at each threshold (score at or above it predicts true).

    The rows are read once: they become a histogram over the gaps between thresholds, which is summed from above. Its
    size is groups times thresholds, whatever the number of rows.
    """
    steps = F.array(*map(F.lit, thresholds))
    # Number of thresholds that the score reaches.
    reached = F.size(F.filter(steps, lambda t: F.col(score) >= t))
    hist = df.groupBy(*by, reached.alias("_r")).agg(F.count_if(F.col(truth)).alias("_t"), F.count_if(~F.col(truth)).alias("_f"))
    total = hist.groupBy(*by).agg(F.sum("_t").alias("support"))
    if by:
        grid = total.select(*by, "support", F.posexplode(steps).alias("_i", "threshold"))
        joined = grid.join(hist, by, "left")
    else:
        grid = total.select("support", F.posexplode(steps).alias("_i", "threshold"))
        joined = grid.crossJoin(hist)  # 19 rows by at most 20
    above = F.col("_r") > F.col("_i")
    out = joined.groupBy(*by, "threshold", "support").agg(F.sum(F.when(above, F.col("_t")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("_f")).otherwise(0)).alias("fp"))
    out = out.withColumn("fn", F.col("support") - F.col("tp")).withColumn("threshold", F.col("threshold").cast("long"))
    return out.withColumns({n: F.round(c, 9) for n, c in S.precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).items()})


def multiset_overlap(a: DataFrame, b: DataFrame, on: list[str], item: list[str]) -> DataFrame:
    """Sizes of the multiset intersection (common) and union (combined) of the items of each group."""
    count = lambda df, name: df.groupBy(*on, *item).agg(F.count(F.lit(1)).alias(name))
    j = count(a, "_a").join(count(b, "_b"), [*on, *item], "full_outer").na.fill(0, ["_a", "_b"])
    return j.groupBy(*on).agg(F.sum(F.least("_a", "_b")).alias("common"), F.sum(F.greatest("_a", "_b")).alias("combined"))


def first_by(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
