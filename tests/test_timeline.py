"""Ranks and running sums over whole tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorespark.operators import timeline as T


@pytest.mark.parametrize("n, wide", [(2000, True), (20_000, True), (5, False), (0, False)])
def test_global_rank_of_wide_rows(spark, tmp_path, n, wide):
    """Under stock settings, which merge small partitions of wide and narrow rows differently."""
    path, before = str(tmp_path / "rows"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("h"), F.repeat(F.md5(F.col("id").cast("string")), 32 if wide else 0).alias("load")).write.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = T.global_rank(spark.read.parquet(path), "h").orderBy("rank").select("rank", "h", F.length("load").alias("l")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r.rank for r in got] == list(range(n))
    assert [r.h for r in got] == sorted(r.h for r in got) and all(r.l == (1024 if wide else 0) for r in got)


def test_running_total(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(k, k % 3, k % 7) for k in range(100)], "k int, a int, v long").repartition(5).write.parquet(path)
    got = {r.k: r.before for r in T.running_total(spark.read.parquet(path), ["a", "k"], F.col("v")).collect()}
    order = sorted(range(100), key=lambda k: (k % 3, k))
    assert got == {k: sum(x % 7 for x in order[:i]) for i, k in enumerate(order)}
