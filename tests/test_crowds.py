"""Spans of very unlike length and pages with very many boxes, against plain loops."""

from __future__ import annotations

import math
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from scorespark import plans
from scorespark.operators import association, folds


def test_range_join_with_spans_of_all_lengths(spark):
    rng = random.Random(8)
    points = [("g", k, rng.choice([float(rng.randint(0, 86_400)), rng.uniform(-5, 5), rng.uniform(0, 86_400)])) for k in range(3000)]
    spans = [("g", -1, -10.0, 90_000.0), ("g", -2, 5.0, 4.0), ("g", -3, 7.0, 7.0), ("g", -4, None, 3.0)]
    for k in range(500):
        lo = rng.uniform(-100, 86_400)
        spans.append(("g", k, lo, lo + rng.choice([0.0, 1e-5, 3.0, 16.0, 100.0, 5000.0]) * rng.random()))
    p, s = spark.createDataFrame(points, "g string, p int, x double"), spark.createDataFrame(spans, "g string, s int, lo double, hi double")
    for margin in (0, 4):
        want = {(b, d) for a, b, x in points for c, d, lo, hi in spans if lo is not None and lo - margin <= hi + margin and lo - margin <= x <= hi + margin}
        got = [(r.p, r.s) for r in association.range_join(p, s, ["g"], "x", "lo", "hi", margin).collect()]
        assert len(got) == len(set(got)) and set(got) == want

    # What short spans are compared with does not grow because of the long one: pairs of one cell, counted.
    cells = {}
    for _, k, lo, hi in spans:
        if lo is not None and lo <= hi:
            width = 2.0 ** math.ceil(math.log2(max(hi - lo, 2.0**-20)))
            for c in range(int(lo // width), int(hi // width) + 1):
                cells.setdefault((width, c), []).append(k)
    pairs = sum(len(ks) * sum(x // width == c for _, _, x in points) for (width, c), ks in cells.items() if width < 10_000)
    assert pairs < 20 * len(points) + 4 * len(want)


def plain_match(rows, least, most):
    truths, out = [r for r in rows if r[1] == 0], []
    for r in sorted((r for r in rows if r[1] == 1), key=lambda r: (-r[2], r[0])):
        ranked = [((-folds.iou(r[3:7], t[3:7]) if most is None else folds._distance(r[3:7], t[3:7])), t[0], t) for t in truths]
        best = min((x for x in ranked if (-x[0] >= least if most is None else x[0] <= most)), default=None, key=lambda x: x[:2])
        if best:
            truths.remove(best[2])
            out.append((r[0], best[1]))
    return sorted(out)


def boxes(rng, n, page, sizes):
    return [(k, rng.randint(0, 1), round(rng.random(), 2), rng.uniform(0, page), rng.uniform(0, page), rng.choice(sizes) * rng.random(), rng.choice(sizes), rng.choice("ab")) for k in range(n)]


BOX = "id long, side int, score double, x double, y double, w double, h double, label string, image int"


@pytest.mark.parametrize("seed", range(4))
def test_boxes_match_plain_loops(spark, seed):
    rng = random.Random(seed)
    rows = boxes(rng, 250, (60, 200, 1000, 20)[seed], [0.0, 1.0, 3.0, 10.0, 40.0]) + [(999, 0, 0.5, 1.0, 1.0, 5.0, 5.0, "a"), (998, 1, 0.5, 1.0, 1.0, 5.0, 5.0, "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], BOX)
    for least, most in ((0.3, None), (0.05, None), (None, 6.0), (None, 0.0)):
        got = sorted((r.found_id, r.truth_id) for r in folds.match_boxes(df, ["image"], least, most).collect())
        assert got == plain_match(rows, least, most)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        if all(folds.iou(r[3:7], k[3:7]) < 0.4 for k in kept):
            kept.append(r)
    assert sorted(r.id for r in folds.suppress_boxes(df, ["image"], 0.4).collect()) == sorted(k[0] for k in kept)


def test_crowded_page_in_reasonable_time(spark):
    """100,000 boxes of one image that overlap over each other: one island."""
    n = 100_000
    at = lambda m, k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    df = spark.range(n).select(
        "id", (F.col("id") % 2).cast("int").alias("side"), (at(1000, 1) / 1000).alias("score"), (at(30_000, 2) / 10).alias("x"), (at(30_000, 3) / 10).alias("y"),
        (5 + at(100, 4) / 10).alias("w"), (5 + at(100, 5) / 10).alias("h"), F.lit("a").alias("label"), F.lit(1).alias("image"),
    )
    began = time.time()
    assert folds.match_boxes(df, ["image"], 0.3).count() > 1000
    assert 1000 < folds.suppress_boxes(df, ["image"], 0.4).count() < n
    assert time.time() - began < 180


@pytest.mark.parametrize("name", ["box_match_center", "box_match_iou"])
def test_box_matches_with_equal_ids_are_those_of_the_sql(spark, tmp_path, name):
    """Line items of one order, line, place and even quantity: truths of one id go together, wherever their centres are."""
    rng, rows = random.Random(5), []
    for order in range(300):
        for _ in range(rng.randint(2, 14)):
            rows.append((order, 100 * rng.randint(0, 9) + rng.choice([3, 5, 60]), 50 * rng.randint(0, 9) + rng.choice([4, 6]), rng.randint(1, 3), float(rng.choice([1, 2, 9, 9, 50])), rng.choice("ANR"), rng.choice("FO")))
    shape = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # rows of equal score and id as they lie
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = plans.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.oracle_sql()[name]})").fetchall()
    assert len(want) > 200 and sorted(map(tuple, got.collect())) == sorted(want)


def test_truths_of_one_id_far_apart(spark):
    """One truth with two boxes far from each other is used once, by the better found box; a box without size is harmless."""
    rows = [(1, 0, 0.0, 0.0, 0.0, 4.0, 4.0, "a"), (1, 0, 0.0, 500.0, 500.0, 4.0, 4.0, "b"), (1, 0, 0.0, 900.0, 0.0, 0.0, 4.0, "c"), (7, 1, 0.9, 500.0, 500.0, 4.0, 4.0, "a"), (8, 1, 0.8, 0.0, 0.0, 4.0, 4.0, "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], BOX)
    for least, most in ((0.3, None), (None, 6.0)):
        assert [(r.found_id, r.truth_id, r.same) for r in folds.match_boxes(df, ["image"], least, most).collect()] == [(7, 1, False)]


def test_halves_are_rounded_as_in_sql(spark):
    from scorespark.plans.ordered import _rounded

    values = [p / q for q in (1024, 5120, 10240) for p in range(1, q)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(_rounded("v")).collect()]
    assert got == duckdb.execute("SELECT list_transform($1::DOUBLE[], lambda v: round(v, 9))", [values]).fetchone()[0]
