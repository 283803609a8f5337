"""Draws with replacement, and reference chains on a hand-made document."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from scorespark.operators.references import resolve_bars
from scorespark.operators.sampling import weighted_draws


@pytest.mark.parametrize("parts", ["4", "17"])
def test_draws_follow_the_weights(spark, tmp_path, parts):
    rng = random.Random(1)
    weights = {k: 3000.0 if k == 500 else 0.0 if k % 7 == 0 else rng.choice([0.25, 1.0, 4.0]) for k in range(3000)}
    path = str(tmp_path / "w")
    spark.createDataFrame([*weights.items(), (-1, None), (-2, -5.0)], "k long, w double").repartition(5).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = weighted_draws(spark.read.parquet(path), ["k"], "w", 40_000, 3).collect()
        again = weighted_draws(spark.read.parquet(path), ["k"], "w", 40_000, 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.draw for r in got) == list(range(40_000)) and sorted(got) == sorted(again)
    n, total = collections.Counter(r.k for r in got), sum(weights.values())
    assert all(weights[k] > 0 for k in n)
    for w in (0.25, 1.0, 4.0, 3000.0):  # within five standard deviations
        keys = [k for k in weights if weights[k] == w]
        share = w * len(keys) / total
        assert abs(sum(n[k] for k in keys) - 40_000 * share) < 5 * (40_000 * share * (1 - share)) ** 0.5
    assert weighted_draws(spark.read.parquet(path), ["k"], "w", 0, 3).count() == 0
    assert weighted_draws(spark.read.parquet(path).where("w IS NULL"), ["k"], "w", 10, 3).count() == 0


def test_draw_lands_on_the_row_that_covers_it(spark):
    """Against the plain running sum, row by row."""
    weights = [(k, (k * 7) % 5) for k in range(200)]
    df = spark.createDataFrame(weights, "k long, w long")
    ends, at = [], 0
    for k, w in weights:
        at += w
        ends.append((at, k, w))
    got = {r.draw: r.k for r in weighted_draws(df, ["k"], "w", 500, 9).collect()}
    import hashlib

    for draw, k in got.items():
        place = int(hashlib.sha256(f"9:{draw}".encode()).hexdigest()[:13], 16) / 2**52 * at
        assert k == next(j for end, j, w in ends if w and end > place)


def test_chain_of_references(spark):
    bars = spark.createDataFrame([(1, "10 -1  11 99"), (2, None), (3, "-1"), (4, "10")], "bar int, voice_refs string")
    voices = spark.createDataFrame([(10, "20 21 20"), (11, "22 77 23"), (12, "20")], "voice int, beat_refs string")
    beats = spark.createDataFrame([(20, "2 1 -1", "5"), (21, "-1", "6"), (22, "3 8", "9"), (23, None, "5")], "beat int, note_refs string, rhythm_ref string")
    notes = spark.createDataFrame([(1, "C"), (2, "E"), (3, "G")], "note int, said string")
    rhythms = spark.createDataFrame([(5, 4), (6, 8)], "rhythm int, ticks long")
    events, dangling = resolve_bars(bars, voices, beats, notes, rhythms)
    first = [(0, 0, 20, "note", "E,C", 4, 0), (0, 1, 21, "rest", "", 8, 4), (0, 2, 20, "note", "E,C", 4, 12)]
    want = [(1, *e) for e in first] + [(1, 1, 0, 22, "note", "G", None, 0), (1, 1, 2, 23, "rest", "", 4, 0)] + [(4, *e) for e in first]
    assert sorted(map(tuple, events.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, dangling.collect())) == [("beat", "11", "77"), ("note", "22", "8"), ("rhythm", "22", "9"), ("voice", "1", "99")]
    assert events.where(F.lit(False)).count() == 0
