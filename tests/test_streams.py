"""Streams that are stopped, fail and go on; rows that come again or too late."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorespark.storage import numbered_folders
from scorespark.streaming import twins

T0 = datetime(2024, 3, 1)
SHAPE = "event_id long, user_id long, ts timestamp, v long"


def add(spark, path, rows):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{path}/in")


def stream(spark, path):
    return twins.stream_of(spark, f"{path}/in", spark.createDataFrame([], SHAPE))


def row(k, user=1, at=0.0, v=None):
    return (k, user, T0 + timedelta(hours=at), v)


def test_intake_is_once_over_stops_failures_and_days(spark, tmp_path):
    path = str(tmp_path)
    sink = partial(twins.intake, path=f"{path}/out", query="q", key=["event_id"])
    run = lambda s=sink: twins.keep(stream(spark, path), s, f"{path}/state")
    told = lambda: sorted((r.event_id or 0, r.v) for r in twins.taken_in(spark, f"{path}/out", SHAPE).collect())
    add(spark, path, [row(k, v=k) for k in range(10)] + [row(3, v=99), row(None, v=-1), row(None, v=-2)])
    run()
    once = [(k, k) for k in range(10)]
    assert told() == sorted([*once, (0, -2)])

    # The same file once more, and a row five days later; the query is cut off after it has written, before it is committed.
    add(spark, path, [row(k, v=k) for k in range(10)] + [row(4, at=120, v=4), row(10, at=120, v=10), row(None, at=120)])

    def cut_off(batch, number):
        sink(batch, number)
        raise OSError("the machine is gone")

    with pytest.raises(Exception, match="gone"):
        run(cut_off)
    run()
    run()
    add(spark, path, [row(11, at=1, v=11), row(0, at=500, v=0)])
    run()
    assert told() == sorted([*once, (0, -2), (10, 10), (11, 11)])

    # Another query into the same set, with numbers of its own.
    twins.keep(stream(spark, path), partial(twins.intake, path=f"{path}/out", query="other", key=["event_id"]), f"{path}/state2")
    assert told() == sorted([*once, (0, -2), (10, 10), (11, 11)])


def test_pages_out_of_order_and_too_late(spark, tmp_path):
    path = str(tmp_path)

    def run(*rows):
        add(spark, path, list(rows))
        twins.keep(twins.number_pages(stream(spark, path), "user_id", "v", timedelta(hours=2), first=5), partial(twins.on_time_and_late, path=path), f"{path}/state")

    def told(name):
        shape = "user_id long, event_id long, printed long, carried long, number long"
        return sorted((r.user_id, r.number or 0, r.event_id, r.carried) for r in spark.read.schema(shape).parquet(f"{path}/{name}").collect())

    run(row(1, at=0, v=7), row(3, at=2.1), row(20, 2, at=1))
    assert told("rows") == [(1, 5, 1, 7)]  # more than two hours behind the newest row
    run(row(2, at=1, v=8), row(4, at=3), row(5, at=4.2))  # in time, before rows that came first
    assert told("rows") == [(1, 5, 1, 7), (1, 6, 2, 8), (1, 7, 3, 8), (2, 5, 20, None)]
    run(row(6, at=1.5, v=9), row(7, at=8))  # its place has been given out
    run(row(8, 3, at=20))
    assert told("rows") == [(1, 5, 1, 7), (1, 6, 2, 8), (1, 7, 3, 8), (1, 8, 4, 8), (1, 9, 5, 8), (1, 10, 7, 8), (2, 5, 20, None)]
    assert told("late") == [(1, 0, 6, None)]


def test_rolling_quality_with_late_rows_and_compaction(spark, tmp_path):
    path, shape = str(tmp_path), "start timestamp, user_id long, n long"

    def run(*rows):
        add(spark, path, list(rows))
        w = twins.rolling_quality(stream(spark, path), "2 hours", "1 hour", "1 hour", "user_id", n=F.lit(True))
        return twins.keep(w, partial(twins.upsert, path=path), f"{path}/state", "update")

    def told():
        hours = F.expr("(unix_seconds(start) - unix_seconds(timestamp'2024-03-01')) div 3600")
        return sorted(tuple(r) for r in twins.latest(spark, path, shape, ["start", "user_id"]).select(hours, "user_id", "n").collect())

    assert run(row(1, at=0.5), row(2, at=0.6), row(3, 2, at=0.5)) == 0
    assert told() == [(-1, 1, 2), (-1, 2, 1), (0, 1, 2), (0, 2, 1)]
    assert run(row(4, at=1.2)) == 0
    assert run(row(5, at=0.7), row(6, at=9.5)) == 0
    want = [(-1, 1, 3), (-1, 2, 1), (0, 1, 4), (0, 2, 1), (1, 1, 1), (8, 1, 1), (9, 1, 1)]
    assert told() == want
    twins.compact(spark, path, shape, ["start", "user_id"])
    assert told() == want and len(numbered_folders(spark, f"{path}/changes", "batch")) == 1
    assert run(row(7, at=3.5), row(8, at=9.6)) == 2  # both windows of the row at 3.5 are over
    want[-2:] = [(8, 1, 2), (9, 1, 2)]
    assert told() == want
    twins.compact(spark, path, shape, ["start", "user_id"])
    twins.compact(spark, path, shape, ["start", "user_id"])
    assert told() == want and len(numbered_folders(spark, path, "base")) == 1


def plain_pages(state, rows, marks, first=1):
    """number_pages() row by row: documents as (last, next, upto, waiting), stepped where rows come or are due."""
    out = []
    for new, mark in zip(rows, marks, strict=True):
        for key in {r[0] for r in new} | {k for k, d in state.items() if d[3] and (d[3][0][0] // 1000 + 1) * 1000 <= mark}:
            last, number, upto, waiting = state.get(key, (None, first, -1, []))
            mine = [r[1:] for r in new if r[0] == key]
            out += [(key, r[1], r[2], None, None, True) for r in mine if r[0] <= upto]
            rest = sorted([*waiting, *(r for r in mine if r[0] > upto)], key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0))
            for _, ident, v in (r for r in rest if r[0] <= mark):
                last = last if v is None else v
                out.append((key, ident, v, last, number, False))
                number += 1
            state[key] = (last, number, max(upto, mark), [r for r in rest if r[0] > mark])
    return out


@pytest.mark.parametrize("seed", range(5))
def test_pages_of_a_bucket_are_those_of_its_documents(seed):
    rng = random.Random(seed)
    maybe = lambda v: None if rng.random() < 0.15 else v
    marks = [-1, 4000, 4000, 9500, 9500, 20_000, 60_000]
    rows = [[(maybe(rng.randint(0, 6)), m + rng.randint(-6000, 15_000) if m > 0 else rng.randint(0, 9000), maybe(rng.randint(-5, 40)), maybe(rng.randint(0, 99))) for _ in range(rng.choice([0, 1, 20]))] for m in marks]
    docs, waiting, got = np.zeros(0, twins._DOCUMENT), np.zeros(0, twins._ROW), []
    for new, mark in zip(rows, marks, strict=True):
        fresh = np.array([(k or 0, t, i or 0, v or 0, k is None, i is None, v is None, True) for k, t, i, v in new], dtype=twins._ROW)
        docs, waiting, (out, numbers, carried, late) = twins.give_out(docs, np.concatenate([waiting, fresh]), mark, 1)
        said = lambda c: [None if n else int(x) for x, n in zip(out[c], out[f"{c}_none"], strict=True)]  # noqa: E731, B023
        whole = lambda a: [None if x is pd.NA else int(x) for x in a]
        got += zip(said("key"), said("id"), said("v"), whole(carried), whole(numbers), map(bool, late), strict=True)
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(plain_pages({}, rows, marks)) and len(got) + len(waiting) == sum(map(len, rows))


def test_a_batch_is_stepped_once_for_both_outputs(spark, tmp_path):
    """Both writes of a batch stepped all states of the stream anew."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    batch = spark.range(100).selectExpr("id AS event_id", "id % 10 = 0 AS late").mapInArrow(counted, "event_id long, late boolean")
    twins.on_time_and_late(batch, 0, str(tmp_path))
    assert seen.value == 100
    assert [spark.read.parquet(f"{tmp_path}/{name}").count() for name in ("rows", "late")] == [90, 10]


def test_many_documents_share_few_states(spark, tmp_path):
    """A state a document cost a dozen calls a batch each; numbers and late rows are the documents' own."""
    path = str(tmp_path)

    def run(rows):
        add(spark, path, rows)
        return twins.keep(twins.number_pages(stream(spark, path), "user_id", "v", timedelta(hours=2)), partial(twins.on_time_and_late, path=path), f"{path}/state")

    run([row(2 * k, k, at=k % 3 / 2) for k in range(3000)] + [row(-1, None, at=0.5, v=4)])
    run([row(2 * k + 1, k, at=1.5) for k in range(3000)] + [row(-2, 9000, at=6)])
    run([row(-3, 9000, at=20)])
    run([row(-4, 1, at=0.2), row(-5, 9001, at=30)])
    got = sorted((r.user_id, r.event_id, r.number) for r in spark.read.parquet(f"{path}/rows").where("user_id < 3000").collect())
    assert got == sorted((k, 2 * k + j, j + 1) for k in range(3000) for j in (0, 1))
    assert [(r.user_id, r.event_id) for r in spark.read.parquet(f"{path}/late").collect()] == [(1, -4)]
    assert [(r.event_id, r.carried, r.number) for r in spark.read.parquet(f"{path}/rows").where("user_id IS NULL").collect()] == [(-1, 4, 1)]
