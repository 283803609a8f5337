"""Streams over the events, compared with their batch twins."""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import partial

from pyspark.sql import functions as F

from scorespark.plans.base import EVENTS, Registry, events, table
from scorespark.storage import scratch_dir
from scorespark.streaming import twins

query = Registry()
QUERIES, SQL = query.queries, query.sql


#: Stretches of time that a table is dealt into, a trigger for each, and files of each.
SLICES, FILES = 4, 4


def _stream(spark, d, df, flush=timedelta(days=2), mixed=False):
    """df as a stream of files in order of time, and a folder for what comes of it. mixed: a third of each stretch comes
    with the next one.

    With flush a last row, of keys -1 and so long after all others, moves the watermark past them, so that what waits is
    given out when the stream ends.
    """
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    first, last = df.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / SLICES if first else None
    for k in range(SLICES if first else 0):
        stretch = F.least(F.lit(SLICES - 1), F.floor((F.col("ts").cast("double") - first.timestamp()) / max(step.total_seconds(), 1e-6)))
        if mixed:
            stretch = F.least(F.lit(SLICES - 1), stretch + F.when(F.xxhash64("event_id") % 3 == 0, 1).otherwise(0))
        # The files of a trigger come after those of the one before; the last stretch has its end.
        df.where(stretch == k).repartition(FILES).write.mode("append").parquet(f"{root}/in")
    if flush and first:
        end = [F.lit(last + flush).alias("ts") if f.name == "ts" else F.lit("" if f.dataType.simpleString() == "string" else -1).cast(f.dataType).alias(f.name) for f in df.schema]
        spark.range(1).select(*end).write.mode("append").parquet(f"{root}/in")
    return twins.stream_of(spark, f"{root}/in", df, FILES), f"{root}/out"


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN v END AS printed FROM events_x)
SELECT user_id, event_id, printed, last_value(printed IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM p""")
def stream_carry_forward(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long")).alias("printed"))
    stream, path = _stream(spark, d, e)
    twins.drain(twins.carry_forward(stream, "user_id", ["ts", "event_id"], "printed", "1 hour"), path)
    return spark.read.schema("user_id long, event_id long, printed long, carried long").parquet(f"{path}/rows")


@query("""SELECT event_id, user_id FROM events""")
def stream_dedupe(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    stream, path = _stream(spark, d, e.unionByName(e.where("event_id % 3 = 0")), flush=None)
    twins.drain(twins.dedupe(stream, ["event_id"], "2 days").select("event_id", "user_id"), path)
    return spark.read.schema("event_id long, user_id long").parquet(f"{path}/rows")


@query(f"""WITH {EVENTS} SELECT day, count(*) FILTER (event_type = 'view') AS tp, count(*) FILTER (event_type = 'click') AS fp FROM events_x GROUP BY day""")
def stream_daily_quality(spark, d):
    e = events(spark, d).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    stream, path = _stream(spark, d, e)
    w = twins.windowed_counts(stream, "1 day", "1 hour", tp=F.col("event_type") == "view", fp=F.col("event_type") == "click")
    twins.drain(w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tp", "fp"), path)
    return spark.read.schema("day string, tp long, fp long").parquet(f"{path}/rows")


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN v END AS printed FROM events_x)
SELECT user_id, event_id, printed, last_value(printed IGNORE NULLS) OVER w AS carried, row_number() OVER w AS number FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def stream_numbered_pages(spark, d):
    """Numbers within each user's stream, and the last price at or before each event; pages (files) come in any order within
    a stretch."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", F.round(F.col("value") * 100).cast("long")).alias("printed"))
    span = e.agg((F.max("ts").cast("long") - F.min("ts").cast("long")).alias("s")).first()["s"] or 0
    late = timedelta(seconds=2 * span // SLICES + 2)  # what comes with the next stretch is up to two stretches late
    stream, path = _stream(spark, d, e, late + timedelta(days=1), mixed=True)
    twins.keep(twins.number_pages(stream, "user_id", "printed", late), partial(twins.on_time_and_late, path=path), f"{path}/state")
    rows = spark.read.schema("user_id long, event_id long, printed long, carried long, number long").parquet(f"{path}/rows")
    return rows.where("user_id >= 0").select("user_id", "event_id", "printed", "carried", "number")


@query("""SELECT event_id, user_id FROM events""")
def stream_intake_once(spark, d):
    """Every event once, though a third of them come again in later files and the query is begun anew in between."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    again = e.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 DAYS"))
    path, half = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}", F.col("event_id") % 2 == 0
    for part in (e.where(half), e.where(~half).unionByName(again)):
        part.repartition(FILES).write.mode("append").parquet(f"{path}/in")
        sink = partial(twins.intake, path=f"{path}/out", query="events", key=["event_id"])
        twins.keep(twins.stream_of(spark, f"{path}/in", e, FILES), sink, f"{path}/state")
    return twins.taken_in(spark, f"{path}/out", "event_id long, user_id long, ts timestamp").select("event_id", "user_id")


@query(f"""WITH {EVENTS}, b AS (SELECT 'r' || user_id % 4 AS renderer, event_type, cast(floor(epoch(ts) / 7200) * 7200 AS BIGINT) AS slot FROM events_x), w AS (SELECT *, slot - k * 7200 AS began FROM b, (VALUES (0), (1), (2)) AS o(k)),
c AS (SELECT renderer, cast(began AS BIGINT) AS began, count(*) FILTER (event_type = 'view') AS tp, count(*) FILTER (event_type = 'click') AS fp, count(*) FILTER (event_type = 'purchase') AS fn, count(*) FILTER (event_type = 'error') AS failed FROM w GROUP BY ALL)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c""")
def stream_rolling_quality(spark, d):
    """Quality of each renderer in windows of six hours every two, kept up to date as rows come in."""
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("renderer"), F.col("ts").cast("timestamp").alias("ts"))
    stream, path = _stream(spark, d, e, flush=None)
    kinds = {"tp": "view", "fp": "click", "fn": "purchase", "failed": "error"}
    w = twins.rolling_quality(stream, "6 hours", "2 hours", "1 hour", "renderer", **{n: F.col("event_type") == k for n, k in kinds.items()})
    twins.keep(w, partial(twins.upsert, path=path), f"{path}/state", "update")
    shape = "start timestamp, renderer string, tp long, fp long, fn long, failed long"
    twins.compact(spark, path, shape, ["start", "renderer"])
    rate = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    rows = twins.latest(spark, path, shape, ["start", "renderer"])
    return rows.select("renderer", F.col("start").cast("long").alias("began"), *kinds, rate(F.col("tp"), F.col("fp")).alias("precision"), rate(F.col("tp"), F.col("fn")).alias("recall"))
