"""Streams that give what their batch twins give: carry-forward, numbered pages, intake once, quality by day and rolling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from scorespark.storage import delete, exists, numbered_folders, rename

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stream_of(spark, path: str, like: DataFrame, files_at_once: int = 1) -> DataFrame:
    """The Parquet files at path as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def carry_forward(stream: DataFrame, by: str, order: list[str], value: str, late: str) -> DataFrame:
    """Each row with the last value at or before it among its key's rows, in order of event time.

    Rows wait until the watermark has passed them, so that rows which come late, within `late`, take their place; the
    state of a key is its last value and the rows that wait. Rows later than that are dropped by the watermark.
    stream has ts (timestamp), the key `by`, event_id and the value (long).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        rows = [tuple(r) for r in waiting]
        for f in frames:
            rows += [(int(t.value // 1000), int(e), None if pd.isna(v) else int(v)) for t, e, v in zip(f["ts"], f["event_id"], f[value], strict=True)]
        mark = state.getCurrentWatermarkMs() * 1000
        ready, rest = [], []
        for r in sorted(rows):
            (ready if r[0] <= mark else rest).append(r)
        out = []
        for _, e, v in ready:
            last = last if v is None else v
            out.append((key[0], e, v, last))
        state.update((last, rest))
        if rest:
            state.setTimeoutTimestamp(max(rest[0][0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[by, "event_id", "printed", "carried"]).astype({"printed": "Int64", "carried": "Int64"})

    marked = stream.withWatermark("ts", late)
    shape = f"{by} long, event_id long, printed long, carried long"
    kept = "last long, waiting array<struct<ts: long, event_id: long, v: long>>"
    return marked.groupBy(by).applyInPandasWithState(step, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)


def dedupe(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    """Rows whose key has not been seen within `late`."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, width: str, late: str, **counts: Column) -> DataFrame:
    """Counts of rows that meet each condition, by window."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width))
    return g.agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def drain(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs the stream over what there is and stops; path holds rows and checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").option("path", f"{path}/rows").start()
    q.awaitTermination()


#: How far behind the newest row a row may be and still reach the state, to be put aside as too late.
REACH = timedelta(days=3650)


#: States that number_pages() deals documents into; fixed for the life of a checkpoint.
BUCKETS = 1024
#: A row that waits, and a document: `none` flags say which values are null.
_ROW = np.dtype([("key", "i8"), ("ts", "i8"), ("id", "i8"), ("v", "i8"), ("key_none", "?"), ("id_none", "?"), ("v_none", "?"), ("new", "?")])
_DOCUMENT = np.dtype([("key", "i8"), ("last", "i8"), ("next", "i8"), ("upto", "i8"), ("key_none", "?"), ("last_none", "?")])


def _whole(values: np.ndarray, none: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(np.where(none, 0, values).astype("i8"), np.array(none, dtype=bool))


def give_out(documents: np.ndarray, rows: np.ndarray, mark: int, first: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """(documents, rows that wait, what is given out: rows, numbers, carried, carried_none, late) at a mark, for all
    documents of a bucket at once.

    A document is touched if it has new rows, or one that waits is due. Its rows up to the mark are given out in order of
    time and id, numbered on; new rows at or before what was given out earlier are late.
    """
    keys, none = np.concatenate([documents["key"], rows["key"]]), np.concatenate([documents["key_none"], rows["key_none"]])
    order = np.lexsort((keys, none))
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = (keys[order][1:] != keys[order][:-1]) | (none[order][1:] != none[order][:-1])
    code = np.empty(len(order), dtype=np.int64)
    code[order] = np.cumsum(begins) - 1
    old, whose = code[: len(documents)], code[len(documents) :]
    docs = np.zeros(int(begins.sum()), dtype=_DOCUMENT)
    docs["key"], docs["key_none"] = keys[order][begins], none[order][begins]
    docs["last_none"], docs["next"], docs["upto"] = True, first, -1
    docs[old] = documents

    touched = np.zeros(len(docs), dtype=bool)
    touched[whose[rows["new"] | ((rows["ts"] // 1000 + 1) * 1000 <= mark)]] = True
    late = rows["new"] & (rows["ts"] <= docs["upto"][whose])
    ready = np.flatnonzero(touched[whose] & ~late & (rows["ts"] <= mark))
    ready = ready[np.lexsort((rows["v"][ready], ~rows["v_none"][ready], rows["id"][ready], ~rows["id_none"][ready], rows["ts"][ready], whose[ready]))]
    waiting = rows.copy()
    waiting["new"] = False
    gone = late.copy()
    gone[ready] = True

    out, of, n = rows[ready], whose[ready], np.arange(len(ready))
    starts = np.searchsorted(of, np.arange(len(docs)))
    many = np.diff(np.append(starts, len(of)))
    place = np.maximum.accumulate(np.where(out["v_none"], -1, n)) if len(n) else n
    printed = place >= starts[of]
    carried = np.where(printed, out["v"][np.maximum(place, 0)], docs["last"][of]) if len(n) else n
    carried_none = ~printed & docs["last_none"][of]
    numbers = docs["next"][of] + n - starts[of]

    has = many > 0
    ends = (starts + many - 1)[has]
    docs["last"][has], docs["last_none"][has] = carried[ends], carried_none[ends]
    docs["next"] += many
    docs["upto"][touched] = np.maximum(docs["upto"][touched], mark)
    rest = np.zeros(int(late.sum()), dtype=np.int64)
    blank = np.ones(len(rest), dtype=bool)
    given = (np.concatenate([out, rows[late]]), _whole(np.concatenate([numbers, rest]), np.concatenate([n < 0, blank])), _whole(np.concatenate([carried, rest]), np.concatenate([carried_none, blank])), np.concatenate([n < 0, blank]))
    return docs, waiting[~gone], given


class _Pages(StatefulProcessor):
    """State of a bucket of documents: each document's last value, next number and the time up to which rows were given out;
    what waits; and the timer that is set."""

    def __init__(self, key: str, late_ms: int, first: int):
        self.key, self.late, self.first = key, late_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "documents binary, waiting binary, timer long")

    def _step(self, new: list[pd.DataFrame], times, expired: bool = False) -> Iterator[pd.DataFrame]:
        documents, waiting, timer = self.state.get() or (b"", b"", -1)
        timer = -1 if expired else timer
        fresh = np.zeros(sum(map(len, new)), dtype=_ROW)
        for c in _ROW.names[:-1] if new else ():
            fresh[c] = np.concatenate([f[c].to_numpy() for f in new])
        fresh["new"] = True
        rows = np.concatenate([np.frombuffer(waiting, dtype=_ROW), fresh])
        docs, rows, (out, numbers, carried, late) = give_out(np.frombuffer(documents, dtype=_DOCUMENT), rows, self._mark(times), self.first)
        wake = max(1, int(rows["ts"].min()) // 1000 + self.late + 1 - _ms(REACH)) if len(rows) else -1
        if wake != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if wake >= 0:
                self.handle.registerTimer(wake)
        self.state.update((docs.tobytes(), rows.tobytes(), wake))
        if len(out):
            yield pd.DataFrame({self.key: _whole(out["key"], out["key_none"]), "event_id": _whole(out["id"], out["id_none"]), "printed": _whole(out["v"], out["v_none"]), "carried": carried, "number": numbers, "late": late})

    def _mark(self, times) -> int:
        """The time up to which rows are given out, in microseconds: `late` behind the newest row of earlier batches."""
        behind = times.getCurrentWatermarkInMs()
        return (behind + _ms(REACH) - self.late) * 1000 if behind > 0 else -1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step(list(rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step([], timerValues, expired=True)

    def close(self) -> None:
        pass


def _ms(t: timedelta) -> int:
    return t // timedelta(milliseconds=1)


def number_pages(stream: DataFrame, by: str, value: str, late: timedelta, first: int = 1) -> DataFrame:
    """Rows of each document `by` in order of event time and id, numbered from `first`, each with the last value at or before
    it: by, event_id, printed, carried, number, late.

    Rows come in any order. They wait until a row `late` newer has come; last value, next number and the time up to which
    all has been given out are kept for each document. Documents are dealt by hash into BUCKETS states, each of which is
    read, folded as arrays and written once in a batch that touches it, as a state for each document costs more in calls
    than in rows; a timer wakes a bucket whose rows are due. A row that comes after its time has been given out changes no
    number: it is given as late, for an output of its own. The watermark lies REACH behind, so that Spark leaves such rows
    to the state.

    stream has ts (timestamp), by, event_id and value (long). Needs the RocksDB state store, which keep() sets.
    """
    # Nulls go beside their values, which stay whole numbers in pandas.
    values = {"key": F.col(by), "id": F.col("event_id"), "v": F.col(value)}
    columns = [c for n, v in values.items() for c in (F.coalesce(v.cast("long"), F.lit(0)).alias(n), v.isNull().alias(f"{n}_none"))]
    rows = stream.select("ts", F.pmod(F.xxhash64(F.col(by).cast("long")), F.lit(BUCKETS)).alias("_bucket"), *columns).withWatermark("ts", f"{REACH.days} days")
    rows = rows.select(F.col("ts").alias("_ts"), "_bucket", F.unix_micros("ts").alias("ts"), *[c for n in values for c in (n, f"{n}_none")])
    shape = f"{by} long, event_id long, printed long, carried long, number long, late boolean"
    return rows.groupBy("_bucket").transformWithStateInPandas(_Pages(by, _ms(late), first), shape, "Append", "EventTime")


def rolling_quality(stream: DataFrame, width: str, slide: str, late: str, by: str, **counts: Column) -> DataFrame:
    """Counts of rows that meet each condition in windows of `width` every `slide`, by key: start, by, counts. For update mode:
    a window's row comes again whenever it has changed."""
    g = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), by)
    return g.agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).select(F.col("window.start").alias("start"), by, *counts)


def intake(batch: DataFrame, number: int, path: str, query: str, key: list[str]) -> None:
    """Adds the rows of a micro-batch whose key is not stored yet to path/rows; of equal keys in the batch the smallest row.
    Nulls in keys are equal to each other.

    What a batch adds lies in a folder of its query and number, and the digests of its keys in a table beside the rows,
    which is all that later batches read. A batch that is run again leaves its own folder out of account and replaces it:
    so it does not matter where it was cut off. Keys are kept for good, not for a span of time. Queries that run at the
    same time must not take in the same keys.
    """
    spark, rest = batch.sparkSession, [c for c in batch.columns if c not in key]
    own = f"query={query}/batch={number}"
    rows = batch.withColumn("_k", F.unhex(F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)))
    rows = rows.groupBy("_k").agg(F.min(F.struct(*key, *rest)).alias("_r")).select("_k", "_r.*")
    if exists(spark, f"{path}/keys"):
        stored = spark.read.schema("_k binary, query string, batch long").parquet(f"{path}/keys").where((F.col("query") != query) | (F.col("batch") != number))
        known = stored.select("_k").join(rows.select("_k"), "_k", "left_semi")  # so it is the batch that is broadcast, if one is
        rows = rows.join(known, "_k", "left_anti")
    rows = rows.persist()
    rows.drop("_k").write.mode("overwrite").parquet(f"{path}/rows/{own}")
    rows.select("_k").write.mode("overwrite").parquet(f"{path}/keys/{own}")
    rows.unpersist()


def taken_in(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that intake() has stored."""
    return spark.read.schema(f"{schema}, query string, batch long").parquet(f"{path}/rows").drop("query", "batch")


def upsert(batch: DataFrame, number: int, path: str) -> None:
    """Stores a micro-batch of changed rows; latest() reads what they amount to. A batch that is run again replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")


def latest(spark: SparkSession, path: str, schema: str, key: list[str], upto: int | None = None) -> DataFrame:
    """The last row of each key that upsert() has stored (in batches up to a number): the newest base of compact(), and the
    changes since."""
    bases = numbered_folders(spark, path, "base")
    rest = [f.name for f in StructType.fromDDL(schema) if f.name not in key]
    changes = spark.read.schema(f"{schema}, batch long").parquet(f"{path}/changes")
    if bases:
        base = spark.read.schema(schema).parquet(f"{path}/base={bases[-1]}").withColumn("batch", F.lit(bases[-1]).cast("long"))
        changes = base.unionByName(changes.where(F.col("batch") > bases[-1]))
    if upto is not None:
        changes = changes.where(F.col("batch") <= upto)
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*")


def compact(spark: SparkSession, path: str, schema: str, key: list[str]) -> None:
    """Puts what all batches but the last (which may be run again) amount to into a new base, and drops what went into it.
    The new base appears by one rename, so readers and a run that is cut off find the old state or the new one."""
    batches = numbered_folders(spark, f"{path}/changes", "batch")
    if len(batches) < 2:
        return
    upto, bases = batches[-2], numbered_folders(spark, path, "base")
    if upto not in bases:
        beside = f"{path}/_new-{upto}"
        latest(spark, path, schema, key, upto).write.mode("overwrite").parquet(beside)
        rename(spark, beside, f"{path}/base={upto}")
    for old in [f"changes/batch={b}" for b in batches[:-1]] + [f"base={b}" for b in bases if b < upto]:
        delete(spark, f"{path}/{old}")


def keep(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Runs the stream over what there is, giving each micro-batch and its number to sink, and goes on where an earlier run
    with this checkpoint ended. Rows that were too late for the watermark are dropped, and counted in the result."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # states with lists and timers need it
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    return sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"])


def on_time_and_late(batch: DataFrame, number: int, path: str) -> None:
    """Sink of number_pages(): rows in path/rows, those that came too late in path/late. The batch is kept for both, as its
    states would be stepped again for each."""
    batch = batch.persist()
    for late, name in ((False, "rows"), (True, "late")):
        batch.where(F.col("late") == late).drop("late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    batch.unpersist()
