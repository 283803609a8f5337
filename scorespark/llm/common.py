"""What the training-data operators share: scratch tables, bounded filters, tiles of hot groups, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorespark.storage import scratch_dir

#: Most bits of a broadcast membership filter: half a million words of 64 bits, about 40 MB at any input size.
FILTER_BITS = 1 << 25
#: Rows, and bytes of their columns about, that a worker holds as Python objects at once; one row may be larger.
AT_ONCE, BYTES_AT_ONCE = 1000, 3 << 20
#: The row number that operators add where all columns of their input pass through.
ROW = "_scorespark_row"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later steps no longer depend on its lineage."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table made by saved(), when nothing will read it again."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """make() once a task gives the function that turns a batch into columns; a column may be passed through as it is."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_pydict(work(part))

    return df.mapInArrow(each, schema)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in order, cut into parts of at most AT_ONCE rows and, but for single rows, BYTES_AT_ONCE bytes of strings."""
    upto = np.zeros(batch.num_rows + 1, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            upto[1:] += np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(upto, upto[at] + BYTES_AT_ONCE, side="right")) - 1
        to = min(max(to, at + 1), at + AT_ONCE, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def running_sum(df: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """df with the sum of value over all rows before, in the order of columns that together are unique.

    Rows are dealt by ranges of the order and summed inside each; the ranges' totals, one row a partition, are added. So
    no key has to be in one task.
    """
    spark = df.sparkSession
    dealt = saved(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_scorespark_p", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_scorespark_p").agg(F.sum(value).alias("_scorespark_n"))
    upto = Window.orderBy("_scorespark_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_scorespark_p", F.coalesce(F.sum("_scorespark_n").over(upto), F.lit(0)).alias("_scorespark_b"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_scorespark_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(out, inner).join(F.broadcast(starts), "_scorespark_p").withColumn(out, F.col(out) + F.col("_scorespark_b")).drop("_scorespark_p", "_scorespark_b")


def bits_for(keys: int, most: int = FILTER_BITS) -> int:
    """Bits of a filter of so many keys: a power of two, 16 a key or more, at most `most`."""
    return min(most, max(1 << 10, 1 << (16 * keys - 1).bit_length() if keys else 0))


def split_by_filter(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in keys, rows whose key surely is not).

    keys has one column named key, and is a saved table: it is counted, and the Bloom-like bitmap that is broadcast has
    bits_for() them, FILTER_BITS at most. False positives, which are many when there are more keys than bits, only send
    more rows down the exact path. A null key is never in keys.
    """
    size = bits_for(keys.count())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size))
    bits = (
        keys.where(F.col(key).isNotNull())
        .select(place(F.col(key)).alias("_scorespark_p"))
        .selectExpr("_scorespark_p div 64 AS _scorespark_w", "shiftleft(1L, cast(_scorespark_p % 64 AS int)) AS _scorespark_b")
        .groupBy("_scorespark_w")
        .agg(F.bit_or("_scorespark_b").alias("_scorespark_m"))
    )
    marked = (
        df.withColumn("_scorespark_p", place(F.col(key)))
        .withColumn("_scorespark_w", F.expr("_scorespark_p div 64"))
        .join(F.broadcast(bits), "_scorespark_w", "left")
        .withColumn("_scorespark_h", F.expr(f"{key} IS NOT NULL AND coalesce(shiftright(_scorespark_m, cast(_scorespark_p % 64 AS int)) & 1, 0) = 1"))
        .drop("_scorespark_p", "_scorespark_w", "_scorespark_m")
    )
    return marked.where("_scorespark_h").drop("_scorespark_h"), marked.where("NOT _scorespark_h").drop("_scorespark_h")


def without_rows(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs less the rows whose key is in gone; only rows that the filter suspects are shuffled."""
    maybe, never = split_by_filter(docs, key, gone)
    return never.unionByName(maybe.join(gone, key, "left_anti"))


def join_counted(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """left joined to right by the keys on, without a task that gets all rows of a hot key.

    right has each key once, with the number of left's rows that have it in `rows`, which is dropped; it is a saved table,
    and left is one or cheap to read twice. Keys with more than a thousandth of all these rows are fewer than a thousand:
    they are broadcast, and their rows stay where they are. The others are shuffled.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    hot, rest = right.where(F.col(rows) * 1000 > total).drop(rows), right.where(F.col(rows) * 1000 <= total).drop(rows)
    stay = left.join(F.broadcast(hot), on)
    return stay.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


def tiles(df: DataFrame, keys: list[str], member: str, size: int, keep_slot: bool = False) -> DataFrame:
    """Splits groups (rows of equal keys, at least two) into tiles (_a, _b) of at most about 2 * size rows.

    Every pair of rows of a group meets in some tile, so nothing is lost, and no task holds a whole hot group: a group
    of m rows becomes slots of about size rows (_s), and each pair of slots is a tile of its own. df is read twice.
    """
    many = saved(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").withColumn("_n", F.col("_m")), "many")
    return (
        join_counted(df, many, keys, "_n")
        .withColumn("_k", F.expr(f"cast(ceil(_m / {size}) AS int)"))
        .withColumn("_s", F.expr(f"cast(pmod(xxhash64({member}, 7), _k) AS int)"))
        .withColumn("_j", F.explode(F.expr("sequence(0, _k - 1)")))
        .withColumn("_a", F.least("_s", "_j"))
        .withColumn("_b", F.greatest("_s", "_j"))
        .drop("_m", "_k", "_j", *([] if keep_slot else ["_s"]))
    )


def map_runs(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Brings rows of equal keys together, sorted, and calls work for each such run; cheap for many small runs."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def finish(frame: pd.DataFrame) -> pd.DataFrame | None:
            outs = []
            change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            for lo, hi in zip(change, [*change[1:], len(frame)], strict=True):
                out = work(frame.iloc[lo:hi])
                if out is not None and len(out):
                    outs.append(out)
            return pd.concat(outs, ignore_index=True) if outs else None

        for frame in frames:
            if not len(frame):
                continue
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            same = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
            start = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            held = frame.iloc[start:]
            if start and (out := finish(frame.iloc[:start])) is not None:
                yield out
        if held is not None and (out := finish(held)) is not None:
            yield out

    return spread(df, *keys).sortWithinPartitions(*keys).mapInPandas(each, schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into all shuffle partitions: few bytes can be much work, so they are not merged by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node with an edge; label is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014), each a join with partial minima, so that a
    node with very many edges is neither gathered in one task nor sent to the driver. Every round's edges are written
    to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    now = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")

    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(u, v) AS decimal(38,0))"))).first())

    seen = mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("inline(array(struct(v AS u, m AS v), struct(u AS u, m AS v)))")
        new = saved(small.where("u <> v").distinct(), "cc")
        drop_saved(spark, now)
        now, last, seen = new, seen, mark(new)
        if last == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label"))
    )
