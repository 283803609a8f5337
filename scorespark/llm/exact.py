"""Exact dedup with a log-structured index of digests, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import FILTER_BITS, ROW, join_counted, saved, split_by_filter, without_rows

#: Characters that do not count: blank, and tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
#: Runs of a level that are merged into one of the next.
FANOUT = 8
_ORDER = "struct(-n_cp AS n, doc_id IS NULL AS no_id, doc_id AS doc_id, batch AS batch, _rid AS rid)"


def normalised(text):
    """text without BLANKS; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _entries(docs: DataFrame, batch: int, digest_chars: int, text: bool = False) -> DataFrame:
    norm = normalised(F.col("text"))
    return docs.select(
        "doc_id",
        F.lit(batch).alias("batch"),
        F.monotonically_increasing_id().alias("_rid"),
        F.spark_partition_id().alias("run"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"),
        F.substring(F.sha2(norm, 256), 1, digest_chars).alias("digest"),
        *([norm.alias("norm")] if text else []),
    )


class Level:
    """The runs of one level: rows (run, digest, best, group_size), sorted, each digest once a run; and their filters
    (run, w, m), words of 64 bits of FILTER_BITS. Runs are numbered from 0."""

    def __init__(self, rows: DataFrame, filters: DataFrame, runs: int):
        self.rows, self.filters, self.runs = rows, filters, runs

    def plus(self, other: Level) -> Level:
        moved = lambda df: df.withColumn("run", F.col("run") + self.runs)
        return Level(self.rows.unionByName(moved(other.rows)), self.filters.unionByName(moved(other.filters)), self.runs + other.runs)

    def cut(self, first: int) -> tuple[Level, Level]:
        """The first runs, and the others."""
        part = lambda df: (df.where(F.col("run") < first), df.where(F.col("run") >= first).withColumn("run", F.col("run") - first))
        (rows, rest), (filters, rest_filters) = part(self.rows), part(self.filters)
        return Level(rows, filters, first), Level(rest, rest_filters, self.runs - first)


class DigestIndex:
    """A log-structured merge index over (digest, best row).

    add() takes rows by memtable (what a task has read) and flushes each as a sorted run of level 0 with a filter. Each
    `fanout` runs of a level are merged into one of the next level, all such groups at once, so a digest is rewritten once
    a level. Before a merge the filters of its runs are asked: a digest that none of the others knows (a miss) is taken as
    it is, and only hits are shuffled; they keep the smallest identifier in the order longest original text, then smallest
    doc_id, and the number of rows. What of the filters goes to the workers is the words of bits that two runs of a group
    share, FILTER_BITS at most; where these are full, more rows take the way of hits.
    """

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, []
        #: Merges so far, and the rows that went through them as hits and as misses, where they are counted.
        self.merges, self.count, self.hits, self.misses = 0, False, 0, 0

    def add(self, entries: DataFrame) -> None:
        """entries: run (the memtable, from 0), digest, and what _ORDER needs."""
        runs = entries.agg(F.max("run")).first()[0]
        rows = entries.groupBy("run", "digest").agg(F.expr(f"min({_ORDER})").alias("best"), F.count(F.lit(1)).alias("group_size"))
        rows = saved(rows.sortWithinPartitions("run", "digest"), "run0")
        place = rows.select("run", F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)).alias("p")).selectExpr("run", "p div 64 AS w", "shiftleft(1L, cast(p % 64 AS int)) AS b")
        filters = saved(place.groupBy("run", "w").agg(F.bit_or("b").alias("m")), "filter0")
        self._put(0, Level(rows, filters, 0 if runs is None else runs + 1))

    def _put(self, k: int, runs: Level) -> None:
        if k == len(self.levels):
            self.levels.append(runs)
        else:
            self.levels[k] = self.levels[k].plus(runs)
        if groups := self.levels[k].runs // self.fanout:
            full, self.levels[k] = self.levels[k].cut(groups * self.fanout)
            self._put(k + 1, self.merge(full, F.expr(f"run div {self.fanout}"), groups, f"{k + 1}"))

    def merge(self, level: Level, group: Column, groups: int, label: str) -> Level:
        """The runs of each group as one."""
        filters = level.filters.withColumn("run", group.cast("int")).groupBy("run", "w").agg(F.collect_list("m").alias("ms"))  # fanout words at most
        fold = "aggregate(ms, named_struct('one', 0L, 'two', 0L), (a, m) -> named_struct('one', a.one | m, 'two', a.two | (a.one & m)))"
        filters = saved(filters.select("run", "w", F.expr(fold).alias("a")).select("run", "w", F.col("a.one").alias("m"), F.col("a.two").alias("two")), f"filter{label}")
        shared = filters.where("two <> 0").groupBy("w").agg(F.bit_or("two").alias("two"))
        rows = level.rows.withColumn("run", group.cast("int")).withColumn("_p", F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))).withColumn("w", F.expr("_p div 64"))
        rows = rows.join(F.broadcast(shared), "w", "left").withColumn("_hit", F.expr("coalesce(shiftright(two, cast(_p % 64 AS int)) & 1, 0) = 1")).drop("_p", "w", "two")
        if self.count:
            told = {r["_hit"]: r["n"] for r in rows.groupBy("_hit").agg(F.count(F.lit(1)).alias("n")).collect()}
            self.hits, self.misses = self.hits + told.get(True, 0), self.misses + told.get(False, 0)
        self.merges += groups
        hits = rows.where("_hit").groupBy("run", "digest").agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        both = hits.unionByName(rows.where("NOT _hit").drop("_hit"))
        return Level(saved(both.sortWithinPartitions("run", "digest"), f"run{label}"), filters.drop("two"), groups)

    def rows(self) -> DataFrame:
        """(digest, best, group_size) over all batches: what is left on all levels as one run."""
        every = self.levels[0]
        for level in self.levels[1:]:
            every = every.plus(level)
        return (self.merge(every, F.lit(0), 1, "all") if every.runs > 1 else every).rows.drop("run")


def exact_dedup(docs: DataFrame, *further: DataFrame, digest_chars: int = 64, fanout: int = FANOUT) -> DataFrame:
    """Groups rows of documents whose texts are the same but for BLANKS.

    Input: doc_id, text, in one batch or several that are added to the index one after the other; other columns are
    ignored, whatever their names. Batches must be stable scans (rows get the same partition and order each time they are
    read), as files and saved tables are. Output, one row for each input row: doc_id, keep_id, group_size, kept,
    text_sha256, _batch and _rid (the batch, and the row's number in it).

    Null text counts as empty; a null doc_id sorts after all others. Rows that repeat, doc_id included, are copies of
    each other and one of them stays. An empty table gives an empty result. Texts of any length are handled whole.

    Rows with equal digests (hits) are verified byte by byte: the smallest and the largest normalised text of a digest
    must be the same. Where they are not, that digest's rows are grouped by the text itself. Only texts of hits are
    shuffled; a bounded filter keeps the others where they were read. digest_chars is for tests of that path.
    """
    batches = [docs, *further]
    index, flushed = DigestIndex(fanout), []
    for n, batch in enumerate(batches):
        flushed.append(saved(_entries(batch, n, digest_chars), "entries"))
        index.add(flushed[-1])
    best = index.rows()
    hits = best.where("group_size > 1").select("digest")
    entries = _union(flushed)
    suspects = _union([split_by_filter(_entries(b, n, digest_chars, text=True), "digest", hits)[0] for n, b in enumerate(batches)])
    clashes = suspects.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest")
    clashes = saved(clashes, "clash")
    first = [F.col("best.doc_id").alias("keep_id"), F.col("best.batch").alias("keep_batch"), F.col("best.rid").alias("keep_rid"), "group_size"]
    rows = join_counted(entries, best.select("digest", *first, F.col("group_size").alias("n")), ["digest"], "n")
    if not clashes.isEmpty():  # digests that stand for several texts: by the text itself
        torn = suspects.join(clashes, "digest")
        by_text = torn.groupBy("norm").agg(F.expr(f"min({_ORDER})").alias("best"), F.count(F.lit(1)).alias("group_size"))
        apart = torn.join(by_text.select("norm", *first), "norm").select(*rows.columns)
        rows = rows.join(clashes, "digest", "left_anti").unionByName(apart)
    if digest_chars == 64:
        rows = rows.withColumnRenamed("digest", "text_sha256")
    else:
        rows = rows.join(_union([_digests(b, n) for n, b in enumerate(batches)]), ["batch", "_rid"])
    return rows.select("doc_id", "keep_id", "group_size", F.expr("_rid = keep_rid AND batch = keep_batch").alias("kept"), "text_sha256", F.col("batch").alias("_batch"), "_rid")


def _digests(docs: DataFrame, batch: int) -> DataFrame:
    return docs.select(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("_rid"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that exact_dedup() does not keep: of equal rows one stays, ties go to the
    smallest doc_id; null texts and empty ones are equal; an empty table stays empty."""
    gone = saved(exact_dedup(docs).where("NOT kept").select(F.col("_rid").alias(ROW)), "gone")
    return without_rows(docs.withColumn(ROW, F.monotonically_increasing_id()), ROW, gone).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, row_number() OVER () AS r
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER g AS keep_id, first_value(r) OVER g AS keep_r,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id, r)
)
SELECT doc_id, keep_id, group_size, r = keep_r AS kept, text_sha256 FROM w
"""
