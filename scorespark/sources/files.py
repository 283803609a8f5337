"""Files as rows: their heads and tails read where tasks run, files written by tasks, and results kept by file."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scorespark.storage import exists

HEADS = "path string, length long, modified timestamp, head binary, tail binary"


def arrow_place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


class _Files(InputPartition):
    def __init__(self, root: str, files: list[tuple]):
        self.root, self.files = root, files


class _HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.head, self.tail, self.each = (int(options.get(k, v)) for k, v in (("head", 24), ("tail", 0), ("files", 200)))

    def partitions(self) -> list[_Files]:
        """Lists the folder; no file is opened. Hidden files and folders are left out."""
        system, base = arrow_place(self.root)
        found = []
        for f in system.get_file_info(pafs.FileSelector(base, recursive=True)):
            below = f.path[len(base.rstrip("/")) + 1 :].split("/")
            if f.type == pafs.FileType.File and fnmatch(f.base_name, self.pattern) and not any(x.startswith(("_", ".")) for x in below):
                found.append((f.path, f.size, f.mtime))
        found.sort()
        return [_Files(self.root, found[k : k + self.each]) for k in range(0, len(found), self.each)] or [_Files(self.root, [])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = arrow_place(partition.root)
        for path, size, modified in partition.files:
            with system.open_input_file(path) as f:
                head = f.read(min(self.head, size))
                tail = f.read_at(min(self.tail, size), size - min(self.tail, size)) if self.tail else b""
            yield path, size, modified, head, tail


class FileHeads(DataSource):
    """Spark data source of the first and last bytes of files: options path, pattern, head and tail (bytes), files (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "scorespark_file_heads"

    def schema(self) -> str:
        return HEADS

    def reader(self, schema) -> _HeadReader:
        return _HeadReader(self.options)


def file_heads(spark: SparkSession, path: str, pattern: str = "*", head: int = 24, tail: int = 0, files: int = 200) -> DataFrame:
    """path, length, modified, head and tail of the files below path, however large: tasks open them, `files` each, and read
    just these bytes; the driver only lists them. In stores that Arrow cannot open, files that are not empty come through
    Spark's reader of binary files, which reads them whole."""
    try:
        arrow_place(path)
    except pa.ArrowInvalid:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
        end = F.substring("content", -tail, tail) if tail else F.lit(b"")
        return whole.select("path", "length", F.col("modificationTime").alias("modified"), F.substring("content", 1, head).alias("head"), end.alias("tail"))
    spark.dataSource.register(FileHeads)
    return spark.read.format(FileHeads.name()).options(path=path, pattern=pattern, head=str(head), tail=str(tail), files=str(files)).load()


def write_files(df: DataFrame, root: str) -> None:
    """Each row's content as a file root/path, written by the tasks; a task that runs again writes the same files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = arrow_place(root)
        n = 0
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                system.create_dir(f"{base}/{name}".rsplit("/", 1)[0])
                with system.open_output_stream(f"{base}/{name}") as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    df.select("path", F.col("content").cast("binary")).mapInArrow(each, "n long").agg(F.sum("n")).collect()  # one row a task


PNG = bytes((137, 80, 78, 71, 13, 10, 26, 10))


def png_rule(head: Column, length: Column, least: int = 10_000, least_side: int = 1_000) -> Column:
    """The first rule that a PNG file breaks, told from its length and its first 24 bytes; null if it keeps all."""
    number = lambda at: F.conv(F.hex(F.substring(head, at, 4)), 16, 10).cast("long")
    rules = F.when(length < least, "too small").when(F.substring(head, 1, 8) != F.lit(PNG), "wrong signature")
    return rules.when(number(17) < least_side, "too narrow").when(number(21) < least_side, "too low")


def checked_pages(files: DataFrame, expected: DataFrame, document: Column, least: int = 10_000, least_side: int = 1_000) -> DataFrame:
    """Rules that rendered pages break: document, path, rule. files has path, length, head; expected has document and pages,
    its number of pages. A document without as many files has a row without path, one that is not expected too."""
    named = files.select(document.alias("document"), "path", png_rule(F.col("head"), F.col("length"), least, least_side).alias("rule"))
    there = named.groupBy("document").agg(F.count(F.lit(1)).alias("_n"))
    counts = expected.join(there, "document", "full").select("document", F.lit(None).cast("string").alias("path"), F.when(F.col("pages").isNull(), "unknown document").when(F.coalesce("_n", F.lit(0)) != F.col("pages"), "wrong page count").alias("rule"))
    return named.where("rule IS NOT NULL").unionByName(counts.where("rule IS NOT NULL"))


def identity(path: str = "path", length: str = "length", modified: str = "modified", **parameters: object) -> Column:
    """Digest of a file's path, size and time of change, and of the parameters of the work on it."""
    return F.sha2(F.concat_ws("\n", path, F.col(length).cast("string"), F.unix_micros(modified).cast("string"), F.lit(json.dumps(parameters, sort_keys=True))), 256)


def with_results(files: DataFrame, work: Callable[[DataFrame], DataFrame], table: str, schema: str, force: bool = False, **parameters: object) -> DataFrame:
    """files (path, length, modified and others) with the columns of schema, the results of work, from the table at that path.

    work takes the rows of files whose identity() has no result yet (all of them with force), and returns path and the
    columns of schema, one row a file at most; these are appended to the table under a number of their run. Of results with
    the same identity the last run's counts. A file that has changed, or other parameters, make another identity, so old
    results stay for whoever asks for them. A run that fails appends nothing and is done again.
    """
    spark, keyed = files.sparkSession, files.withColumn("_identity", identity(**parameters))
    shape = f"_identity string, _run long, {schema}"
    done = exists(spark, table)
    stored = spark.read.schema(shape).option("recursiveFileLookup", True).parquet(table) if done else spark.createDataFrame([], shape)
    todo = keyed if force or not done else keyed.join(stored.select("_identity"), "_identity", "left_anti")
    last = stored.agg(F.max("_run")).first()[0] if done else None
    names = spark.createDataFrame([], schema).columns
    fresh = todo.select("path", "_identity").join(work(todo.drop("_identity")), "path").select("_identity", F.lit((last or 0) + 1).cast("long").alias("_run"), *names)
    beside = f"{table}/run={uuid.uuid4().hex}"
    fresh.write.parquet(beside)
    now = spark.read.schema(shape).option("recursiveFileLookup", True).parquet(table)
    best = now.groupBy("_identity").agg(F.max_by(F.struct(*names), "_run").alias("_r")).select("_identity", "_r.*")
    return keyed.join(best, "_identity").drop("_identity")
