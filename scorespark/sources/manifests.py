"""Sources and sinks: JSON lines, documents, COCO sets, split manifests, plans, incremental work."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """One JSON record a line; blank lines are skipped, malformed ones are an error. missing_ok: no file, no rows."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.json") -> DataFrame:
    """One JSON document a file, the whole tree below path, with the file it came from."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return df.withColumn("file", F.col("_metadata.file_path"))


COCO = (
    "images array<struct<id: bigint, file_name: string, source_group: string>>, annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>>>, categories array<struct<id: int, name: string>>"
)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of a COCO file."""
    whole = spark.read.schema(COCO).option("multiLine", True).json(path)
    return tuple(whole.select(F.inline(c)) for c in ("images", "annotations", "categories"))


def annotated_images(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with their annotations in order of id; an annotation without image is an error when it is read."""
    known = images.select(F.col("id").alias("image_id"), F.lit(True).alias("_there"))
    # The error hangs on the joined flag: hung on the key, it would be evaluated before the join.
    wrong = F.raise_error(F.concat(F.lit("no image "), F.col("image_id").cast("string"))).cast("long")
    checked = annotations.join(known, "image_id", "left").withColumn("image_id", F.when(F.col("_there").isNull(), wrong).otherwise(F.col("image_id"))).drop("_there")
    grouped = checked.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in annotations.columns if c not in {"id", "image_id"}]))).alias("annotations"))
    return images.join(grouped, images["id"] == grouped["image_id"], "left").drop("image_id")


def rewrite(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], bool] | None = None) -> None:
    """Replaces what lies at path by what write(folder) writes, whole or not at all.

    The new set is written beside the old one and looked at by check(folder); only then the two are swapped by renames.
    If writing or checking fails, the old set stays as it is, and what was begun is removed. Only path is touched.
    """
    P = spark._jvm.org.apache.hadoop.fs.Path
    new, old, goal = (P(f"{path.rstrip('/')}{x}") for x in (f".new-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}", ""))
    system = goal.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        write(new.toString())
        if check and not check(new.toString()):
            raise ValueError(f"{path}: the new set is not as it should be; the old one stays")
        there = system.exists(goal)
        if there and not system.rename(goal, old):
            raise OSError(f"{path}: cannot be moved")
        if not system.rename(new, goal):
            if there:
                system.rename(old, goal)
            raise OSError(f"{path}: the new set cannot be moved there; the old one stays")
        if there:
            system.delete(old, True)
    finally:
        system.delete(new, True)


def write_manifest(df: DataFrame, path: str, split: str = "split", key: str = "sample_id") -> None:
    """One folder a split, rows sorted by key within each file. Only the splits in df are replaced."""
    (df.repartition(split, F.pmod(F.xxhash64(key), F.lit(max(1, df.sparkSession.sparkContext.defaultParallelism)))).sortWithinPartitions(split, key)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split).json(path))


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    rewrite(df.sparkSession, path, df.coalesce(1).write.json)


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    rewrite(df.sparkSession, path, df.write.option("header", True).csv)


def write_id_lists(df: DataFrame, path: str, split: str = "split", key: str = "sample_id") -> None:
    """Text files of the ids of each split, one a line, in order within each file; a folder for each split."""
    lines = df.select(split, F.col(key).cast("string").alias("value")).repartition(split, F.pmod(F.xxhash64(key), F.lit(max(1, df.sparkSession.sparkContext.defaultParallelism)))).sortWithinPartitions(split, "value")
    rewrite(df.sparkSession, path, lines.write.partitionBy(split).text)


def discover(spark: SparkSession, path: str, pattern: str, least: int = 2_000, most: int = 20_000_000, depth: int | None = None) -> DataFrame:
    """Files below path of a size within bounds, in order of path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")
    files = files.where(F.col("length").between(least, most))
    if depth is not None:
        # Segments below the folder itself.
        base = len(path.split("://")[-1].removeprefix("file:").strip("/").split("/"))
        segments = F.size(F.filter(F.split(F.regexp_replace("path", r"^\w+:/*", ""), "/"), lambda s: s != ""))
        files = files.where(segments - base <= depth)
    return files.orderBy("path")


def incremental(todo: DataFrame, done: DataFrame, identity: list[str]) -> DataFrame:
    """Rows of todo that no row of done has the same identity as; nulls are equal to each other."""
    key = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    return todo.withColumn("_k", key).join(done.select(key.alias("_k")), "_k", "left_anti").drop("_k")


def plan_lines(meta: DataFrame, events: DataFrame) -> DataFrame:
    """(key, line) of a tab-separated plan; meta and events have key (order) and their fields in `fields`."""
    line = F.concat_ws("\t", "kind", F.array_join("fields", "\t"))
    return meta.unionByName(events).select("key", line.alias("line"))


def write_plans(lines: DataFrame, path: str, document: str, order: list[str], lines_in_file: int = 100_000) -> None:
    """Each document's lines in order as text: a folder for each document (an integer), whose files follow each other by
    name. Rows are dealt by ranges of document and order, so a long document is written by several tasks."""
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The sink sorts by the folder's column; rows that are sorted by it already stay as they are.
    dealt = lines.withColumn(document, F.col(document).cast("long")).repartitionByRange(ranges, document, *order).sortWithinPartitions(document, *order)
    rewrite(lines.sparkSession, path, dealt.select(document, F.col("line").alias("value")).write.option("maxRecordsPerFile", lines_in_file).partitionBy(document).text)


def read_plans(spark: SparkSession, path: str, document: str, kind: str) -> DataFrame:
    """document, number (from 0), line of what write_plans() wrote, in order of the files' names and of the lines in them."""
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("int")
    files = spark.read.schema(f"value string, {document} {kind}").text(path, wholetext=True)
    files = files.select(document, number(r"part-(\d+)").alias("_part"), number(r"\.c(\d+)").alias("_file"), F.split(F.regexp_replace("value", r"\n$", ""), "\n").alias("_lines"))
    place = [document, "_part", "_file"]
    before = F.coalesce(F.sum(F.size("_lines")).over(W.partitionBy(document).orderBy("_part", "_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = files.select(*place, before.alias("_before"))
    each = files.select(*place, F.posexplode("_lines").alias("_pos", "line")).join(sizes, place)
    return each.select(document, (F.col("_before") + F.col("_pos")).alias("number"), "line")


def with_row_number(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
