"""Queries that go through sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scorespark.plans.aggregates import CONFUSION, confusion_matrix
from scorespark.plans.base import EVENTS, Registry, events, table
from scorespark.sources import files as L
from scorespark.sources import manifests as M
from scorespark.storage import scratch_dir

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders""")
def jsonl_roundtrip(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    path = _folder(spark, "jsonl")
    o.write.json(path)
    return M.read_jsonl(spark, path, o.schema)


@query("""SELECT o_orderkey AS id, o_orderpriority AS file_name, count(l_orderkey) AS n, string_agg(l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def coco_images_with_annotations(spark, d):
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("file_name"))
    a = table(spark, d, "lineitem").select((F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("image_id"), "l_linenumber")
    # Lines of unknown orders are excluded beforehand; annotated_images() takes one as an error.
    a = a.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    j = M.annotated_images(images, a)
    n = F.coalesce(F.size("annotations"), F.lit(0))
    return j.select("id", "file_name", F.when(n > 0, n).otherwise(0).cast("long").alias("n"), F.when(n > 0, F.array_join(F.transform("annotations", lambda x: x["l_linenumber"].cast("string")), ",")).alias("lines"))


@query("""SELECT c_mktsegment AS split, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY ALL""")
def manifest_by_split(spark, d):
    path = _folder(spark, "manifest")
    M.write_manifest(table(spark, d, "customer").select(F.col("c_mktsegment").alias("split"), F.col("c_custkey").alias("sample_id"), "c_name"), path)
    back = spark.read.schema("sample_id long, c_name string, split string").json(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first"), F.max("sample_id").alias("last"))


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS sources, cast(sum(cast(l_quantity AS BIGINT)) AS BIGINT) AS quantity, 'test sources excluded' AS policy FROM lineitem GROUP BY l_returnflag""")
def dataset_summary(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("sources"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.lit("test sources excluded").alias("policy"))
    path = _folder(spark, "summary")
    M.write_summary(s, path)
    return spark.read.schema(s.schema).json(path)


@query("""SELECT o_orderkey AS key, concat_ws(chr(9), 'META', o_orderkey, o_orderstatus, o_orderpriority) AS line FROM orders UNION ALL SELECT l_orderkey, concat_ws(chr(9), 'EVENT', l_linenumber, l_partkey, cast(l_quantity AS BIGINT)) FROM lineitem""")
def plan_lines(spark, d):
    text = lambda *cs: F.array(*[F.col(c).cast("string") if isinstance(c, str) else c for c in cs])
    meta = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit("META").alias("kind"), text("o_orderkey", "o_orderstatus", "o_orderpriority").alias("fields"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit("EVENT").alias("kind"), text("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").cast("string")).alias("fields"))
    return M.plan_lines(meta, lines)


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)""")
def incremental_todo(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return M.incremental(o, o.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0"), ["o_orderkey", "o_orderstatus"])


@query(r"""SELECT event_id, k, CASE WHEN k IS NULL THEN 'failed' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, CASE WHEN k IS NULL THEN 'no integer k in ' || coalesce(props, 'null') WHEN event_type = 'error' THEN 'event ' || event_id || ' tells of an error' END AS error
FROM (SELECT *, try_cast(regexp_extract(props, '"k": (\d+)', 1) AS INTEGER) AS k FROM events)""")
def quarantine_rows(spark, d):
    """A complete queue: rows that failed keep their place, with status and error text."""
    k = F.from_json("props", "k int")["k"]
    failed, told = k.isNull(), F.col("event_type") == "error"
    error = F.when(failed, F.concat(F.lit("no integer k in "), F.coalesce("props", F.lit("null")))).when(told, F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" tells of an error")))
    return table(spark, d, "events").select("event_id", k.alias("k"), F.when(failed, "failed").when(told, "error").otherwise("ok").alias("status"), error.alias("error"))


@query(f"""WITH {EVENTS} SELECT day, event_type, count(*) AS n, min(x) AS first FROM events_x GROUP BY ALL""")
def json_documents(spark, d):
    """A JSON document a file, the whole tree: one for each day, with the counts of its event types."""
    kinds = events(spark, d).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("first"))
    days = kinds.groupBy("day").agg(F.collect_list(F.struct("event_type", "n", "first")).alias("kinds")).withColumn("month", F.substring("day", 1, 7))
    path = _folder(spark, "documents")
    days.select("month", F.struct("day").alias("page"), "kinds").write.partitionBy("month").option("maxRecordsPerFile", 1).json(path)
    shape = "page struct<day: string>, kinds array<struct<event_type: string, n: bigint, first: bigint>>"
    back = M.read_json_documents(spark, path, StructType.fromDDL(shape))
    return back.select("page.day", F.inline("kinds"))


@query("""SELECT c_mktsegment AS split, c_custkey AS id FROM customer""")
def split_id_lists(spark, d):
    """Text lists of the ids of each split, written and read back."""
    path = _folder(spark, "ids")
    M.write_id_lists(table(spark, d, "customer").select(F.col("c_mktsegment").alias("split"), F.col("c_custkey").alias("sample_id")), path)
    back = spark.read.schema("value string, split string").text(path)
    return back.select("split", F.col("value").cast("long").alias("id"))


@query(CONFUSION)
def confusion_csv(spark, d):
    """The confusion matrix as CSV, written and read back."""
    matrix, path = confusion_matrix(spark, d), _folder(spark, "confusion")
    M.write_table(matrix, path)
    return spark.read.schema(matrix.schema).option("header", True).csv(path)


@query("""SELECT c_custkey, c_name, 2 AS version FROM customer""")
def staged_rewrite(spark, d):
    """A set that is rewritten beside the old one and swapped; a rewrite that fails its check changes nothing."""
    path, c = _folder(spark, "rewrite"), table(spark, d, "customer").select("c_custkey", "c_name")
    count = c.count()
    whole = lambda p: spark.read.parquet(p).count() == count
    M.rewrite(spark, path, c.withColumn("version", F.lit(1)).write.parquet, whole)
    M.rewrite(spark, path, c.withColumn("version", F.lit(2)).write.parquet, whole)
    try:
        M.rewrite(spark, path, c.where("c_custkey % 2 = 0").withColumn("version", F.lit(3)).write.parquet, whole)
    except ValueError:
        pass
    return spark.read.schema("c_custkey long, c_name string, version int").parquet(path)


@query("""SELECT page_id, CASE WHEN 9000 + page_id % 2500 * 4 < 10000 THEN 'too small' WHEN page_id % 7 = 0 THEN 'wrong signature' WHEN 900 + page_id % 1000 < 1000 THEN 'too narrow' WHEN 950 + page_id % 600 < 1000 THEN 'too low' END AS rule FROM pages""")
def dq_page_headers(spark, d):
    """Rules of rendered pages, told from the head of each: here, heads made of the pages' numbers."""
    four = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    n = F.col("page_id")
    signature = F.when(n % 7 == 0, F.lit(b"GIF89a..")).otherwise(F.lit(L.PNG))
    head = F.concat(signature, F.lit(b"\x00\x00\x00\rIHDR"), four(900 + n % 1000), four(950 + n % 600))
    return table(spark, d, "pages").select("page_id", L.png_rule(head, 9000 + n % 2500 * 4).alias("rule"))


@query()
def discover_files(spark, d):
    """The tables' own files, by size."""
    return M.discover(spark, d, "*.parquet", 1_000, 10_000_000_000).select("path", "length")


@query()
def dq_file_header(spark, d):
    """Files of all tables, each with whether it begins and ends as Parquet does."""
    heads = L.file_heads(spark, d, "*.parquet", 4, 4)
    return heads.select("path", ((F.col("length") >= 8) & (F.col("head") == F.lit(b"PAR1")) & (F.col("tail") == F.lit(b"PAR1"))).alias("ok"))


@query("""WITH p AS (SELECT page_id, page_id // 8 AS doc, 9000 + page_id % 50 * 40 AS size, page_id % 7 AS kind, 900 + page_id % 1000 AS width, 950 + page_id % 600 AS height FROM pages WHERE page_id % 37 <> 5),
r AS (SELECT doc, page_id, CASE WHEN size < 10000 THEN 'too small' WHEN kind = 0 THEN 'wrong signature' WHEN width < 1000 THEN 'too narrow' WHEN height < 1000 THEN 'too low' END AS rule FROM p),
e AS (SELECT page_id // 8 AS doc, count(*) AS n FROM pages WHERE page_id % 37 <> 6 GROUP BY ALL), t AS (SELECT doc, count(*) AS n FROM p GROUP BY ALL)
SELECT cast(doc AS VARCHAR) AS document, page_id, rule FROM r WHERE rule IS NOT NULL UNION ALL
SELECT cast(coalesce(e.doc, t.doc) AS VARCHAR), NULL, CASE WHEN e.n IS NULL THEN 'unknown document' ELSE 'wrong page count' END FROM e FULL JOIN t ON e.doc = t.doc WHERE e.n IS DISTINCT FROM t.n""")
def dq_page_files(spark, d):
    """Rendered pages as real files, eight a document: some are too small, begin wrong, or have too short a side; some are
    missing, and of some documents fewer are expected."""
    n, root = F.col("page_id"), _folder(spark, "rendered")
    four = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    signature = F.when(n % 7 == 0, F.lit(b"GIF89a..")).otherwise(F.lit(L.PNG))
    head = F.concat(signature, F.lit(b"\x00\x00\x00\rIHDR"), four(900 + n % 1000), four(950 + n % 600))
    content = F.concat(head, F.unhex(F.repeat(F.lit("00"), (9000 + n % 50 * 40 - 24).cast("int"))))
    pages = table(spark, d, "pages").select("page_id", F.floor(n / 8).cast("string").alias("document"))
    rendered = pages.where("page_id % 37 <> 5").select(F.concat("document", F.lit("/page-"), n.cast("string"), F.lit(".png")).alias("path"), content.alias("content"))
    L.write_files(rendered, root)
    expected = pages.where("page_id % 37 <> 6").groupBy("document").agg(F.count(F.lit(1)).alias("pages"))
    wrong = L.checked_pages(L.file_heads(spark, root, "*.png"), expected, F.regexp_extract("path", r"(\d+)/page-\d+\.png$", 1))
    return wrong.select("document", F.regexp_extract("path", r"page-(\d+)\.png$", 1).try_cast("long").alias("page_id"), "rule")


@query(f"""WITH {EVENTS} SELECT event_type, count(*) AS n, max(v) AS largest FROM events_x GROUP BY event_type""")
def incremental_files(spark, d):
    """A file for each event type, read again only where no result is kept: the second run finds what the first one did."""
    e, root, kept = events(spark, d), _folder(spark, "queue"), _folder(spark, "results")
    shape = "event_id long, v long"

    def work(files):
        rows = spark.read.schema(shape).option("recursiveFileLookup", True).json(root).select("v", F.col("_metadata.file_path").alias("path"))
        return rows.join(files.select("path"), "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("largest"))

    for part in ("event_type < 'd'", "event_type >= 'd'"):
        e.where(part).repartition("event_type").select("event_id", "v", "event_type").write.mode("append").partitionBy("event_type").json(root)
        listed = spark.read.schema(shape).option("recursiveFileLookup", True).json(root).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_modification_time").alias("modified")).distinct()
        out = L.with_results(listed, work, kept, "n long, largest long", rule="count and largest")
    named = out.select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("event_type"), "n", "largest")
    return named.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
