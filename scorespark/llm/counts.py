"""Token counts with a cache of digests."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorespark.llm.common import join_counted, map_batches, new_path, saved, split_by_filter
from scorespark.llm.tokens import counter, file_of

CACHE = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(name: str) -> str:
    """Digest of the tokenizer's file and of how special strings are treated."""
    with open(file_of(name), "rb") as f:
        return hashlib.sha256(f.read() + json.dumps({"special": "default", "limit": None}).encode()).hexdigest()


def _count(name: str):
    def make():
        count = counter(name)
        return lambda batch: {"digest": batch["digest"], "n_tokens": pa.array([count(t) for t in batch["text"].to_pylist()], pa.int64())}

    return make


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, cache: str | None = None) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens).

    Null text counts as empty (0 tokens); doc_id may be null or repeated; other columns are ignored. An empty table
    gives an empty result.

    cache is the folder of the cache table (digest of the content, digest of the tokenizer's version, count); without
    one a new folder is taken. Texts are joined to it by both digests; each distinct text that is missing is encoded
    once and appended. Content is normalised only by null -> empty, since any other change could alter the count.
    Only texts that may be repeated or cached are shuffled; texts that occur once are encoded where they are read.
    """
    spark = docs.sparkSession
    path, version = cache or new_path(spark, "token-counts"), tokenizer_version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    full = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    light = saved(full.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")

    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    stored = spark.read.schema(CACHE).parquet(path) if known else spark.createDataFrame([], CACHE)
    stored = stored.where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])

    repeats = saved(light.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeats")
    again = repeats.select("digest")
    again = saved(again.unionByName(stored.select("digest")), "again") if known else again
    suspects, once = split_by_filter(full.select("digest", "text"), "digest", again)
    if known:
        suspects = suspects.join(stored, "digest", "left_anti")
    misses = once.unionByName(suspects.dropDuplicates(["digest"]))
    fresh = map_batches(misses, _count(tokenizer), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(path)

    stored = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    counted = saved(stored.join(repeats, "digest", "left").select("digest", "n_tokens", F.coalesce("n", F.lit(1)).alias("n")), "counted")
    return join_counted(light, counted, ["digest"], "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
