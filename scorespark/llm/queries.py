"""The operators' queries over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorespark.llm import automaton, bpe, counts, embeddings, exact, langid, license, packing, repair, simhash, spelling, substring, suffix


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(_table(spark, sf_dir, "documents")).drop("detections")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"))


def op10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.automaton_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash, op2_substring, op3_packing, op4_exact, op5_suffix, op6_license, op7_embeddings, op8_language, op9_bpe, op10_counts, op11_spelling, op12_repair, op13_automaton)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_simhash": simhash.SQL, "op2_substring": substring.SQL, "op4_exact": exact.SQL, "op5_suffix": suffix.SQL, "op6_license": license.sql(), "op7_embeddings": embeddings.SQL}
