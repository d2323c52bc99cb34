"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewright.llm import alignment, embeddings, langid, merkle, mixing, packing, pii, quality, secrets, sharding, simhash, substrings, tokencount


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.rate_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(_documents(spark, sf_dir)))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard(_documents(spark, sf_dir)))


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_documents(spark, sf_dir)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs", "ranges")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(_documents(spark, sf_dir)))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(_documents(spark, sf_dir))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(_documents(spark, sf_dir), merkle.tamper_fifth())


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(_documents(spark, sf_dir)))


def queries() -> dict:
    return {f.__name__: f for f in (op1_langid, op2_secrets, op3_quality, op4_substrings, op5_embeddings, op6_sharding, op7_tokencount, op8_simhash, op9_mixing, op10_packing, op11_alignment, op12_merkle, op13_pii)}


def oracle_sql() -> dict:
    """The other operators have models, tokenizers, fingerprints, lexing or choices that SQL can't express; tests hold them against brute force."""
    return {"op4_substrings": substrings.SQL, "op5_embeddings": embeddings.SQL, "op12_merkle": merkle.SQL}
