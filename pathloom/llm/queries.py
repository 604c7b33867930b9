"""The registered queries of this folder, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fingerprints, mixing, near_dedup, packing, quality, sharding, token_counts, token_files, url_filter

END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return chosen.select("doc_id", "n_grams", "score", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), END_ID, special=True)
    back = token_files.read_token_files(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 4096, END_ID, special=True)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


#: The rules that the URL query is given.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(32)], 4093


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))
    return near.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_fingerprints, op2_quality, op3_token_files, op4_sharding, op5_token_counts, op6_nearest, op7_mixing, op8_near_dedup, op9_url_filter, op10_packing]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": sharding.shard_sql("documents", "doc_id", SHARDS, SLOTS), "op9_url_filter": url_filter.judge_sql("pages", RULES)}
