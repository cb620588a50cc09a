"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import language_id, licenses, media, mixing, near_duplicates, neighbours, packing, sharding, substring_dedup, token_counts
from readloom.llm.common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_in = language_id.held_in(F.col("doc_id"))
    chain = language_id.learn(docs, held_in)
    found = language_id.identify(docs.select("doc_id", "text"), chain)
    return found.select("doc_id", (~held_in).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(read_table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op6_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_columns(read_table(spark, sf_dir, "documents"), keep=("n_bytes", "media", "payload", "feature", "rgb_crc32"))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "rgb_crc32",
    )


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.license_scan(docs).select("doc_id", "license.*")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("expressions").alias("n_expressions"))


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.fingerprint_neighbours(read_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", F.length("text").cast("long").alias("n_chars"), "tokens.n_tokens", "tokens.score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_collinear_chaining, op2_language_id, op3_harmonic_packing, op4_sampled_splitters, op5_cube_mixing, op6_progressive_jpeg, op7_dart_minhash, op8_license_scan, op9_weighted_sampling, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {}
