"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, mixing and packing of `documents`.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and all but the last return the
columns of docs. run() applies the stages in order; each one's rows are written to the shared folder and read
again by the next, so that a lost executor costs a stage's tasks and not the pipeline.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns of
any name; what it does with them stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import language_id, mixing, near_duplicates, packing, queries, substring_dedup
from readloom.llm.common import delete, free_name, shared_folder, small_batches

#: Documents without a letter go, and those of which no language holds this share of the words.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that have a language; null and empty texts and texts without a letter go. Rows are judged by their text alone: repeated ones stay or go together, null doc_ids and labels are allowed. Texts are read whole. An empty table stays empty."""
    small_batches(spark)
    chain = language_id.learn(docs, language_id.held_in(docs["doc_id"]))
    name = free_name(docs, "language")
    found = language_id.identify(docs, chain, into=name)
    kept = (found[name]["lang"] != language_id.UNDETERMINED) & (found[name]["score"] >= LEAST_SHARE)
    # without labelled rows nothing is known, and nothing is rejected but texts without a letter
    kept = kept if chain is not None else docs["text"].rlike(r"\p{L}")
    return found.where(kept).select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each class of near duplicates; of rows with one doc_id that of the smallest text. Null texts are like no other, rows with a null doc_id stay, texts without a word are like equal ones only. An empty table stays empty."""
    small_batches(spark)
    found = near_duplicates.classes(docs)
    return near_duplicates.one_of_each(docs, found).select(*docs.columns)


def repeated_passage_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages that a document of a smaller doc_id has as well out of the texts; n_chars follows. Documents of which no word is left go. Rows with a null text or doc_id stay as they are, repeated rows are cut alike and are no passage of each other; of different texts with one doc_id the one of the larger hash is cut. An empty table stays empty."""
    small_batches(spark)
    return substring_dedup.cut_passages(docs, substring_dedup.repeated_passages(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix says: never, once or twice. Null sources are a source of their own; null and empty texts have no words and are taken as the document totals ask. Of rows equal in doc_id, text and source that differ elsewhere, the smallest stands for all. An empty table stays empty."""
    small_batches(spark)
    # decisions meet their rows by doc_id, source and a hash of the text; of equal rows, one is written as often as all are taken
    taken = mixing.mix(docs).groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    key, i, place, tie, copies, rows, n = (free_name(docs, f"mix_{c}") for c in ("key", "id", "source", "tie", "copies", "rows", "n"))
    taken = taken.select(F.col("doc_id").alias(i), F.col("source").alias(place), F.col("tie").alias(tie), F.col("copies").alias(copies), F.col("rows").alias(rows))
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    same = (keyed[key] == taken[tie]) & keyed["doc_id"].eqNullSafe(taken[i]) & keyed["source"].eqNullSafe(taken[place])
    joined = keyed.join(taken.where(F.col(copies) > 0), same)
    single = joined.where(F.col(rows) == 1).select(*docs.columns, copies)
    several = joined.where(F.col(rows) > 1).groupBy(key, i, place).agg(F.min(F.struct(*docs.columns)).alias(rows), F.first(copies).alias(copies))
    several = several.select(*[F.col(f"{rows}.{c}").alias(c) for c in docs.columns], copies)
    repeated = single.unionByName(several).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their ids as digest. Null and empty texts are the end id alone, repeated rows are packed each, and an empty table gives no rows."""
    small_batches(spark)
    pieces = packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicate_removal),
    ("substring dedup", repeated_passage_removal),
    ("mixing sources to target weights", source_mixing),
    ("packing", sequence_packing),
]

#: No stage but the last but one's counts can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.mode("overwrite").parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
            if number:
                delete(spark, f"{folder}/{number - 1}")  # read by nobody any more
    return docs
