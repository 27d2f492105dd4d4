"""The registered query of each operator: production parameters over the whole table, as the contract asks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe_merges, chat_format, conversation_repair, decontaminate, exact_dedup, impact_index, licenses, mixing, ngram_join, quality_cnn, token_ids, toxicity_gru, warc
from tracelake.llm.shared import new_path, spent, table

TOKENIZER = "word_bpe_49k.json"


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra)))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokenize, write the binary format, and read it back."""
    spark = docs.sparkSession
    path = public_tokenizers.path(tokenizer)
    staged = new_path(spark, "tokens")
    token_ids.tokenize(docs, path).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(staged)
    tokens = spark.read.parquet(staged)
    tokens.written_to = staged
    folder = token_ids.write_ids(tokens, wide=token_ids.is_wide(path))
    spent(tokens)
    return token_ids.read_checksums(spark, folder)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.read_archive(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gru.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, docs = impact_index.build(table(spark, sf_dir, "documents"))
    return impact_index.search(index, docs, table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    done = bpe_merges.decode(bpe_merges.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(table(spark, sf_dir, "conversations"))
