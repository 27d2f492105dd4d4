"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Defined results, in every stage: each row is a document of its own, also where ids are null or repeated; null texts count
as empty, and stay unless the classifier rejects them; equal rows are near duplicates of each other, of which one stays
(texts without words are linked with nothing, so that each of them stays); very long texts are read whole; an empty table
gives an empty table; further columns pass through, whatever their names, up to the last stage, which has its own.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, mixing, ngram_join, quality_cnn, token_ids
from tracelake.llm.shared import BLOCK_BYTES, new_path, table, written

TOKENIZER = "word_bpe_49k.json"
#: The mix takes a document at most so often, as ``mixing.mix`` has it.
MOST_COPIES = 3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network does not reject."""
    return quality_cnn.keep(docs, table(spark, sf_dir, "labels"))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, row_key): the rows as structs, each with a key of its own: the number of its file, and its place there.

    Rows that do not come straight from Parquet files are written once, so that all uses see the same keys.
    """
    try:
        placed = docs.select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # no such hidden column
        return written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("row_key")), "keyed")
    files = placed.select("file").distinct().withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long"))  # a row per file: the driver lists them all
    return placed.join(F.broadcast(written(files, "files")), "file").select("row", (F.shiftleft("number", 38) + F.col("place")).alias("row_key"))


def times(rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``keyed`` as often as ``counts`` (row_key, copies, up to ``most``) says, in the columns of the documents.

    Counts travel as bitmaps over the keys, a bit for each row and copy, so that texts stay where they are as long as these are small.
    """
    bucket, bit = (f(F.col("row_key") + 1) for f in (F.bitmap_bucket_number, F.bitmap_bit_position))
    levels = counts.filter("copies > 0").withColumn("level", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    maps = levels.groupBy(bucket.alias("bucket")).agg(*[F.bitmap_construct_agg(F.when(F.col("level") == k, bit)).alias(f"level_{k}") for k in range(1, most + 1)])
    found = rows.withColumns({"bucket": bucket, "bit": bit}).join(written(maps, "copies"), "bucket")
    byte = lambda c: F.conv(F.hex(F.substring(c, (F.shiftright("bit", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    copies = reduce(lambda a, b: a + b, [F.getbit(byte(F.col(f"level_{k}")), F.pmod("bit", F.lit(8)).cast("int")).cast("int") for k in range(1, most + 1)])
    taken = found.withColumn("copies", copies).filter("copies > 0")
    if most > 1:
        taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, null last; rows with equal ids are not one document."""
    rows = keyed(docs)
    classes = ngram_join.ngram_components(rows.select("row_key", F.col("row.text").alias("text")), id_col="row_key").select("row_key", F.col("component_id").alias("component"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    first = rows.select("row_key", F.col("row.doc_id").alias("doc_id")).join(classes, "row_key").groupBy("component").agg(F.min(order).alias("first"))
    return times(rows, first.select("first.row_key", F.lit(1).alias("copies")), 1)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = keyed(docs)
    mixed = mixing.mix(rows.select("row_key", F.col("row.text").alias("text"), F.col("row.source").alias("source")), id_col="row_key", most=MOST_COPIES)
    return times(rows, mixed.select("row_key", "copies"), MOST_COPIES)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in the binary format, read back: (doc_id, start, n_tokens, ids_crc32)."""
    staged = new_path(spark, "tokens")
    path = public_tokenizers.path(TOKENIZER)
    token_ids.tokenize(docs, path).write.option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).parquet(staged)
    return token_ids.read_checksums(spark, token_ids.write_ids(spark.read.parquet(staged), wide=token_ids.is_wide(path)))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", tokens),
]

#: The first stage is a trained network and the last a tokenizer: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
