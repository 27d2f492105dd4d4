"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its bytes, modulo two primes. Texts are cut in chunks; chunk hashes
are computed side by side and combined as H(ab) = H(a) * B**len(b) + H(b), so that a huge text needs no
serial pass. Texts with equal fingerprints and lengths are then compared with their group's first text, chunk
by chunk, so that the result does not rest on the fingerprint; those that differ (fingerprints collided) are told apart by
their SHA-256. A large group is dealt out over tasks, the first text copied to each.

Defined results: null text counts as empty; of equal texts the row with the largest id stays (null ids rank
lowest); of repeated rows with one id and one text exactly one is kept; very long texts are hashed in chunks, and two of them have
to fit a task; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.keybits import bits_of, has_bit
from tracelake.llm.shared import small_batches, spent, written
from tracelake.llm.textbytes import column_bytes, pieces

MODULI = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 1 << 14


@lru_cache(16)
def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out, x = np.ones(n, np.int64), 1
    for k in range(1, n):
        out[k] = x = x * base % modulus
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK, moduli: tuple[int, int] = MODULI) -> np.ndarray:
    """One 62-bit fingerprint for each row of the concatenated bytes."""
    sizes = np.diff(offsets)
    n_chunks = np.maximum(-(-sizes // chunk), 1)
    first = np.cumsum(n_chunks) - n_chunks
    row = np.repeat(np.arange(len(sizes)), n_chunks)
    place = np.arange(len(row)) - first[row]
    begin = offsets[:-1][row] + place * chunk
    end = np.minimum(begin + chunk, offsets[1:][row])
    length = end - begin
    out = np.zeros(len(sizes), np.int64)
    for modulus, base in zip(moduli, BASES, strict=True):
        power = _powers(base, modulus, chunk + 1)
        # the last byte of a chunk has power 0: place a byte by its distance from the end
        away = np.repeat(end, length) - 1 - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
        terms = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data.astype(np.int64) + 1) * power[away], out=terms[1:])
        hashes = (terms[end] - terms[begin]) % modulus
        total = np.zeros(len(sizes), np.int64)
        for k in range(int(n_chunks.max(initial=1))):
            live = np.flatnonzero(n_chunks > k)
            at = first[live] + k
            total[live] = (total[live] * power[length[at]] + hashes[at]) % modulus
        out = (out << 31) | total
    return out


def _key_of(text: str, moduli: tuple[int, int]):
    """Rows of (id, text) with their fingerprint and length; ``wanted`` keeps only rows whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None, keep_text: bool = False):
        for batch in pieces(batches, text):
            data, offsets = column_bytes(batch.column(text))
            key, size = fingerprints(data, offsets, moduli=moduli), np.diff(offsets)
            rows = [batch.column(0), batch.column(text), pa.array(key), pa.array(size)]
            if wanted is not None:
                hit = pa.array(has_bit(wanted, key, size))
                rows = [x.filter(hit) for x in rows]
            if not keep_text:
                del rows[1]
            yield pa.RecordBatch.from_arrays(rows, ["id", *["text"] * keep_text, "key", "size"])

    return run


def _same_as_first(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Over rows sorted so that each group's first text leads: whether a row's text equals it."""
    group, first = None, b""
    for batch in pieces(batches, "text"):
        data, offsets = column_bytes(batch.column("text"))
        raw, same = memoryview(np.ascontiguousarray(data)), np.ones(batch.num_rows, bool)
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "size", "salt")), strict=True))
        for k, own in enumerate(keys):
            text = raw[offsets[k] : offsets[k + 1]]
            if own != group:
                group, first = own, bytes(text)
                continue
            same[k] = len(first) == len(text) and all(first[i : i + chunk] == text[i : i + chunk] for i in range(0, len(first), chunk))
        kept = [batch.column(c) for c in ("id", "key", "size", "sha", "copy")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(same)], ["id", "key", "size", "sha", "copy", "same"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, int] = MODULI, salt_rows: int = 512) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (of the UTF-8 text as it is)."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    run = _key_of("text", moduli)
    keyed = rows.mapInArrow(lambda b: run(b, None, True), f"id {id_type}, text string, key long, size long")
    narrow = written(keyed.select("id", "key", "size", F.sha2("text", 256).alias("sha")), "fingerprints")
    groups = narrow.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    shared = written(groups.filter("n > 1"), "fingerprint-groups")

    # Only texts whose fingerprint recurs are read on and moved.
    wanted = docs.sparkSession.sparkContext.broadcast(bits_of(shared, "key", "size"))

    texts = rows.mapInArrow(lambda b: run(b, wanted.value, True), f"id {id_type}, text string, key long, size long").withColumn("row", F.monotonically_increasing_id())  # tells rows of one id apart
    members = texts.join(shared, ["key", "size"])
    salts = F.ceil(F.col("n") / salt_rows).cast("int")
    leads = (
        members.filter(F.col("id").eqNullSafe(F.col("top")))
        .groupBy("key", "size")
        .agg(F.min("text").alias("text"), F.max("id").alias("id"), F.max("n").alias("n"))  # the least text: the same in every attempt
        .select("id", "text", "key", "size", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("copy"))
    )
    own = members.select("id", "text", "key", "size", F.pmod(F.xxhash64("id", "row"), salts).cast("int").alias("salt"), F.lit(False).alias("copy"))
    compared = (
        own.unionByName(leads)
        .withColumn("sha", F.sha2("text", 256))
        .repartition("key", "size", "salt")
        .sortWithinPartitions("key", "size", "salt", F.desc("copy"))
        .mapInArrow(_same_as_first, f"id {id_type}, key long, size long, sha string, copy boolean, same boolean")
        .filter("not copy")
        .withColumn("form", F.when(F.col("same"), F.lit("")).otherwise(F.col("sha")))
        .drop("copy", "same")
        .withColumn("nth", F.monotonically_increasing_id())
    )
    compared = written(compared, "compared")
    # settled first, so that Spark can split a large class's rows in the joins
    classes = written(compared.groupBy("key", "size", "form").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")), "classes")
    tops = compared.join(classes, ["key", "size", "form"]).withColumn("is_top", F.col("id").eqNullSafe(F.col("top")))
    # of the rows of the id that stays one does, the first by its number; the others are not numbered
    one = written(tops.filter("is_top").groupBy("key", "size", "form").agg(F.min("nth").alias("one")), "kept")
    copies = tops.join(one, ["key", "size", "form"])
    out = copies.select("id", F.col("top").alias("keep_id"), F.col("n").alias("group_size"), (F.col("is_top") & (F.col("nth") == F.col("one"))).alias("kept"), "sha")
    alone = narrow.join(shared.select("key", "size"), ["key", "size"], "left_anti")
    out = out.unionByName(alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"))
    out = written(out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")), "duplicates")
    spent(narrow, shared, compared, classes, one)
    return out
