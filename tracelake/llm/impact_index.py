"""Ranked lexical search on a bit-sliced index of impacts.

The index has a row per block of documents: their ids in ascending order, the block's terms, and for each term the documents that
hold it with the impact of the term in them, ``(1000000000 * tf) div (1000 * tf + 8 * m)``, as bit slices: slice b has bit b of
every impact. A term's slices are stored over its own documents only, and become bitmaps over the block when it is searched.

A search multiplies impacts by the terms' weights and adds them up for many queries at once by carry arithmetic on 64 documents a word
(shift and add for the product, ripple carries for the sum), so that the scores are bit slices too. The best k are
found from the most significant slice down: those above the k-th score for certain, those still level with it; of the last level ones
the smallest ids. Every task keeps its best k of a query over all its blocks, and a window over these gives the ranks.

Blocks are made where the documents are read, and searched where they are stored: neither texts nor the index are shuffled. Queries are
broadcast in groups of at most QUERY_BYTES of terms; the index is searched once for each group.

Defined results: null and empty texts, and texts without terms, score 0 and are never found; each row is a document of its own,
also where ids are null or repeated (null ids come last among equal scores); a query without terms finds nothing, and queries with
one id are each ranked on their own; very long texts are read whole, in a block of their own if need be; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import small_batches, spent, written
from tracelake.llm.textbytes import LOWER, MARKS, column_bytes, parts_of, pieces, words
from tracelake.llm.token_ids import ranges

BLOCK_DOCS, BLOCK_TEXT, PIECE = 8192, 16 << 20, 2 << 20
QUERY_BYTES = 1 << 20
GROUP_TERMS, GROUP_QUERIES = 1024, 256
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, FREE, SPREAD = 1_000_000_000, 1000, 8
INDEX = "ids array<long>, terms array<string>, docs array<int>, places binary, bits int, slices binary"
#: Sorts behind every id.
NO_ID = np.iinfo(np.int64).max


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of a batch (id, text): document, number of its term, and count of each distinct pair; the terms; the terms of each document with repeats."""
    data, offsets = column_bytes(batch.column("text"))
    if len(offsets) == 2 and len(data) > 2 * PIECE:  # one long text, in parts
        parts = [_terms(pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["text"])) for x in parts_of(data, PIECE)]
        names = pa.chunked_array([x[3] for x in parts]).dictionary_encode().combine_chunks()
        at = np.concatenate([x[1] + a for x, a in zip(parts, np.cumsum([0, *(len(x[3]) for x in parts)]), strict=False)])
        count = np.bincount(names.indices.to_numpy()[at], np.concatenate([x[2] for x in parts]), len(names.dictionary)).astype(np.int64)
        return np.zeros(len(count), np.int64), np.arange(len(count)), count, names.dictionary, sum(x[4] for x in parts)
    starts, ends, heads = words(data, offsets, MARKS)
    sizes = np.diff(heads)
    bounds = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    column = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(LOWER[data[~MARKS[data]]])).dictionary_encode()
    n = max(len(column.dictionary), 1)
    pair, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + column.indices.to_numpy().astype(np.int64), return_counts=True)
    return pair // n, pair % n, count, column.dictionary, sizes


def impacts(tf: np.ndarray, size: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Impact of a term that occurs ``tf`` times in a document of ``size`` terms; all integers."""
    m = 25 + 75 * size * docs // total
    return UNIT * tf // (FREE * tf + SPREAD * m)


def sliced(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit slices (bits, bytes) of numbers, eight to a byte."""
    return np.stack([np.packbits((values >> b & 1).astype(np.uint8), bitorder="little") for b in range(bits)]) if bits else np.zeros((0, 0), np.uint8)


def _index(docs: int, total: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = size = 0

        def block() -> pa.RecordBatch:
            """The held documents as a block, in ascending order of id."""
            ids = np.concatenate([x[0] for x in held])
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            names = pa.chunked_array([x[4] for x in held]).dictionary_encode().combine_chunks()
            code_at = np.cumsum([0, *(len(x[4]) for x in held)])
            row_at = np.cumsum([0, *(len(x[0]) for x in held)])
            codes = names.indices.to_numpy().astype(np.int64)
            doc = np.concatenate([x[1] + a for x, a in zip(held, row_at, strict=False)])
            term = np.concatenate([codes[x[2] + a] for x, a in zip(held, code_at, strict=False)])
            tf, sizes = np.concatenate([x[3] for x in held]), np.concatenate([x[5] for x in held])
            impact = impacts(tf, sizes[doc], docs, total)
            by = np.lexsort((place[doc], term))
            counts = np.bincount(term, minlength=len(names.dictionary))
            bits = int(impact.max(initial=0)).bit_length()
            held.clear()
            own = [pa.array(ids[order], mask=ids[order] == NO_ID), names.dictionary, pa.array(counts.astype(np.int32))]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in own]
            columns += [pa.array([place[doc][by].astype(np.uint16).tobytes()], pa.binary()), pa.array([bits], pa.int32()), pa.array([sliced(impact[by], bits).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in INDEX.split(", ")])

        for batch in pieces(batches, "text", PIECE):
            batch_ids = batch.column("id").fill_null(NO_ID).to_numpy()
            bytes_of = batch.column("text").nbytes
            if held and (rows + len(batch_ids) > block_docs or size + bytes_of > BLOCK_TEXT):
                yield block()
                rows = size = 0
            doc, term, count, names, sizes = _terms(batch)
            held.append((batch_ids, doc, term, count, names, sizes))
            rows, size = rows + len(batch_ids), size + bytes_of
        if held:
            yield block()

    return run


def _texts(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, int]:
    """The index of all rows, written, and the number of documents with a term. Blocks have at most ``block_docs`` (65,536) rows."""
    rows = _texts(docs, id_col, text_col)
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    have, total = rows.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    made = small_batches(rows).mapInArrow(_index(have, max(total, 1), block_docs), INDEX)
    return written(made, "index"), have


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def add(total: np.ndarray, more: np.ndarray, shift: int = 0) -> None:
    """Add numbers to numbers, both as bit slices (slice, ...), the second ones shifted; carries ripple up."""
    carry = np.zeros_like(more[0])
    for b in range(min(len(more), len(total) - shift)):  # slices beyond are empty: the total holds all sums
        own, other = total[b + shift], more[b]
        half = own ^ other
        own_and = own & other
        np.bitwise_xor(half, carry, out=total[b + shift])
        carry = own_and | (half & carry)
    for b in range(len(more) + shift, len(total)):
        if not carry.any():
            break
        own = total[b]
        carry, total[b] = own & carry, own ^ carry


def weighted(impact: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slices of impact times weight, number by number, by shift and add."""
    factors = sliced(weights, int(weights.max(initial=0)).bit_length())
    out = np.zeros((len(impact) + len(factors), impact.shape[1]), np.uint8)
    for b, factor in enumerate(factors):
        add(out, impact & factor, b)
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """(queries, words) bitmaps of the documents of the k highest scores above 0, with all that are level with the last, from slices (slice, queries, words)."""
    level = np.bitwise_or.reduce(scores, 0)
    above = np.zeros_like(level)
    for one in scores[::-1]:
        both = above | (level & one)
        count = np.bitwise_count(both).sum(1, dtype=np.int64)
        few = (count < k)[:, None]
        above = np.where(few, both, above)
        level = np.where(few, level & ~one, level & one)
    return above | level


def _search(queries: pa.Table, k: int):
    """queries: (number, term, repeats, weight), in ascending order of number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, repeats, weights = (queries[c].to_numpy() for c in ("number", "repeats", "weight"))
        found = {"number": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)}
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values.fill_null(NO_ID).to_numpy()
                terms = batch.column("terms")[row].values
                counts = batch.column("docs")[row].values.to_numpy().astype(np.int64)
                places = np.frombuffer(batch.column("places")[row].as_buffer(), np.uint16)
                slices = np.frombuffer(batch.column("slices")[row].as_buffer(), np.uint8).reshape(batch.column("bits")[row].as_py(), -1)
                asked = pc.index_in(queries["term"].combine_chunks(), value_set=terms).fill_null(-1).to_numpy().astype(np.int64)
                use = np.flatnonzero((asked >= 0) & (weights > 0))
                for own in _groups(number[use]):
                    at = use[own]
                    found = _merged(found, _block(number[at], asked[at], repeats[at], weights[at], ids, counts, places, slices, k), k)
        if len(found["number"]):
            yield pa.RecordBatch.from_arrays([pa.array(found["number"]), pa.array(found["id"], mask=found["id"] == NO_ID), pa.array(found["score"])], ["number", "doc_id", "score"])

    return run


def _groups(number: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the entries of GROUP_QUERIES queries at a time."""
    names, first = np.unique(number, return_index=True)
    first = np.append(first, len(number))
    for low in range(0, len(names), GROUP_QUERIES):
        yield np.arange(first[low], first[min(low + GROUP_QUERIES, len(names))])


def _block(number: np.ndarray, term: np.ndarray, repeats: np.ndarray, weights: np.ndarray, ids: np.ndarray, counts: np.ndarray, places: np.ndarray, slices: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The best documents of one block for some queries: entries of (query, term of the block, repeats, weight)."""
    names, query = np.unique(number, return_inverse=True)
    wide = -(-len(ids) // 64)
    top = np.bincount(query, repeats.astype(np.float64) * weights * 2.0 ** len(slices))
    scores = np.zeros((max(int(top.max(initial=1) * 1.001) + 1, 1).bit_length(), len(names), wide), np.uint64)
    starts = np.cumsum(counts) - counts
    own, first = np.unique(term, return_index=True)
    for low in range(0, len(own), GROUP_TERMS):
        some = own[low : low + GROUP_TERMS]
        size = counts[some]
        posting = ranges(starts[some], size)
        bits = np.stack([np.packbits(np.unpackbits(x, count=int(counts.sum()), bitorder="little")[posting], bitorder="little") for x in slices])
        product = weighted(bits, np.repeat(weights[first[low : low + GROUP_TERMS]], size))
        place = np.repeat(np.arange(len(some)), size) * wide * 64 + places[posting]
        maps = np.empty((len(product), len(some), wide), np.uint64)
        for b, x in enumerate(product):  # from a bit for each document of a term to a bit for each document of the block
            flat = np.zeros(len(some) * wide * 64, np.uint8)
            flat[place] = np.unpackbits(x, count=len(place), bitorder="little")
            maps[b] = np.packbits(flat, bitorder="little").view(np.uint64).reshape(len(some), wide)
        here = np.flatnonzero((term >= some[0]) & (term <= some[-1]))
        _add_all(scores, maps, query[here], np.searchsorted(some, term[here]), repeats[here])
    hits = best(scores, k)
    q, doc = np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little"))
    word, bit = doc // 64, (doc % 64).astype(np.uint64)
    value = np.zeros(len(q), np.int64)
    for b, x in enumerate(scores):
        value |= ((x[q, word] >> bit & np.uint64(1)) << np.uint64(b)).astype(np.int64)
    return {"number": names[q], "id": ids[doc], "score": value}


def _add_all(scores: np.ndarray, maps: np.ndarray, query: np.ndarray, term: np.ndarray, repeats: np.ndarray) -> None:
    """Add the terms' bitmaps to the scores of their queries, one term of every query at a time; repeats by shifted additions."""
    for shift in range(int(repeats.max(initial=0)).bit_length()):
        on = np.flatnonzero(repeats >> shift & 1)
        if not len(on):
            continue
        on = on[np.argsort(query[on], kind="stable")]
        names, first, size = np.unique(query[on], return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        names, first, size = names[order], first[order], size[order]
        part = scores[:, names]
        for step in range(int(size[0])):
            active = int(np.searchsorted(-size, -step, "left"))
            add(part[:, :active], maps[:, term[on[first[:active] + step]]], shift)
        scores[:, names] = part


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray], k: int) -> dict[str, np.ndarray]:
    """The best k of each query."""
    both = {c: np.concatenate([a[c], b[c]]) for c in a}
    order = np.lexsort((both["id"], -both["score"], both["number"]))
    number = both["number"][order]
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
    place = np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number))))
    return {c: x[order][place < k] for c, x in both.items()}


def search(index: DataFrame, docs: int, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best k documents for each row of ``queries``, from the index and the number of documents of ``build``."""
    asked = written(queries.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("number")), "asked")
    found = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(TERM), F.lit(0))
    entries = asked.select("number", F.explode(found).alias("term")).groupBy("number", "term").agg(F.count(F.lit(1)).alias("repeats"))
    held = index.select(F.explode(F.arrays_zip("terms", "docs")).alias("x")).select("x.terms", F.col("x.docs").cast("long").alias("docs"))
    counts = held.join(entries.select("term").distinct(), F.col("terms") == F.col("term"), "left_semi").groupBy("terms").agg(F.sum("docs").alias("df"))
    known = written(entries.join(counts, F.col("terms") == F.col("term")).drop("terms"), "entries")
    size = known.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    groups = size // query_bytes + 1  # by hash, so of about this size, or of one query's
    parts = []
    for group in range(groups):
        own = known.filter(F.pmod(F.xxhash64("number"), F.lit(groups)) == group).toArrow().sort_by([("number", "ascending"), ("term", "ascending")])
        own = own.append_column("weight", pa.array([weight(docs, x) for x in own["df"].to_pylist()], pa.int64()))
        part = small_batches(index).mapInArrow(_search(own, k), "number long, doc_id long, score long")
        parts.append(written(part, "found") if groups > 1 else part)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = written(ranked.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score"), "ranked")
    spent(asked, known, *(parts if groups > 1 else ()))
    return out
