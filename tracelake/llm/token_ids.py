"""Token ids, and a binary file format for them.

Words recur, so each distinct piece of text is given to the tokenizer once and then looked up by its bytes, in a
table of bounded size. Pieces are cut only where the tokenizer's own pre-tokenizer always cuts: at ASCII white
space, and between an ASCII or Latin letter and another ASCII character that is no apostrophe. Words with any
other character, and words that might hold a special token, are looked up whole and as they are.

The format is a folder with three Parquet tables, so that Spark's own commit protocol guards it:
``codebook`` (id, bits), a canonical Huffman code of limited length from the counts of all ids;
``blocks`` (shard, block, first_token, doc_ids, doc_tokens, checkpoints, payload), documents in ascending order
of id in independent blocks whose ``checkpoints`` are the bit offsets of every 1024th token, from where all parts
of a block are decoded side by side by table; ``shards`` (shard, first_token), the ids before each shard.

Defined results: null text counts as empty (one end id); null ids come first; repeated ids stay, ordered by
their tokens; texts of over PART bytes are tokenized in parts cut at white space, and a long document is packed and
unpacked SLICE ids at a time; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import new_path, small_batches
from tracelake.llm.textbytes import LOWER, SPACE, column_bytes, parts_of, pieces, span_hashes, words

STEP = 1024
SLICE = 1 << 19
BLOCK_TOKENS = 1 << 15
PART = 1 << 20
MOST_PIECES, LONGEST_PIECE = 500_000, 256
# The normaliser and the pre-tokenizer that the cuts agree with.
CUT_FOR = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 3
BLOCKS = "shard int, block int, first_token long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, payload binary"


class PieceTable:
    """Ids of pieces already seen, in arrays of bounded size: sorted by the hash of a piece, checked by its bytes.

    Beyond ``most`` pieces those that were asked for only once since the last sweep go, and of the rest what is over half of ``most``.
    """

    def __init__(self, kind: str, most: int = MOST_PIECES):
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.key, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.text_at, self.text_size, self.ids_at, self.ids_size = (np.zeros(0, np.int32) for _ in range(4))
        self.texts, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.kind)

    def find(self, key: np.ndarray, data: np.ndarray, at: np.ndarray, asked: bool = True) -> np.ndarray:
        """The place of each piece ``data[at[k]:at[k + 1]]`` in the table, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        size = np.diff(at)
        same = (self.key[place] == key) & (self.text_size[place] == size)
        hit = np.flatnonzero(same)
        if len(hit):
            bytes_of = ranges(at[:-1][hit], size[hit])
            differs = data[bytes_of] != self.texts[ranges(self.text_at[place[hit]], size[hit])]
            if differs.any():
                same[hit[np.repeat(np.arange(len(hit)), size[hit])[differs]]] = False
        if asked:
            self.used[place[same]] = True
        return np.where(same, place, -1)

    def add(self, key: np.ndarray, texts: list[bytes], ids: list[list[int]]) -> None:
        """Add pieces of distinct new keys; a piece whose key another one has stays out."""
        if not texts:
            return
        order = np.argsort(key, kind="stable")
        order = order[np.concatenate([[True], key[order[1:]] != key[order[:-1]]])]
        to = np.searchsorted(self.key, key[order])
        free = (self.key[np.minimum(to, len(self.key) - 1)] != key[order]) if len(self.key) else np.ones(len(order), bool)
        order, to = order[free], to[free]
        picked = order.tolist()
        text_size, ids_size = (np.array([len(x[k]) for k in picked], np.int32) for x in (texts, ids))
        new = {"key": key[order], "used": np.zeros(len(order), bool), "text_size": text_size, "ids_size": ids_size, "text_at": len(self.texts) + np.cumsum(text_size) - text_size, "ids_at": len(self.ids) + np.cumsum(ids_size) - ids_size}
        for name, values in new.items():
            old = getattr(self, name)
            setattr(self, name, np.insert(old, to, values.astype(old.dtype)))
        self.texts = np.concatenate([self.texts, np.frombuffer(b"".join(texts[k] for k in picked), np.uint8)])
        self.ids = np.concatenate([self.ids, np.array([i for k in picked for i in ids[k]], self.kind)])

    def sweep(self) -> None:
        if len(self.key) <= self.most and len(self.texts) + self.ids.nbytes <= 32 * self.most:
            return
        kept = np.flatnonzero(self.used)[: self.most // 2]  # in the order of hashes
        self.texts, self.ids = self.texts[ranges(self.text_at[kept], self.text_size[kept])], self.ids[ranges(self.ids_at[kept], self.ids_size[kept])]
        self.key, self.text_size, self.ids_size, self.used = self.key[kept], self.text_size[kept], self.ids_size[kept], np.zeros(len(kept), bool)
        self.text_at, self.ids_at = ((np.cumsum(x) - x).astype(np.int32) for x in (self.text_size, self.ids_size))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of the spans, one span behind the other."""
    stop = np.cumsum(sizes, dtype=np.int64)
    return np.repeat(starts - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)


class PieceEncoder:
    """The tokenizer behind a table of pieces. Tokenizers whose normaliser or pre-tokenizer are not those that the cuts were made
    for get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        self.by_piece = [parts["normalizer"], parts["pre_tokenizer"]] == CUT_FOR
        self.kind = id_kind(self.tokenizer.get_vocab_size())
        self.table = PieceTable(self.kind)

    def ids_of(self, texts: list[bytes], single: list[bool]) -> list[list[int]]:
        """The tokenizer's ids of some pieces."""
        found: list[list[int] | None] = [None] * len(texts)
        joined = [k for k, x in enumerate(single) if x]
        for low in range(0, len(joined), 256):  # pieces of letters only: many in one call, told apart by their word number
            group = joined[low : low + 256]
            done = self.tokenizer.encode(b" ".join(texts[k] for k in group).decode(), add_special_tokens=False)
            number, ids = done.word_ids, done.ids
            if ids and number[-1] == len(group) - 1:
                bounds = np.searchsorted(np.array(number), np.arange(len(group) + 1)).tolist()
                for k, a, b in zip(group, bounds[:-1], bounds[1:], strict=True):
                    found[k] = ids[a:b]
        alone = [k for k, x in enumerate(found) if x is None]
        for k, x in zip(alone, self.tokenizer.encode_batch([texts[k].decode() for k in alone], add_special_tokens=False), strict=True):
            found[k] = x.ids
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the number of ids of each."""
        if not self.by_piece:
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(x) for x in found], np.int64)
        data, starts, ends, heads, single = cut(data, offsets)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        # pieces are all that is no white space, so they lie one behind the other once that is taken out
        bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[~SPACE[data]])]).dictionary_encode()
        codes, (names, at) = column.indices.to_numpy(), column_bytes(column.dictionary)
        self.table.sweep()
        key = span_hashes(names, at[:-1], at[1:])
        missing = np.flatnonzero(self.table.find(key, names, at) < 0)
        extra: list[list[int]] = []
        if len(missing):
            first = np.empty(len(key), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            texts = column.dictionary.take(pa.array(missing)).to_pylist()
            extra = self.ids_of(texts, single[first[missing]].tolist())
            short = [k for k, x in enumerate(texts) if len(x) <= LONGEST_PIECE]
            self.table.add(key[missing[short]], [texts[k] for k in short], [extra[k] for k in short])
        place = self.table.find(key, names, at, asked=False)
        found = place >= 0
        own_start, own_length = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        own_start[found], own_length[found] = self.table.ids_at[place[found]], self.table.ids_size[place[found]]
        pool = self.table.ids
        if not found.all():  # pieces too long for the table, or of another's hash
            spare = [extra[k] for k in np.searchsorted(missing, np.flatnonzero(~found)).tolist()]
            size = np.array([len(x) for x in spare], np.int64)
            own_length[~found], own_start[~found] = size, len(pool) + np.cumsum(size) - size
            pool = np.concatenate([pool, np.array([i for x in spare for i in x], self.kind)])
        length = own_length[codes]
        out = pool[ranges(own_start[codes], length)]
        return out, np.diff(np.concatenate([[0], np.cumsum(length)])[heads])


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces: (bytes, starts, ends, index of each row's first piece, whether a piece has only letters)."""
    kind = _KIND[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC9)) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    lead = lead[(data[lead] != 0xC4) | (data[lead + 1] != 0xB0)]  # the dotted capital I, whose dot is no letter once lowered
    kind[lead] = kind[lead + 1] = 1
    starts, ends, heads = words(data, offsets)
    odd = kind == 3
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
    marks = np.concatenate([[0], np.cumsum(odd)])
    whole = marks[ends] > marks[starts]
    inner = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0) & ~((data[:-1] == 39) & (kind[1:] == 1))) + 1
    word = np.searchsorted(starts, inner, "right") - 1
    inner = inner[~whole[word] & (inner > starts[word])] if len(starts) else inner
    lowered = LOWER[data]
    if whole.any():
        kept = np.zeros(len(data) + 1, np.int8)
        kept[starts[whole]] += 1
        kept[ends[whole]] -= 1
        kept = np.cumsum(kept[:-1]).astype(bool)
        lowered[kept] = data[kept]
    all_starts, all_ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    letters = kind[all_starts] == 1
    if whole.any():
        letters &= ~np.isin(all_starts, starts[whole])
    return lowered, all_starts, all_ends, np.searchsorted(all_starts, offsets), letters


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in pieces(batches, "text", PART):
            data, offsets = column_bytes(batch.column("text"))
            if len(offsets) == 2 and len(data) > 2 * PART and own.by_piece:
                ids = np.concatenate([own.encode(x, np.array([0, len(x)]))[0] for x in parts_of(data, PART)])
                counts = np.array([len(ids)])
            else:
                ids, counts = own.encode(data, offsets)
            ends = np.cumsum(counts)
            full = np.insert(ids, ends, end_id)
            bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * full.itemsize
            column = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(full)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(counts + 1)], ["id", "ids", "n"])

    return run


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """(id, ids, n): the ids of each whole text with ``end_id`` behind, as little-endian 16-bit (or 32-bit) integers."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(path, end_id), "id long, ids binary, n long")


def id_kind(ids: int) -> str:
    """The integers that hold this many ids."""
    return "<u2" if ids <= 1 << 16 else "<u4"


def is_wide(path: str) -> bool:
    """Whether a tokenizer's ids need 32 bits."""
    from tokenizers import Tokenizer

    return id_kind(Tokenizer.from_file(path).get_vocab_size()) == "<u4"


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Bits of each symbol (of positive counts) in the best prefix code with at most ``most`` bits: package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError(f"{n} symbols do not fit codes of {most} bits")
    order = np.argsort(counts, kind="stable")
    leaves, packages, is_leaf = counts[order].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(most):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        is_leaf.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codebook:
    """Canonical code: ids ordered by (bits, id) get consecutive codes."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort([ids, bits])
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.most = int(self.bits.max(initial=1))
        room = np.left_shift(1, self.most - self.bits)
        first = np.cumsum(room) - room
        size = int(self.ids.max(initial=0)) + 1
        self.code, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.code[self.ids], self.length[self.ids] = first >> (self.most - self.bits), self.bits
        self.symbol_at = np.zeros(1 << self.most, np.int32)
        self.bits_at = np.ones(1 << self.most, np.uint8)
        self.symbol_at[: room.sum()], self.bits_at[: room.sum()] = np.repeat(self.ids, room), np.repeat(self.bits, room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of the ids, and the bit offset of every STEP-th of them; a slice of the ids at a time."""
        slices = [ids[k : k + SLICE] for k in range(0, len(ids), SLICE)]
        total = sum(int(self.length[x].sum()) for x in slices)
        out, starts, done = np.zeros((total >> 3) + 5, np.uint8), [np.zeros(0, np.int64)], 0
        for own in slices:
            length = self.length[own]
            end = np.cumsum(length) + done
            start = end - length
            value = self.code[own] << (32 - length - (start & 7))
            base, size = done >> 3, (int(end[-1]) >> 3) - (done >> 3) + 4
            for k in range((self.most + 7) // 8 + 1):  # the bits of different ids never meet, so sums are unions
                out[base : base + size] += np.bincount((start >> 3) - base + k, (value >> (24 - 8 * k)) & 255, size)[:size].astype(np.uint8)
            starts.append(start[::STEP])
            done = int(end[-1])
        return out[: (total + 7) >> 3].tobytes(), np.concatenate(starts)

    def decode(self, payload: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids from every bit offset in ``starts`` (ascending), so many of each, SLICE // STEP of them side by side."""
        out = np.empty(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        side = SLICE // STEP
        for low in range(0, len(starts), side):
            high = min(low + side, len(starts))
            first = int(starts[low]) >> 3
            last = (int(starts[high]) >> 3) + 1 if high < len(starts) else len(payload)
            a, b = int(ends[low] - counts[low]), int(ends[high - 1])
            self._decode(payload[first:last], starts[low:high] - first * 8, counts[low:high], out[a:b])
        return out

    def _decode(self, payload: np.ndarray, starts: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        data = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        to, at = np.cumsum(counts) - counts, starts.astype(np.int64)
        by = np.argsort(-counts, kind="stable")
        at, to, counts = at[by], to[by], counts[by]
        mask = np.uint32((1 << self.most) - 1)
        for k in range(int(counts.max(initial=0))):
            live = int(np.searchsorted(-counts, -k, "left"))
            at, to = at[:live], to[:live]
            code = (window[at >> 3] >> (32 - self.most - (at & 7)).astype(np.uint32)) & mask
            out[to + k] = self.symbol_at[code]
            at = at + self.bits_at[code]


def _count(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, _ = column_bytes(batch.column("ids"))
            found = np.bincount(data.view(kind))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    return run


def _pack(book, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        for batch in pieces(batches, "ids", BLOCK_TOKENS * np.dtype(kind).itemsize):
            data, offsets = column_bytes(batch.column("ids"))
            ids = data.view(kind)
            payload, checkpoints = book.value.encode(ids)
            n = np.diff(offsets) // np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([n]), pa.array([checkpoints]), pa.array([payload], pa.binary())],
                ["shard", "block", "first_token", "doc_ids", "doc_tokens", "checkpoints", "payload"],
            )
            block, first = block + 1, first + len(ids)

    return run


def write_ids(tokens: DataFrame, path: str | None = None, wide: bool = False, most_bits: int = 16, shard_tokens: int = 16 << 20) -> str:
    """Write (id, ids, n) rows in the format above, in ascending order of id; returns the folder."""
    spark, kind = small_batches(tokens).sparkSession, "<u4" if wide else "<u2"
    path = path or new_path(spark, "token-ids")
    # one row per id of the vocabulary: bounded by the tokenizer, whatever the corpus
    counts = tokens.select("ids").mapInArrow(_count(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    bits = code_lengths(n, max(most_bits, int(len(n)).bit_length()))
    spark.createDataFrame(pa.table({"id": ids, "bits": bits})).coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(Codebook(ids, bits))
    shards = max(1, -(-int(n.sum()) // shard_tokens))
    ordered = tokens.repartitionByRange(shards, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "ids")
    ordered.select("id", "ids").mapInArrow(_pack(book, kind), BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    sizes.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.mode("overwrite").parquet(f"{path}/shards")
    return path


def _unpack(book, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "payload", 2 << 20):
            payload, at = column_bytes(batch.column("payload"))
            checkpoints, docs = batch.column("checkpoints"), batch.column("doc_tokens")
            n_docs = docs.flatten().to_numpy()
            doc_bounds = np.concatenate([[0], np.cumsum(n_docs)])
            per_block, per_docs = np.diff(checkpoints.offsets.to_numpy()), np.diff(docs.offsets.to_numpy())
            block_ends = np.cumsum(per_docs)
            tokens = np.diff(doc_bounds[np.concatenate([[0], block_ends])])
            counts = np.full(int(per_block.sum()), STEP)
            last = np.cumsum(per_block) - 1
            full = per_block > 0
            counts[last[full]] = tokens[full] - (per_block[full] - 1) * STEP
            starts = checkpoints.flatten().to_numpy() + np.repeat(at[:-1] * 8, per_block)
            ids = book.value.decode(payload, starts, counts)
            base = np.repeat(batch.column("first_token").to_numpy() - doc_bounds[np.concatenate([[0], block_ends[:-1]])], per_docs) + doc_bounds[:-1]
            ids = np.ascontiguousarray(ids, "<u4")
            if check:
                raw, last = memoryview(ids).cast("B"), (doc_bounds * 4).tolist()
                column = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(last[:-1], last[1:], strict=True)], pa.int64())
            else:
                column = pa.BinaryArray.from_buffers(pa.binary(), len(n_docs), [None, pa.py_buffer((doc_bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids").flatten(), pa.array(base), pa.array(n_docs), column], ["doc_id", "start", "n_tokens", "ids_crc32" if check else "ids"])

    return run


def _read(spark: SparkSession, path: str, check: bool) -> DataFrame:
    table = spark.read.parquet(f"{path}/codebook").toArrow()
    book = spark.sparkContext.broadcast(Codebook(table["id"].to_numpy(), table["bits"].to_numpy()))
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("first_token").alias("base"))
    blocks = small_batches(spark.read.parquet(f"{path}/blocks")).join(shards, "shard").withColumn("first_token", F.col("first_token") + F.col("base"))
    blocks = blocks.select("first_token", "doc_ids", "doc_tokens", "checkpoints", "payload")
    return blocks.mapInArrow(_unpack(book, check), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if check else "ids binary"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from a written folder; ``ids`` are little-endian 32-bit integers."""
    return _read(spark, path, False)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from a written folder: the checksum of what ``read_ids`` gives as ``ids``."""
    return _read(spark, path, True)


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = column_bytes(batch.column("ids"))
        raw = memoryview(np.ascontiguousarray(data))
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the rows of ``read_ids``."""
    return ids.mapInArrow(_checks, "doc_id long, start long, n_tokens long, ids_crc32 long")
