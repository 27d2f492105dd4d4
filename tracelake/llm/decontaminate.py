"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (Unicode letters, their marks, and digits, lowered; in scripts
without spaces each character is a word). Windows of MATCH words are hashed
Karp-Rabin style; windows that a document shares with an item are the seeds, and neighbouring seeds of one diagonal
form a match, whose words are compared before it counts. The longest match that is still unmarked on both sides is marked as a tile, what marks cut
off is put back, and so on until no match of MATCH words is left. An item's coverage is the share of its
words under tiles; tiles may lie in any order, so reordered passages count in full. A document with any item at
``threshold`` or more is contaminated. An item of fewer than MATCH words has its whole sequence as its one seed.

Items are held by every task, in blocks of at most ``block_bytes`` of text: a larger benchmark takes several passes.

Defined results: null or empty texts match nothing; very long texts are read in parts and count whole; items of fewer than LEAST words match nothing; repeated rows give
equal rows; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import small_batches, written
from tracelake.llm.textbytes import code_points, column_bytes, parts_of, pieces, shingle_rows, span_hashes, unicode_words

MATCH, THRESHOLD = 5, 0.5
LEAST = 2
SIEVE_BITS = 22
FOUND = "item_id long, tiles long, covered long, item_words long, coverage double"


def token_hashes(column: pa.Array, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the rows, and each row's first word (one more entry at the end); a single long text is read in parts."""
    data, offsets = column_bytes(column)
    if len(offsets) == 2 and len(data) > most:
        made = [_token_hashes(x, np.array([0, len(x)]))[0] for x in parts_of(data, most // 2)]
        return np.concatenate(made), np.array([0, sum(map(len, made))])
    return _token_hashes(data, offsets)


def _token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points, starts, ends, heads = unicode_words(data, offsets)
    return span_hashes(points, starts, ends, code_points()[1]), heads


def runs(first: np.ndarray, second: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches (place in the item, place in the document, words) of the seeds of ``least`` words: neighbours on a diagonal are one."""
    order = np.lexsort([first, second - first])
    first, second = first[order], second[order]
    new = np.ones(len(first), bool)
    new[1:] = (second[1:] - first[1:] != second[:-1] - first[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    return first[begin], second[begin], np.diff(np.append(begin, len(first))) + least - 1


def runs_of_groups(at: np.ndarray, group: np.ndarray, places: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for repetitive texts, where ``places[group[k]]`` are the item's places that the document's place ``at[k]`` meets.

    A match begins where the diagonal's place before is no seed, and ends where the one behind is none. Which places these are depends on
    two neighbouring groups alone, so that seeds inside of matches are never listed.
    """
    known: dict[tuple[int, int, int], np.ndarray] = {}

    def bare(k: int, other: int, away: int) -> np.ndarray:
        own, near = int(group[k]), int(group[other]) if 0 <= other < len(at) and at[other] == at[k] + away else -1
        if (own, near, away) not in known:
            known[own, near, away] = places[own] if near < 0 else np.setdiff1d(places[own], places[near] - away, assume_unique=True)
        return known[own, near, away]

    sides = []
    for away in (-1, 1):
        found = [bare(k, k + away, away) for k in range(len(at))]
        place, own = np.concatenate(found), np.repeat(at, [len(x) for x in found])
        order = np.lexsort([place, own - place])
        sides.append((place[order], own[order]))
    (i, j), (last, _) = sides
    return i, j, last - i + least


def tiling(first: np.ndarray, second: np.ndarray, n_first: int, n_second: int, least: int = MATCH) -> tuple[int, int]:
    """Tiles and words covered, from the seeds (place in the item, place in the document) of ``least`` equal words."""
    return tiles(*runs(first, second, least), np.zeros(n_first, bool), np.zeros(n_second, bool), least)


def tiles(first: np.ndarray, second: np.ndarray, size: np.ndarray, own: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int]:
    """Greedy tiles of the matches: how many, and words covered. Of equally long matches that of the first place in the item, then in the
    document, goes first. ``own`` and ``text`` are the words; where they differ in a match (equal hashes of other words), it is cut.
    """
    heap = [(-n, i, j) for n, i, j in zip(size.tolist(), first.tolist(), second.tolist(), strict=True)]
    heapq.heapify(heap)
    taken_first, taken_second = np.zeros(len(own), bool), np.zeros(len(text), bool)
    count = covered = 0
    while heap and covered < len(own):
        n, i, j = heapq.heappop(heap)
        n = -n
        blocked = taken_first[i : i + n] | taken_second[j : j + n] | (own[i : i + n] != text[j : j + n])
        if not blocked.any():
            taken_first[i : i + n] = taken_second[j : j + n] = True
            count, covered = count + 1, covered + n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blocked, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return count, covered


class Items:
    """The seeds of a block of items: sorted hashes, and of each the items that have it, with its places there."""

    def __init__(self, ids: list[int | None], texts: pa.Array):
        tokens, heads = token_hashes(texts)
        self.ids, self.sizes = ids, np.diff(heads)
        row, place, seed = shingle_rows(tokens, heads, MATCH)
        full = self.sizes[row] >= LEAST
        row, place, seed = row[full], place[full], seed[full]
        self.widths = np.unique(np.minimum(self.sizes[row], MATCH)).tolist()
        order = np.lexsort([place, row, seed])
        seed, row, self.place = seed[order], row[order], place[order]
        new = np.ones(len(seed), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
        self.first = np.append(np.flatnonzero(new), len(seed))  # of each group of one seed in one item
        self.seed, self.row = seed[self.first[:-1]], row[self.first[:-1]]
        self.words = [tokens[a:b] for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(self.seed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True

    def matches(self, column: pa.Array, threshold: float) -> list[tuple[int, int, int, int]]:
        """(row of the column, item, tiles, covered words) where the coverage reaches the threshold."""
        tokens, heads = token_hashes(column)
        sizes = np.diff(heads)
        near = []
        for width in self.widths:  # a seed's hash has its width in it
            row, place, seed = shingle_rows(tokens, heads, width)
            at = np.flatnonzero(self.sieve[(seed >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] & (sizes[row] >= width))
            near.append((row[at], place[at], seed[at]))
        if not near:
            return []
        row, place, seed = (np.concatenate(x) for x in zip(*near, strict=True))
        low, high = np.searchsorted(self.seed, seed, "left"), np.searchsorted(self.seed, seed, "right")
        n = high - low
        own = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        doc, second, item = np.repeat(row, n), np.repeat(place, n), self.row[own]
        order = np.lexsort([second, item, doc])
        doc, second, item, own = doc[order], second[order], item[order], own[order]
        cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]), [True]])) if len(doc) else []
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            words = self.words[item[a]]
            size, width = len(words), min(len(words), MATCH)
            if width * (b - a) < threshold * size:  # every seed covers so many words at most
                continue
            count, covered = tiles(*self.found(second[a:b], own[a:b], width), words, tokens[heads[doc[a]] : heads[doc[a] + 1]], width)
            if covered >= threshold * size:
                out.append((int(doc[a]), int(item[a]), count, covered))
        return out

    def found(self, at: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matches of a document's places, ascending, with an item, each with its group of the item's places."""
        n = self.first[group + 1] - self.first[group]
        if n.sum() <= 4 * len(at):
            place = np.repeat(self.first[group], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            return runs(self.place[place], np.repeat(at, n), width)
        kinds, group = np.unique(group, return_inverse=True)
        return runs_of_groups(at, group, [self.place[self.first[k] : self.first[k + 1]] for k in kinds], width)


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """The benchmark's items in blocks of bounded size, each broadcast by itself, when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(1, -(-2 * (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    context = benchmark.sparkSession.sparkContext
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        if own.num_rows:
            yield context.broadcast(Items(own["item_id"].to_pylist(), own["text"].combine_chunks()))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per document and item that it holds: id, item_id, tiles, covered, item_words, coverage."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text"):
                items = shared.value
                found = items.matches(batch.column("text"), threshold)
                size = [int(items.sizes[x[1]]) for x in found]
                columns = [batch.column("id").take(pa.array([x[0] for x in found], pa.int64())), pa.array([items.ids[x[1]] for x in found], pa.int64())]
                columns += [pa.array([x[k] for x in found], pa.int64()) for k in (2, 3)] + [pa.array(size, pa.int64()), pa.array([x[3] / n for x, n in zip(found, size, strict=True)], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "item_id", "tiles", "covered", "item_words", "coverage"])

        return run

    found = []  # what a block finds is written before the next one is made, so that one block is held at a time, unless it is the only one
    ahead = blocks(benchmark, block_bytes)
    shared = next(ahead, None)
    while shared is not None:
        part, following = rows.mapInArrow(search(shared), "id long, " + FOUND), next(ahead, None)
        if found or following is not None:
            part = written(part, "leaks")
            shared.destroy()
        found.append(part)
        shared = following
    out = reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], "id long, " + FOUND)
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col):
                good = np.ones(batch.num_rows, bool)
                good[[x[0] for x in shared.value.matches(batch.column(text_col), threshold)]] = False
                yield batch.filter(pa.array(good))

        return run

    for shared in blocks(benchmark, block_bytes):
        docs = small_batches(docs).mapInArrow(search(shared), docs.schema)
    return docs
