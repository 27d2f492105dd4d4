"""Byte-pair encoding and decoding: merge rounds over many words at once, in numpy.

The symbols of many distinct words stand in one flat array. In a round every word finds the lowest rank among its adjacent pairs,
by binary search of the pairs in a sorted array of pair keys, and merges all occurrences of that pair from the left; words
without a known pair are done and leave the array. This is the order of a queue of (rank, place) as long as what a merge makes
only takes part in later merges; where a vocabulary breaks that, a round merges one place per word. Words of over ``LONG`` symbols
are merged rank by rank instead, in linked lists, with the same search, so that their cost does not grow with its square.

Text is cut by the cuts of ``token_ids``; words with other characters go through the normaliser and the pre-tokenizer of the
tokenizer's file whole. Words already seen are looked up in a table of bounded size. Decoding gathers the bytes of all ids' tokens.

Defined results: null text counts as empty (no ids, empty text); each row is a document of its own, also where ids are null or
repeated; texts of over PART bytes are encoded in parts cut at white space; special tokens in a text become their ids; symbols
that the vocabulary lacks are dropped, as the library does without an unknown token; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import small_batches
from tracelake.llm.textbytes import column_bytes, parts_of, pieces
from tracelake.llm.token_ids import PART, PieceEncoder, ranges

LONG = 2048
_SLICE = 1 << 18


class Merges:
    """The merge rules of a vocabulary as a sorted array of pair keys, with the rank and the product of each pair."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values(), default=0) + 1
        left, right, made = (np.array([vocab[x] for x in column], np.int64) for column in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        keys, ranks = keys[order], order
        last = np.append(keys[1:] != keys[:-1], True) if len(keys) else np.zeros(0, bool)  # of rules for one pair the last holds
        self.keys, self.ranks = keys[last], ranks[last].astype(np.int64)
        self.made = made[self.ranks]
        born = np.full(self.size, -1, np.int64)
        np.maximum.at(born, self.made, self.ranks)
        self.in_order = bool((np.maximum(born[self.keys // self.size], born[self.keys % self.size]) < self.ranks).all())
        self.none = len(merges)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` where there is no rule) of pairs of symbols, and their places among the keys."""
        if not len(self.keys):
            return np.full(len(left), self.none), np.zeros(len(left), np.int64)
        keys = left * self.size + right
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.ranks[place], self.none), place

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, given the symbols of all, one word behind the other; also the number of ids of each."""
        at = np.cumsum(counts) - counts
        out: list[np.ndarray] = [None] * len(counts)
        huge = np.flatnonzero(counts > LONG) if self.in_order else np.zeros(0, np.int64)
        for k in huge.tolist():
            out[k] = self.by_rank(symbols[at[k] : at[k] + counts[k]])
        active = np.flatnonzero((counts > 0) & ((counts <= LONG) | (not self.in_order)))
        symbols, word = symbols[ranges(at[active], counts[active])], np.repeat(np.arange(len(active)), counts[active])
        done_symbols, done_words = [], []
        while len(symbols):
            rank, place = self.find(symbols[:-1], symbols[1:])
            rank[word[1:] != word[:-1]] = self.none
            rank = np.append(rank, self.none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            over = lowest == self.none
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                symbols, word, rank, lowest, place = symbols[~over], word[~over], rank[~over], lowest[~over], np.append(place, 0)[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == lowest)
            if self.in_order:  # of a run of overlapping pairs every second, from the left
                run = np.cumsum(np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])))
                start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
                hit = hit[(np.arange(len(hit)) - start[run - 1]) % 2 == 0]
            else:
                hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
            symbols[hit] = self.made[place[hit]]
            kept = np.ones(len(symbols), bool)
            kept[hit + 1] = False
            symbols, word = symbols[kept], word[kept]
        flat, owner = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (done_symbols, done_words))
        order = np.argsort(owner, kind="stable")
        flat, sizes = flat[order], np.zeros(len(counts), np.int64)
        sizes[active] = np.bincount(owner, minlength=len(active))
        if not len(huge):
            return flat, sizes
        sizes[huge] = [len(out[k]) for k in huge.tolist()]
        ends = np.cumsum(sizes)
        result = np.empty(int(ends[-1]), np.int64)
        result[ranges((ends - sizes)[active], sizes[active])] = flat
        for k in huge.tolist():
            result[ends[k] - sizes[k] : ends[k]] = out[k]
        return result, sizes

    def by_rank(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: all places of a rank at once, ranks in ascending order."""
        n = len(symbols)
        symbols = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def add(places: np.ndarray) -> None:
            places = places[after[places] < n]
            rank, _ = self.find(symbols[places], symbols[after[places]])
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else np.zeros(0, np.int64)
            for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rank)], strict=True) if len(cuts) else ():
                r = int(rank[low])
                if r < self.none:
                    if r not in waiting:
                        heapq.heappush(ranks, r)
                    waiting.setdefault(r, []).append(places[low:high])

        add(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[alive[places]]
            places = places[after[places] < n]
            rank, at = self.find(symbols[places], symbols[after[places]])
            places, at = places[rank == r], at[rank == r]
            if not len(places):
                continue
            chain = np.append(True, after[places[:-1]] != places[1:])
            start = np.flatnonzero(chain)
            pick = (np.arange(len(places)) - start[np.cumsum(chain) - 1]) % 2 == 0
            places, at = places[pick], at[pick]
            gone = after[places]
            symbols[places] = self.made[at]
            alive[gone] = False
            after[places] = after[gone]
            before[after[places]] = places
            left = before[places]
            add(np.unique(np.concatenate([places, left[left >= 0]])))
        return symbols[:n][alive[:n]]


class MergeEncoder(PieceEncoder):
    """Encodes and decodes with the rules of a tokenizer's file; of the library it takes the normaliser and the pre-tokenizer."""

    def __init__(self, path: str):
        super().__init__(path)
        made = json.loads(self.tokenizer.to_str())
        model = made["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or made["decoder"] is not None:
            raise ValueError(f"{path}: merge rounds are for plain byte-pair encoding without a decoder")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.merges = Merges(self.vocab, pairs)
        added = {x["content"]: x["id"] for x in made["added_tokens"]}
        self.added = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.tokens = {i: x for x, i in (self.vocab | added).items()}
        letters = byte_letters()
        # ids of a byte inside a word, and at its end; -1: not in the vocabulary
        self.inner, self.final = (np.array([self.vocab.get(c + end, -1) for c in letters], np.int64) for end in ("", self.suffix))
        self.byte_of = {c: k for k, c in enumerate(letters)}
        names = [self.tokens.get(i, "").encode() + b" " for i in range(max(self.tokens, default=-1) + 1)]
        self.token_at, self.token_bytes = np.cumsum([0, *map(len, names)]), np.frombuffer(b"".join(names), np.uint8)

    def split(self, text: str) -> list[bytes | int]:
        """The words of a text as bytes after normalisation, and the ids of special tokens."""
        out: list[bytes | int] = []
        at = 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            plain = text[at : m.start() if m else len(text)]
            if plain:
                normal = self.tokenizer.normalizer.normalize_str(plain)
                out += [bytes(self.byte_of[c] for c in word) for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            if m:
                out.append(self.added[m.group(0)])
                at = m.end()
        return out

    def ids_of(self, texts: list[bytes], single: list[bool]) -> list[list[int]]:
        words: list[bytes] = []
        owner: list[int] = []
        fixed: list[tuple[int, int, int]] = []  # special tokens: text, number of words before, id
        # pieces of Latin letters alone: lowering is all that the normaliser does to them
        letters = iter(b"\n".join(x for x, plain in zip(texts, single, strict=True) if plain).decode().lower().encode().split(b"\n"))
        for k, (text, plain) in enumerate(zip(texts, single, strict=True)):
            for x in [next(letters)] if plain else self.split(text.decode()):
                if isinstance(x, int):
                    fixed.append((k, len(words), x))
                else:
                    words.append(x)
                    owner.append(k)
        counts = np.array([len(x) for x in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(counts) - 1
        symbols[ends] = self.final[data[ends]]
        known = symbols >= 0
        if not known.all():
            counts = np.diff(np.append(0, np.cumsum(known)[ends]))
            symbols = symbols[known]
        ids, sizes = self.merges.merge(symbols, counts)
        bounds = np.append(0, np.cumsum(sizes)).tolist()
        found: list[list[int]] = [[] for _ in texts]
        ids = ids.tolist()
        fixed.reverse()
        for w, k in enumerate(owner):
            while fixed and fixed[-1][1] <= w:
                i, _, x = fixed.pop()
                found[i].append(x)
            found[k] += ids[bounds[w] : bounds[w + 1]]
        for i, _, x in reversed(fixed):
            found[i].append(x)
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.by_piece:
            return super().encode(data, offsets)
        found = self.ids_of([data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], [False] * (len(offsets) - 1))
        return np.array([i for x in found for i in x], self.kind), np.array([len(x) for x in found], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens of the ids, joined by spaces."""
        parts = [ids[k : k + _SLICE] for k in range(0, len(ids), _SLICE)]
        return b"".join(self.token_bytes[ranges(self.token_at[x], self.token_at[x + 1] - self.token_at[x])].tobytes() for x in parts)[:-1]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(k) if k in printable else chr(next(other)) for k in range(256)]


_encoders: dict[str, MergeEncoder] = {}


def encoder(path: str) -> MergeEncoder:
    if path not in _encoders:
        _encoders[path] = MergeEncoder(path)
    return _encoders[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in pieces(batches, "text", PART):
            data, offsets = column_bytes(batch.column("text"))
            if len(offsets) == 2 and len(data) > 2 * PART and own.by_piece:
                ids = np.concatenate([own.encode(x, np.array([0, len(x)]))[0] for x in parts_of(data, PART)])
                counts = np.array([len(ids)])
            else:
                ids, counts = own.encode(data, offsets)
            bounds = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))], ["id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            column = batch.column("ids")
            at, flat = column.offsets.to_numpy(), column.values.to_numpy()
            texts = [own.decode(flat[a:b].astype(np.int64)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(texts, pa.binary()).cast(pa.string())], ["id", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of each whole text, by the tokenizer's file at ``path``."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(path), "id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, ids, text): the tokens of (id, ids), special ones included, joined by spaces; null ids count as none."""
    rows = small_batches(encoded).select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode(path), "id long, ids array<int>, text string")
