"""Numpy work on the UTF-8 bytes of an Arrow string column: words, their hashes, shingles.

All functions take the concatenated bytes of many rows and the rows' offsets, so that one call covers
a whole Arrow batch. Words are maximal runs of bytes other than space, tab, line feed, vertical tab,
form feed and carriage return; as these are ASCII, cutting bytes and cutting code points agree.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII that is neither a letter nor a digit.
MARKS = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEED = np.random.default_rng(20240131)
_BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _SEED.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text (or one row), to bound the arrays made of them."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = column_bytes(batch.column(column))
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more entry at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals lowered."""
    out = LOWER[data]
    tail = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    tail = tail[(data[tail] >= 0x80) & (data[tail] <= 0x9E) & (data[tail] != 0x97)]
    out[tail] += 32
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span of bytes (or of other codes, which ``values`` has numbers for): a polynomial whose prefix sums serve all spans at once."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def parts_of(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """One text's bytes in parts of about ``most``, cut at white space."""
    low = 0
    while low < len(data):
        high = min(low + most, len(data))
        while high < len(data) and not SPACE[data[high]]:
            high = min(high + 1 + int(np.argmax(np.append(SPACE[data[high + 1 : high + most]], True))), len(data))
        yield data[low:high]
        low = high


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each row's first word (one more entry at the end); a single long text is hashed in parts."""
    if len(offsets) == 2 and len(data) > most:
        made = [word_hashes(x, np.array([0, len(x)]), len(x))[0] for x in parts_of(data, most // 2)]
        return np.concatenate(made), np.array([0, sum(map(len, made))])
    starts, ends, heads = words(data, offsets)
    return span_hashes(data, starts, ends), heads


#: Scripts written without spaces between words: Thai, Lao, Myanmar, Khmer, Tai, kana, bopomofo, Han.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3031, 0x3035), (0x303B, 0x303C), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x16FE0, 0x18CFF), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
BETWEEN, PART, ALONE = 0, 1, 2


@cache
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it is in a text (BETWEEN words, PART of a word, a word ALONE), and a number that it shares with its other case."""
    kind, lower = np.zeros(sys.maxunicode + 1, np.uint8), np.arange(sys.maxunicode + 1, dtype=np.uint64)
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if unicodedata.category(c)[0] in "LMN" and not unicodedata.name(c, "").startswith("VARIATION SELECTOR"):
            kind[k] = PART
            lower[k] = ord(c.lower()[0])  # the dotted capital I is the one with two
    lower[0x03C2] = 0x03C3  # the final sigma
    kind[0xDC80:0xDD00] = PART  # bytes that are not UTF-8
    for low, high in UNSPACED:
        kind[low : high + 1] *= ALONE
    return kind, mixed(lower + np.uint64(1)) | np.uint64(1)


def unicode_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, start and end of every word among them, and for each row the index of its first word (one more entry at the end).

    Words are maximal runs of letters, digits and the marks on them; in scripts without spaces each is a word.
    """
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        none = np.zeros(0, np.int64)
        return points, none, none, np.zeros(len(offsets), np.int64)
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    width[(points >= 0xDC80) & (points < 0xDD00)] = 1
    rows = np.searchsorted(np.cumsum(width, dtype=np.int64), offsets, "right")
    kind = code_points()[0][points]
    cut = np.ones(len(points) + 1, bool)  # before each point, and at the end
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == ALONE)
    cut[rows] = True
    starts = np.flatnonzero(cut[:-1] & (kind != BETWEEN))
    ends = np.flatnonzero(cut[1:] & (kind != BETWEEN)) + 1
    return points, starts, ends, np.searchsorted(starts, rows)


def shingle_rows(hashes: np.ndarray, heads: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row's word hashes: (row, place, hash) of its shingles, in order.

    A row with fewer words than ``width`` has its whole sequence as one shingle, and none without words.
    """
    counts = np.diff(heads)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = heads[:-1][row] + place
    have = np.minimum(counts, width)[row]
    out = np.zeros(len(row), np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        out += np.where(k < have, padded[at + k] * _STEP[k], np.uint64(0))
    return row, place, mixed(out + have.astype(np.uint64))
