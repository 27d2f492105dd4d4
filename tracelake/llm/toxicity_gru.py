"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as the sum of two learned vectors: one for the word and one for its character trigrams (ends marked).
Windows of WINDOW words start every STRIDE words, so that they overlap and cover the whole text. In each window two
gated recurrent networks read forth and back, attention weighs their states, and a linear layer gives the
window's logit; the text's score is that of its highest window. In training, windows share a text's
slope in proportion to how high they are (a soft maximum).

Words are cut at white space, with ASCII letters lowered and ASCII punctuation taken off both ends; of a word of
punctuation alone the last character stays.

Defined results: null text, empty text and text of white space have one window without words; very long texts are scored
PART windows at a time, with the same result; repeated rows get equal scores; an empty table gives an empty result; without examples of both classes the score is the share of label 1
(0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import small_batches
from tracelake.llm.textbytes import LOWER, column_bytes, pieces, span_hashes, words
from tracelake.llm.training import Adam, fold, labelled_sample, sigmoid

WINDOW, STRIDE, SIZE, HIDDEN, ATTENTION = 32, 24, 16, 8, 8
WORD_BITS, GRAM_BITS = 14, 14
LEAST_STEPS = 200
PART, LONG = 1 << 12, 1 << 21
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[k for k in range(33, 127) if not chr(k).isalnum()]] = True


def vocabulary(data: np.ndarray, offsets: np.ndarray):
    """Distinct words of the rows: (code of each word, words per row, word bucket, trigram buckets and their word)."""
    import pandas as pd

    low = LOWER[data]
    starts, ends, heads = words(data, offsets)
    if len(starts):
        at, bare = np.arange(len(low)), ~_PUNCTUATION[low]
        after = np.minimum.accumulate(np.where(bare, at, len(low))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(bare, at, -1))
        starts = np.minimum(after[starts], ends - 1)
        ends = np.maximum(before[ends - 1] + 1, starts + 1)
    keys = span_hashes(low, starts, ends)
    codes, distinct = pd.factorize(keys)
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    at, size = starts[first], ends[first] - starts[first]
    # each word spelled with a zero before and behind it; a trigram for each of its bytes
    room = size + 2
    bounds = np.cumsum(room) - room
    spelled = np.zeros(int(room.sum()), np.int64)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    spelled[np.repeat(bounds + 1, size) + place] = low[np.repeat(at, size) + place] if len(size) else 0
    grams = (spelled[:-2] * 65599 + spelled[1:-1]) * 65599 + spelled[2:] if len(spelled) > 2 else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    grams = grams[np.repeat(bounds, size) + place] if len(size) else grams
    return codes, np.diff(heads), _bucket(distinct, WORD_BITS), _bucket(grams, GRAM_BITS), owner


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each window over the concatenated rows, and each row's first window (one more at the end)."""
    n = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
    heads = np.concatenate([[0], np.cumsum(n)])
    base = np.cumsum(counts) - counts
    place = (np.arange(heads[-1]) - np.repeat(heads[:-1], n)) * STRIDE
    return np.repeat(base, n) + place, np.minimum(np.repeat(counts, n) - place, WINDOW), heads


def window_parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """One text's bytes in parts that together have the windows of the whole, at most PART windows each."""
    starts, ends, _ = words(data, np.array([0, len(data)]))
    low = 0
    while low == 0 or low + WINDOW - STRIDE < len(starts):  # else the last part has its end
        high = min(low + PART * STRIDE + WINDOW - STRIDE, len(starts))
        yield data[starts[low] : ends[high - 1]] if high > low else data[:0]
        low += PART * STRIDE


def _segment_sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(owner):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


class WindowNet:
    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed).normal
        w = {"word": draw(0, 0.05, (1 << WORD_BITS, SIZE)), "gram": draw(0, 0.3, (1 << GRAM_BITS, SIZE)), "look": draw(0, 0.4, (2 * HIDDEN, ATTENTION)), "ask": draw(0, 0.5, ATTENTION), "out": draw(0, 0.5, 2 * HIDDEN), "bias": np.zeros(1)}
        for way in "fb":
            w |= {f"in_{way}": draw(0, SIZE**-0.5, (SIZE, 3 * HIDDEN)), f"bias_{way}": np.zeros(3 * HIDDEN), f"own_{way}": draw(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))}
        self.w = {k: v.astype(np.float32) for k, v in w.items()}
        self.constant: float | None = None

    def vectors(self, word, gram, owner, dropped=None) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(np.bincount(owner, minlength=len(word)), 1).astype(np.float32)[:, None]
        spelled = _segment_sum(self.w["gram"][gram], owner, len(word)) / np.sqrt(n)
        own = self.w["word"][word]
        return (own if dropped is None else own * dropped[:, None]) + spelled, n

    def _read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """States of one direction, (steps, windows, HIDDEN); x: (steps, windows, 3 * HIDDEN) projected input."""
        own, h = self.w[f"own_{way}"], np.zeros((x.shape[1], HIDDEN), np.float32)
        states, held = np.empty((len(x), x.shape[1], HIDDEN), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            recurrent = h @ own
            gates = 0.5 * np.tanh(0.5 * (x[t, :, : 2 * HIDDEN] + recurrent[:, : 2 * HIDDEN])) + 0.5
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[t, :, 2 * HIDDEN :] + reset * recurrent[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            step = (update * (new - h)) * m
            if keep:
                held.append((t, h, update, reset, new, recurrent[:, 2 * HIDDEN :], m))
            h = h + step
            states[t] = h
        return states, held

    def logits(self, projected: dict[str, np.ndarray], place: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of each window; place: (steps, windows) word codes, mask: which of them are words."""
        both, held = [], {}
        for way in "fb":
            states, held[way] = self._read(projected[way][place], mask, way, keep)
            both.append(states)
        states = np.concatenate(both, 2)
        seen = np.tanh(states.reshape(-1, 2 * HIDDEN) @ self.w["look"]).reshape(*place.shape, ATTENTION)
        weight = seen @ self.w["ask"] + np.where(mask, 0, -30).astype(np.float32)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tw,twh->wh", weight, states)
        return pooled @ self.w["out"] + self.w["bias"][0], (states, seen, weight, pooled, held)

    @staticmethod
    def layout(codes, first, size):
        steps = np.arange(WINDOW)[:, None]
        mask = steps < size
        if not len(codes):
            return np.zeros(mask.shape, np.int64), mask
        return codes[np.minimum(first + np.minimum(steps, np.maximum(size - 1, 0)), len(codes) - 1)], mask

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        if len(offsets) == 2 and len(data) > LONG:
            return np.maximum.reduce([self._score(x, np.array([0, len(x)])) for x in window_parts(data)])
        return self._score(data, offsets)

    def _score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, counts, word, gram, owner = vocabulary(data, offsets)
        first, size, heads = windows(counts)
        x, _ = self.vectors(word, gram, owner)
        x = x if len(x) else np.zeros((1, SIZE), np.float32)
        projected = {way: x @ self.w[f"in_{way}"] + self.w[f"bias_{way}"] for way in "fb"}
        z = np.empty(len(first), np.float32)
        for k in range(0, len(first), 4096):
            place, mask = self.layout(codes, first[k : k + 4096], size[k : k + 4096])
            z[k : k + 4096] = self.logits(projected, place, mask)[0]
        return sigmoid(np.maximum.reduceat(z, heads[:-1]).astype(np.float64))

    def slopes(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> dict[str, np.ndarray]:
        w = self.w
        codes, counts, word, gram, owner = vocabulary(data, offsets)
        first, size, heads = windows(counts)
        dropped = (draw.random(len(word)) < 0.5).astype(np.float32)
        x, n = self.vectors(word, gram, owner, dropped)
        x, n = (x, n) if len(x) else (np.zeros((1, SIZE), np.float32), np.ones((1, 1), np.float32))
        projected = {way: x @ w[f"in_{way}"] + w[f"bias_{way}"] for way in "fb"}
        place, mask = self.layout(codes, first, size)
        z, (states, seen, weight, pooled, held) = self.logits(projected, place, mask, True)
        row = np.repeat(np.arange(len(y)), np.diff(heads))
        top = np.maximum.reduceat(z, heads[:-1])
        share = np.exp(z - top[row])
        share /= np.add.reduceat(share, heads[:-1])[row]
        dz = (share * ((sigmoid(top) - y) / len(y))[row]).astype(np.float32)
        out = {"out": pooled.T @ dz, "bias": np.array([dz.sum()], np.float32)}
        dp = dz[:, None] * w["out"]
        ds = weight[:, :, None] * dp
        da = np.einsum("twh,wh->tw", states, dp)
        da = weight * (da - (weight * da).sum(0))
        out["ask"] = np.einsum("twa,tw->a", seen, da)
        dk = (da[:, :, None] * w["ask"] * (1 - seen * seen)).reshape(-1, ATTENTION)
        out["look"] = states.reshape(-1, 2 * HIDDEN).T @ dk
        ds += (dk @ w["look"].T).reshape(ds.shape)
        dx_word = np.zeros((len(x), SIZE), np.float32)
        for way, cut in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            own, dh = w[f"own_{way}"], np.zeros((len(z), HIDDEN), np.float32)
            d_own, dg = np.zeros_like(own), np.zeros((WINDOW, len(z), 3 * HIDDEN), np.float32)
            for t, h, update, reset, new, recurrent, m in reversed(held[way]):
                dh = dh + ds[t][:, cut]
                step = dh * m
                d_new = step * update * (1 - new * new)
                d_update = step * (new - h) * update * (1 - update)
                d_reset = d_new * recurrent * reset * (1 - reset)
                g = np.concatenate([d_update, d_reset, d_new * reset], 1)
                d_own += h.T @ g
                dg[t] = np.concatenate([d_update, d_reset, d_new], 1)
                dh = dh - step * update + g @ own.T
            flat, at = dg.reshape(-1, 3 * HIDDEN), place.ravel()
            by = np.argsort(at, kind="stable")
            per_word = _segment_sum(flat[by], at[by], len(x))
            out |= {f"own_{way}": d_own, f"in_{way}": x.T @ per_word, f"bias_{way}": flat.sum(0)}
            dx_word += per_word @ w[f"in_{way}"].T
        if len(word):
            by = np.argsort(word, kind="stable")
            out["word"] = _segment_sum((dx_word * dropped[:, None])[by], word[by], 1 << WORD_BITS)
            by = np.argsort(gram, kind="stable")
            out["gram"] = _segment_sum((dx_word / np.sqrt(n))[owner[by]], gram[by], 1 << GRAM_BITS)
        return out


def train(texts: pa.Array, y: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 1e-2, seed: int = 0) -> WindowNet:
    net = WindowNet(seed)
    if len(set(y.tolist())) < 2:
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    draw, adam = np.random.default_rng(seed), Adam(net.w, rate)
    per_epoch = -(-len(y) // batch)
    steps = max(epochs * per_epoch, LEAST_STEPS)
    while adam.n < steps:
        order = draw.permutation(len(y))
        for k in range(0, len(y), batch):
            own = order[k : k + batch]
            adam.rate = rate * max(0, 1 - adam.n / steps) + 1e-4
            adam.step(net.slopes(*column_bytes(texts.take(pa.array(own))), y[own], draw))
    return net


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(*column_bytes(batch.column("text"))))], ["id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 800, most_bytes: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> WindowNet:
    """Learn ``labels.toxic`` from a bounded sample outside the held-out fold."""
    return train(*labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class, most_bytes, id_col, text_col))


def score(docs: DataFrame, net: WindowNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of toxicity."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
