"""Quality classifier: a convolutional network over bytes, trained in numpy.

Filters of four bytes slide over the whole text. Their highest values are taken in chunks of 2 * BLOCK positions
that overlap by half, so that every window of the text is in some chunk; a hidden layer reads each chunk, and the mean
and the maximum of the chunks' hidden values give one probability. Bytes are looked up in pairs: a filter's sum over
four bytes is one row of a table for its first two bytes plus one for its last two.

Defined results: null and empty texts are scored as four zero bytes; very long texts are read PART bytes at a time, with
the same result; repeated rows get equal scores; an empty table gives an empty result; without examples of both classes the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import small_batches
from tracelake.llm.textbytes import column_bytes, pieces
from tracelake.llm.training import Adam, fold, labelled_sample, sigmoid

WIDTH, FILTERS, HIDDEN, BLOCK = 4, 24, 16, 128
LEAST_STEPS, PART = 200, 1 << 16
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with WIDTH - 1 zeros behind each row (WIDTH if it is empty), and the new offsets."""
    sizes = np.diff(offsets)
    room = np.maximum(sizes, 1) + WIDTH - 1
    bounds = np.concatenate([[0], np.cumsum(room)])
    out = np.zeros(bounds[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(bounds[:-1] - offsets[:-1], sizes)] = data
    return out, bounds


def _blocks(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window of each block, and each row's first block (one more entry at the end)."""
    n = -(-(np.diff(bounds) - WIDTH + 1) // BLOCK)
    heads = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(heads[-1]) - np.repeat(heads[:-1], n)
    return np.repeat(bounds[:-1], n) + place * BLOCK, heads


class ByteNet:
    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed).normal
        self.w = {
            "bytes": draw(0, 0.4, (WIDTH, 256, FILTERS)), "hidden": draw(0, FILTERS**-0.5, (FILTERS, HIDDEN)), "bias": np.zeros(HIDDEN),
            "mean": draw(0, HIDDEN**-0.5, HIDDEN), "top": draw(0, HIDDEN**-0.5, HIDDEN), "out": np.zeros(1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.constant: float | None = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        b = self.w["bytes"]
        return tuple((b[k][:, None, :] + b[k + 1][None, :, :]).reshape(65536, FILTERS) for k in (0, 2))

    def pooled(self, data: np.ndarray, bounds: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None, where: bool = False):
        """Highest value of each filter in each block (and the window that has it), and the rows' first blocks."""
        starts, heads = _blocks(bounds)
        pair = (data[:-1].astype(np.int32) << 8) | data[1:]
        if tables is None:
            b = self.w["bytes"]
            values = b[0][data[: len(pair) - 2]] + b[1][data[1 : len(pair) - 1]] + b[2][data[2 : len(pair)]] + b[3][data[3:]]
        else:
            values = tables[0][pair[:-2]] + tables[1][pair[2:]]
        ends = np.append(starts[1:], bounds[-1] - WIDTH + 1)
        ends[heads[1:] - 1] = bounds[1:] - WIDTH + 1
        cuts = np.stack([starts, ends], 1).ravel()
        if cuts[-1] >= len(values):
            cuts = cuts[:-1]
        best = np.maximum.reduceat(values, cuts, axis=0)[::2]
        if not where:
            return best, heads, None
        size = ends - starts
        block = np.repeat(np.arange(len(starts)), size)
        own = values[np.repeat(starts, size) + np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)]
        row, column = np.nonzero(own == best[block])
        at = np.zeros(best.shape, np.int64)
        at[block[row], column] = (np.repeat(starts, size) + np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size))[row]
        return best, heads, at

    def head(self, best: np.ndarray, heads: np.ndarray):
        last = np.zeros(len(best), bool)
        last[heads[1:] - 1] = True
        nxt = np.where(last, np.arange(len(best)), np.minimum(np.arange(len(best)) + 1, len(best) - 1))
        chunk = np.maximum(best, best[nxt])
        hidden = np.maximum(chunk @ self.w["hidden"] + self.w["bias"], 0)
        n = np.diff(heads)[:, None]
        mean = np.add.reduceat(hidden, heads[:-1], axis=0) / n
        top = np.maximum.reduceat(hidden, heads[:-1], axis=0)
        return nxt, chunk, hidden, mean, top, mean @ self.w["mean"] + top @ self.w["top"] + self.w["out"][0]

    def score(self, data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        if len(offsets) == 2 and len(data) > PART:  # a long text: PART windows at a time, whole blocks each
            padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
            parts = (padded[k : k + PART + WIDTH - 1] for k in range(0, len(data), PART))
            best = np.concatenate([self.pooled(x, np.array([0, len(x)]), tables)[0] for x in parts])
            heads = np.array([0, len(best)])
        else:
            padded, bounds = _padded(data, offsets)
            best, heads, _ = self.pooled(padded, bounds, tables)
        return sigmoid(self.head(best, heads)[-1].astype(np.float64))

    def slopes(self, data: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        padded, bounds = _padded(data, offsets)
        best, heads, at = self.pooled(padded, bounds, where=True)
        nxt, chunk, hidden, mean, top, z = self.head(best, heads)
        w, n = self.w, np.diff(heads)
        dz = ((sigmoid(z) - y) / len(y)).astype(np.float32)
        row = np.repeat(np.arange(len(y)), n)
        dh = (dz / n)[row, None] * w["mean"] + np.where(hidden == top[row], dz[row, None] * w["top"], 0)
        dh = np.where(hidden > 0, dh, 0).astype(np.float32)
        dc = dh @ w["hidden"].T
        first = best >= best[nxt]
        db = np.where(first, dc, 0)
        np.add.at(db, nxt, np.where(first, 0, dc))
        out = {"hidden": chunk.T @ dh, "bias": dh.sum(0), "mean": mean.T @ dz, "top": top.T @ dz, "out": np.array([dz.sum()], np.float32)}
        g = np.zeros((WIDTH, 256 * FILTERS), np.float32)
        columns = np.broadcast_to(np.arange(FILTERS), at.shape).ravel()
        for k in range(WIDTH):
            g[k] = np.bincount(padded[at.ravel() + k].astype(np.int64) * FILTERS + columns, db.ravel(), 256 * FILTERS)
        return out | {"bytes": g.reshape(WIDTH, 256, FILTERS)}


def train(texts: pa.Array, y: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 6e-3, seed: int = 0) -> ByteNet:
    net = ByteNet(seed)
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
            adam.step(net.slopes(*column_bytes(texts.take(pa.array(own))), y[own]))
    return net


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = shared.value, shared.value.tables()
        for batch in pieces(batches, "text", PART):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(net.score(*column_bytes(batch.column("text")), tables))], ["id", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, most_bytes: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> ByteNet:
    """Learn ``labels.quality`` from a bounded sample outside the held-out fold."""
    return train(*labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class, most_bytes, id_col, text_col))


def score(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of good quality."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_score(shared), f"id {kind}, score double").withColumnRenamed("id", id_col)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""
    net = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for batch in pieces(batches, text_col, PART):
            good = shared.value.score(*column_bytes(batch.column(text_col)), tables) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return small_batches(docs).mapInArrow(run, docs.schema)
