"""What the trained models share: the bounded labelled sample, and an optimiser."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, per_class: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[pa.Array, np.ndarray]:
    """Texts and labels to learn from: at most ``per_class`` ids of each class, those of the smallest id hashes, with one text each.

    Rows of the held-out fold, of null label, and texts of over ``most_bytes`` are no examples. Of several texts of one id the smallest
    one counts, of several labels the larger. The sample is the only thing that reaches the driver: at most 2 * per_class rows.
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (fold("i", folds) != held_out))
    given = docs.select(F.col(id_col).alias("j"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).filter(F.octet_length("t") <= most_bytes)
    # the limit counts only rows that are examples: labels of other rows must not take their places
    known = known.groupBy("i").agg(F.max("y").alias("y")).join(given.select(F.col("j").alias("i")), "i", "left_semi").withColumn("h", F.xxhash64("i"))
    chosen = [known.filter(F.col("y") == k).orderBy("h", "i").limit(per_class) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    rows = given.join(F.broadcast(chosen), F.col("i") == F.col("j")).groupBy("h", "i", "y").agg(F.min("t").alias("t")).select("h", "i", "t", "y").toArrow()
    rows = rows.sort_by([("h", "ascending"), ("i", "ascending"), ("t", "ascending")])
    return rows["t"].combine_chunks(), rows["y"].to_numpy()


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.n = weights, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, slopes: dict[str, np.ndarray]) -> None:
        self.n += 1
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n))
        for k, g in slopes.items():
            m, v = self.first[k], self.second[k]
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            self.weights[k] -= rate * m / (np.sqrt(v) + np.float32(1e-7))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
