"""Ranked search against scores counted document by document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_text_operators import EDGE, documents
from tracelake.llm import impact_index, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}
ITEMS = "item_id long, text string, number long, term string, doc_id long, score long"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    n, total, df = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag in bags:
            score = 0
            for t in terms(text):
                if t in bag:
                    m = 100 - 75 + (75 * sum(bag.values()) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def drawn(n, seed):
    draw = random.Random(seed)
    names = ["a", "B", "née", "Ünd", "ünd", "x1", "日本語", "the", "THE", "of", "rare"] + [f"w{k}" for k in range(40)]
    return [(draw.choice([k, k, k, None, 7]), " ".join(draw.choices(names, [60 / (j + 1) for j in range(len(names))], k=draw.randint(0, 60))).replace(" x1", draw.choice(["-x1", "\x00x1", "  x1"]))) for k in range(n)]


@pytest.mark.parametrize("k, block_docs, query_bytes", [(10, 8192, 1 << 20), (3, 50, 300)])
def test_the_best_by_brute_force(spark, k, block_docs, query_bytes):
    docs = drawn(700, 1) + EDGE + [(2000 + j, "copy of the rare one") for j in range(200)]
    items = [(j, t) for j, (_, t) in enumerate(drawn(30, 2))] + [(5, "rare the the the THE"), (None, "rare copy"), (60, None), (61, ""), (62, "nowhere"), (63, "the " * 300 + " ".join(f"q{j} w{j % 40}" for j in range(2000)))]
    index, n = impact_index.build(documents(spark, docs).repartition(3), block_docs=block_docs)
    found = impact_index.search(index, n, spark.createDataFrame([(*x, 1, "z", 2, 3) for x in items], ITEMS), k=k, query_bytes=query_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def test_a_long_text_is_counted_in_parts(spark, monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{j % 977} the" for j in range(30000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    whole = impact_index._terms(batch)
    monkeypatch.setattr(impact_index, "PIECE", 5000)
    parts = impact_index._terms(batch)
    count = lambda x: dict(zip(x[3].take(pa.array(x[1])).to_pylist(), x[2].tolist(), strict=True))
    assert count(whole) == count(parts) and whole[4].tolist() == parts[4].tolist()


def test_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, [(1, "a b"), (2, "a")])
    item = spark.createDataFrame([(1, "b", 0, "", 0, 0)], ITEMS)
    assert impact_index.search(*impact_index.build(none), item).count() == 0
    assert impact_index.search(*impact_index.build(some), item.limit(0)).count() == 0
    assert [tuple(r) for r in impact_index.search(*impact_index.build(some), item).collect()] == brute([(1, "a b"), (2, "a")], [(1, "b")], 10)


def test_slices_add_and_multiply():
    draw = np.random.default_rng(4)
    a, b, w = draw.integers(0, 1 << 20, 999), draw.integers(0, 1 << 17, 999), draw.integers(0, 1 << 12, 999)
    number = lambda x: sum(np.unpackbits(s, count=999, bitorder="little").astype(np.int64) << k for k, s in enumerate(x))
    total = impact_index.sliced(a, 24)
    impact_index.add(total, impact_index.sliced(b, 17), 3)
    assert (number(total) == a + 8 * b).all()
    assert (number(impact_index.weighted(impact_index.sliced(a, 20), w)) == a * w).all()


def test_query(spark, tmp_path):
    docs, items = drawn(120, 5), [(j, t) for j, (_, t) in enumerate(drawn(12, 6))]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, queries.op11_ranked_search(spark, str(tmp_path)).collect()), key=str) == brute(docs, items, 10)
