"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import chat_format, decontaminate, exact_dedup, licenses, mixing, ngram_join, textbytes, token_ids, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key long, size long, n long"


def documents(spark, rows):
    """Rows of (doc_id, text[, source]) with columns whose names operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1, 2, 3, 4) for r in rows], DOCS)


LONG = " ".join(f"w{k * 7919 % 9973}" for k in range(30000))
EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (None, "one"), (7, "é" * 300), (8, "don't  <|end|> \\ naïve 日本語!ok 'S x''s")]


# --- exact dedup ---

def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        top = max((x for x in ids if x is not None), default=None)
        first = True
        for i in ids:
            kept = i == top and first
            first = first and not kept
            out.append((i, top, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("moduli", [exact_dedup.MODULI, (3, 2)])
def test_exact_dedup_also_when_fingerprints_collide(spark, moduli):
    rows = EDGE + [(k, "abcdefgh"[k % 8 : k % 8 + 2]) for k in range(20, 60)]
    got = exact_dedup.exact_duplicates(documents(spark, rows), moduli=moduli, salt_rows=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0


def test_chunks_combine():
    text = np.frombuffer(LONG.encode(), np.uint8)
    at = np.array([0, len(text) // 3, len(text)])
    assert (exact_dedup.fingerprints(text, at, 64) == exact_dedup.fingerprints(text, at, 1 << 14)).all()


# --- mixing ---

def test_mixing_meets_targets(spark):
    draw = np.random.default_rng(1)
    rows = [(k, "w " * int(draw.integers(0, 60)), [None, "a", "B", "ü"][k % 7 % 4]) for k in range(600)] + [(1000, None, "a"), (1001, "x y", "zero"), (1001, "x y", "zero")]
    got = mixing.mix(documents(spark, rows)).collect()
    again = mixing.mix(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    by = {}
    for r in got:
        assert 0 <= r["copies"] <= 3
        x = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        x[2] += r["size"]
        x[3] += r["copies"] * r["size"]
    total, weights = sum(x[0] for x in by.values()), {s: k % 3 + 1 for k, s in enumerate(sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None])}
    left, free, want = float(total), set(by), {}
    while free:
        share = {s: left * weights[s] / sum(weights[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * by[s][0]]
        want |= {s: 3.0 * by[s][0] for s in over} if over else share
        left -= sum(3.0 * by[s][0] for s in over)
        free = free - set(over) if over else set()
    for s, (size, target, seen, taken) in by.items():
        assert size == seen and abs(target - want[s]) < 1e-6
        assert abs(taken - target) <= max(0.03 * target, 5)


def test_copies_come_as_often_as_they_are_expected(spark):
    """Many sources of like make are as many draws: copies by length class against the inclusion probabilities, unequal within a source."""
    sizes = [2, 5, 12, 25, 40] * 50
    rows = [(1000 * s + k, "w " * n, f"s{s:03}") for s in range(40) for k, n in enumerate(sizes)]
    level = sum(sizes) / sum((8 + n.bit_length()) * n for n in sizes)
    for share in (0.55, 1.7):
        got = mixing.mix(documents(spark, rows), weights=(1,), share=share).collect()
        means = [np.mean([r["copies"] for r in got if r["size"] == n]) for n in sizes[:5]]
        want = [share * level * (8 + n.bit_length()) for n in sizes[:5]]
        assert np.abs(np.array(means) - want).max() < 0.08 and means == sorted(means) and want[-1] > want[0] + 0.1
        assert {r["copies"] for r in got} == {int(share), int(share) + 1}


def test_many_sources_are_numbered_over_ranges(spark):
    rows = spark.createDataFrame([(f"s{k * 7919 % 5000:04}",) for k in range(5000)] + [(None,), ("é",), ("Z",)], "source string").repartition(9)
    got = {r["source"]: r["rank"] for r in mixing.numbered(rows, "source").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [*sorted((k for k in got if k is not None), key=lambda k: k.encode()), None] and sorted(got.values()) == list(range(5003))


def test_mixing_empty_and_wordless(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert {tuple(r)[2:] for r in mixing.mix(documents(spark, [(1, None), (2, " ")])).collect()} == {(0, 0, 0.0, 0)}


@pytest.mark.parametrize("batch", [1, 3, 4096])
def test_rooms_are_filled_in_order_with_what_fits(spark, batch):
    draw = np.random.default_rng(4)
    rows = [(s, 100 * s + k, int(draw.integers(1, 3 ** int(draw.integers(1, 6)))), min(k // 9, (0, 11, 3)[s % 3]), k // 2 / 100) for s in range(9) for k in range(100)] + [(9, 901, 50, 0, 0.5)]
    ranked = spark.createDataFrame([(s, r, n, c, (x, f"t{r % 2}", r)) for s, r, n, c, x in rows], "s long, row long, size long, slice int, at struct<rank: double, tie: string, row: long>")
    rooms, want, left = {s: (0.5, 1.0, 300.25, 99999.0)[s % 4] + 40 * s for s in range(9)} | {9: 30.0}, set(), {}
    for s, room in rooms.items():
        for _, row, size, _, _ in sorted((x for x in rows if x[0] == s), key=lambda x: (x[4], x[1] % 2, x[1])):
            if size <= room:
                room -= size
                want.add(row)
        left[s] = room
    state = spark.createDataFrame([(s, x, None) for s, x in rooms.items()], "s long, room double, after struct<rank: double, tie: string, row: long>")
    chosen, ends, _ = mixing._taken(ranked, state, batch)
    got = [r["row"] for r in chosen.collect()]
    assert len(got) == len(set(got)) and set(got) == want and dict(map(tuple, ends.collect())) == left


def test_the_mix_takes_few_jobs(spark):
    """The driver plans for each and holds a thread for each shuffle and broadcast of the last minute."""
    docs = documents(spark, [(k, "w " * (k * 7 % 61), ["a", "b", "c"][k % 3]) for k in range(300)])
    sc = spark.sparkContext
    sc.setJobGroup("mix", "")
    mixing.mix(docs)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("mix")) < 60


# --- n-gram join ---

def brute_classes(rows, width=5):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(frozenset(s))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((i, len(s), find(i)) for i in ids for s in sets[i]))


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 5)  # many tiles of one block
    draw = np.random.default_rng(3)
    words = [f"t{k}" for k in range(400)]
    base = [[words[k] for k in draw.integers(0, 400, n)] for n in (3, 8, 40, 60, 200)]
    rows = list(EDGE)
    for k in range(150):
        own = list(base[k % 5])
        for _ in range(int(draw.integers(0, 4))):
            own[int(draw.integers(0, len(own)))] = "x%d" % draw.integers(0, 5)
        rows.append((100 + k, " ".join(own) if k % 3 else " ".join(own).upper() + " tail"))
    got = sorted(tuple(r) for r in ngram_join.ngram_components(documents(spark, rows)).filter("doc_id is not null").collect())
    assert got == brute_classes(rows)


def test_ngram_join_of_rows_that_share_ids(spark):
    """Other texts under one id, of equal and of unequal sizes: the id has the links of all of them."""
    draw = np.random.default_rng(8)
    base = [[f"v{k}" for k in draw.integers(0, 300, n)] for n in (30, 30, 31, 34, 60, 61)]
    rows = []
    for k in range(160):
        own = list(base[k % 6])
        for _ in range(int(draw.integers(0, 3))):
            own[int(draw.integers(0, len(own)))] = "y%d" % draw.integers(0, 4)
        rows.append((int(draw.integers(0, 110)) if k % 5 else 200 + k, " ".join(own)))
    got = sorted(tuple(r) for r in ngram_join.ngram_components(documents(spark, rows)).collect())
    assert got == brute_classes(rows)


def test_ngram_join_boundary(spark):
    shared = [f"s{k}" for k in range(44)]  # 40 shingles; 50 in the union are exactly 80 in 100
    rows = [(1, " ".join(shared)), (2, " ".join(shared + [f"a{k}" for k in range(10)])), (3, " ".join(shared + [f"b{k}" for k in range(11)]))]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_ngram_join_empty(spark):
    assert ngram_join.ngram_components(documents(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_components(documents(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def test_tree_join_equals_all_pairs():
    draw = np.random.default_rng(5)
    points = draw.integers(0, 6, (90, ngram_join.GROUPS)).astype(np.uint8)
    points[::3] = points[0]
    n, label, over = points.sum(1, dtype=np.int64), draw.integers(0, 9, 90), np.zeros(90, np.int64)
    order = np.lexsort([n, label])
    tree = ngram_join.Tree(points[order], over, n[order], label[order])
    i, j = ngram_join.tree_join(tree, tree, 80, True)
    want = {frozenset((a, b)) for a in range(90) for b in range(a) if label[a] != label[b] and 100 * n[a] >= 80 * n[b] and 100 * n[b] >= 80 * n[a] and 180 * int(np.minimum(points[a], points[b]).sum()) >= 80 * (n[a] + n[b])}
    assert {frozenset(x) for x in zip(order[i].tolist(), order[j].tolist(), strict=True)} == want and len(i) == len(want)


def test_large_counts_keep_the_bound():
    a, b = (ngram_join.counted(np.zeros(n, np.uint64), 64) for n in (1000, 700))
    assert ngram_join.overlap_bound(a[0].tobytes(), b[0].tobytes(), min(a[1], b[1])) == 700


# --- decontamination ---

def brute_tiling(a, b, least=5):
    """Greedy string tiling by the definition: always the longest unmarked common run."""
    used_a, used_b, tiles, covered = [False] * len(a), [False] * len(b), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return tiles, covered
        k, i, j = best
        used_a[i : i + k] = used_b[j : j + k] = [True] * k
        tiles, covered = tiles + 1, covered + k


def test_tiling_against_the_definition():
    draw = np.random.default_rng(2)
    for _ in range(60):
        a, b = draw.integers(0, 3, 25).tolist(), draw.integers(0, 3, 40).tolist()
        if draw.random() < 0.5:
            b[5:17] = a[10:22]
        seeds = [(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if a[i : i + 5] == b[j : j + 5]]
        got = decontaminate.tiling(np.array([x[0] for x in seeds], np.int64), np.array([x[1] for x in seeds], np.int64), len(a), len(b)) if seeds else (0, 0)
        want = brute_tiling(a, b)
        assert got[1] >= 5 * got[0] and (got[0] == 0) == (want[0] == 0)
        assert abs(got[1] - want[1]) <= 4  # equally long runs may be taken in another order


def test_tiling_equals_the_definition_on_repetitive_texts():
    draw = np.random.default_rng(12)
    for k in range(80):
        a = draw.integers(0, 2 + k % 3, 24).tolist() if k % 4 else [1] * 12 + [2] * 8
        b = draw.integers(0, 2 + k % 3, 60).tolist() if k % 5 else ([1] * 9 + [2]) * 5 + [1, 2] * 4
        items = decontaminate.Items([1], pa.array([" ".join(f"w{x}" for x in a)]))
        text = pa.array(["w9", " ".join(f"w{x}" for x in b)])
        got = items.matches(text, 0.0)
        want = brute_tiling(a, b)
        assert [(r[0], *r[2:]) for r in got] == ([(1, *want)] if want[0] else [])
        seeds = [(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if a[i : i + 5] == b[j : j + 5]]
        if seeds:
            first, second = (np.array(x) for x in zip(*seeds, strict=True))
            at = np.unique(second)
            kinds = [tuple(first[second == j].tolist()) for j in at]
            places = sorted(set(kinds))
            listed = decontaminate.runs_of_groups(at, np.array([places.index(x) for x in kinds]), [np.array(x) for x in places], 5)
            assert sorted(zip(*(x.tolist() for x in listed), strict=True)) == sorted(zip(*(x.tolist() for x in decontaminate.runs(first, second, 5)), strict=True))


def test_equal_words_by_the_hundred_thousand():
    items = decontaminate.Items([1, 2], pa.array(["same " * 1000, "one two three four five six"]))
    got = items.matches(pa.array(["same " * 200_000, "x " * 300_000 + "one two three four five six " + "y " * 2_000_000]), 0.5)
    assert got == [(0, 0, 1, 1000), (1, 1, 1, 6)]


def test_matches_of_other_words_are_cut():
    own, text = np.arange(20, dtype=np.uint64), np.arange(20, dtype=np.uint64)
    text[9] = 77  # as if hashes of seeds had been equal
    assert decontaminate.tiles(np.array([0]), np.array([0]), np.array([20]), own, text, 5) == (2, 19)


def test_decontamination_finds_reordered_passages(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    plain = " ".join(item)
    rows = EDGE + [
        (20, f"before {plain} after"), (21, " ".join(item[10:]) + " gap here " + " ".join(item[:10])), (22, plain.upper().replace(" ", ", ")), (23, " ".join(item[:9])),
        (24, " ".join(item[k] for k in range(0, 20, 2))), (25, (plain + " ") * 50),
    ]
    bench = spark.createDataFrame([(1, plain, "x"), (2, None, "x"), (3, "one", "x"), (4, "", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["tiles"], r["covered"], r["coverage"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(20, 1): (1, 20, 1.0), (21, 1): (2, 20, 1.0), (22, 1): (1, 20, 1.0), (25, 1): (1, 20, 1.0)}
    clean = decontaminate.clean(documents(spark, rows), bench)
    assert clean.columns == documents(spark, []).columns and clean.count() == len(rows) - 4
    assert decontaminate.contaminated(documents(spark, rows), bench, block_bytes=40).count() == 4  # several passes
    assert decontaminate.contaminated(documents(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0


def test_decontamination_in_any_script_and_of_short_items(spark):
    items = [
        (1, "床前明月光疑是地上霜举头望明月低头思故乡"), (2, "吾輩は猫であるまだ名はない"), (3, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"), (4, "Η ΓΛΩΣΣΑ ΤΩΝ ΑΡΧΑΙΩΝ ΕΛΛΗΝΩΝ ΗΤΑΝ ΑΛΛΗ"),
        (5, "Съешь ещё этих мягких французских булок"), (6, "It's what \"they\" said - and don't ask"), (7, "purple walrus"), (8, "how deep is this"), (9, "हिन्दी में लिखा हुआ एक वाक्य"),
    ]
    texts = [
        f"前言 {items[0][1]} 后记", f"「{items[1][1]}」と", f"ก่อน{items[2][1]}หลัง", "πριν " + items[3][1].lower() + " μετά", items[4][1].upper(),
        "So: it’s what “they” said – and\u00a0don’t ask.", "a Purple, Walrus!", "how deep, is this", "वह " + items[8][1] + "।",
    ]
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(20, "purple is a walrus"), (21, "deep is this how"), (22, "床上有一本书和一支笔"), (23, "purple"), (24, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()}
    assert got == {(k, k, 1.0) for k in range(1, 10)}
    assert {r["doc_id"] for r in decontaminate.clean(documents(spark, rows), bench).collect()} == {20, 21, 22, 23, 24}
    short = bench.filter("item_id = 7")  # no item of five words in the block
    assert [(r["doc_id"], r["item_words"]) for r in decontaminate.contaminated(documents(spark, rows), short).collect()] == [(7, 2)]


def test_unicode_words_at_row_ends_and_in_broken_bytes():
    rows = ["ab", "cd 日本", "語x", "", "É1", "𠀀b", "  "]
    for extra in ([], [b"\xff\xfe a"]):
        data = pa.array([x.encode() for x in rows] + extra, pa.binary())
        points, starts, ends, heads = textbytes.unicode_words(*textbytes.column_bytes(data))
        found = ["".join(map(chr, points[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        assert [found[a:b] for a, b in zip(heads[:7], heads[1:8], strict=False)] == [["ab"], ["cd", "日", "本"], ["語", "x"], [], ["É1"], ["𠀀", "b"], []]
        assert len(found) == 9 + 2 * len(extra)


# --- licences ---

def brute_licenses(rows, given, t=0.8):
    norm = lambda s: re.sub(" +", " ", re.sub(r"[\W_]+", " ", s.lower())).strip().split(" ")
    grams = lambda w: set(zip(w[:-1], w[1:], strict=True))
    known, out = [(n, grams(norm(x))) for n, x in given], {}
    for i, text in rows:
        for unit in (text or "").split("\n") + ([text] if "\n" in (text or "") else []):
            g = grams(norm(unit))
            scores = sorted((-2 * len(g & k) / (len(g) + len(k)), n) for n, k in known if g and k)
            if scores and -scores[0][0] >= t:
                d, n = -scores[0][0], scores[0][1]
                best, count = out.get((i, n), (0.0, 0))
                out[i, n] = (max(best, d), count + 1)
    return {(i, n, round(d, 9), c) for (i, n), (d, c) in out.items()}


def test_licenses_equal_brute_force(spark):
    given = licenses.templates()
    mit = licenses.TEXTS["MIT"]
    rows = EDGE + [
        (20, "intro line\nReleased under the MIT License.\nmore"), (21, "Licensed under the Apache License, Version 2.0!\nLicensed under the Apache License, Version 2.0"), (22, mit.replace(", ", ",\n", 3)),
        (23, "This work is licensed under the GNU General Public License, version 3."), (24, "permission is hereby granted"), (25, mit + " but not so much"), (26, "under under under"),
    ]
    got = {(r["doc_id"], r["license"], round(r["score"], 9), r["units"]) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == brute_licenses(rows, given) and {x[1] for x in got} == {"MIT", "Apache-2.0", "GPL-3.0"}
    assert licenses.scan(documents(spark, [])).count() == 0
    assert licenses.scan(documents(spark, rows), given=[("X", "one")]).count() == 0


def brute_windows(text, given, t=0.8):
    """(licence, score) of the windows by the definition: from every bigram of every template the best end, what matching lines cover left out."""
    norm = lambda s: re.sub(" +", " ", re.sub(r"[\W_]+", " ", s.lower())).strip().split(" ")
    grams = lambda w: set(zip(w[:-1], w[1:], strict=True))
    known = [(k, n, norm(x)) for k, (n, x) in enumerate(given)]
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
    matches = lambda line: any(dice(grams(norm(line)), grams(w)) >= t for _, _, w in known)
    if "\n" in text and matches(text):
        return []
    words = [w for line in text.split("\n") for w in (["-"] if matches(line) else norm(line)) if w]
    hits, pairs = [], list(zip(words[:-1], words[1:], strict=True))
    for k, name, own in known:
        asked, span = grams(own), int((len(own) - 1) * (2 - t) / t + 1e-9)
        for start in [x for x, g in enumerate(pairs) if g in asked]:
            d, stop = max((dice(set(pairs[start : start + n]), asked), -n) for n in range(1, min(span, len(pairs) - start) + 1))
            if d >= t:
                hits.append((start, start - stop + 1, k, -d, name))
    out, stop = [], -1
    for a, z, _, d, name in sorted(hits):
        if a >= stop:
            out.append((d, name))
        out[-1] = min(out[-1], (d, name))
        stop = max(stop, z)
    return sorted((name, round(-d, 9)) for d, name in out)


def test_licenses_over_lines_and_within_them(spark):
    import textwrap

    given = licenses.templates()
    body = "\n".join(f"def f{k}(x): return x + {k}" for k in range(30))
    wrapped = {n: textwrap.fill(x, 78) for n, x in licenses.WHOLE.items()}
    rows = [
        (1, body + "\n" + wrapped["MIT"] + "\n" + body), (2, "Copyright (c) 2020 A. Person\n" + wrapped["BSD-3-Clause"]), (3, "We like it. It is released under the MIT License. Enjoy it, all of you."), (4, "Some words first. This work is licensed under the Creative Commons\nAttribution 4.0 International License. And some words behind."),
        (5, body), (6, "Released under the MIT License.\n" + body + "\n# " + wrapped["Zlib"].replace("\n", "\n# ")), (7, wrapped["ISC"].replace("distribute", "share", 1) + " " + body.replace("\n", " ")), (8, "the license of the world under the license"), (9, wrapped["Apache-2.0"] + "\n" + body + "\n" + wrapped["GPL-3.0"]), (10, None), (10, "MIT"),
    ]
    got = {}
    for r in licenses.scan(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["license"], round(r["score"], 9), r["units"]))
    for i, text in rows:
        if text is not None:
            lines = {(n, s): c for _, n, s, c in brute_licenses([(i, text)], given)}
            best, units = {}, {}
            for n, s, c in [(n, s, c) for (n, s), c in lines.items()] + [(n, s, 1) for n, s in brute_windows(text, given)]:
                best[n], units[n] = max(best.get(n, 0), s), units.get(n, 0) + c
            assert got.get(i, set()) == {(n, best[n], units[n]) for n in best}, i
    assert {i: {x[0] for x in v} for i, v in got.items()} == {1: {"MIT"}, 2: {"BSD-3-Clause"}, 3: {"MIT"}, 4: {"CC-BY-4.0"}, 6: {"MIT", "Zlib"}, 7: {"ISC"}, 9: {"Apache-2.0", "GPL-3.0"}}


def test_licenses_with_words_inserted_dropped_and_changed(spark):
    """An altered licence counts by its coefficient alone, whatever stands around it."""
    draw = np.random.default_rng(8)
    prose = lambda n: " ".join(draw.choice("lorem ipsum dolor sit amet the of and to in we they software".split(), n))
    rows, full = [], licenses.WHOLE["MIT"].split()
    for n in (0, 1, 3, 6, 9, 12):
        for kind in range(3):
            words = list(full)
            for at in sorted({(k + 1) * len(full) // (n + 1) for k in range(n)}, reverse=True):
                words[at : at + (kind > 0)] = [] if kind == 1 else ["xyzzy"]
            rows.append((10 * n + kind, f"{prose(200)} {' '.join(words)} {prose(200)}"))
    rows.append((999, " ".join([licenses.WHOLE["ISC"], prose(100)] * 40)))  # over several pieces
    got = {(r["doc_id"], r["license"]): r["score"] for r in licenses.scan(documents(spark, rows)).collect()}
    given = [x for x in licenses.templates() if x[0] in ("MIT", "ISC")]
    assert got[999, "ISC"] == 1.0
    for i, text in rows[:-1]:
        assert {x: round(y, 9) for (k, x), y in got.items() if k == i} == {"MIT": max(d for _, d in brute_windows(text, given))}
        assert got[i, "MIT"] >= 0.85


# --- chat ---

def test_a_hot_null_conversation_and_one_that_is_too_large(spark, monkeypatch):
    turns = [(None if k % 3 else k, k, "user" if k % 2 else "assistant", f"text {k} <|") for k in range(6000)]
    schema = "conv_id long, turn long, role string, text string"
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in chat_format.digests(chat_format.format_conversations(spark.createDataFrame(turns, schema))).collect()}
    own = [t for t in turns if t[0] is None]
    assert len(got) == 2001 and got[None] == (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest())
    monkeypatch.setattr(chat_format, "MOST_TEXT", 100)
    with pytest.raises(ValueError, match="has to stay below 100"):
        chat_format.assemble(pa.array(["user"] * 9), pa.array(["some text"] * 9), np.array([9]))


TURNS = "conv_id long, turn long, role string, text string, id string, n_turns string"


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "<|end|>", "<\\|end|>", "<\\\\|", "<", "|", "<|", "a<|turn|>b<|text|>", "é日本\U0001f600", "", None, "x" * 70000, "<<|", "\\<|\\"]
    rows = [(k // 5, k % 5, ["user", "assistant", None, "assistant", "a<|b"][k % 5], odd[k % len(odd)]) for k in range(60)]
    rows += [(100, 1, "assistant", "b"), (100, 1, "assistant", "a"), (100, None, "user", "first"), (None, 0, "user", "q"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    assert set(got) == set(groups)
    for i, own in groups.items():
        own = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[i]["n_turns"] == len(own)
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[i]["formatted_chars"] == sum(len(chat_format.escape(x or "")) for r in own for x in r[2:4]) + 23 * len(own)
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_conversation_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(k // 30, k, "assistant", f"t{k}", "", "") for k in range(90)], TURNS)
        got = chat_format.digests(chat_format.format_conversations(df)).collect()
        assert sorted((r["conv_id"], r["n_turns"]) for r in got) == [(0, 30), (1, 30), (2, 30)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- token ids ---

@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_pieces_give_the_tokenizers_ids(vocabulary):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    texts = [t or "" for _, t in EDGE] + ["don't I'LL 'S x''s !'s a<|startoftext|>b <|EndOfText|> “q”! J̌ ǰ 3½ ²x ×2 a×b É́ \xa0 İ ſ ﬁ ΣΑΣ. x\x1cy l'été ''' 1's", "a" * 999 + "'b"]
    ids, counts = token_ids.PieceEncoder(vocabulary).encode(*textbytes.column_bytes(pa.array(texts)))
    cuts = np.cumsum(counts)[:-1]
    assert [x.tolist() for x in np.split(ids, cuts)] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_piece_table_of_any_size_and_part_lengths(vocabulary):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    texts = [" ".join(f"w{k * j % 977}x" for k in range(300)) + " " + "z" * 300 for j in range(12)]
    own = token_ids.PieceEncoder(vocabulary)
    own.table.most = 50
    for text in texts:
        data, at = textbytes.column_bytes(pa.array([text, "", text[:40]]))
        ids, counts = own.encode(data, at)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in tokenizer.encode_batch([text, "", text[:40]], add_special_tokens=False)]
    data = textbytes.column_bytes(pa.array([LONG + " " + "y" * 5000 + " é end "]))[0]
    parts = list(token_ids.parts_of(data, 100))
    assert b"".join(x.tobytes() for x in parts) == data.tobytes() and max(map(len, parts)) < 5200
    assert sum((own.encode(x, np.array([0, len(x)]))[0].tolist() for x in parts), []) == own.encode(data, np.array([0, len(data)]))[0].tolist()


def test_other_tokenizers_get_whole_texts():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = [t or "" for _, t in EDGE[:6]] + ["Some Text, with  spaces\n"]
    ids, counts = token_ids.PieceEncoder(path).encode(*textbytes.column_bytes(pa.array(texts)))
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert not token_ids.is_wide(path) and token_ids.id_kind(70000) == "<u4"


def test_token_files_round_trip(spark, vocabulary):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    rows = EDGE + [(k, f"word{k} and more") for k in range(300, 360)]
    folder = token_ids.write_ids(token_ids.tokenize(documents(spark, rows), vocabulary), shard_tokens=20000)
    got = sorted(token_ids.checksums(token_ids.read_ids(spark, folder)).collect(), key=lambda r: r["start"])
    want = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    start = 0
    assert len(got) == len(want)
    for r, (i, ids) in zip(got, want, strict=True):
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = token_ids.write_ids(token_ids.tokenize(documents(spark, []), vocabulary))
    assert token_ids.read_ids(spark, empty).count() == 0


def test_code_lengths_are_best_within_the_limit(monkeypatch):
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    heap, total = counts.tolist(), 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a + b
        heapq.heappush(heap, a + b)
    assert (token_ids.code_lengths(counts, 16) * counts).sum() == total
    short = token_ids.code_lengths(counts, 4)
    assert short.max() <= 4 and (2.0**-short).sum() <= 1
    with pytest.raises(ValueError):
        token_ids.code_lengths(counts, 3)
    monkeypatch.setattr(token_ids, "SLICE", 2048)  # ids of a block in several slices
    book = token_ids.Codebook(np.arange(10), short)
    ids = np.random.default_rng(0).integers(0, 10, 5000)
    payload, starts = book.encode(ids)
    sizes = np.minimum(token_ids.STEP, len(ids) - np.arange(len(starts)) * token_ids.STEP)
    assert (book.decode(np.frombuffer(payload, np.uint8), starts, sizes) == ids).all()


def test_long_texts_in_parts_score_as_a_whole(monkeypatch):
    from tracelake.llm import quality_cnn, toxicity_gru

    draw = np.random.default_rng(4)
    names = ["".join(draw.choice(list("abc.!"), draw.integers(1, 12))) for _ in range(200)]
    bytes_net, window_net = quality_cnn.ByteNet(1), toxicity_gru.WindowNet(1)
    for n in (1, 31, 32, 33, 56, 57, 3000):
        data, at = textbytes.column_bytes(pa.array([" ".join(draw.choice(names, n))]))
        whole = bytes_net.score(data, at, bytes_net.tables()), window_net.score(data, at)
        with monkeypatch.context() as m:
            m.setattr(quality_cnn, "PART", 1024)
            m.setattr(toxicity_gru, "LONG", 1)
            m.setattr(toxicity_gru, "PART", 3)
            parts = bytes_net.score(data, at, bytes_net.tables()), window_net.score(data, at)
        assert np.allclose(whole, parts, atol=1e-6)


# --- WARC ---

def test_warc_round_trip(spark, tmp_path):
    body = "<p>" + "é" * 100
    rows = [(5, "http://a/1", body), (3, "http://a/2 \r\n", body), (9, None, body), (3, "http://a/2", body), (7, "u", "short"), (8, "u", "short"), (2, "u", None), (1, "u", ""), (None, "u", body), (11, "v", LONG), (12, "w", LONG)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, range int")
    root = "file://" + str(tmp_path / "warc")
    manifest = warc.write_archive(pages, root, roll=20000, range_bytes=100)
    got = warc.read_archive(manifest).drop("payload", "url").collect()
    want, used = [], set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (html or "").encode()
        first = min(r[0] for r in rows if r[2] == html and r[0] is not None)
        again = len(raw) >= 100 and (i != first or html in used)
        if len(raw) >= 100 and i == first:
            used.add(html)
        want.append((i, "revisit" if again else "response", len(raw), hashlib.sha256(raw).hexdigest(), first if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    other = warc.write_archive(pages.repartition(5), "file://" + str(tmp_path / "again"), roll=20000, range_bytes=100)
    assert sorted(map(tuple, manifest.drop("path").collect())) == sorted(map(tuple, other.drop("path").collect()))
    names = sorted(x.name for x in (tmp_path / "warc").glob("*.gz"))
    assert names == sorted(r["name"] for r in manifest.collect()) and not list((tmp_path / "warc" / "_temporary").iterdir())
    assert warc.read_archive(warc.write_archive(pages.limit(0), "file://" + str(tmp_path / "none"))).count() == 0


def test_warc_of_distant_and_null_ids(spark, tmp_path):
    """Ids at both ends of long and many without any: ranges of about equal bytes, in the order of ids and digests, rolled within."""
    draw = np.random.default_rng(6)
    ids = [-(2**63), 2**63 - 1, 0, -1, 10**15, *range(500, 600), *[None] * 80]
    rows = [(i, f"u{k}", " ".join(map(str, draw.integers(0, 10**9, 60)))) for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    narrow = warc.records(pages).select("id", "digest", F.length("body").cast("long").alias("size"))
    keys = warc.cuts(narrow, 10000)
    assert keys == sorted(keys) == warc.cuts(narrow.repartition(7), 10000)
    placed = narrow.withColumn("key", warc._key()).withColumn("range", warc.range_of(keys)).collect()
    order = sorted(placed, key=lambda r: (r["id"] is not None, r["id"] or 0, r["digest"]))
    assert [r["range"] for r in order] == sorted(r["range"] for r in placed)
    sums = {}
    for r in placed:
        sums[r["range"]] = sums.get(r["range"], 0) + r["size"] + 512
    assert len(sums) == len(keys) + 1 > 15 and max(sums.values()) < 12000
    manifest = warc.write_archive(pages, "file://" + str(tmp_path / "w"), range_bytes=20000, roll=2000)
    got = warc.read_archive(manifest).collect()
    assert sorted((r["page_id"], r["payload"].decode()) for r in got if r["page_id"] is not None) == sorted((i, h) for i, _, h in rows if i is not None) and len(got) == len(rows)
    parts = [r["name"].split("-")[2] for r in manifest.collect()]
    assert len(set(parts)) > 2 and all(r["bytes"] < 4000 for r in manifest.collect())  # the limit on compressed bytes is what ends files
    assert len(warc.cuts(narrow, 1, most=8)) <= 8


def test_words_and_shingles_equal_python():
    texts = ["", " a  b\n", "A b c d e f", "é x y", None, "x"]
    data, offsets = textbytes.column_bytes(pa.array(texts))
    starts, ends, heads = textbytes.words(data, offsets)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(heads[:-1], heads[1:], strict=True)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    row, place, _ = textbytes.shingle_rows(textbytes.span_hashes(data, starts, ends), heads)
    assert list(zip(row.tolist(), place.tolist(), strict=True)) == [(1, 0), (2, 0), (2, 1), (3, 0), (5, 0)]


def test_components_of_links_shuffle_twice_a_round(spark, monkeypatch):
    from tracelake.llm.components import components
    from tracelake.operators import reach

    rounds, plain = [], reach.written
    monkeypatch.setattr(reach, "written", lambda df, name: (rounds.append((name, str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning"))), plain(df, name))[1])
    links = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (2, 2), (7, 9), (3, 1), (None, 1)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(1, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 7)]
    assert {n for name, n in rounds if name == "pointed"} == {2}
