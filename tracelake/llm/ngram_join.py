"""Jaccard join of documents on word shingles through a forest of count-vector R-trees.

A document is the set of its distinct five-word shingles (as 64-bit hashes). Shingles are hashed into groups; the counts of
the groups are the document's point. For two points the sum of coordinate minima bounds the overlap from above, and the
same holds for the maxima of two boxes of points; pairs of boxes, then of points, that cannot reach the similarity are cut.
The more groups, the tighter the bound, and finer counts add up to coarser ones: boxes hold GROUPS groups, a document's own
vector at least as many as it has shingles. Counts are kept in two bits each; what exceeds them is added up apart, and
added to the bound. Pairs that the bound leaves are verified on the sets themselves, made anew from the two texts.

Points of unlike texts lie too close for one tree over all of them to cut much (see the README), so trees stand on blocks:
two sets as similar as asked for must share a shingle among the first ``n - ceil(t * n) + 1`` of each in any one order.
The order puts common shingles last, so that blocks stay small; the order only affects speed, never the result. Blocks of
the same documents are one. A block of at most LEAF documents is a tree of a single leaf.

Groups of near copies would make every pair of a block a link. Documents of larger blocks are therefore first compared with
a few pivots of their blocks; verified links give provisional components, and the trees then search only pairs of different
components. Every link between different components is found, so
components are exact. A pair that meets in several blocks is told in the first; where it is not among the FIRSTS first
blocks of both, it may be told again.

Defined results: null or empty text has an empty set and links with nothing; shorter texts have one shingle, their whole
word sequence; rows of equal sets are linked; rows that share an id are one document; rows of null id have a null
component; very long texts are hashed in parts, and their sets have to fit a task; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.components import components
from tracelake.llm.keybits import bits_of, has_bit
from tracelake.llm.shared import small_batches, spent, written
from tracelake.llm.textbytes import LOWER, column_bytes, mixed, pieces, shingle_rows, word_hashes

GROUPS, FANOUT, LEAF, TILE, PIVOTS, FIRSTS = 64, 8, 16, 4096, 6, 8
OPENED = 1 << 12
SHINGLE = 5
COMMON_SHARE, COMMON_LEAST, COMMON_MOST, SEEN_LEAST, FLUSH = 0.001, 32, 200_000, 3, 2_000_000
PART, SEEN_MOST = 1 << 19, 50_000
LINKS = "a long, b long"


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct shingles of each row, ascending, and how many."""
    data, offsets = column_bytes(column)
    hashes, heads = word_hashes(LOWER[data], offsets)
    row, _, shingle = shingle_rows(hashes, heads, width)
    at = np.searchsorted(row, np.arange(len(column) + 1)).tolist()
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = np.sort(shingle[a:b])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else own)
    return sets, np.array([len(x) for x in sets], np.int64)


def common_shingles(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of about COMMON_SHARE of all rows or more, at most COMMON_MOST of them, with their counts, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, docs = [], 0, 0

        def flush():
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(SEEN_LEAST, int(docs * COMMON_SHARE / 2))
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often]), pa.array(np.zeros(int(often.sum()), np.int64))], ["s", "n", "docs"])

        for batch in pieces(batches, "text", PART):
            sets, sizes = shingle_sets(batch.column("text"), width)
            held += sets
            n += int(sizes.sum())
            docs += batch.num_rows
            if n > FLUSH:
                yield flush()
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([docs])], ["s", "n", "docs"])
                held, n, docs = [], 0, 0
        if held:
            yield flush()
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([docs])], ["s", "n", "docs"])

    seen = written(rows.mapInArrow(run, "s long, n long, docs long").groupBy("s").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "common")
    total = seen.agg(F.sum("docs")).first()[0] or 0
    found = seen.filter(F.col("n") >= max(COMMON_LEAST, int(total * COMMON_SHARE))).select("s", "n").orderBy(F.desc("n"), "s").limit(COMMON_MOST).toArrow()
    spent(seen)
    shingles, counts = found["s"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def counted(shingles: np.ndarray, groups: int) -> tuple[np.ndarray, int]:
    """Counts of the groups, two bits each (those of the later quarters in the upper bits), and the sum of what exceeds them."""
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    low = np.minimum(counts, 3).astype(np.uint8).reshape(4, -1)
    return low[0] | (low[1] << 2) | (low[2] << 4) | (low[3] << 6), int(np.maximum(counts - 3, 0).sum())


def counts_of(point: bytes) -> np.ndarray:
    x = np.frombuffer(point, np.uint8)
    return np.concatenate([x & 3, (x >> 2) & 3, (x >> 4) & 3, x >> 6])


def folded_counts(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same counts in fewer groups."""
    return counts.reshape(-1, groups).sum(0, dtype=np.int32)


def groups_for(n: int) -> int:
    """A power of two of at least n, from GROUPS to 131072."""
    return min(max(1 << max(n - 1, 1).bit_length(), GROUPS), 1 << 17)


PROFILE = "id long, n long, f1 long, f2 long, point binary, over long, prefix array<long>"


def _profile(common, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = common.value
        seen: set[tuple[int, int, int]] = set()
        for batch in pieces(batches, "text", PART):
            sets, n = shingle_sets(batch.column("text"), width)
            point, prefix, sums = [], [], []
            first = n - -(-n * percent // 100) + 1
            known = batch.column("id").is_valid().to_pylist()
            for own, size, k, has_id in zip(sets, n.tolist(), first.tolist(), known, strict=True):
                point.append(counted(own, groups_for(size)))
                sums.append([int(mixed(own ^ np.uint64(salt)).sum()) for salt in (0x51ED270B, 0xA5A5F00D1234567)])
                # a set that this task has just told under another id need not be told again: equal sets are linked apart
                key = (size, *sums[-1])
                if not size or not has_id or key in seen:
                    prefix.append(None)
                    continue
                if len(seen) >= SEEN_MOST:
                    seen.clear()
                seen.add(key)
                if len(often):
                    place = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    weight = np.where(often[place] == own, counts[place], 0)
                    own = own[np.lexsort([own, weight])] if weight.any() else own
                prefix.append(own[:k].view(np.int64))
            f1, f2 = (np.array([x[k] for x in sums], np.uint64).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n), pa.array(f1), pa.array(f2), pa.array([x[0].tobytes() for x in point], pa.binary()), pa.array([x[1] for x in point], pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                ["id", "n", "f1", "f2", "point", "over", "prefix"],
            )

    return run


def bound_holds(overlap: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of at most so many leaves room for the similarity: t <= I / (n_a + n_b - I)."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def overlap_bound(a: bytes | np.ndarray, b: bytes | np.ndarray, over: int) -> int:
    """Summed minima of two count vectors (packed or not), the finer one folded to the coarser."""
    x, y = (counts_of(v) if isinstance(v, bytes) else v for v in (a, b))
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = folded_counts(y, len(x))
    return int(np.minimum(x, y).sum(dtype=np.int64)) + over


class Tree:
    """R-tree over points in a given order: FANOUT entries a box, each with its corner of maxima and its range of sizes."""

    def __init__(self, points: np.ndarray, over: np.ndarray, n: np.ndarray, label: np.ndarray):
        self.levels = [(points, over, n, n, label, label)]
        while len(self.levels[-1][0]) > 1:
            top, over, low, high, first, last = self.levels[-1]
            cuts = np.arange(0, len(top), FANOUT)
            self.levels.append((*(np.maximum.reduceat(x, cuts) for x in (top, over)), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)))


def tree_pairs(a: Tree, b: Tree, percent: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points (of one tree with itself if ``own``, i < j) of different labels that the bound leaves, some at a time."""
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    waiting = [(max(len(a.levels), len(b.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:  # pairs of boxes of one level, few at a time, so that what they open to stays small
        k, i, j = waiting.pop()
        (pa_, oa, la, ha, fa, za), (pb_, ob, lb, hb, fb, zb) = level(a, k), level(b, k)
        ok = (100 * ha[i] >= percent * lb[j]) & (100 * hb[j] >= percent * la[i])
        ok &= ~((fa[i] == za[i]) & (fb[j] == zb[j]) & (fa[i] == fb[j]))
        if own and k == 0:
            ok &= i != j
        i, j = i[ok], j[ok]
        kept = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 14):
            x, y = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            overlap = np.minimum(pa_[x], pb_[y]).sum(1, dtype=np.int64) + np.minimum(oa[x], ob[y])
            kept[s : s + (1 << 14)] = bound_holds(overlap, la[x], lb[y], percent)
        i, j = i[kept], j[kept]
        if k == 0:
            if len(i):
                yield i, j
            continue
        for s in range(0, len(i), OPENED):
            x, y = i[s : s + OPENED], j[s : s + OPENED]
            for tree, side in ((a, 0), (b, 1)):
                if k <= len(tree.levels) - 1:
                    box = (x, y)[side]
                    fan = np.minimum(len(tree.levels[k - 1][0]) - box * FANOUT, FANOUT)
                    away = np.arange(int(fan.sum())) - np.repeat(np.cumsum(fan) - fan, fan)
                    opened = np.repeat(box * FANOUT, fan) + away
                    x, y = (opened, np.repeat(y, fan)) if side == 0 else (np.repeat(x, fan), opened)
            if own:
                x, y = x[x <= y], y[x <= y]
            if len(x):
                waiting.append((k - 1, x, y))


def tree_join(a: Tree, b: Tree, percent: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``tree_pairs``."""
    found = [(np.zeros(0, np.int64),) * 2, *tree_pairs(a, b, percent, own)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class FineCounts:
    """Documents' own count vectors; a pair is bounded at the length of the shorter one, the other one folded to it."""

    def __init__(self, points: list[bytes], over: np.ndarray, n: np.ndarray):
        self.counts, self.over, self.n = [counts_of(x) for x in points], over, n
        self.length = np.array([len(x) for x in self.counts])

    def leave(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which of the pairs the bound leaves."""
        length, ok = np.minimum(self.length[i], self.length[j]), np.zeros(len(i), bool)
        for groups in np.unique(length).tolist():
            own = np.flatnonzero(length == groups)
            rows = np.unique(np.concatenate([i[own], j[own]]))
            vectors = np.stack([folded_counts(self.counts[r], groups) for r in rows]).astype(np.uint16)
            for s in range(0, len(own), step := max(1, (1 << 22) // groups)):
                k = own[s : s + step]
                overlap = np.minimum(vectors[np.searchsorted(rows, i[k])], vectors[np.searchsorted(rows, j[k])]).sum(1, dtype=np.int64) + np.minimum(self.over[i[k]], self.over[j[k]])
                ok[k] = bound_holds(overlap, self.n[i[k]], self.n[j[k]], percent)
        return ok


def _search(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by block (token, t, u): the pairs that each block's tree (or two trees) leaves."""
        held: list[pa.RecordBatch] = []

        def candidates(points, n, label, over, side, keys) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            # trees of one leaf: all of them at once, each row with the rows next to it
            leaf = np.repeat((sizes <= LEAF) & (keys[cuts[:-1], 1] == keys[cuts[:-1], 2]), sizes)
            block = np.repeat(np.arange(len(sizes)), sizes)
            for away in range(1, min(LEAF, len(keys))):
                i = np.flatnonzero(leaf[:-away] & (block[:-away] == block[away:]) & (label[:-away] != label[away:]))
                j = i + away
                near = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
                i, j = i[near], j[near]
                ok = bound_holds(np.minimum(points[i], points[j]).sum(1, dtype=np.int64) + np.minimum(over[i], over[j]), n[i], n[j], percent)
                yield i[ok], j[ok]
            for low, high in ((x, y) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if not leaf[x]):
                order = low + np.lexsort([n[low:high], label[low:high]])
                if keys[low, 1] == keys[low, 2]:
                    tree = Tree(points[order], over[order], n[order], label[order])
                    yield from ((order[i], order[j]) for i, j in tree_pairs(tree, tree, percent, True))
                else:
                    x, y = (order[side[order] == keys[low, k]] for k in (1, 2))
                    if len(x) and len(y):
                        yield from ((x[i], y[j]) for i, j in tree_pairs(*(Tree(points[z], over[z], n[z], label[z]) for z in (x, y)), percent, False))

        def searched(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, n, label, over, side = (rows[c].to_numpy() for c in ("id", "n", "component", "over", "side"))
            fine = FineCounts(rows["point"].to_pylist(), over, n)
            points = np.array([folded_counts(x, GROUPS) for x in fine.counts], np.int32)
            keys = np.stack([rows[c].to_numpy() for c in ("token", "t", "u")], 1)
            firsts = np.full((len(ids), FIRSTS), np.iinfo(np.int64).max)
            for k, x in enumerate(rows["firsts"].to_pylist()):
                firsts[k, : len(x)] = x
            for i, j in candidates(points, n, label, over, side, keys):
                good = fine.leave(i, j, percent)
                i, j = i[good], j[good]
                new = np.ones(len(i), bool)
                for s in range(0, len(i), 1 << 13):  # an earlier block has the pair too: a token of both that is less than this block's
                    x, y = firsts[i[s : s + (1 << 13)]], firsts[j[s : s + (1 << 13)]]
                    new[s : s + (1 << 13)] = ~((x[:, :, None] == y[:, None, :]) & (x < keys[i[s : s + (1 << 13)], :1])[:, :, None]).any((1, 2))
                pairs = np.unique(np.stack([np.minimum(ids[i[new]], ids[j[new]]), np.maximum(ids[i[new]], ids[j[new]])], 1), axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("token", "t", "u")], 1)
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
            if held and [held[-1].column(c)[-1].as_py() for c in ("token", "t", "u")] != keys[0].tolist():
                yield from searched(pa.Table.from_batches(held))
                held = []
            if len(changes):
                cut = int(changes[-1]) + 1
                yield from searched(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from searched(pa.Table.from_batches(held))

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by (b, salt) with b's own text first: which of the following sets are similar enough to it."""
        now, lead = None, []
        for batch in pieces(batches, "text", PART):
            sets, _ = shingle_sets(batch.column("text"), width)
            a, b, salt = (batch.column(c).to_pylist() for c in ("a", "b", "salt"))
            good = np.zeros(len(a), bool)
            for k, own in enumerate(sets):
                if (b[k], salt[k]) != now:
                    now, lead = (b[k], salt[k]), []
                if a[k] == b[k]:
                    lead.append(own)
                    continue
                for other in lead:
                    place = np.minimum(np.searchsorted(other, own), max(len(other) - 1, 0))
                    both = int((other[place] == own).sum()) if len(other) else 0
                    good[k] |= both > 0 and (100 + percent) * both >= percent * (len(own) + len(other))
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return run


def verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int, salt_rows: int = 512) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked for; sets are made anew from the texts of the documents in question."""
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    bits = rows.sparkSession.sparkContext.broadcast(bits_of(ends, "id"))

    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits.value, batch.column("id").to_numpy())))

    texts = rows.mapInArrow(asked_for, "id long, text string")
    # the second document of a pair leads its group; a group with many partners is dealt out, its lead copied to each part
    salts = pairs.groupBy("b").agg((F.floor(F.count(F.lit(1)) / salt_rows) + 1).cast("int").alias("salts"))
    dealt = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"))
    leads = salts.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asked = dealt.unionByName(leads)
    joined = asked.join(texts, F.col("a") == F.col("id")).select("a", "b", "salt", "text")
    links = written(joined.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a") != F.col("b")).mapInArrow(_verify(width, percent), LINKS), "links")
    spent(pairs)
    return links


def _pivot_bounds(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that sizes and the counts leave."""
        for batch in batches:
            over = np.minimum(*(batch.column(c).to_numpy() for c in ("oa", "o"))).tolist()
            overlap = np.array([overlap_bound(x, y, z) for x, y, z in zip(batch.column("va").to_pylist(), batch.column("v").to_pylist(), over, strict=True)], np.int64)
            ok = pa.array(bound_holds(overlap, batch.column("na").to_numpy(), batch.column("m").to_numpy(), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return run


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that it reaches by links)."""
    spark = small_batches(docs).sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(rows, width))
    profile = written(rows.mapInArrow(_profile(common, width, percent), PROFILE), "profiles")
    given = profile.filter("id is not null and n > 0")
    rows = rows.filter("id is not null")
    # rows of equal sets have one representative, the smallest id; settled first, so that Spark can split a hot set's rows in the join
    same = ["n", "f1", "f2"]
    reps = written(given.groupBy(*same).agg(F.min("id").alias("rep")), "sets")
    narrow = written(given.select("id", *same).join(reps, same).select("id", "rep", "n").distinct(), "representatives")
    # blocks: the prefix shingles that several documents share; of blocks with the same documents one
    prefix = given.select(F.explode("prefix").alias("token"), "id").filter("token is not null").repartition("token")
    marks = [F.sum(F.xxhash64("id", F.lit(k)).bitwiseAND(0x7FFFFFFF)).alias(f"m{k}") for k in (1, 2)]
    shared = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), *marks, F.min(F.xxhash64("id", F.lit(3))).alias("m3")).filter("docs > 1")
    shared = shared.groupBy("docs", "m1", "m2", "m3").agg(F.min("token").alias("token")).select("token")
    members = prefix.join(shared.hint("shuffle_hash"), "token")
    block = written(members.join(narrow, "id").select("token", F.col("rep").alias("id"), "n").distinct(), "blocks")
    points = given.join(narrow.filter("id = rep").select(F.col("id").alias("r"), F.col("n").alias("m")), (F.col("id") == F.col("r")) & (F.col("n") == F.col("m")), "left_semi")
    points = written(points.select(F.col("id").alias("i"), F.col("n").alias("m"), F.col("point").alias("v"), F.col("over").alias("o")).distinct(), "points")
    sizes = written(profile.select("id", "n"), "set-sizes")
    # rows of one id may have several sets of one size, which (id, n) does not tell apart
    alike = written(reps.groupBy(F.col("rep").alias("h"), F.col("n").alias("m")).count().filter("count > 1").select("h", "m", F.lit(True).alias("alike")), "alike")
    spent(profile, reps)

    # first links: each document of a larger block with the first of its blocks' pivots, in each of a few orders
    pivots = [F.min(F.struct(F.xxhash64("id", F.lit(10 + k)).alias("h"), "id", "n")).alias(f"p{k}") for k in range(PIVOTS)]
    led = block.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), *pivots).filter(f"docs > {LEAF // 4}").drop("docs")
    near = lambda p: (F.col("id") != F.col(f"{p}.id")) & (100 * F.col("n") >= percent * F.col(f"{p}.n")) & (100 * F.col(f"{p}.n") >= percent * F.col("n"))
    firsts = block.join(led, "token").groupBy(F.col("id").alias("a")).agg(*[F.min(F.when(near(f"p{k}"), F.col(f"p{k}"))).alias(f"p{k}") for k in range(PIVOTS)])
    stars = firsts.select("a", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}.id") for k in range(PIVOTS)]))).alias("b")).filter("b is not null")
    ends = stars.join(points, F.col("a") == F.col("i")).select("a", "b", F.col("m").alias("na"), F.col("v").alias("va"), F.col("o").alias("oa"))
    ends = ends.join(points, F.col("b") == F.col("i")).filter(f"100 * na >= {percent} * m and 100 * m >= {percent} * na")
    ends = ends.select("a", "b", "na", "m", "va", "oa", "v", "o").mapInArrow(_pivot_bounds(percent), LINKS)
    first = verified(ends, rows, width, percent)
    so_far = components(first)

    # then the trees: blocks whose documents are of several components, large ones in tiles
    labels = written(block.join(so_far.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", F.coalesce("component", "id").alias("component")), "labelled")
    # of a block only documents go on that have one of another component in their own or a neighbouring band of sizes
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * 1.001)).cast("int") if percent < 100 else F.col("n")
    labelled = labels.withColumn("band", band)
    seen = [F.min("c1").alias("c1"), F.max("c2").alias("c2")]
    bands = labelled.groupBy("token", "band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("docs"))
    about = bands.select("token", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])).alias("band"), "c1", "c2")
    about = about.groupBy("token", "band").agg(*seen).filter("c1 <> c2").select("token", "band")
    open_ = written(bands.select("token", "band", "docs").join(about, ["token", "band"], "left_semi"), "bands")
    several = open_.groupBy("token").agg(F.ceil(F.sum("docs") / TILE).cast("int").alias("tiles"))
    tiled = labelled.join(open_.select("token", "band"), ["token", "band"], "left_semi").join(several, "token")
    # with the first blocks of each document among those that are searched: by them a pair is told in one block only
    held = tiled.groupBy(F.col("id").alias("h"), F.col("n").alias("m")).agg(F.slice(F.array_sort(F.collect_set("token")), 1, FIRSTS).alias("firsts"))  # a prefix at most
    held = held.join(alike, ["h", "m"], "left").withColumn("firsts", F.when(F.col("alike"), F.array().cast("array<long>")).otherwise(F.col("firsts")))
    held = held.join(points.withColumnsRenamed({"i": "h"}), ["h", "m"]).select("h", "firsts", "m", F.col("v").alias("point"), F.col("o").alias("over"))
    tiled = tiled.withColumn("side", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("token", "id", "n", "component", "side", F.least("side", "other").alias("t"), F.greatest("side", "other").alias("u"))
    leaves = tiled.join(held, (F.col("id") == F.col("h")) & (F.col("n") == F.col("m"))).select("token", "t", "u", "side", "id", "n", "component", "point", "over", "firsts")
    pairs = leaves.repartition("token", "t", "u").sortWithinPartitions("token", "t", "u").mapInArrow(_search(percent), LINKS)
    second = verified(pairs.distinct(), rows, width, percent)
    linked = so_far.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)
    # rows that share an id are one document: link their representatives
    of_id = narrow.groupBy("id").agg(F.min("rep").alias("r1"), F.max("rep").alias("r2"))
    twice = of_id.filter("r1 <> r2").select("id", "r1")
    linked = linked.unionByName(narrow.join(twice, "id").select(F.col("rep").alias("a"), F.col("r1").alias("b")))
    final = written(of_id.select(F.col("id").alias("i"), F.col("r1").alias("rep")).join(components(linked).select(F.col("node").alias("rep"), "component"), "rep", "left").select("i", F.coalesce("component", "rep").alias("c")), "components")
    out = written(sizes.join(final, F.col("id") == F.col("i"), "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id")), "classes")
    spent(sizes, alike, narrow, block, points, first, so_far, labels, open_, second, final)
    return out
