"""Reach without paths: of a set of nodes, of many seeds at once, and components.

A set's reach is a frontier of (repo_id, node) alone, and without a bound on the hops it is the components that hold a node of the set. For many
seeds, 64 of them share a word: a row is a node with the mask of the seeds of one block that are there, and a hop is one join and
one ``bit_or``. Rows and shuffles grow with nodes times blocks, until the masks are told apart at the end, where they are.
Every hop is written to the shared folder and deleted when it is used up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.tables import bucketed, dealt, spent, written

WORD = 64


def both_ways(edges: DataFrame, once: bool = True) -> DataFrame:
    """(repo_id, node, next) of edges (repo_id, source, target), in either direction; each once, unless what follows bears rows more than once."""
    ends = F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("next")) for a, b in (("source", "target"), ("target", "source"))])
    both = edges.select("repo_id", F.inline(ends))
    return both.distinct() if once else both


def neighbours(edges: DataFrame) -> DataFrame:
    """``both_ways``, each once, as a table in buckets by node."""
    return bucketed(dealt(both_ways(edges, once=False), "repo_id", "node").distinct(), "near", "repo_id", "node")


def components(edges: DataFrame, most_rounds: int = 50, deal: Callable[..., DataFrame] = dealt) -> DataFrame:
    """(repo_id, node, component) of every node with an edge to another one; ``component`` is the smallest node it reaches.

    By alternating stars: each round points every node's larger neighbours, then its smaller ones, at the smallest node that it sees, so that
    rounds grow with the logarithm of the nodes. A node at which none is pointed is a leaf then: it is set aside with the node that it points at, and
    later rounds have only the others. Once no links are left, leaves are named from the last round to the first. A round shuffles its
    links both ways by node, and what it points at what, once each. ``deal`` shuffles rows by keys.
    """
    links, rounds = edges.select("repo_id", "source", "target").filter("source <> target"), []
    while not rounds or not links.isEmpty():
        if len(rounds) == most_rounds:
            raise RuntimeError(f"links are left after {most_rounds} rounds")
        rounds.append(_pointed(links, deal))
        links = rounds[-1].filter("kept").drop("kept")
    named = None
    for leaves in reversed(rounds):
        own = leaves.filter("not kept").select("repo_id", F.col("source").alias("node"), F.col("target").alias("component"))
        if named is not None:
            above = named.select("repo_id", F.col("node").alias("component"), F.col("component").alias("top"))
            own = named.unionByName(own.join(above, ["repo_id", "component"], "left").select("repo_id", "node", F.coalesce("top", "component").alias("component")))
        last, named = named, written(own, "named")
        spent(leaves, *([] if last is None else [last]))
    return named.unionByName(named.select("repo_id", F.col("component").alias("node"), "component").distinct())


def _pointed(links: DataFrame, deal: Callable[..., DataFrame]) -> DataFrame:
    """A round of ``components``: (repo_id, source, target, kept) of links (repo_id, source, target), where rows that are not kept are the leaves."""
    rows = lambda *order: Window.partitionBy("repo_id", "node").orderBy(*order)
    upto = lambda c: rows(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = deal(both_ways(links, once=False), "repo_id", "node").withColumns({"low": F.least("node", F.min("next").over(upto("next"))), "before": F.lag("next").over(rows("next"))})
    near = near.filter("next > node and (before is null or before <> next)")
    # a node at which others are pointed is told so, once by each node that points there: a row without ``lower``
    told = F.when((F.col("low") < F.col("node")) & (F.col("before").isNull() | (F.col("before") < F.col("node"))), F.struct(F.col("low").alias("node"), F.lit(None).alias("lower")))
    sent = near.select("repo_id", F.inline(F.array_compact(F.array(F.struct(F.col("next").alias("node"), F.col("low").alias("lower")), told))))
    got = deal(sent, "repo_id", "node").withColumns({"low": F.min("lower").over(upto("lower")), "told": F.max(F.col("lower").isNull()).over(upto("lower")), "before": F.lag("lower").over(rows("lower"))})
    got = got.filter("lower is not null and (before is null or before <> lower)")
    first = F.col("lower") == F.col("low")
    return written(got.select("repo_id", F.when(first, F.col("node")).otherwise(F.col("lower")).alias("source"), F.col("low").alias("target"), (~first | F.col("told")).alias("kept")), "pointed")


def reach_of_set(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(repo_id, node): the nodes that any of the seeds (repo_id, node) reaches over edges in either direction, themselves included."""
    own = seeds.select("repo_id", "node").distinct()
    if max_depth is None:
        parts = components(edges)
        hit = written(parts.join(own, ["repo_id", "node"], "left_semi").select("repo_id", "component").distinct(), "hit")
        return parts.join(hit, ["repo_id", "component"], "left_semi").select("repo_id", "node").unionByName(own).distinct()
    near, front = written(both_ways(edges), "near"), written(own, "hop")
    hops = [front]
    for _ in range(max_depth):
        known = front if len(hops) < 2 else front.unionByName(hops[-2])  # edges go both ways: a hop leads on, or to the last two
        reached = front.join(near, ["repo_id", "node"]).select("repo_id", F.col("next").alias("node")).distinct()
        front = written(reached.join(known, ["repo_id", "node"], "left_anti"), "hop")
        hops.append(front)
        if front.isEmpty():
            break
    return _gathered(hops, near)


def _gathered(hops: list[DataFrame], *used: DataFrame) -> DataFrame:
    out = hops[0]
    for hop in hops[1:]:
        out = out.unionByName(hop)
    out = written(out, "reached")
    spent(*used, *hops)
    return out


def reach_masks(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The seeds (repo_id, seed, number), and who reaches what: (repo_id, node, block, mask, depth), where bit k of the mask is the seed numbered
    ``WORD * block + k``. Edges and hops lie in buckets by node, so that a hop shuffles what it finds, once, and nothing else.
    """
    numbered = seeds.select("repo_id", F.col("node").alias("seed")).distinct().repartitionByRange("repo_id", "seed").sortWithinPartitions("repo_id", "seed")
    numbered = written(numbered.withColumn("number", F.monotonically_increasing_id()), "seeds")
    near = neighbours(edges)
    bit = F.col("number").bitwiseAND(WORD - 1).cast("int")
    first = numbered.select("repo_id", F.col("seed").alias("node"), F.shiftright("number", 6).alias("block"), bit.alias("bit")).withColumn("mask", F.expr("shiftleft(1L, bit)"))
    hops = [bucketed(first.select("repo_id", "node", "block", "mask", F.lit(0).alias("depth")), "hop", "repo_id", "node")]
    while (max_depth is None or len(hops) <= max_depth) and not hops[-1].isEmpty():
        reached = hops[-1].drop("depth").join(near, ["repo_id", "node"]).select("repo_id", F.col("next").alias("node"), "block", "mask", F.lit(0).cast("long").alias("known"))
        both = dealt(reached, "repo_id", "node")
        for hop in hops[-2:]:  # edges go both ways: a hop leads on, or to the last two
            both = both.unionByName(hop.select("repo_id", "node", "block", F.lit(0).cast("long").alias("mask"), F.col("mask").alias("known")))
        new = both.groupBy("repo_id", "node", "block").agg(F.bit_or("mask").alias("mask"), F.bit_or("known").alias("known"))
        hops.append(bucketed(new.select("repo_id", "node", "block", F.col("mask").bitwiseAND(F.bitwise_not("known")).alias("mask"), F.lit(len(hops)).alias("depth")).filter("mask <> 0"), "hop", "repo_id", "node"))
    spent(near)
    masks = hops[0]
    for hop in hops[1:]:
        masks = masks.unionByName(hop)
    return numbered, masks


def told_apart(masks: DataFrame) -> DataFrame:
    """Rows with ``block`` and ``mask``: one for each seed in the mask, with its ``number``."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.getbit(F.col("mask"), k) == 1)
    return masks.withColumn("bit", F.explode(bits)).withColumn("number", F.col("block") * WORD + F.col("bit")).drop("block", "mask", "bit")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """G3 without paths: (repo_id, seed, node, depth): every node that a seed (repo_id, node) reaches over edges in either direction, once."""
    numbered, masks = reach_masks(edges, seeds, max_depth)
    names = numbered.groupBy("repo_id", F.shiftright("number", 6).alias("block")).agg(F.collect_list(F.struct(F.col("number").bitwiseAND(WORD - 1).cast("int").alias("bit"), "seed")).alias("seeds"))  # at most 64
    found = masks.join(names, ["repo_id", "block"]).select("repo_id", "node", "depth", F.explode(F.filter("seeds", lambda x: F.getbit(F.col("mask"), x["bit"]) == 1)).alias("x"))
    return found.select("repo_id", F.col("x.seed").alias("seed"), "node", "depth")
