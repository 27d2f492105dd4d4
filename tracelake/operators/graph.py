"""The contract graph: nodes and edges, and what can be reached on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.labels import CALLS, MODELS, ROUTES
from tracelake.functions.paths import call_id, symbol_id
from tracelake.operators.reach import components, neighbours, reach_masks, reach_of_set, told_apart
from tracelake.sources.tables import bucketed, dealt, spent, written

KIND = {"call": CALLS, "route": ROUTES, "model": MODELS}
#: Pieces of targets that are broadcast: some 20 MB.
PIECES = 1 << 18


def last_definition(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows with equal keys the last in path, then file order."""
    order = Window.partitionBy("repo_id", *keys).orderBy(F.desc("path"), F.desc("ordinal"))
    return rows.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target), the last written; ranked matches are written best first, so the lowest confidence."""
    order = Window.partitionBy("repo_id", "source", "target").orderBy(F.coalesce("confidence", F.lit(1.0)), "relation")
    return edges.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def build_nodes(calls: DataFrame, routes: DataFrame, models: DataFrame) -> DataFrame:
    """G1: (repo_id, id, node_type, path, line, symbol), one row per id."""
    parts = [
        calls.select("repo_id", call_id(F.col("path"), F.col("line")).alias("id"), F.lit(CALLS[1]).alias("node_type"), "path", "line", F.lit(None).cast("string").alias("symbol"), "ordinal"),
        routes.select("repo_id", symbol_id(F.col("path"), F.col("handler")).alias("id"), F.lit(ROUTES[1]).alias("node_type"), "path", "line", F.col("handler").alias("symbol"), "ordinal"),
        models.select("repo_id", symbol_id(F.col("path"), F.col("class_name")).alias("id"), F.lit(MODELS[1]).alias("node_type"), "path", "line", F.col("class_name").alias("symbol"), "ordinal"),
    ]
    return last_definition(parts[0].unionByName(parts[1]).unionByName(parts[2]), "id").drop("ordinal")


def link_routes_to_models(routes: DataFrame, models: DataFrame) -> DataFrame:
    """(repo_id, source, target) from each route to the last definition of each class that it refers to."""
    named = last_definition(models, "class_name").select("repo_id", "class_name", symbol_id(F.col("path"), F.col("class_name")).alias("target"))
    refs = routes.select("repo_id", F.col("route_id").alias("source"), F.explode("model_refs").alias("class_name"))
    return refs.join(named, ["repo_id", "class_name"]).select("repo_id", "source", "target").distinct()


def link_models(models: DataFrame) -> DataFrame:
    """(repo_id, source, target) from each class to the last definition of each class that it relates to."""
    last = last_definition(models, "class_name").withColumn("id", symbol_id(F.col("path"), F.col("class_name")))
    refs = last.select("repo_id", F.col("id").alias("source"), F.explode("relationships").alias("class_name"))
    return refs.join(last.select("repo_id", "class_name", F.col("id").alias("target")), ["repo_id", "class_name"]).select("repo_id", "source", "target").distinct()


def build_edges(matches: DataFrame, route_models: DataFrame, model_links: DataFrame) -> DataFrame:
    """The three relations as edges, one per (source, target); calls carry their confidence and parameter map."""
    none = [F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("is_exact"), F.lit(None).cast("map<string,string>").alias("param_map")]
    edges = matches.select("repo_id", F.col("call_id").alias("source"), F.col("route_id").alias("target"), F.lit("calls").alias("relation"), F.lit("FETCHES").alias("relation_type"), "confidence", "is_exact", "param_map")
    edges = edges.unionByName(route_models.select("repo_id", "source", "target", F.lit("accesses").alias("relation"), F.lit("USES_MODEL").alias("relation_type"), *none))
    return dedupe_edges(edges.unionByName(model_links.select("repo_id", "source", "target", F.lit("relates_to").alias("relation"), F.lit("RELATIONSHIP").alias("relation_type"), *none)))


def nodes_by_type(nodes: DataFrame, kind: str) -> DataFrame:
    """nodes of kind call, route or model, in either vocabulary."""
    return nodes.filter(F.col("node_type").isin(*KIND[kind]))


def blast_radius(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(repo_id, seed, node, depth, path): every node that a seed reaches over edges in either direction, once, with the
    smallest of its shortest paths. Seeds are (repo_id, node). One join per hop; each hop is written, so lineage stays short, in buckets by node, as
    the edges are, so that a hop shuffles what it finds, once. As edges go both ways, a hop leads to the next depth or to the two last
    ones, so that only these are left out of it. Where the paths are not asked for, ``reach.reach`` finds the rest with a fraction of the rows.
    """
    near = neighbours(edges)
    hops = [bucketed(_starts(seeds), "hop", "repo_id", "node")]
    while (max_depth is None or len(hops) <= max_depth) and not hops[-1].isEmpty():
        steps = _steps(len(hops))
        both = dealt(_longer(hops[-1], near, len(hops)).withColumn("known", F.lit(None).cast("boolean")), "repo_id", "node")
        for hop in hops[-2:]:
            both = both.unionByName(hop.select("repo_id", "seed", "node", F.lit(True).alias("known")), allowMissingColumns=True)
        least = [F.min(F.when(F.col("known").isNull(), F.struct(*steps))).alias("least")] if steps else []
        new = both.groupBy("repo_id", "node", "seed").agg(F.max("known").alias("known"), *least).filter("known is null")
        hops.append(bucketed(new.select("repo_id", "seed", *[f"least.{c}" for c in steps], "node"), "hop", "repo_id", "node"))
    return _together(hops, near)


def _starts(seeds: DataFrame) -> DataFrame:
    return seeds.select("repo_id", F.col("node").alias("seed"), "node").distinct()


def _steps(depth: int) -> list[str]:
    """The columns of a hop that hold the nodes between its seed and its node."""
    return [f"step{k}" for k in range(1, depth)]


def _longer(hop: DataFrame, near: DataFrame, depth: int) -> DataFrame:
    """The rows of a hop carried on to their neighbours at ``depth``, without those that they came by: (repo_id, seed, steps, node). A path is
    columns here, and neither seed nor node are held twice: these rows are what a hop shuffles and writes.
    """
    steps = _steps(depth - 1)
    on = hop.join(near, ["repo_id", "node"]).filter(~F.col("next").isin(*[F.col(c) for c in ("seed", *steps, "node")]))
    return on.select("repo_id", "seed", *steps, *[F.col("node").alias(c) for c in _steps(depth)[-1:]], F.col("next").alias("node"))


def _together(hops: list[DataFrame], *used: DataFrame) -> DataFrame:
    """The rows of all hops with their depths and paths; tables that nothing reads any more go."""
    spent(*used)
    paths = [hop.select("repo_id", "seed", "node", F.lit(k).alias("depth"), F.array(*(["seed"] if k else []), *_steps(k), "node").alias("path")) for k, hop in enumerate(hops)]
    return reduce(DataFrame.unionByName, paths)


def simple_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """(repo_id, seed, node, depth, path): every cycle-free path of up to so many edges. Edges and hops lie in buckets by node, so that a hop
    shuffles its own rows, once; the last one, which is most of the rows, is neither shuffled nor written: it is joined where it is read.
    """
    near = neighbours(edges)
    hops = [bucketed(_starts(seeds), "hop", "repo_id", "node")]
    for depth in range(1, max_depth + 1):
        if hops[-1].isEmpty():
            return _together(hops, near)
        longer = _longer(hops[-1], near, depth)
        hops.append(bucketed(longer, "hop", "repo_id", "node") if depth < max_depth else longer)
    return _together(hops)


def paths_by_depth(paths: DataFrame) -> DataFrame:
    """T3"""
    return paths.orderBy("depth", "path")


def _counting(nodes: DataFrame) -> DataFrame:
    """Nodes with what each counts for: (repo_id, node, file, one, call, route). Of a node in several files the first counts, the others are files alone."""
    same = Window.partitionBy("repo_id", "node")
    rows = nodes.select("repo_id", F.col("id").alias("node"), F.col("path").alias("file"), *[F.col("node_type").isin(*kind).cast("long").alias(name) for kind, name in ((CALLS, "call"), (ROUTES, "route"))])
    first = (F.row_number().over(same.orderBy("file")) == 1).cast("long")
    return rows.select("repo_id", "node", "file", first.alias("one"), *[(first * F.coalesce(F.max(c).over(same), F.lit(0))).alias(c) for c in ("call", "route")])


def _summed(rows: DataFrame, *seed: str) -> DataFrame:
    """Rows (seed, file, one, call, route) shuffled once: by seed and file, then by seed."""
    per_file = rows.repartition(*seed).groupBy(*seed, "file").agg(*[F.sum(c).alias(c) for c in ("one", "call", "route")])
    return per_file.groupBy(*seed).agg(F.sum("one").alias("n_nodes"), F.count("file").alias("n_files"), F.sum("call").alias("n_calls"), F.sum("route").alias("n_routes"), F.sort_array(F.collect_list("file")).alias("files"))


def blast_summary(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per seed, how many nodes, files, calls and routes are reached (each node once, as G3 has them), and which files; the seed itself not counted."""
    rows = reached.filter("node <> seed").select("repo_id", "seed", "node").join(_counting(nodes), ["repo_id", "node"])
    return _summed(rows.drop("node"), "repo_id", "seed")


def reach_summary(edges: DataFrame, seeds: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``blast_summary`` of ``reach``: nodes meet the masks where these lie, and seeds go by their numbers until the end."""
    numbered, masks = reach_masks(edges, seeds, max_depth)
    rows = told_apart(masks.filter("depth > 0").drop("depth").join(_counting(nodes), ["repo_id", "node"]).drop("repo_id", "node"))
    return numbered.join(_summed(rows, "number"), "number").drop("number")


def impacted_files(modified: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(repo_id, path): the modified files and those of all nodes that their nodes reach: of their components, or within ``max_depth`` hops."""
    modified = modified.select("repo_id", "path").distinct()
    if max_depth is None:  # the files of each component, in one pass over the nodes, tell which ones are hit
        parts = components(edges).withColumnRenamed("node", "id")
        held = written(nodes.join(parts, ["repo_id", "id"], "left").select("repo_id", F.coalesce("component", "id").alias("component"), "path").distinct(), "files")
        hit = held.join(modified, ["repo_id", "path"], "left_semi").select("repo_id", "component").distinct()
        files = held.join(hit, ["repo_id", "component"], "left_semi").select("repo_id", "path")
    else:
        seeds = nodes.join(modified, ["repo_id", "path"]).select("repo_id", F.col("id").alias("node"))
        reached = reach_of_set(edges, seeds, max_depth).withColumnRenamed("node", "id")
        files = nodes.join(reached, ["repo_id", "id"], "left_semi").select("repo_id", "path")
    return files.unionByName(modified).distinct()


def trace_chains(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo_id, chain) from paths with an id column ``path_id``: the first call's file, the first route, the first model;
    where a seed has no full chain, its whole paths as symbols.
    """
    steps = paths.select("repo_id", "seed", F.col("path").alias("whole"), F.posexplode("path").alias("place", "id"))
    typed = steps.join(nodes.select("repo_id", "id", "node_type", F.col("path").alias("file"), "symbol", "title"), ["repo_id", "id"])
    first = lambda kind, value: F.min_by(F.when(F.col("node_type").isin(*kind), value), F.when(F.col("node_type").isin(*kind), F.col("place")))
    per_path = typed.groupBy("repo_id", "seed", "whole").agg(
        first(CALLS, F.element_at(F.split("file", "/"), -1)).alias("call"), first(ROUTES, F.col("title")).alias("route"), first(MODELS, F.col("symbol")).alias("model"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.coalesce("symbol", "id").alias("s")))), lambda x: x["s"]), " -> ").alias("plain"),
    )
    full = per_path.filter("call is not null and route is not null and model is not null").select("repo_id", "seed", F.concat_ws(" -> ", "call", "route", "model").alias("chain")).distinct()
    rest = per_path.join(full.select("repo_id", "seed").distinct(), ["repo_id", "seed"], "left_anti").select("repo_id", "seed", F.col("plain").alias("chain")).distinct()
    return full.unionByName(rest)


def reach_edges(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``induced_edges`` of ``reach``: (repo_id, seed, source, target), with the edges' further columns. A hop keeps the edges that it goes over, which
    are those between a depth and the next, and those within a depth, of which the way from source to target counts. So the hops are the result,
    and what is shuffled is what is found. Edges within the last depth are looked for at its nodes first, without seeds.
    """
    own = [c for c in edges.columns if c not in ("repo_id", "source", "target")]
    ends = F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("next"), F.lit(out).alias("out")) for a, b, out in (("source", "target", True), ("target", "source", False))])
    near = bucketed(edges.select("repo_id", F.inline(ends), *own), "near", "repo_id", "node")
    blank = lambda kind: F.lit(None).cast(kind)
    hops = [bucketed(_starts(seeds).withColumns({"before": blank("string"), "new": F.lit(True)}), "hop", "repo_id", "node")]
    fronts = [_front(hops[0])]
    while (max_depth is None or len(hops) <= max_depth) and not hops[-1].filter("new").isEmpty():
        on = fronts[-1].join(near, ["repo_id", "node"]).filter("(next = node and out) or (next <> node and (low is null or next not in (low, high)))")
        both = dealt(on.select("repo_id", "seed", F.col("next").alias("node"), F.col("node").alias("before"), "out", *own, blank("int").alias("level")), "repo_id", "node")
        for level, front in enumerate(fronts[-2:][::-1]):
            both = both.unionByName(front.select("repo_id", "seed", "node", F.lit(level).alias("level")), allowMissingColumns=True)
        both = both.withColumn("known", F.min("level").over(Window.partitionBy("repo_id", "node", "seed")))
        met = both.filter("level is null and (known is null or known = 0 and out)").withColumn("new", F.col("known").isNull())
        hops.append(bucketed(met.drop("level", "known"), "hop", "repo_id", "node"))
        fronts.append(_front(hops[-1]))
    found = [hop.drop("new") for hop in hops[1:]] + [_within(fronts[-1], near).select("repo_id", "seed", "node", "before", "out", *own)]
    spent(near, hops[0])
    turned = lambda a, b: F.when(F.col("out"), F.col(a)).otherwise(F.col(b))
    return reduce(DataFrame.unionByName, found).select("repo_id", "seed", turned("before", "node").alias("source"), turned("node", "before").alias("target"), *own)


def _front(hop: DataFrame) -> DataFrame:
    """The new rows of a hop of ``reach_edges``, each once, with the first and the last node that led there."""
    return hop.filter("new").groupBy("repo_id", "node", "seed").agg(F.min("before").alias("low"), F.max("before").alias("high"))


def _within(front: DataFrame, near: DataFrame) -> DataFrame:
    """The edges with both ends in the front of a seed, at their targets. These go to the sources that are in any seed's front, which send them back with their seeds."""
    nodes, seeds = front.select("repo_id", "node").distinct(), front.select("repo_id", "seed", "node")
    into = near.filter("not out").join(nodes, ["repo_id", "node"], "left_semi").withColumnsRenamed({"node": "target", "next": "node"}).withColumn("out", F.lit(True))
    asked = bucketed(dealt(into, "repo_id", "node").join(nodes, ["repo_id", "node"], "left_semi"), "asked", "repo_id", "node")
    sent = asked.join(seeds, ["repo_id", "node"]).withColumnsRenamed({"node": "before", "target": "node"})
    both = dealt(sent, "repo_id", "node").unionByName(seeds.withColumn("here", F.lit(True)), allowMissingColumns=True)
    met = both.withColumn("here", F.max("here").over(Window.partitionBy("repo_id", "node", "seed"))).filter("here and before is not null")
    out = bucketed(met.drop("here"), "within", "repo_id", "node")
    spent(asked)
    return out


def induced_edges(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Per seed, the edges with both ends in its set."""
    inside = reached.select("repo_id", "seed", "node")
    from_ = edges.join(inside.withColumnRenamed("node", "source"), ["repo_id", "source"])
    return from_.join(inside.withColumnRenamed("node", "target"), ["repo_id", "seed", "target"], "left_semi")


def resolve_target(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """(repo_id, target, id): the node that a text names. Ranked: id (1), end of the id behind a colon (2), path and symbol (3), symbol (4),
    file path (5), containment (6); then the smallest id. An empty text names nothing. The first five are one equi-join on the texts that name a node,
    of which only those go on that have as many parts and characters as some target; targets that they leave are searched by containment.
    """
    slashed = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    asked = written(targets.select("repo_id", "target").distinct().withColumn("wanted", slashed("target")).filter("wanted <> ''"), "asked")
    names = written(nodes.select("repo_id", "id", "path", "symbol"), "names")
    own = names.withColumn("own", slashed("id"))
    symbols = written(own.filter("symbol is not null"), "symbols")
    ends = own.withColumn("parts", _parts("own")).withColumn("last", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    rank = F.when(F.col("last") == F.col("parts"), 1).otherwise(2)
    keys = ends.select("repo_id", F.expr("substring_index(own, ':', -last)").alias("wanted"), rank.alias("rank"), "id")
    pairs = asked.filter(F.contains("wanted", F.lit("::"))).select("repo_id", "wanted", F.element_at(F.split("wanted", "::"), -1).alias("symbol"), F.substring_index("wanted", "::", 1).alias("place"))
    both = symbols.join(pairs, ["repo_id", "symbol"]).filter(F.contains("own", "place"))
    for rows, c, rank in ((both, "wanted", 3), (symbols, "symbol", 4), (own, "path", 5)):
        keys = keys.unionByName(rows.groupBy("repo_id", F.col(c).alias("wanted")).agg(F.min("id").alias("id")).withColumn("rank", F.lit(rank)))
    shape = lambda df: df.withColumn("parts", F.least(_parts("wanted"), F.lit(64))).withColumn("size", F.least(F.length("wanted"), F.lit(1 << 12)))
    shapes = shape(asked).select("parts", "size").distinct()
    keys = shape(keys).join(F.broadcast(shapes), ["parts", "size"], "left_semi").select("repo_id", "wanted", "rank", "id")
    best = dealt(keys, "repo_id", "wanted").groupBy("repo_id", "wanted").agg(F.min(F.struct("rank", "id")).alias("best"))
    tried = written(dealt(asked, "repo_id", "wanted").join(best, ["repo_id", "wanted"], "left").select("repo_id", "target", "wanted", F.col("best.id").alias("id")), "named")
    spent(asked, symbols)
    rest = written(tried.filter("id is null").select("repo_id", "target", "wanted"), "unnamed")
    inside = written(containing(own, rest).groupBy("repo_id", "target").agg(F.min("id").alias("id")), "inside")
    spent(names, rest)
    return tried.filter("id is not null").select("repo_id", "target", "id").unionByName(inside)


def _parts(c: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(":"))) + 1


def containing(names: DataFrame, rest: DataFrame, width: int = 3) -> DataFrame:
    """(repo_id, target, id) where the id contains the target: met at the target's rarest piece of ``width`` characters (or the whole
    of a shorter target), then compared. Names are cut into pieces of the widths that there are, once to count and once to meet. Pieces go by their
    hash with the repository, and those of the targets are broadcast while they are at most PIECES.
    """
    asked = rest.filter("wanted <> ''").withColumn("width", F.least(F.lit(width), F.length("wanted")))
    found = asked.groupBy("width").agg(F.sum(F.length("wanted") - F.col("width") + 1).alias("n")).collect()
    hint = F.broadcast if sum(r["n"] for r in found) <= PIECES else lambda df: df
    asked = _pieces(asked, "wanted").select("repo_id", "target", "wanted", F.expr("substr(wanted, place, width)").alias("gram"), "piece").distinct()
    widths = F.array(*[F.lit(r["width"]) for r in sorted(found)]).cast("array<int>")
    held = _pieces(names.select("repo_id", "id", "own", F.explode(widths).alias("width")), "own")
    counts = held.join(hint(asked.select("piece").distinct()), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "piece", "left").groupBy("repo_id", "target", "wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "piece")).alias("x")).filter("x.n > 0")
    met = held.join(hint(rarest.select(F.col("repo_id").alias("repo"), "target", "wanted", "x.gram", "x.piece")), "piece")
    # a piece counts where it comes first, so that a pair is one row; the target's own piece, so that this is asked of what has met alone
    return met.filter(F.expr("repo_id = repo and contains(own, wanted) and instr(own, gram) = place")).select("repo_id", "target", "id")


def _pieces(df: DataFrame, c: str) -> DataFrame:
    """With each piece of ``width`` characters of the text, hashed, and its place."""
    placed = df.filter(F.length(c) >= F.col("width")).withColumn("place", F.explode(F.sequence(F.lit(1), F.length(c) - F.col("width") + 1)))
    return placed.withColumn("piece", F.xxhash64("repo_id", F.substr(c, "place", "width")))
