"""Reach of sets, of many seeds and components against a plain search, on graphs with circles, hubs and lone nodes."""

import random
from collections import deque

import pytest

from tracelake.operators import graph, reach
from tracelake.sources import tables

EDGES = "repo_id string, source string, target string"


def drawn(seed):
    draw = random.Random(seed)
    edges = {(r, f"n{draw.randint(0, 120)}", f"n{draw.randint(0, 120)}") for r in "ab" for _ in range(90)}
    edges |= {("a", "hub", f"n{k}") for k in range(0, 120, 5)} | {("b", f"c{k}", f"c{(k + 1) % 40}") for k in range(40)} | {("b", "self", "self")}
    seeds = [("a", f"n{k}") for k in range(100)] + [("b", f"c{k}") for k in range(0, 40, 3)] + [("b", "self"), ("c", "alone")]
    return sorted(edges), seeds


def search(edges, repo, start, most):
    near = {}
    for r, a, b in edges:
        near.setdefault((r, a), set()).add(b)
        near.setdefault((r, b), set()).add(a)
    found, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near.get((repo, x), ()) if most is None or found[x] < most else ():
            if y not in found:
                found[y] = found[x] + 1
                queue.append(y)
    return found


@pytest.mark.parametrize("most", [None, 2])
def test_reach_by_masks_and_of_the_set(spark, most):
    edges, seeds = drawn(1)
    e, s = spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds + seeds[:3], "repo_id string, node string")
    want = {(r, x, y, d) for r, x in seeds for y, d in search(edges, r, x, most).items()}
    got = [tuple(x) for x in reach.reach(e, s, most).select("repo_id", "seed", "node", "depth").collect()]
    assert len(got) == len(want) and set(got) == want
    whole = [tuple(x) for x in reach.reach_of_set(e, s, most).select("repo_id", "node").collect()]
    assert len(whole) == len(set(whole)) and set(whole) == {(r, y) for r, _, y, _ in want}


def test_components_and_files_of_components(spark):
    edges, _ = drawn(2)
    e = spark.createDataFrame(edges, EDGES)
    want = {(r, x, min(search(edges, r, x, None))) for r, a, b in edges if a != b for x in (a, b)}
    assert {tuple(x) for x in reach.components(e).select("repo_id", "node", "component").collect()} == want
    nodes = spark.createDataFrame([(r, x, f"{x[-1]}.py") for r, x, _ in want], "repo_id string, id string, path string")
    modified = spark.createDataFrame([("a", "7.py"), ("b", "new.py")], "repo_id string, path string")
    hit = {c for r, x, c in want if r == "a" and x[-1] == "7"}
    assert {tuple(x) for x in graph.impacted_files(modified, nodes, e).collect()} == {("a", f"{x[-1]}.py") for r, x, c in want if r == "a" and c in hit} | {("a", "7.py"), ("b", "new.py")}
    assert reach.components(e.limit(0)).count() == 0 and reach.reach(e.limit(0), nodes.select("repo_id", "id").withColumnRenamed("id", "node").limit(2)).count() == 2


def test_simple_paths_in_circles(spark):
    edges = [("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d")]
    got = {tuple(x["path"]) for x in graph.simple_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("r", "a")], "repo_id string, node string")).collect()}
    assert got == {("a",), ("a", "b"), ("a", "c"), ("a", "b", "c"), ("a", "c", "b"), ("a", "c", "d"), ("a", "b", "c", "d")}


def exchanges(df):
    """The shuffles of a plan, before Spark adapts it."""
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


def test_hops_shuffle_what_they_find_alone(spark, monkeypatch):
    edges, seeds = drawn(3)
    e, s = spark.createDataFrame(edges + edges[:9], EDGES), spark.createDataFrame(seeds, "repo_id string, node string")
    found = []
    plain = tables.bucketed
    for module in (reach, graph):
        monkeypatch.setattr(module, "bucketed", lambda df, name, *keys: (found.append((name, exchanges(df))), plain(df, name, *keys))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        reach.reach_masks(e, s, 3), graph.blast_radius(e, s, 3)
        assert [n for name, n in found if name == "hop"][1:4] == [1, 1, 1] and [n for name, n in found if name == "hop"][-3:] == [1, 1, 1]
        found.clear()
        graph.simple_paths(e, s, 3)
        assert [n for name, n in found if name == "hop"][1:] == [0, 0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_summary_and_induced_edges_by_masks(spark):
    edges, seeds = drawn(4)
    e, s = spark.createDataFrame(edges + edges[:5], EDGES), spark.createDataFrame(seeds, "repo_id string, node string")
    ids = sorted({(r, x) for r, a, b in edges for x in (a, b)})
    rows = [(r, x, (None, "api_route", "frontend_component")[k % 3], None if k % 7 == 0 else f"{k % 5}.py") for k, (r, x) in enumerate(ids)] + [("a", "hub", "api_route", "other.py")]
    nodes = spark.createDataFrame(rows, "repo_id string, id string, node_type string, path string")
    want = {}
    for r, seed in set(seeds):
        near = set(search(edges, r, seed, 2)) - {seed}
        own = [x for x in rows if x[0] == r and x[1] in near]
        if own:
            of = lambda kind: len({x[1] for x in own if x[2] == kind})  # noqa: B023, E731
            files = sorted({x[3] for x in own if x[3]})
            want[r, seed] = (len({x[1] for x in own}), len(files), of("frontend_component"), of("api_route"), files)
    for got in (graph.reach_summary(e, s, nodes, 2), graph.blast_summary(reach.reach(e, s, 2), nodes)):
        assert {(x["repo_id"], x["seed"]): (x["n_nodes"], x["n_files"], x["n_calls"], x["n_routes"], x["files"]) for x in got.collect()} == want
        assert exchanges(got.select("repo_id", "seed", "n_nodes")) > 0 and "Expand" not in str(got._jdf.queryExecution().executedPlan())
    names = "repo_id", "seed", "source", "target"
    plain = sorted(map(tuple, graph.induced_edges(reach.reach(e, s, 2), e).select(*names).collect()))
    assert sorted(map(tuple, graph.reach_edges(e, s, 2).select(*names).collect())) == plain and plain


def test_a_round_of_components_shuffles_links_both_ways_and_what_they_point_at(spark, monkeypatch):
    edges, _ = drawn(5)
    e = spark.createDataFrame(edges + edges[:5], EDGES)
    rounds, plain = [], tables.written
    monkeypatch.setattr(reach, "written", lambda df, name: (rounds.append((name, exchanges(df), df.count())), plain(df, name))[1])
    got = {tuple(x) for x in reach.components(e).select("repo_id", "node", "component").collect()}
    assert got == {(r, x, min(search(edges, r, x, None))) for r, a, b in edges if a != b for x in (a, b)}
    pointed = [x for x in rounds if x[0] == "pointed"]
    assert pointed and {n for _, n, _ in pointed} == {2} and pointed[-1][2] < pointed[0][2]


def shuffle_files(spark):
    """Shuffles that lie on the disk."""
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {x for x in (held.apply(k).getName() for k in range(held.size())) if x.startswith("shuffle_")}


def test_paths_are_columns_and_the_last_hop_is_not_written(spark, monkeypatch):
    edges, seeds = drawn(6)
    e, s = spark.createDataFrame(edges + edges[:9], EDGES), spark.createDataFrame(seeds[:20], "repo_id string, node string")
    made, plain = [], tables.bucketed
    for module in (reach, graph):
        monkeypatch.setattr(module, "bucketed", lambda df, name, *keys: (made.append((name, df.schema.simpleString())), plain(df, name, *keys))[1])
    monkeypatch.setattr(tables, "written", None)
    monkeypatch.setattr(graph, "written", None)  # nothing but hops is written
    before = shuffle_files(spark)
    got = [(r["repo_id"], tuple(r["path"]), r["depth"]) for r in graph.simple_paths(e, s, 3).collect()]
    assert [name for name, _ in made] == ["near", "hop", "hop", "hop"] and not any("array" in schema for _, schema in made)
    near = {}
    for r, a, b in edges:
        near.setdefault((r, a), set()).add(b)
        near.setdefault((r, b), set()).add(a)
    want, last = [], [(r, (x,)) for r, x in seeds[:20]]
    for depth in range(4):
        want += [(r, path, depth) for r, path in last]
        last = [(r, (*path, y)) for r, path in last for y in near.get((r, path[-1]), ()) if y not in path]
    assert sorted(got) == sorted(want)
    made.clear()
    reached = graph.blast_radius(e, s, 3).collect()
    assert len(made) == 5 and not any("array" in schema for _, schema in made)
    least = {}
    for r, path, depth in want:
        least[r, path[0], path[-1]] = min(least.get((r, path[0], path[-1]), (depth, path)), (depth, path))
    assert {(x["repo_id"], x["seed"], x["node"]): (x["depth"], tuple(x["path"])) for x in reached} == least and len(reached) == len(least)
    assert not shuffle_files(spark) - before


def test_a_hop_shuffles_no_ways_back(spark, monkeypatch):
    chain = [("r", f"n{k}", f"n{k + 1}") for k in range(9)]
    e, s = spark.createDataFrame(chain, EDGES), spark.createDataFrame([("r", "n0")], "repo_id string, node string")
    sizes, plain = [], tables.dealt
    monkeypatch.setattr(graph, "dealt", lambda df, *keys: (sizes.append(df.count()), plain(df, *keys))[1])
    assert [r["depth"] for r in graph.blast_radius(e, s, 4).orderBy("depth").collect()] == [0, 1, 2, 3, 4] and sizes == [1, 1, 1, 1]
    sizes.clear()
    assert {(r["source"], r["target"]) for r in graph.reach_edges(e, s, 4).collect()} == {x[1:] for x in chain[:4]} and sizes[:4] == [1, 1, 1, 1]


@pytest.mark.parametrize("most", [None, 1, 3])
def test_induced_edges_are_the_hops(spark, most):
    edges, seeds = drawn(7)
    edges = sorted({*edges, *(("a", b, a) for r, a, b in edges[:9] if r == "a"), ("a", "n1", "n1"), ("a", "n5", "n10"), ("a", "n10", "n15")})
    rows = [(*x, k) for k, x in enumerate(edges + edges[:5])]
    e, s = spark.createDataFrame(rows, EDGES + ", number int"), spark.createDataFrame(seeds + seeds[:3], "repo_id string, node string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = graph.reach_edges(e, s, most)
        assert exchanges(found) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = []
    for r, seed in set(seeds):
        inside = search(edges, r, seed, most)
        want += [(r, seed, a, b, k) for q, a, b, k in rows if q == r and a in inside and b in inside]
    assert sorted(map(tuple, found.select("repo_id", "seed", "source", "target", "number").collect())) == sorted(want)
