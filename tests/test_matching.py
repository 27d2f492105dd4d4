"""Golden and brute-force cases of matching calls to routes."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tracelake.functions import paths
from tracelake.jobs import graph_jobs
from tracelake.operators import checks, graph, matching

CALL = "repo_id string, call_id string, path string, line int, ordinal int, method string, norm_path string, is_template boolean"
ROUTE = "repo_id string, route_id string, path string, line int, ordinal int, handler string, raw_path string, norm_path string, methods array<string>, model_refs array<string>"
MODEL = "repo_id string, path string, line int, ordinal int, class_name string, table_name string, fields array<string>, relationships array<string>"


def calls(spark, rows):
    return spark.createDataFrame([("r", f"{p}::fetch::{n}", p, n, k, m, url, "{" in url) for k, (p, n, m, url) in enumerate(rows)], CALL)


def routes(spark, rows):
    return spark.createDataFrame([("r", f"{p}::{h}", p, k, k, h, url, url, ms, refs) for k, (p, h, ms, url, refs) in enumerate(rows)], ROUTE)


BILLING_CALLS = [("web/Profile.tsx", 26, "GET", "/api/v1/teams"), ("web/Profile.tsx", 33, "GET", "/api/v1/users/{userId}/billing")]
BILLING_ROUTES = [("api/routes.py", "get_teams", ["GET"], "/api/v1/teams", []), ("api/routes.py", "get_user_billing", ["GET"], "/api/v1/users/{user_id}/billing", ["Account"])]
BILLING_MODELS = [("r", "api/models.py", 9, 0, "User", "users", ["id", "email"], ["Account"]), ("r", "api/models.py", 19, 1, "Account", "accounts", ["id", "plan"], ["User"])]


def test_billing_app_matches(spark):
    got = matching.match_routes(calls(spark, BILLING_CALLS), routes(spark, BILLING_ROUTES)).orderBy("call_id").collect()
    assert [(r["call_id"], r["route_id"], r["confidence"], r["is_exact"], r["param_map"]) for r in got] == [
        ("web/Profile.tsx::fetch::26", "api/routes.py::get_teams", 1.0, True, {}),
        ("web/Profile.tsx::fetch::33", "api/routes.py::get_user_billing", 0.88, False, {"userId": "user_id"}),
    ]


def test_no_match_for_literal_method_or_length(spark):
    asked = calls(spark, [("a.ts", 1, "GET", "/api/v1/orders/123"), ("a.ts", 2, "POST", "/api/v1/teams"), ("a.ts", 3, "GET", "/api/v1/users")])
    assert matching.match_routes(asked, routes(spark, BILLING_ROUTES)).count() == 0
    assert checks.unknown_endpoints(asked, routes(spark, BILLING_ROUTES)).count() == 2  # the POST path exists in another method


def test_root_and_long_masks(spark):
    deep = "/a/{b}/{c}/{d}/{e}/{f}/g/h"
    got = matching.match_routes(calls(spark, [("a.ts", 1, "GET", "/"), ("a.ts", 2, "GET", "/a/1/2/3/4/5/g/h")]), routes(spark, [("r.py", "root", ["GET"], "/", []), ("r.py", "deep", ["GET"], deep, [])]))
    assert {(r["route_id"], r["confidence"]) for r in got.collect()} == {("r.py::root", 1.0), ("r.py::deep", 0.63)}


def test_repeated_parameter_keeps_the_last(spark):
    got = matching.match_routes(calls(spark, [("a.ts", 1, "GET", "/x/{id}/{id}")]), routes(spark, [("r.py", "h", ["GET"], "/x/{one}/{two}", [])]))
    assert got.first()["param_map"] == {"id": "two"}


def test_empty_routes(spark):
    asked, none = calls(spark, BILLING_CALLS), routes(spark, [])
    assert matching.match_routes(asked, none).count() == 0
    assert checks.unknown_endpoints(asked, none).count() == 0


def test_mask_rewrite_equals_pairwise_rule(spark):
    draw = random.Random(1)
    one = lambda: "/" + "/".join(draw.choice(["a", "b", "{x}", "{y}"]) for _ in range(draw.randint(0, 4)))
    asked = [(f"{k}.ts", k, draw.choice(["GET", "POST"]), one()) for k in range(60)]
    known = [("r.py", f"h{k}", draw.choice([["GET"], ["GET", "POST"]]), one(), []) for k in range(40)]
    want = set()
    for (p, n, m, url), (rp, h, ms, path, _) in itertools.product(asked, known):
        c, r = [[s for s in x.split("/") if s] for x in (url, path)]
        if m not in ms or len(c) != len(r) or any((x[0] == "{" or x != y) and y[0] != "{" for x, y in zip(c, r, strict=True)):
            continue
        score = sum(0.4 if y[0] == "{" else 1 for y in r) / len(r) if r else 1.0
        want.add((f"{p}::fetch::{n}", f"{rp}::{h}", round(score + 1e-9, 2)))
    got = matching.match_routes(calls(spark, asked), routes(spark, known), 0.0)
    assert {(r["call_id"], r["route_id"], r["confidence"]) for r in got.collect()} == want


def test_billing_graph_and_blast_radius(spark):
    c, r, m = calls(spark, BILLING_CALLS), routes(spark, BILLING_ROUTES), spark.createDataFrame(BILLING_MODELS, MODEL)
    nodes = graph.build_nodes(c, r, m)
    edges = graph.build_edges(matching.match_routes(c, r), graph.link_routes_to_models(r, m), graph.link_models(m))
    assert (nodes.count(), edges.count()) == (6, 5)
    reached = graph.blast_radius(edges, spark.createDataFrame([("r", "api/models.py::Account")], "repo_id string, node string"))
    assert {(x["node"], x["depth"]) for x in reached.collect()} == {("api/models.py::Account", 0), ("api/models.py::User", 1), ("api/routes.py::get_user_billing", 1), ("web/Profile.tsx::fetch::33", 2)}
    files = graph.impacted_files(spark.createDataFrame([("r", "api/models.py")], "repo_id string, path string"), nodes, edges)
    assert {x["path"] for x in files.collect()} == {"api/models.py", "api/routes.py", "web/Profile.tsx"}


def test_cycle_hub_and_prefix_ids(spark):
    links = [("r", "A", "B"), ("r", "B", "C"), ("r", "C", "A"), ("r", "x::User", "x::UserProfile")] + [("r", "hub", f"n{k}") for k in range(500)]
    edges = spark.createDataFrame(links, "repo_id string, source string, target string")
    seeds = spark.createDataFrame([("r", "A"), ("r", "hub"), ("r", "x::User")], "repo_id string, node string")
    got = graph.blast_radius(edges, seeds)
    assert got.count() == 3 + 501 + 2
    paths_ = graph.simple_paths(edges, spark.createDataFrame([("r", "A"), ("r", "x::User")], "repo_id string, node string"))
    assert paths_.filter("seed = 'A'").count() == 5 and paths_.filter("seed = 'x::User'").count() == 2


def test_route_regex_and_prefix(spark):
    row = spark.range(1).select(paths.route_regex(F.lit("/api/v1/users/{user_id}/billing")).alias("a"), paths.join_prefix(F.lit("/api/v2"), F.lit("/auth/login")).alias("b"), paths.join_prefix(F.lit(""), F.lit("/")).alias("c"), paths.segment_count(F.lit("/")).alias("d")).first()
    assert tuple(row) == ("^/api/v1/users/(?P<user_id>[^/]+)/billing$", "/api/v2/auth/login", "/", 0)


def test_reach_of_every_customer_equals_brute_force(spark, tmp_path):
    orders = [(k, k * 7 % 60 + 1, f"{k % 4 + 1}-X") for k in range(1, 121)]
    lines = sorted({(o, (o * 13 + j * 5) % 30 + 1) for o, *_ in orders for j in range(2)})
    for name, rows, schema in (
        ("customer", [(k, k % 3, "BUILDING") for k in range(1, 71)], "c_custkey long, c_nationkey int, c_mktsegment string"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderpriority string"),
        ("lineitem", lines, "l_orderkey long, l_partkey long"),
        ("part", [(k, f"B{k % 4}") for k in range(1, 31)], "p_partkey long, p_brand string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    near = {}
    for a, b in [(("c", c % 3, c), ("o", c % 3, o)) for o, c, _ in orders] + [(("o", c % 3, o), ("p", c % 3, p)) for o, c, _ in orders for x, p in lines if x == o]:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = set()
    for c in range(1, 71):
        seed = ("c", c % 3, c)
        depth, front = {seed: 0}, [seed]
        for k in range(1, graph_jobs.DEPTH + 1):
            front = {y for x in front for y in near.get(x, ())} - depth.keys()
            depth |= dict.fromkeys(front, k)
        want |= {(f"n{c % 3}", f"c::{c}", f"{x}::{k}", d) for (x, _, k), d in depth.items()}
    run = lambda name: graph_jobs.ENTRIES[name][0](spark, str(tmp_path))
    got = [tuple(r)[:4] for r in run("g3_blast_radius").select("repo_id", "seed", "node", "depth").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {r["seed"]: r["n_nodes"] for r in run("g5_blast_summary").collect()} == {s: n for s, n in Counter(x[1] for x in want if x[1] != x[2]).items()}
    inside = {(s, x) for _, s, x, _ in want}
    assert {(r["seed"], r["source"], r["target"]) for r in run("g8_induced_edges").collect()} == {(s, f"{a[0]}::{a[2]}", f"{b[0]}::{b[2]}") for s in {x[1] for x in want} for a in near for b in near[a] if a[1] == int(s[3:]) % 3 and (a[0], b[0]) in (("c", "o"), ("o", "p")) and {(s, f"{a[0]}::{a[2]}"), (s, f"{b[0]}::{b[2]}")} <= inside}
