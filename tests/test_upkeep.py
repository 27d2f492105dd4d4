"""Edits applied as signed rows against a rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import upkeep
from tracelake.operators.graph import dedupe_edges
from tracelake.operators.matching import match_routes

CALLS = "repo_id string, call_id string, method string, norm_path string, is_template boolean"
ROUTES = "repo_id string, route_id string, ordinal int, methods array<string>, norm_path string"


def drawn(draw, kind, n):
    part = lambda: draw.choice(["a", "b", "{x}", "{y}"])
    path = lambda: "/" + "/".join(part() for _ in range(draw.randint(1, 3)))
    if kind == "call":
        return [(draw.choice("rs"), f"c{draw.randint(0, 25)}", draw.choice(["GET", "POST"]), path(), False) for _ in range(n)]
    return [(draw.choice("rs"), f"h{draw.randint(0, 12)}", 0, draw.choice([["GET"], ["GET", "POST"]]), path()) for _ in range(n)]


def edited(draw, rows, kind):
    kept = [x for x in rows if draw.random() > 0.2]
    return kept + drawn(draw, kind, 8) + draw.sample(kept, 4)


def signed(matches):
    return upkeep.counted(matches.select("repo_id", "call_id", "route_id", "confidence", "is_exact", F.array_sort(F.map_entries("param_map")).alias("params"), F.lit(1).cast("long").alias("change")))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits_equal_a_rebuild(spark, seed):
    draw = random.Random(seed)
    old_calls, old_routes = drawn(draw, "call", 60), drawn(draw, "route", 30)
    new_calls, new_routes = edited(draw, old_calls, "call"), edited(draw, old_routes, "route")
    a, b = (spark.createDataFrame(x, CALLS) for x in (old_calls, new_calls))
    p, q = (spark.createDataFrame(x, ROUTES) for x in (old_routes, new_routes))
    before, after = signed(match_routes(a, p)), signed(match_routes(b, q))
    changes = upkeep.changed_matches(a, b, p, q)
    kept, fresh, gone = upkeep.changed_edges(before, changes)
    rows = lambda df: sorted(map(str, df.select("repo_id", "call_id", "route_id", "confidence", "params", "change").collect()))
    assert rows(kept) == rows(after)
    edges = lambda df: {(r["repo_id"], r["source"], r["target"]): (r["confidence"], r["param_map"]) for r in df.collect()}
    whole = lambda df: edges(dedupe_edges(df.select("repo_id", F.col("call_id").alias("source"), F.col("route_id").alias("target"), F.lit("calls").alias("relation"), "confidence", F.map_from_entries("params").alias("param_map"))))
    was, now, made = whole(before), whole(after), edges(fresh)
    assert {k: v[0] for k, v in (was | made).items() if k not in {tuple(r) for r in gone.collect()}} == {k: v[0] for k, v in now.items()}
    assert set(made) <= set(now) and len(made) < len(now)


def test_nothing_changed(spark):
    calls, routes = spark.createDataFrame(drawn(random.Random(3), "call", 20), CALLS), spark.createDataFrame(drawn(random.Random(3), "route", 20), ROUTES)
    assert upkeep.changed_matches(calls, calls, routes, routes).count() == 0
