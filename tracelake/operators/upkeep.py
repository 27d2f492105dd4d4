"""R3 and U2 by what changed: signed rows of calls and routes become signed matches, and only the edges that differ are made anew.

With D for what changed, the matches of C and R change by D(C) with the old R, and the new C with D(R): each new match is told once, each lost
one withdrawn once, and rows that stand more than once are counted. What did not change is read as the other side of a join only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.graph import dedupe_edges
from tracelake.operators.matching import match_routes
from tracelake.sources.tables import written


def changed_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of which the tables have different numbers, with ``change``: how many more the new one has."""
    names = old.columns
    both = new.select(*names, F.lit(1).alias("change")).unionByName(old.select(*names, F.lit(-1).alias("change")))
    return both.groupBy(*names).agg(F.sum("change").alias("change")).filter("change <> 0")


def changed_matches(calls: DataFrame, new_calls: DataFrame, routes: DataFrame, new_routes: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """(repo_id, call_id, route_id, confidence, is_exact, params, change): the matches that are new (above 0) or lost, ``params`` the sorted entries of the map."""
    d_calls, d_routes = written(changed_rows(calls, new_calls), "changed-calls"), written(changed_rows(routes, new_routes), "changed-routes")
    every = None
    for sign in (1, -1):
        of = lambda rows: rows.filter(F.signum("change") == sign).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("change")))).drop("change", "nth")  # noqa: B023, E731
        for left, right in ((of(d_calls), routes), (new_calls, of(d_routes))):
            found = match_routes(left, right, min_confidence).select("repo_id", "call_id", "route_id", "confidence", "is_exact", F.array_sort(F.map_entries("param_map")).alias("params"), F.lit(sign).cast("long").alias("change"))
            every = found if every is None else every.unionByName(found)
    return counted(every)


def counted(matches: DataFrame) -> DataFrame:
    """Signed matches, each once with the sum of its changes; those that cancel are gone."""
    return matches.groupBy("repo_id", "call_id", "route_id", "confidence", "is_exact", "params").agg(F.sum("change").alias("change")).filter("change <> 0")


def changed_edges(stored: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the stored matches and their changes (both as ``counted`` gives them): the matches to store, the edges to write, one per (source, target)
    that any change touches, and the (repo_id, source, target) that have none left.
    """
    touched = written(changes.select("repo_id", F.col("call_id").alias("source"), F.col("route_id").alias("target")).distinct(), "touched")
    kept = counted(stored.unionByName(changes)).filter("change > 0")
    edges = kept.select("repo_id", F.col("call_id").alias("source"), F.col("route_id").alias("target"), F.lit("calls").alias("relation"), F.lit("FETCHES").alias("relation_type"), "confidence", "is_exact", F.map_from_entries("params").alias("param_map"))
    fresh = written(dedupe_edges(edges.join(touched, ["repo_id", "source", "target"], "left_semi")), "fresh-edges")
    return kept, fresh, touched.join(fresh, ["repo_id", "source", "target"], "left_anti")
