"""Calls and routes: which call hits which route, and how surely.

A call matches a route of the same method and number of segments if literals agree wherever the route has no parameter and
every parameter of the call meets one of the route. Both follow from the route's mask (which positions are parameters):
a call that fits the mask agrees with the route on a key in which masked positions are blanked. So the pairwise rule
becomes two equi-joins, on few masks and then on the key, and confidence depends on the mask alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.paths import is_param, param_name, segments
from tracelake.sources.tables import written

PARAMETER_SCORE = 0.4


def _confidence(n: Column, masked: Column) -> Column:
    return F.when(n == 0, F.lit(1.0)).otherwise(F.round(((n - masked) + F.lit(PARAMETER_SCORE) * masked) / n, 2))


def _key(parts: Column, mask: Column) -> Column:
    return F.zip_with(parts, mask, lambda s, m: F.when(m, F.lit("*")).otherwise(F.concat(F.lit("="), s)))


def param_map(call_parts: Column, route_parts: Column) -> Column:
    """Call parameter or literal to route parameter; of repeated names the last holds."""
    pairs = F.filter(F.zip_with(call_parts, route_parts, lambda c, r: F.struct(param_name(c).alias("k"), param_name(r).alias("v"), is_param(r).alias("p"))), lambda x: x["p"])
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def candidates(calls: DataFrame, routes: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """All (call, route) pairs that fit, with confidence. Calls and routes keep their ids only."""
    left = calls.select("repo_id", "call_id", F.upper("method").alias("method"), segments(F.col("norm_path")).alias("call_parts"), "is_template")
    left = left.withColumn("n", F.size("call_parts")).withColumn("call_mask", F.transform("call_parts", is_param))
    right = routes.select("repo_id", "route_id", F.col("ordinal").alias("route_ordinal"), F.explode(F.array_distinct(F.transform("methods", F.upper))).alias("method"), segments(F.col("norm_path")).alias("route_parts"))
    right = right.withColumn("n", F.size("route_parts")).withColumn("mask", F.transform("route_parts", is_param))
    right = right.withColumn("confidence", _confidence(F.col("n"), F.size(F.filter("mask", lambda m: m))))
    right = right.filter(F.col("confidence") >= min_confidence).withColumn("key", _key(F.col("route_parts"), F.col("mask")))
    # settled first: Spark then knows the sizes, broadcasts what is small enough, and splits the calls of a hot route else
    right = written(right, "route-keys")
    masks = written(right.select("repo_id", "method", "n", "mask").distinct(), "route-masks")
    fits = F.forall(F.zip_with("call_mask", "mask", lambda c, m: ~c | m), lambda x: x)
    keyed = left.join(masks, ["repo_id", "method", "n"]).filter(fits).withColumn("key", _key(F.col("call_parts"), F.col("mask")))
    return keyed.join(right.drop("n"), ["repo_id", "method", "mask", "key"])


def match_routes(calls: DataFrame, routes: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Every pair of at least the given confidence, with its parameter map."""
    pairs = candidates(calls, routes, min_confidence)
    return pairs.select(
        "repo_id", "call_id", "route_id", "route_ordinal", "method", "confidence", (F.col("confidence") == 1.0).alias("is_exact"), param_map(F.col("call_parts"), F.col("route_parts")).alias("param_map"), F.lit("segment_scoring").alias("strategy")
    )


def filter_confidence(matches: DataFrame, least: float = 0.5) -> DataFrame:
    """F6"""
    return matches.filter(F.col("confidence") >= least)


def rank_matches(matches: DataFrame) -> DataFrame:
    """1 is the best route of a call; ties go by the routes' order."""
    best = Window.partitionBy("repo_id", "call_id").orderBy(F.desc("confidence"), "route_ordinal", "route_id")
    return matches.withColumn("rank", F.row_number().over(best))


def top_matches(matches: DataFrame, k: int) -> DataFrame:
    """The k best routes of each call."""
    return rank_matches(matches).filter(F.col("rank") <= k)


def best_route(calls: DataFrame, routes: DataFrame, strip_prefix: str = "/api") -> DataFrame:
    """The best route of each call after a prefix is taken off: 1.0 for equal static paths, 0.88 where either has parameters."""
    path = F.col("norm_path")
    rest = F.when(path.startswith(strip_prefix), F.substring(path, len(strip_prefix) + 1, 1 << 20)).otherwise(path)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    pairs = candidates(calls.withColumn("norm_path", rest), routes)
    templated = F.col("is_template") | F.exists("mask", lambda m: m)
    scored = pairs.select(
        "repo_id", "call_id", "route_id", "route_ordinal", F.when(templated, F.lit(0.88)).otherwise(F.lit(1.0)).alias("confidence"), F.when(templated, F.lit("template_slug_alignment")).otherwise(F.lit("exact_static_match")).alias("strategy")
    )
    return rank_matches(scored).filter("rank = 1").drop("rank", "route_ordinal")
