"""Summaries of the graph and of its contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.labels import CALLS, MODELS, ROUTES, tokens_of_length
from tracelake.operators.checks import numbered
from tracelake.operators.graph import last_definition

# Status codes looked for in a handler's file, beside 200.
CODES = ("201", "400", "401", "403", "404")


def stack_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1: per repository: nodes, edges, and how many of each type."""
    of = lambda kind: F.count_if(F.col("node_type").isin(*kind))
    n = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("nodes"), of(CALLS).alias("calls"), of(ROUTES).alias("routes"), of(MODELS).alias("models"))
    return n.join(edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edges")), "repo_id", "full").na.fill(0)


def confidence_breakdown(edges: DataFrame) -> DataFrame:
    """A2: per repository: exact and template matches, all, and the mean confidence; edges without confidence are skipped."""
    c = F.col("confidence")
    out = edges.groupBy("repo_id").agg(F.count_if(c >= 0.99).alias("exact"), F.count_if((c >= 0.8) & (c < 0.99)).alias("template"), F.count(c).alias("total"), F.round(F.avg(c), 2).alias("mean"))
    return out.withColumn("mean", F.coalesce("mean", F.lit(1.0)))


def token_savings(files: DataFrame, slices: DataFrame) -> DataFrame:
    """A5: per repository: tokens of all files joined by line feeds, of the slice (repo_id, text), and what is saved."""
    joined = lambda c: F.coalesce(F.sum(F.length(c)), F.lit(0)) + F.greatest(F.count(c) - 1, F.lit(0))
    raw = files.groupBy("repo_id").agg(joined("content").alias("raw_length"))
    short = slices.groupBy("repo_id").agg(joined("text").alias("slice_length"))
    out = raw.join(short, "repo_id", "left").select("repo_id", tokens_of_length(F.col("raw_length")).alias("raw_tokens"), tokens_of_length(F.coalesce("slice_length", F.lit(0))).alias("slice_tokens"))
    saved = F.greatest(F.lit(0), F.col("raw_tokens") - F.col("slice_tokens"))
    return out.withColumn("saved", saved).withColumn("percent", F.when(F.col("raw_tokens") > 0, F.round(F.col("saved") * 100.0 / F.col("raw_tokens"), 2)).otherwise(F.lit(0.0)))


def route_matrix(routes: DataFrame, models: DataFrame) -> DataFrame:
    """A row per route (kind, path, methods, file, handler, its models with their tables and fields) and a row per model
    (kind, class, no methods, file, table, fields), whether a route refers to it or not.
    """
    table = F.coalesce("table_name", F.lower("class_name"))
    last = last_definition(models, "class_name").select("repo_id", "class_name", F.concat(F.col("class_name"), F.lit(":"), table, F.lit("("), F.array_join("fields", ","), F.lit(")")).alias("shown"))
    used = routes.select("repo_id", "route_id", F.explode("model_refs").alias("class_name")).join(last, ["repo_id", "class_name"]).groupBy("repo_id", "route_id").agg(F.array_join(F.sort_array(F.collect_set("shown")), "; ").alias("models"))
    kind = F.when(F.array_contains("methods", "MCP_TOOL") | F.array_contains("methods", "MCP_RESOURCE"), F.lit("tool")).otherwise(F.lit("http"))
    of_routes = routes.join(used, ["repo_id", "route_id"], "left").select("repo_id", kind.alias("kind"), "norm_path", F.array_join("methods", ",").alias("methods"), "path", "handler", F.coalesce("models", F.lit("")).alias("models"))
    own = last_definition(models, "path", "class_name")
    return of_routes.unionByName(own.select("repo_id", F.lit("model").alias("kind"), F.col("class_name").alias("norm_path"), F.lit("").alias("methods"), "path", table.alias("handler"), F.array_join("fields", ",").alias("models")))


def callers_per_route(edges: DataFrame) -> DataFrame:
    """Per route its callers with their confidence, a row each, numbered in the order of their ids."""
    fetches = edges.filter(F.col("relation_type") == "FETCHES").select("repo_id", F.col("target").alias("route_id"), "source", "confidence")
    return numbered(fetches, ["repo_id", "route_id"], [F.col("source")], "nth")


def status_codes(routes: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, route_id, codes): 200 and each code whose digits occur in the handler's file."""
    found = F.filter(F.array(*[F.lit(c) for c in CODES]), lambda c: F.contains(F.col("content"), c))
    per_file = files.select("repo_id", "path", found.alias("found"))
    joined = routes.select("repo_id", "route_id", "path").join(per_file, ["repo_id", "path"], "left")
    return joined.select("repo_id", "route_id", F.array_sort(F.concat(F.array(F.lit("200")), F.coalesce("found", F.array().cast("array<string>")))).alias("codes"))


def asked_for(target: str) -> Column:
    """Whether a route is meant: by its path, normalised or as written, without slashes at the end, or by the end of its id."""
    bare = lambda c: F.regexp_replace(c, "(?<=.)/+$", "")
    wanted = bare(F.lit(target))
    return (bare(F.col("norm_path")) == wanted) | (bare(F.col("raw_path")) == wanted) | F.endswith("route_id", wanted)


def route_contract(routes: DataFrame, edges: DataFrame, calls: DataFrame, codes: DataFrame, wanted: Column) -> DataFrame:
    """The contract of the routes that ``wanted`` selects, a row per caller (one without a caller where a route has none).

    Each row has the route's path, first and all methods, handler, file, line, response model, parameters, status codes and accessed models,
    and the caller's file, line, url, confidence, exact flag and parameter map. Callers stay rows, so that a route may have any number.
    """
    own = routes.filter(wanted)
    accessed = edges.filter(F.col("relation_type") == "USES_MODEL").groupBy("repo_id", F.col("source").alias("route_id")).agg(F.array_sort(F.collect_set(F.element_at(F.split("target", "::"), -1))).alias("models"))
    fetches = edges.filter(F.col("relation_type") == "FETCHES").select("repo_id", F.col("target").alias("route_id"), F.col("source").alias("call_id"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("is_exact", F.lit(False)).alias("is_exact"), "param_map")
    places = calls.select("repo_id", "call_id", F.col("path").alias("caller_path"), F.col("line").alias("caller_line"), F.col("raw_url").alias("caller_url"))
    callers = fetches.join(own.select("repo_id", "route_id"), ["repo_id", "route_id"], "left_semi").join(places, ["repo_id", "call_id"])
    out = own.join(accessed, ["repo_id", "route_id"], "left").join(codes, ["repo_id", "route_id"], "left").join(callers, ["repo_id", "route_id"], "left")
    method = F.coalesce(F.get("methods", F.lit(0)), F.lit("GET")).alias("method")
    return out.select("repo_id", "route_id", "norm_path", method, "methods", "handler", "path", "line", "response_model", "path_params", "codes", "models", "call_id", "caller_path", "caller_line", "caller_url", "confidence", "is_exact", "param_map")


def code_snippets(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """The error line with one line before and behind, numbered, the error line marked with ``>``."""
    lines = F.split(F.regexp_replace("content", "\n$", ""), "\n")
    rows = diagnostics.join(files.select("repo_id", "path", lines.alias("lines")), ["repo_id", "path"]).withColumn("n", F.size("lines"))
    at = F.greatest(F.lit(1), F.least(F.col("n"), F.col("line")))
    rows = rows.withColumn("first", F.greatest(F.lit(1), at - 1)).withColumn("last", F.least(F.col("n"), at + 1))
    shown = F.transform(F.sequence("first", "last"), lambda k: F.concat(F.when(k == F.col("line"), F.lit("> ")).otherwise(F.lit("  ")), F.lpad(k.cast("string"), 4, " "), F.lit(" | "), F.regexp_replace(F.element_at("lines", k.cast("int")), "\r$", "")))
    return rows.withColumn("snippet", F.array_join(shown, "\n")).drop("lines", "n", "first", "last")


def mtime_changes(snapshots: DataFrame) -> DataFrame:
    """(repo_id, path, snapshot_ts): files whose mtime differs from their previous snapshot; of snapshots of one time the lesser
    mtime comes first.
    """
    order = Window.partitionBy("repo_id", "path").orderBy("snapshot_ts", "mtime")
    return snapshots.withColumn("before", F.lag("mtime").over(order)).filter("before is not null and before <> mtime").select("repo_id", "path", "snapshot_ts")
