"""What a change breaks: calls without routes, routes without calls, attributes that models lack, and what of it is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import globs
from tracelake.functions.paths import is_param, segments
from tracelake.operators.graph import last_definition
from tracelake.sources.tables import written

# Attributes that every model has.
STANDARD = ("__tablename__", "metadata")


def _diagnostic(rule: str, message: Column, source: str) -> list[Column]:
    return ["repo_id", "path", "line", message.alias("message"), F.lit("error").alias("severity"), F.lit(rule).alias("rule"), F.lit(source).alias("source")]


def unmatched_calls(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """A diagnostic for each call without an outgoing FETCHES edge."""
    fetched = edges.filter(F.col("relation_type") == "FETCHES").select("repo_id", F.col("source").alias("call_id"))
    rows = calls.join(fetched, ["repo_id", "call_id"], "left_anti")
    return rows.select(*_diagnostic("guard-unmatched-endpoint", F.concat(F.lit("Endpoint '"), "norm_path", F.lit("' does not match any registered backend route")), "guard"))


def unknown_endpoints(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """A diagnostic for each call whose path no route fits in any method, parameters allowed on either side; none for a
    repository without routes. Parameters of either side are blanked on both: an equi-join per pair of masks.
    """
    asked = calls.withColumn("parts", segments(F.col("norm_path"))).withColumn("n", F.size("parts")).withColumn("call_mask", F.transform("parts", is_param))
    known = routes.select("repo_id", "norm_path", segments(F.col("norm_path")).alias("route_parts")).withColumn("n", F.size("route_parts"))
    known = known.withColumn("route_mask", F.transform("route_parts", is_param)).distinct()
    blank = lambda parts: F.zip_with(parts, F.zip_with("call_mask", "route_mask", lambda a, b: a | b), lambda s, m: F.when(m, F.lit("*")).otherwise(F.concat(F.lit("="), s)))
    call_masks = asked.select("repo_id", "n", "call_mask").distinct()
    route_masks = known.select("repo_id", "n", "route_mask").distinct()
    masks = call_masks.join(route_masks, ["repo_id", "n"])
    left = asked.join(masks, ["repo_id", "n", "call_mask"]).withColumn("key", blank("parts"))
    right = known.join(masks, ["repo_id", "n", "route_mask"]).select("repo_id", "n", "call_mask", "route_mask", blank("route_parts").alias("key")).distinct()
    hit = left.join(right, ["repo_id", "n", "call_mask", "route_mask", "key"], "left_semi").select("repo_id", "call_id").distinct()
    rows = calls.join(routes.select("repo_id").distinct(), "repo_id", "left_semi").join(hit, ["repo_id", "call_id"], "left_anti")
    return rows.select(*_diagnostic("unmatched-fetch-route", F.concat(F.lit("Fetch endpoint '"), "norm_path", F.lit("' does not match any registered backend route")), "typescript"))


def unused_routes(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Routes that no call fetches."""
    fetched = edges.filter(F.col("relation_type") == "FETCHES").select("repo_id", F.col("target").alias("route_id"))
    return routes.join(fetched, ["repo_id", "route_id"], "left_anti")


def valid_attributes(models: DataFrame) -> DataFrame:
    """(repo_id, class_name, attr): fields, relationship targets and standard names."""
    names = F.array_distinct(F.concat("fields", "relationships", F.array(*[F.lit(x) for x in STANDARD])))
    return models.select("repo_id", "class_name", F.explode(names).alias("attr"))


def missing_attributes(accesses: DataFrame, bindings: DataFrame, models: DataFrame) -> DataFrame:
    """Accesses (repo_id, path, line, col, obj, attr) to attributes that the object's model lacks.

    A variable is bound by ``query(M)``, ``select(M)`` or ``M(`` in its assignment (repo_id, path, line, var, rhs); of several
    assignments the earliest holds. A model's own name stands for itself.
    """
    classes = models.select("repo_id", "class_name").distinct()
    found = bindings.select("repo_id", "path", "line", "var", F.posexplode(F.regexp_extract_all("rhs", F.lit(r"(?:\b(?:query|select)\(\s*(\w+))|(?:\b(\w+)\()"), F.lit(0))).alias("place", "hit"))
    found = found.withColumn("class_name", F.regexp_extract("hit", r"(\w+)\(?$", 1)).join(classes, ["repo_id", "class_name"])
    first = Window.partitionBy("repo_id", "path", "var").orderBy("line", "place")
    bound = found.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("repo_id", "path", F.col("var").alias("obj"), F.col("class_name").alias("bound_to"))
    named = accesses.join(bound, ["repo_id", "path", "obj"], "left").join(classes.select("repo_id", F.col("class_name").alias("obj"), F.col("class_name").alias("itself")), ["repo_id", "obj"], "left")
    typed = named.withColumn("class_name", F.coalesce("bound_to", "itself")).filter("class_name is not null")
    rows = typed.join(valid_attributes(last_definition(models, "class_name")), ["repo_id", "class_name", "attr"], "left_anti")
    return rows.select(*_diagnostic("schema-attribute-missing", F.concat(F.lit("Attribute '"), "attr", F.lit("' does not exist on model '"), "class_name", F.lit("'")), "python"))


def new_diagnostics(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows of ``current`` whose (path, line, message) the baseline does not have."""
    return current.join(baseline.select("repo_id", "path", "line", "message"), ["repo_id", "path", "line", "message"], "left_anti")


def overlay_files(base: DataFrame, modified: DataFrame) -> DataFrame:
    """(repo_id, path, content, baseline): modified contents over the base; a new file has baseline ''."""
    new = modified.select("repo_id", "path", F.col("content").alias("new_content"))
    return base.select("repo_id", "path", F.col("content").alias("old")).join(new, ["repo_id", "path"], "full").select("repo_id", "path", F.coalesce("new_content", "old").alias("content"), F.coalesce("old", F.lit("")).alias("baseline"))


def guard_diagnostics(*parts: DataFrame) -> DataFrame:
    """U4: all diagnostics, one below the other."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def guard_summary(diagnostics: DataFrame, calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Per repository: errors, whether anything broke, how many calls and routes."""
    errors = diagnostics.groupBy("repo_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("rule") == "guard-unmatched-endpoint").alias("unmatched"))
    counts = [t.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name)) for t, name in ((calls, "calls"), (routes, "routes"))]
    out = counts[0].join(counts[1], "repo_id", "full").join(errors, "repo_id", "full").na.fill(0)
    return out.withColumn("has_breakage", F.col("errors") > 0)


def unmatched_lists(calls: DataFrame, routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, kind, id, path, line): the calls without a route and the routes without a call."""
    fetched = edges.filter(F.col("relation_type") == "FETCHES")
    lone = calls.join(fetched.select("repo_id", F.col("source").alias("call_id")), ["repo_id", "call_id"], "left_anti").select("repo_id", F.lit("call").alias("kind"), F.col("call_id").alias("id"), "path", "line")
    return lone.unionByName(unused_routes(routes, edges).select("repo_id", F.lit("route").alias("kind"), F.col("route_id").alias("id"), "path", "line"))


def severity_class(rule: Column, severity: Column) -> Column:
    """F8: drift for warnings and rules of drift or deprecation, else breaking."""
    named = F.lower(F.coalesce(rule, F.lit("")))
    return F.when((F.lower(F.coalesce(severity, F.lit(""))) == "warning") | named.contains("drift") | named.contains("deprecated"), F.lit("drift")).otherwise(F.lit("breaking"))


def rank_diagnostics(diagnostics: DataFrame, patterns: tuple[str, ...] = globs.CRITICAL_PATTERNS) -> DataFrame:
    """Within each repository and class, critical paths (100) before others (10), then in the order of ``ordinal``."""
    rows = diagnostics.withColumn("class", severity_class(F.col("rule"), F.col("severity")))
    rows = rows.withColumn("priority", F.when(is_critical(F.col("path"), patterns), F.lit(100)).otherwise(F.lit(10)))
    return numbered(rows, ["repo_id", "class"], [F.desc("priority"), F.col("ordinal")], "rank")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows numbered within their keys, however many a key has: sorted slices are numbered by themselves, and what lies in the slices before
    is added.
    """
    sliced = written(rows.repartitionByRange(*keys, *order).withColumn("slice", F.spark_partition_id()), "slices")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(sliced.groupBy(*keys, "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("before", before).drop("n"), "slice-counts")
    own = sliced.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(*order)))
    return own.join(counts, [*keys, "slice"]).withColumn(name, (F.col(name) + F.col("before")).cast("int")).drop("slice", "before")


def is_critical(path: Column, patterns: tuple[str, ...] = globs.CRITICAL_PATTERNS) -> Column:
    """whether a path is business critical."""
    return globs.path_matches(path, patterns) | globs.path_contains(path, patterns)


def tag_critical(nodes: DataFrame, patterns: tuple[str, ...] = globs.CRITICAL_PATTERNS, boost: float = 2.5) -> DataFrame:
    """nodes with ``is_critical`` and ``criticality_weight``."""
    hit = F.coalesce(is_critical(F.col("path"), patterns), F.lit(False))
    return nodes.withColumn("is_critical", hit).withColumn("criticality_weight", F.when(hit, F.lit(boost)).otherwise(F.lit(1.0)))
