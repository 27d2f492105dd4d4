"""Registered queries on calls, routes and the graph built of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import labels, paths
from tracelake.jobs.adapters import CALLS, CLASSES, ROUTES, duck, table
from tracelake.operators import checks, graph, matching, reports, upkeep
from tracelake.sources import tables


def calls_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, CALLS)


def routes_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, ROUTES, split="methods model_refs")


def models_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, CLASSES, split="fields relationships")


def matches_of(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match_routes(calls_of(spark, sf), routes_of(spark, sf))


def nodes_of(spark: SparkSession, sf: str) -> DataFrame:
    return graph.build_nodes(calls_of(spark, sf), routes_of(spark, sf), models_of(spark, sf))


def edges_of(spark: SparkSession, sf: str) -> DataFrame:
    routes, models = routes_of(spark, sf), models_of(spark, sf)
    return graph.build_edges(matches_of(spark, sf), graph.link_routes_to_models(routes, models), graph.link_models(models))


def kept_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges, written: for what reads them more than once."""
    return tables.written(edges_of(spark, sf), "edges")


#: Routes that grow with the tables: one per part with a parameter, one per brand with two; and a call per part and line number.
PART_ROUTES = """
SELECT 'p' || CAST(p_partkey % 4 AS STRING) AS repo_id, 'part_' || CAST(p_partkey AS STRING) AS route_id, CAST(p_partkey AS INT) AS ordinal, 'GET,PUT' AS methods,
       '/api/' || lower(p_brand) || '/parts/' || CAST(p_partkey AS STRING) || '/{{view}}' AS norm_path FROM {part}
UNION ALL SELECT DISTINCT 'p' || CAST(p_partkey % 4 AS STRING), 'any_' || lower(p_brand), 0, 'GET', '/api/' || lower(p_brand) || '/parts/{{id}}/{{view}}' FROM {part}"""
PART_CALLS = """
SELECT DISTINCT 'p' || CAST(p_partkey % 4 AS STRING) AS repo_id, CAST(p_partkey AS STRING) || '::' || CAST(l_linenumber AS STRING) AS call_id, CASE WHEN l_linenumber % 2 = 0 THEN 'get' ELSE 'PUT' END AS method,
       '/api/' || lower(p_brand) || '/parts/' || CAST(p_partkey AS STRING) || '/l' || CAST(l_linenumber AS STRING) || '?q=1' AS norm_path, false AS is_template FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


def _routes_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Dealt out over the cores: the table of parts is small, and few tasks would read it."""
    return tables.dealt(table(spark, sf, PART_ROUTES, split="methods"), "repo_id", "route_id")


def _of_parts(spark: SparkSession, sf: str) -> DataFrame:
    matches = matching.match_routes(table(spark, sf, PART_CALLS), _routes_of_parts(spark, sf))
    return matching.rank_matches(matches).select("repo_id", "call_id", "route_id", "confidence", _params("param_map").alias("params"), "rank")


def _params(c: str) -> F.Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")


_PARTS = "list_filter(string_split({0}, '/'), lambda s: s <> '')"
_IS = "regexp_matches({0}, '^(\\{{.*\\}}|:.*)$')"
_NAME = "CASE WHEN " + _IS + " THEN trim({0}, '{{}}:') ELSE {0} END"
BASE = f"calls AS ({duck(CALLS)}), routes AS ({duck(ROUTES)}), classes AS ({duck(CLASSES)})"
# the pairwise rule, every call with every route of its repository, method and length
_PAIRS = f"""{BASE},
c AS (SELECT *, {_PARTS.format("norm_path")} AS cs FROM calls),
r AS (SELECT * EXCLUDE (methods), unnest(string_split(methods, ',')) AS m, {_PARTS.format("norm_path")} AS rs FROM routes),
z AS (SELECT c.repo_id, call_id, route_id, r.ordinal AS route_ordinal, c.method, c.is_template, cs, rs, list_zip(cs, rs) AS z FROM c JOIN r ON c.repo_id = r.repo_id AND c.method = r.m AND len(cs) = len(rs)),
scored AS (
  SELECT *, list_transform(z, lambda x: CASE WHEN {_IS.format("x[2]")} THEN 0.4::DOUBLE WHEN {_IS.format("x[1]")} OR x[1] <> x[2] THEN -1000::DOUBLE ELSE 1::DOUBLE END) AS scores FROM z),
fits AS (SELECT *, round(list_sum(scores) / len(scores), 2) AS confidence FROM scored WHERE list_min(scores) > 0),
matches AS (
  SELECT repo_id, call_id, route_id, route_ordinal, method, confidence, confidence = 1 AS is_exact,
         array_to_string(list_sort(list_transform(list_filter(z, lambda x: {_IS.format("x[2]")}), lambda x: ({_NAME.format("x[1]")}) || '=' || ({_NAME.format("x[2]")}))), ';') AS params
  FROM fits WHERE confidence >= 0.5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, call_id ORDER BY confidence DESC, route_ordinal, route_id) AS rank FROM matches)"""
_GRAPH = f"""{_PAIRS},
last_class AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, class_name ORDER BY path DESC, ordinal DESC) AS nth FROM classes) WHERE nth = 1),
all_nodes AS (
  SELECT repo_id, call_id AS id, 'frontend_component' AS node_type, path, line, NULL AS symbol, ordinal FROM calls
  UNION ALL SELECT repo_id, route_id, 'api_route', path, line, handler, ordinal FROM routes
  UNION ALL SELECT repo_id, path || '::' || class_name, 'schema_model', path, line, class_name, ordinal FROM classes),
nodes AS (SELECT * EXCLUDE (nth, ordinal) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY path DESC, ordinal DESC) AS nth FROM all_nodes) WHERE nth = 1),
route_models AS (SELECT DISTINCT r.repo_id, route_id AS source, k.path || '::' || k.class_name AS target FROM routes r JOIN last_class k ON r.repo_id = k.repo_id AND list_contains(string_split(r.model_refs, ','), k.class_name)),
model_links AS (SELECT DISTINCT a.repo_id, a.path || '::' || a.class_name AS source, b.path || '::' || b.class_name AS target FROM last_class a JOIN last_class b ON a.repo_id = b.repo_id AND list_contains(string_split(a.relationships, ','), b.class_name)),
all_edges AS (
  SELECT repo_id, call_id AS source, route_id AS target, 'calls' AS relation, 'FETCHES' AS relation_type, confidence, is_exact, params FROM matches
  UNION ALL SELECT repo_id, source, target, 'accesses', 'USES_MODEL', NULL, NULL, NULL FROM route_models
  UNION ALL SELECT repo_id, source, target, 'relates_to', 'RELATIONSHIP', NULL, NULL, NULL FROM model_links),
edges AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, source, target ORDER BY coalesce(confidence, 1), relation) AS nth FROM all_edges) WHERE nth = 1)"""


#: The same calls and routes after an edit: clients of one segment call another one's routes, and routes of any segment take one method more.
EDITED_CALLS = "SELECT repo_id, path, line, method, replace(norm_path, '/machinery/', '/furniture/') AS norm_path, is_template, ordinal, call_id FROM (" + CALLS + ") AS c"
EDITED_ROUTES = "SELECT repo_id, path, line, model_refs, handler, norm_path, CASE WHEN handler LIKE 'any%' THEN 'GET,PUT' ELSE methods END AS methods, ordinal, raw_path, route_id FROM (" + ROUTES + ") AS r"


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    calls, new_calls = (table(spark, sf, x).select("repo_id", "call_id", "method", "norm_path", "is_template") for x in (CALLS, EDITED_CALLS))
    routes, new_routes = (table(spark, sf, x, split="methods").select("repo_id", "route_id", "ordinal", "methods", "norm_path") for x in (ROUTES, EDITED_ROUTES))
    return upkeep.changed_matches(calls, new_calls, routes, new_routes).select("repo_id", "call_id", "route_id", "confidence", "change")


def _with(base: str, select: str) -> str:
    return f"WITH {base}\n{select}"


def _best(spark: SparkSession, sf: str) -> DataFrame:
    routes = routes_of(spark, sf).withColumn("norm_path", F.regexp_replace("norm_path", "^/api", ""))
    return matching.best_route(calls_of(spark, sf), routes)


_GUARD = """
SELECT repo_id, path, line, 'Endpoint ''' || norm_path || ''' does not match any registered backend route' AS message, 'error' AS severity, 'guard-unmatched-endpoint' AS rule, 'guard' AS source
FROM calls c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = c.repo_id AND e.source = c.call_id AND relation_type = 'FETCHES')"""
_UNKNOWN = f"""
SELECT repo_id, path, line, 'Fetch endpoint ''' || norm_path || ''' does not match any registered backend route' AS message, 'error' AS severity, 'unmatched-fetch-route' AS rule, 'typescript' AS source
FROM c WHERE repo_id IN (SELECT repo_id FROM routes) AND NOT EXISTS (
  SELECT 1 FROM r WHERE r.repo_id = c.repo_id AND len(rs) = len(cs)
  AND list_bool_and(list_transform(list_zip(cs, rs), lambda x: {_IS.format("x[1]")} OR {_IS.format("x[2]")} OR x[1] = x[2])))"""


def _unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return checks.unmatched_calls(calls_of(spark, sf), edges_of(spark, sf))


def _unknown(spark: SparkSession, sf: str) -> DataFrame:
    return checks.unknown_endpoints(calls_of(spark, sf), routes_of(spark, sf))


def _guard(spark: SparkSession, sf: str) -> DataFrame:
    return checks.guard_diagnostics(_unmatched(spark, sf), _unknown(spark, sf))


_HANDLER_FILES = """
SELECT repo_id, path, array_join(array_sort(collect_set(said)), chr(10)) AS content FROM (
  SELECT 'r' || CAST(c_custkey % 4 AS STRING) AS repo_id, 'api/' || lower(c_mktsegment) || '.py' AS path, 'raise HTTPException(status_code=' || CAST(400 + (c_custkey % 4 + c_nationkey % 3) % 5 AS STRING) || ')' AS said FROM {customer}) AS f
GROUP BY repo_id, path"""


def _contract(spark: SparkSession, sf: str) -> DataFrame:
    routes = routes_of(spark, sf).withColumns({"response_model": F.concat("handler", F.lit("_out")), "path_params": paths.path_params(F.col("norm_path"))})
    calls = calls_of(spark, sf).withColumn("raw_url", F.col("norm_path"))
    out = reports.route_contract(routes, kept_edges(spark, sf), calls, reports.status_codes(routes, table(spark, sf, _HANDLER_FILES)), F.col("norm_path").endswith("/items") | reports.asked_for("/api/v1/machinery/summary/"))
    joined = {c: F.array_join(c, ",") for c in ("methods", "path_params", "codes", "models")}
    return out.withColumns(joined).withColumn("params", _params("param_map")).drop("param_map")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    n, e = nodes_of(spark, sf), edges_of(spark, sf)
    routes = routes_of(spark, sf).select("repo_id", F.col("route_id").alias("id"), F.element_at("methods", 1).alias("method"), "norm_path")
    n = n.join(routes, ["repo_id", "id"], "left")
    named = labels.node_label(F.col("node_type"), F.col("path"), F.col("line"), F.col("method"), F.col("norm_path"), F.col("symbol"), F.lower("symbol"))
    nodes = n.select("repo_id", "id", named.alias("label"), labels.node_level(F.col("node_type")).alias("level"))
    shown = e.select("repo_id", F.concat_ws(">", "source", "target").alias("id"), labels.edge_label(F.col("relation"), F.col("confidence"), F.col("is_exact")).alias("label"), F.lit(0).alias("level"))
    return nodes.unionByName(shown)


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    path = tables.new_path(spark, "graph")
    tables.write_graph(nodes_of(spark, sf), edges_of(spark, sf), path)
    n, e = tables.read_graph(spark, path)
    return n.select("repo_id", "id", "type", "symbol").unionByName(e.select("repo_id", F.concat_ws(">", "source", "target").alias("id"), F.col("relation_type").alias("type"), F.col("confidence").cast("decimal(5,2)").cast("string").alias("symbol")))


def _exported(spark: SparkSession, sf: str) -> DataFrame:
    """S3: the graph written as JSON lines and read back: its nodes, edges and summaries."""
    path = tables.new_path(spark, "export")
    tables.export_graph_json(*tables.graph_tables(nodes_of(spark, sf), edges_of(spark, sf)), path)
    n, e, summary = tables.load_graph_json(spark, path)
    shown = n.select("repo_id", F.lit("node").alias("kind"), "id", F.concat_ws("|", "node_type", "path", "line").alias("body"))
    shown = shown.unionByName(e.select("repo_id", F.lit("edge").alias("kind"), F.concat_ws(">", "source", "target").alias("id"), F.concat_ws("|", "relation", F.col("confidence").cast("decimal(5,2)"), _params("param_map")).alias("body")))
    return shown.unionByName(summary.select("repo_id", F.lit("summary").alias("kind"), F.col("version").alias("id"), F.concat_ws("|", "node_count", "edge_count").alias("body")))


def _scalars(spark: SparkSession, sf: str) -> DataFrame:
    r = routes_of(spark, sf)
    return r.select(
        "repo_id", "route_id", paths.route_regex(F.col("norm_path")).alias("regex"), F.array_join(paths.path_params(F.col("norm_path")), ",").alias("params"), paths.join_prefix(F.lit("/v2/"), F.col("norm_path")).alias("prefixed"),
        paths.segment_count(F.col("norm_path")).alias("n_segments"), paths.normalize_file_path(F.concat(F.lit("C:\\w\\"), F.replace("path", F.lit("/"), F.lit("\\"))), F.lit("C:\\w")).alias("file"),
    )


ENTRIES = {
    "j1_match_routes": (lambda s, d: matches_of(s, d).select("repo_id", "call_id", "route_id", "method", "confidence", "is_exact", _params("param_map").alias("params")), _with(_PAIRS, "SELECT repo_id, call_id, route_id, method, confidence, is_exact, params FROM matches")),
    "j1_w1_routes_of_parts": (_of_parts, f"""
      WITH calls AS (SELECT DISTINCT l_partkey AS k, l_linenumber AS n, lower(p_brand) AS brand FROM lineitem JOIN part ON l_partkey = p_partkey),
      pairs AS (
        SELECT k, n, 'part_' || k AS route_id, 0.88::DOUBLE AS confidence, 'l' || n || '=view' AS params, 1 AS rank FROM calls
        UNION ALL SELECT k, n, 'any_' || brand, 0.76::DOUBLE, k || '=id;l' || n || '=view', 2 FROM calls WHERE n % 2 = 0)
      SELECT 'p' || (k % 4) AS repo_id, k || '::' || n AS call_id, route_id, confidence, params, rank FROM pairs"""),
    "j2_param_map": (lambda s, d: matches_of(s, d).select("repo_id", "call_id", "route_id", F.explode("param_map").alias("call_param", "route_param")), _with(_PAIRS, "SELECT repo_id, call_id, route_id, split_part(p, '=', 1) AS call_param, split_part(p, '=', 2) AS route_param FROM (SELECT *, unnest(string_split(params, ';')) AS p FROM matches) WHERE p <> ''")),
    "f6_filter_confidence": (lambda s, d: matching.filter_confidence(matches_of(s, d), 0.85).select("repo_id", "call_id", "route_id", "confidence"), _with(_PAIRS, "SELECT repo_id, call_id, route_id, confidence FROM matches WHERE confidence >= 0.85")),
    "w1_rank_matches": (lambda s, d: matching.rank_matches(matches_of(s, d)).select("repo_id", "call_id", "route_id", "confidence", "rank"), _with(_PAIRS, "SELECT repo_id, call_id, route_id, confidence, rank::INT AS rank FROM ranked")),
    "t1_top_matches": (lambda s, d: matching.top_matches(matches_of(s, d), 1).select("repo_id", "call_id", "route_id", "confidence"), _with(_PAIRS, "SELECT repo_id, call_id, route_id, confidence FROM ranked WHERE rank = 1")),
    "j3_best_route": (_best, _with(_PAIRS, f"""SELECT repo_id, call_id, route_id, confidence, strategy FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_id, call_id ORDER BY confidence DESC, route_ordinal, route_id) AS nth FROM (
        SELECT repo_id, call_id, route_id, route_ordinal, CASE WHEN t THEN 0.88::DOUBLE ELSE 1::DOUBLE END AS confidence, CASE WHEN t THEN 'template_slug_alignment' ELSE 'exact_static_match' END AS strategy
        FROM (SELECT *, is_template OR list_bool_or(list_transform(rs, lambda x: {_IS.format("x")})) AS t FROM fits))) WHERE nth = 1""")),
    "c_route_scalars": (_scalars, _with(BASE, r"""SELECT repo_id, route_id, '^' || regexp_replace(norm_path, '\{([a-z_]+)\}', '(?P<\1>[^/]+)', 'g') || '$' AS regex, array_to_string(regexp_extract_all(norm_path, '\{([a-z_]+)\}', 1), ',') AS params,
      '/v2' || norm_path AS prefixed, len(string_split(norm_path, '/')) - 1 AS n_segments, path AS file FROM routes""")),
    "g1_build_nodes": (nodes_of, _with(_GRAPH, "SELECT * FROM nodes")),
    "r3_changed_matches": (_deltas, f"""
      WITH was AS (WITH {_PAIRS} SELECT repo_id, call_id, route_id, confidence, params FROM matches), now AS (WITH {_PAIRS.replace(duck(CALLS), duck(EDITED_CALLS)).replace(duck(ROUTES), duck(EDITED_ROUTES))} SELECT repo_id, call_id, route_id, confidence, params FROM matches)
      SELECT repo_id, call_id, route_id, confidence, sum(x)::BIGINT AS change FROM (SELECT *, 1 AS x FROM now UNION ALL SELECT *, -1 FROM was) GROUP BY repo_id, call_id, route_id, confidence, params HAVING sum(x) <> 0"""),
    "g2_build_edges": (lambda s, d: edges_of(s, d).withColumn("params", _params("param_map")).drop("param_map"), _with(_GRAPH, "SELECT * FROM edges")),
    "w2_last_definition": (lambda s, d: graph.last_definition(models_of(s, d), "class_name").select("repo_id", "class_name", "path", "ordinal"), _with(_GRAPH, "SELECT repo_id, class_name, path, ordinal FROM last_class")),
    "w3_dedupe_edges": (lambda s, d: graph.dedupe_edges(matches_of(s, d).select("repo_id", F.col("method").alias("source"), F.col("route_id").alias("target"), F.lit("calls").alias("relation"), "confidence")), _with(_PAIRS, "SELECT repo_id, method AS source, route_id AS target, 'calls' AS relation, min(confidence) AS confidence FROM matches GROUP BY ALL")),
    "j5_routes_to_models": (lambda s, d: graph.link_routes_to_models(routes_of(s, d), models_of(s, d)), _with(_GRAPH, "SELECT * FROM route_models")),
    "j6_link_models": (lambda s, d: graph.link_models(models_of(s, d)), _with(_GRAPH, "SELECT * FROM model_links")),
    "j7_unmatched_calls": (_unmatched, _with(_GRAPH, _GUARD)),
    "j8_unknown_endpoints": (_unknown, _with(_PAIRS, _UNKNOWN)),
    "j9_unused_routes": (lambda s, d: checks.unused_routes(routes_of(s, d), edges_of(s, d)).select("repo_id", "route_id"), _with(_GRAPH, "SELECT repo_id, route_id FROM routes r WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.repo_id = r.repo_id AND m.route_id = r.route_id)")),
    "u4_guard_diagnostics": (_guard, _with(_GRAPH, _GUARD + " UNION ALL " + _UNKNOWN)),
    "a6_guard_summary": (lambda s, d: checks.guard_summary(_guard(s, d), calls_of(s, d), routes_of(s, d)), _with(_GRAPH + f", diags AS ({_GUARD} UNION ALL {_UNKNOWN})", """
      SELECT repo_id, (SELECT count(*) FROM calls c WHERE c.repo_id = x.repo_id) AS calls, (SELECT count(*) FROM routes r WHERE r.repo_id = x.repo_id) AS routes, count(*) AS errors, count(*) FILTER (WHERE rule = 'guard-unmatched-endpoint') AS unmatched, true AS has_breakage FROM diags x GROUP BY repo_id""")),
    "a1_stack_health": (lambda s, d: reports.stack_health(nodes_of(s, d), edges_of(s, d)), _with(_GRAPH, """
      SELECT repo_id, count(*) AS nodes, count(*) FILTER (WHERE node_type = 'frontend_component') AS calls, count(*) FILTER (WHERE node_type = 'api_route') AS routes, count(*) FILTER (WHERE node_type = 'schema_model') AS models,
             (SELECT count(*) FROM edges e WHERE e.repo_id = n.repo_id) AS edges FROM nodes n GROUP BY repo_id""")),
    "a2_confidence_breakdown": (lambda s, d: reports.confidence_breakdown(edges_of(s, d)), _with(_GRAPH, "SELECT repo_id, count(*) FILTER (WHERE confidence >= 0.99) AS exact, count(*) FILTER (WHERE confidence >= 0.8 AND confidence < 0.99) AS template, count(confidence) AS total, coalesce(round(avg(confidence), 2), 1) AS mean FROM edges GROUP BY repo_id")),
    "a8_route_matrix": (lambda s, d: reports.route_matrix(routes_of(s, d), models_of(s, d)), _with(_GRAPH, """
      SELECT r.repo_id, 'http' AS kind, norm_path, methods, r.path, handler, coalesce((SELECT string_agg(class_name || ':' || table_name || '(' || fields || ')', '; ' ORDER BY class_name) FROM last_class k WHERE k.repo_id = r.repo_id AND k.class_name = r.model_refs), '') AS models FROM routes r
      UNION ALL SELECT repo_id, 'model', class_name, '', path, table_name, fields FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, class_name ORDER BY ordinal DESC) AS nth FROM classes) WHERE nth = 1""")),
    "a9_callers_per_route": (lambda s, d: reports.callers_per_route(edges_of(s, d)), _with(_GRAPH, "SELECT repo_id, target AS route_id, source, confidence, row_number() OVER (PARTITION BY repo_id, target ORDER BY source)::INT AS nth FROM edges WHERE relation_type = 'FETCHES'")),
    "j16_route_contract": (_contract, _with(_GRAPH + """,
      said AS (SELECT DISTINCT 'r' || (c_custkey % 4)::VARCHAR AS repo_id, 'api/' || lower(c_mktsegment) || '.py' AS path, (400 + (c_custkey % 4 + c_nationkey % 3) % 5)::VARCHAR AS code FROM customer),
      codes AS (SELECT repo_id, path, string_agg(code, ',' ORDER BY code) AS codes FROM said WHERE code IN ('201', '400', '401', '403', '404') GROUP BY ALL),
      used AS (SELECT repo_id, source AS route_id, string_agg(DISTINCT split_part(target, '::', -1), ',' ORDER BY split_part(target, '::', -1)) AS models FROM edges WHERE relation_type = 'USES_MODEL' GROUP BY ALL)""", """
      SELECT r.repo_id, r.route_id, r.norm_path, split_part(r.methods, ',', 1) AS method, r.methods, r.handler, r.path, r.line, r.handler || '_out' AS response_model,
             array_to_string(regexp_extract_all(r.norm_path, '\\{([a-z_]+)\\}', 1), ',') AS path_params, '200' || coalesce(',' || k.codes, '') AS codes, u.models,
             e.source AS call_id, c.path AS caller_path, c.line AS caller_line, c.norm_path AS caller_url, e.confidence, e.is_exact, e.params
      FROM routes r LEFT JOIN codes k ON r.repo_id = k.repo_id AND r.path = k.path LEFT JOIN used u ON r.repo_id = u.repo_id AND r.route_id = u.route_id
      LEFT JOIN (SELECT * FROM edges WHERE relation_type = 'FETCHES') e ON e.repo_id = r.repo_id AND e.target = r.route_id LEFT JOIN calls c ON c.repo_id = e.repo_id AND c.call_id = e.source
      WHERE r.norm_path LIKE '%/items' OR r.norm_path = '/api/v1/machinery/summary'""")),
    "a6_unmatched_lists": (lambda s, d: checks.unmatched_lists(calls_of(s, d), routes_of(s, d), kept_edges(s, d)), _with(_GRAPH, """
      SELECT repo_id, 'call' AS kind, call_id AS id, path, line FROM calls c WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = c.repo_id AND e.source = c.call_id AND relation_type = 'FETCHES')
      UNION ALL SELECT repo_id, 'route', route_id, path, line FROM routes r WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo_id = r.repo_id AND e.target = r.route_id AND relation_type = 'FETCHES')""")),
    "c8_c12_labels": (_labels, _with(_GRAPH, """
      SELECT n.repo_id, id, CASE node_type WHEN 'frontend_component' THEN '[UI] ' || split_part(n.path, '/', -1) || ' (L' || n.line || ')' WHEN 'api_route' THEN '[API] ' || split_part(r.methods, ',', 1) || ' ' || r.norm_path ELSE '[DB] ' || symbol || ' (' || lower(symbol) || ')' END AS label,
             CASE node_type WHEN 'frontend_component' THEN 1 WHEN 'api_route' THEN 2 ELSE 3 END AS level
      FROM nodes n LEFT JOIN routes r ON n.repo_id = r.repo_id AND n.id = r.route_id
      UNION ALL SELECT repo_id, source || '>' || target, CASE relation WHEN 'relates_to' THEN '[RELATION]' WHEN 'accesses' THEN '[ORM]' ELSE CASE WHEN confidence >= 0.99 THEN '1.0 [STATIC]' WHEN confidence >= 0.8 THEN printf('%.2f [TEMPLATE]', confidence) ELSE printf('%.2f [PARAM]', confidence) END END, 0 FROM edges""")),
    "s3_exported_graph": (_exported, _with(_GRAPH, """
      SELECT repo_id, 'node' AS kind, id, node_type || '|' || path || '|' || line AS body FROM nodes
      UNION ALL SELECT repo_id, 'edge', source || '>' || target, relation || '|' || coalesce(confidence, 1)::DECIMAL(5, 2) || '|' || coalesce(params, '') FROM edges
      UNION ALL SELECT repo_id, 'summary', '1.0', n || '|' || (SELECT count(*) FROM edges e WHERE e.repo_id = k.repo_id) FROM (SELECT repo_id, count(*) AS n FROM nodes GROUP BY repo_id) k""")),
    "s2_stored_graph": (_stored, _with(_GRAPH, """
      SELECT repo_id, id, node_type AS type, coalesce(symbol, split_part(id, '::', -1)) AS symbol FROM nodes
      UNION ALL SELECT repo_id, source || '>' || target, relation_type, coalesce(confidence, 1)::DECIMAL(5, 2)::VARCHAR FROM edges""")),
}
