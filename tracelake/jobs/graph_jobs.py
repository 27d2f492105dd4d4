"""Registered queries on reachability: the trade graph (three levels, hubs) and the geography tree.

On the trade graph every customer is a seed, and reach by seeds ends at DEPTH hops (``max_depth`` of ``blast_radius``): a nation's
customers are all linked through parts, so whole components would have a row per pair of nodes. Components are given as classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.jobs import match_jobs
from tracelake.jobs.adapters import CALLS, GEO_EDGES, GEO_NODES, ROUTES, TRADE_EDGES, TRADE_NODES, TRADE_SEEDS, duck, table
from tracelake.operators import graph, reach

DEPTH = 3


def _trade(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(s, d, t) for t in (TRADE_NODES, TRADE_EDGES, TRADE_SEEDS))


def _blast(s: SparkSession, d: str) -> DataFrame:
    _, edges, seeds = _trade(s, d)
    return graph.blast_radius(edges, seeds, DEPTH)


def _summary(s: SparkSession, d: str) -> DataFrame:
    nodes, edges, seeds = _trade(s, d)
    return graph.reach_summary(edges, seeds, nodes, DEPTH)


def _induced(s: SparkSession, d: str) -> DataFrame:
    _, edges, seeds = _trade(s, d)
    return graph.reach_edges(edges.select("repo_id", "source", "target"), seeds, DEPTH)


def _component(s: SparkSession, d: str) -> DataFrame:
    """Unbounded reach on the geography tree: every node from every region."""
    nodes, edges = table(s, d, GEO_NODES), table(s, d, GEO_EDGES)
    return reach.reach(edges, graph.nodes_by_type(nodes, "model").select("repo_id", F.col("id").alias("node")))


def _geo_paths(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = table(s, d, GEO_NODES), table(s, d, GEO_EDGES)
    return graph.simple_paths(edges, graph.nodes_by_type(nodes, "model").select("repo_id", F.col("id").alias("node")))


def _modified(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "SELECT repo_id, path FROM (" + TRADE_NODES + ") AS n WHERE node_type = 'frontend_component' UNION SELECT 'n1', 'docs/new.md' FROM {region}")


def _chains(s: SparkSession, d: str) -> DataFrame:
    return graph.trace_chains(_geo_paths(s, d).filter("depth >= 1"), table(s, d, GEO_NODES))


# of calls the last parts, of routes a part of the path with the handler, the handler, the file, a piece of the id
_CALL_TARGETS = """
SELECT repo_id, 'fetch::' || CAST(line AS STRING) AS target FROM ({calls}) AS c
UNION SELECT repo_id, substr(path, 5, 20) || '::fetch' FROM ({calls}) AS c
UNION SELECT repo_id, substr(path, 5, 20) || '::' || handler FROM ({routes}) AS r
UNION SELECT repo_id, handler FROM ({routes}) AS r UNION SELECT repo_id, path FROM ({routes}) AS r UNION SELECT repo_id, substr(handler, 2, 9) FROM ({routes}) AS r
UNION SELECT repo_id, 'api' || chr(92) || substr(path, 5, 20) FROM ({routes}) AS r UNION SELECT repo_id, '' FROM ({routes}) AS r UNION SELECT repo_id, 'none' || handler FROM ({routes}) AS r""".replace("{calls}", CALLS).replace("{routes}", ROUTES)


_TARGETS = "SELECT 'geo' AS repo_id, n_name AS target FROM {nation} UNION SELECT 'geo', 's::' || CAST(s_suppkey AS STRING) FROM {supplier} UNION SELECT 'geo', CAST(n_nationkey AS STRING) FROM {nation} UNION SELECT 'geo', 'models/regions.py' FROM {region} UNION SELECT 'geo', ':1' FROM {region} UNION SELECT 'geo', 'nowhere' FROM {region}"

_WALK = """
near AS (SELECT repo_id, source AS node, target AS next FROM edges UNION SELECT repo_id, target, source FROM edges),
walk AS (
  SELECT repo_id, node AS seed, node, 0 AS depth, [node] AS path FROM seeds
  UNION ALL
  SELECT w.repo_id, seed, next, depth + 1, list_append(path, next) FROM walk w JOIN near n ON w.repo_id = n.repo_id AND w.node = n.node WHERE NOT list_contains(path, next) AND depth < {depth})"""
_TRADE = f"WITH RECURSIVE nodes AS ({duck(TRADE_NODES)}), edges AS ({duck(TRADE_EDGES)}), seeds AS ({duck(TRADE_SEEDS)}), {_WALK.format(depth=DEPTH).strip()}, reached AS (SELECT repo_id, seed, node, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM walk GROUP BY ALL)"
_GEO = f"WITH RECURSIVE nodes AS ({duck(GEO_NODES)}), edges AS ({duck(GEO_EDGES)}), seeds AS (SELECT repo_id, id AS node FROM nodes WHERE node_type = 'model'), {_WALK.format(depth=8).strip()}"
_SUMMARY = """
SELECT repo_id, seed, count(DISTINCT node) AS n_nodes, count(DISTINCT path) AS n_files, count(DISTINCT node) FILTER (WHERE node_type = 'frontend_component') AS n_calls, count(DISTINCT node) FILTER (WHERE node_type = 'api_route') AS n_routes,
       string_agg(DISTINCT path, ';' ORDER BY path) AS files
FROM (SELECT r.repo_id, seed, node, n.path, node_type FROM reached r JOIN nodes n ON n.repo_id = r.repo_id AND n.id = r.node WHERE node <> seed) GROUP BY ALL"""

ENTRIES = {
    "g3_blast_radius": (lambda s, d: _blast(s, d).withColumn("path", F.array_join("path", ">")), _TRADE + " SELECT repo_id, seed, node, depth, array_to_string(path, '>') AS path FROM reached"),
    "g3_component": (_component, _GEO + " SELECT repo_id, seed, node, min(depth) AS depth FROM walk GROUP BY ALL"),
    "g3_classes": (lambda s, d: reach.components(_trade(s, d)[1]), f"""
      WITH RECURSIVE edges AS ({duck(TRADE_EDGES)}), near AS (SELECT repo_id, source AS node, target AS next FROM edges UNION SELECT repo_id, target, source FROM edges),
      classes(repo_id, node, component) USING KEY (repo_id, node) AS (
        SELECT DISTINCT repo_id, node, node FROM near
        UNION SELECT n.repo_id, n.next, min(c.component) FROM classes c JOIN near n ON n.repo_id = c.repo_id AND n.node = c.node JOIN recurring.classes k ON k.repo_id = n.repo_id AND k.node = n.next WHERE c.component < k.component GROUP BY ALL)
      SELECT * FROM classes"""),
    "g4_simple_paths": (lambda s, d: graph.paths_by_depth(_geo_paths(s, d)).withColumn("path", F.array_join("path", ">")), _GEO + " SELECT repo_id, seed, node, depth, array_to_string(path, '>') AS path FROM walk"),
    "g4_trade_paths": (lambda s, d: graph.simple_paths(*_trade(s, d)[1:], max_depth=4).withColumn("path", F.array_join("path", ">")), _TRADE.replace(f"depth < {DEPTH}", "depth < 4") + " SELECT repo_id, seed, node, depth, array_to_string(path, '>') AS path FROM walk"),
    "g5_blast_summary": (lambda s, d: _summary(s, d).withColumn("files", F.array_join("files", ";")), _TRADE + _SUMMARY),
    "g6_impacted_files": (lambda s, d: graph.impacted_files(_modified(s, d), *_trade(s, d)[:2]), f"""
      WITH RECURSIVE nodes AS ({duck(TRADE_NODES)}), edges AS ({duck(TRADE_EDGES)}),
      modified AS (SELECT repo_id, path FROM nodes WHERE node_type = 'frontend_component' UNION SELECT 'n1', 'docs/new.md'),
      near AS (SELECT repo_id, source AS node, target AS next FROM edges UNION SELECT repo_id, target, source FROM edges),
      walk AS (SELECT n.repo_id, n.id AS node FROM nodes n JOIN modified m ON n.repo_id = m.repo_id AND n.path = m.path UNION SELECT w.repo_id, next FROM walk w JOIN near USING (repo_id, node))
      SELECT DISTINCT n.repo_id, n.path FROM nodes n JOIN walk w ON n.repo_id = w.repo_id AND n.id = w.node UNION SELECT repo_id, path FROM modified"""),
    "g7_trace_chains": (_chains, _GEO + """, full_paths AS (SELECT w.repo_id, seed, path, list_extract(path, 3) AS s, list_extract(path, 2) AS n FROM walk w WHERE depth = 2)
      SELECT f.repo_id, seed, s.symbol || '.tsx -> ' || n.title || ' -> ' || r.symbol AS chain FROM full_paths f JOIN nodes s ON s.id = f.s JOIN nodes n ON n.id = f.n JOIN nodes r ON r.id = f.seed
      UNION SELECT w.repo_id, w.seed, r.symbol || ' -> ' || n.symbol FROM walk w JOIN nodes r ON r.id = w.seed JOIN nodes n ON n.id = w.node WHERE depth = 1 AND w.seed NOT IN (SELECT seed FROM full_paths)"""),
    "g8_induced_edges": (_induced, _TRADE + """
      SELECT e.repo_id, a.seed, source, target FROM edges e JOIN reached a ON a.repo_id = e.repo_id AND a.node = e.source JOIN reached b ON b.repo_id = e.repo_id AND b.node = e.target AND a.seed = b.seed"""),
    "f9_nodes_by_type": (lambda s, d: graph.nodes_by_type(_trade(s, d)[0], "route").groupBy("repo_id").agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("path").alias("files")), f"SELECT repo_id, count(*) AS routes, count(DISTINCT path) AS files FROM ({duck(TRADE_NODES)}) WHERE node_type = 'api_route' GROUP BY repo_id"),
    "j18_resolve_target": (lambda s, d: graph.resolve_target(table(s, d, GEO_NODES), table(s, d, _TARGETS)), f"""
      WITH nodes AS ({duck(GEO_NODES)}), targets AS ({duck(_TARGETS)}),
      tried AS (SELECT n.repo_id, target, id, CASE WHEN id = target THEN 1 WHEN ends_with(id, ':' || target) THEN 2 WHEN symbol = target THEN 4 WHEN path = target THEN 5 WHEN contains(id, target) THEN 6 END AS rank FROM nodes n JOIN targets t ON n.repo_id = t.repo_id)
      SELECT repo_id, target, arg_min(id, (rank, id)) AS id FROM tried WHERE rank IS NOT NULL GROUP BY ALL"""),
    "j18_resolve_call_targets": (lambda s, d: graph.resolve_target(match_jobs.nodes_of(s, d), table(s, d, _CALL_TARGETS)), f"""
      WITH {match_jobs.BASE}, targets AS (SELECT *, replace(target, chr(92), '/') AS t FROM ({duck(_CALL_TARGETS)}) WHERE target <> ''),
      nodes AS (SELECT repo_id, call_id AS id, path, NULL AS symbol FROM calls UNION SELECT repo_id, route_id, path, handler FROM routes UNION SELECT repo_id, path || '::' || class_name, path, class_name FROM classes),
      ends AS (SELECT repo_id, id, unnest(list_transform(range(2, len(string_split(id, ':')) + 1), lambda k: array_to_string(string_split(id, ':')[k:], ':'))) AS t FROM nodes),
      named AS (
        SELECT t.repo_id, target, id, 1 AS rank FROM targets t JOIN nodes n ON t.repo_id = n.repo_id AND t.t = id
        UNION ALL SELECT t.repo_id, target, id, 2 FROM targets t JOIN ends n ON t.repo_id = n.repo_id AND t.t = n.t
        UNION ALL SELECT t.repo_id, target, id, 3 FROM targets t JOIN nodes n ON t.repo_id = n.repo_id AND symbol = split_part(t.t, '::', -1) WHERE contains(t.t, '::') AND contains(id, split_part(t.t, '::', 1))
        UNION ALL SELECT t.repo_id, target, id, 4 FROM targets t JOIN nodes n ON t.repo_id = n.repo_id AND symbol = t.t
        UNION ALL SELECT t.repo_id, target, id, 5 FROM targets t JOIN nodes n ON t.repo_id = n.repo_id AND path = t.t),
      inside AS (SELECT t.repo_id, target, id, 6 AS rank FROM targets t JOIN nodes n ON t.repo_id = n.repo_id AND contains(id, t.t) WHERE (t.repo_id, target) NOT IN (SELECT (repo_id, target) FROM named))
      SELECT repo_id, target, arg_min(id, (rank, id)) AS id FROM (SELECT * FROM named UNION ALL SELECT * FROM inside) GROUP BY ALL"""),
}
