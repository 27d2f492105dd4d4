"""Registered queries on files, diagnostics, tests and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import labels
from tracelake.jobs.adapters import CHANGED_FILES, CHANGES, FILES, PASSAGES, PROBLEMS, SNAPSHOTS, TEST_FILES, duck, table
from tracelake.operators import checks, impact, incremental, reach, reports
from tracelake.sources import tables
from tracelake.streaming.changes import debounce_changes

GAP = "2 hours"


def _files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, FILES)


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("sha256", labels.content_hash(F.col("content")))


def _decisions(s: SparkSession, d: str) -> DataFrame:
    return incremental.incremental_index(_hashed(_files(s, d)), _hashed(table(s, d, CHANGED_FILES)))


def _merged(s: SparkSession, d: str) -> DataFrame:
    current, cache = _hashed(_files(s, d)), _hashed(table(s, d, CHANGED_FILES)).select("repo_id", "path", "mtime", "size", "sha256", F.lit("old").alias("parsed"))
    decisions = _decisions(s, d)
    fresh = current.join(decisions.filter("decision = 'parse'").select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("repo_id", "path", "mtime", "size", "sha256", F.lit("new").alias("parsed"))
    return incremental.merge_index(decisions, cache, fresh)


def _tested(s: SparkSession, d: str) -> DataFrame:
    return impact.map_tests_to_routes(impact.search_tokens(table(s, d, PASSAGES)), table(s, d, TEST_FILES))


_LENGTH = "'models/len_' || CAST(CAST(floor(length(text) / 20) AS INT) AS STRING) || '.py'"  # an item's model: those of like length share one
_ROUTE_MODELS = "SELECT 'bench' AS repo_id, 'api/' || CAST(item_id AS STRING) || '.py::item_' || CAST(item_id AS STRING) AS source, " + _LENGTH + " || '::Item' AS target FROM {benchmark}"
_MODIFIED = "SELECT 'bench' AS repo_id, CAST(doc_id AS STRING) || '.spec.ts' AS path FROM {documents} WHERE doc_id % 7 = 0 UNION SELECT 'bench', 'api/' || CAST(item_id AS STRING) || '.py' FROM {benchmark} WHERE item_id % 3 = 0 UNION SELECT 'bench', " + _LENGTH + " FROM {benchmark} WHERE item_id % 5 = 0"


def _impacted(s: SparkSession, d: str) -> DataFrame:
    """Tests and files of routes and models are modified; what these reach on the graph of routes and their models counts too."""
    modified, edges = table(s, d, _MODIFIED), table(s, d, _ROUTE_MODELS)
    ends = edges.select("repo_id", F.col("source").alias("node")).unionByName(edges.select("repo_id", F.col("target").alias("node"))).distinct()
    seeds = ends.withColumn("path", F.substring_index("node", "::", 1)).join(modified, ["repo_id", "path"], "left_semi")
    return impact.impacted_tests(modified, table(s, d, TEST_FILES), _tested(s, d), reach.reach_of_set(edges, seeds))


def _snippets(s: SparkSession, d: str) -> DataFrame:
    return reports.code_snippets(table(s, d, PROBLEMS), _files(s, d)).select("repo_id", "path", "ordinal", "snippet")


def _baseline(s: SparkSession, d: str) -> DataFrame:
    now = table(s, d, PROBLEMS)
    return checks.new_diagnostics(now, now.filter("ordinal % 3 <> 1").withColumn("line", F.col("line") + (F.col("ordinal") % 2).cast("int"))).select("repo_id", "path", "line", "message")


def _status_lines(s: SparkSession, d: str) -> DataFrame:
    moved = table(s, d, "SELECT CASE ordinal % 3 WHEN 0 THEN ' M ' || path WHEN 1 THEN 'R  old/' || path || ' -> ' || path ELSE '?? ' || path END AS value FROM (" + FILES + ") AS f WHERE ordinal % 2 = 0")
    named = table(s, d, "SELECT path AS value FROM (" + FILES + ") AS f WHERE ordinal % 3 = 0")
    return incremental.changed_files(tables.read_change_list(moved), tables.read_change_list(named))


_IGNORE_LISTS = """
SELECT DISTINCT coalesce(source, '') AS repo_id, '.gitignore' AS path, '# built' || chr(10) || '*_test.ts' || chr(13) || chr(10) || chr(10) || '/lib/de/' || chr(10) || '!lib/de/d5.py' || chr(10) || 'd1[0-4]?.*' AS content FROM {documents}
UNION SELECT DISTINCT coalesce(source, ''), 'src/en/.gitignore', 'd?.py' || chr(10) || 'd[!1-8]*' FROM {documents}"""


def _unignored(s: SparkSession, d: str) -> DataFrame:
    return incremental.drop_ignored(_files(s, d), rules=incremental.ignore_rules(table(s, d, _IGNORE_LISTS))).select("repo_id", "path")


def _indexed(s: SparkSession, d: str) -> DataFrame:
    """A7 with a graph of a node per file, and an edge from each file to the next of its repository and folder."""
    files = _files(s, d)
    nodes = files.select("repo_id", F.col("path").alias("id"))
    edges = files.filter(F.col("path").like("%.py")).select("repo_id", F.col("path").alias("source"), F.concat("path", F.lit("::main")).alias("target"))
    return incremental.index_report(_decisions(s, d), nodes, edges)


def _report(s: SparkSession, d: str) -> DataFrame:
    path = tables.new_path(s, "report")
    tables.write_report(table(s, d, PROBLEMS).select("path", "line", "rule", "message"), path)
    return s.read.text(path)


_F = f"files AS ({duck(FILES)}), cache AS ({duck(CHANGED_FILES)}), problems AS ({duck(PROBLEMS)})"
_SRC = "regexp_matches(lower(path), '\\.(ts|tsx|js|jsx|py)$')"
_CRIT = "regexp_matches(path, 'auth|billing|payment')"
_CLASS = "CASE WHEN severity = 'warning' OR contains(rule, 'drift') OR contains(rule, 'deprecated') THEN 'drift' ELSE 'breaking' END"
_DECIDED = f"""WITH {_F}, decided AS (
  SELECT f.repo_id, f.path, f.mtime, f.size, sha256(f.content) AS sha256, CASE WHEN f.mtime = c.mtime AND f.size = c.size THEN 'hit' WHEN sha256(f.content) = sha256(c.content) THEN 'hash_hit' ELSE 'parse' END AS decision
  FROM files f LEFT JOIN cache c ON f.repo_id = c.repo_id AND f.path = c.path)"""
_BENCH = f"WITH tests AS ({duck(TEST_FILES)}), routes AS ({duck(PASSAGES)}), hits AS (SELECT DISTINCT r.repo_id, route_id, ordinal, r.path AS route_path, t.path AS test FROM routes r JOIN tests t ON (raw_path <> '' AND raw_path <> '/' AND contains(t.content, raw_path)) OR contains(t.content, handler) OR contains(t.content, r.path))"

ENTRIES = {
    "f1_source_files": (lambda s, d: _files(s, d).filter(incremental.is_source_file(F.col("path"))).select("repo_id", "path"), f"WITH {_F} SELECT repo_id, path FROM files WHERE {_SRC}"),
    "f2_drop_ignored": (lambda s, d: incremental.drop_ignored(_files(s, d), ("*_test.ts",)).select("repo_id", "path"), f"WITH {_F} SELECT repo_id, path FROM files WHERE NOT (path LIKE 'node_modules/%' OR path LIKE 'scripts/%' OR regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR path LIKE '%!_test.ts' ESCAPE '!')"),
    "f3_test_files": (lambda s, d: _files(s, d).filter(impact.is_test_file(F.col("path"))).select("repo_id", "path"), f"WITH {_F}, n AS (SELECT *, split_part(path, '/', -1) AS base FROM files) SELECT repo_id, path FROM n WHERE (starts_with(base, 'test_') AND ends_with(base, '.py')) OR ends_with(base, '_test.py') OR ends_with(base, '.test.tsx')"),
    "f4_tag_critical": (lambda s, d: checks.tag_critical(_files(s, d)).select("repo_id", "path", "is_critical", "criticality_weight"), f"WITH {_F} SELECT repo_id, path, {_CRIT} AS is_critical, CASE WHEN {_CRIT} THEN 2.5::DOUBLE ELSE 1::DOUBLE END AS criticality_weight FROM files"),
    "f5_drop_config_ignored": (lambda s, d: incremental.drop_config_ignored(_files(s, d)).select("repo_id", "path"), f"WITH {_F} SELECT repo_id, path FROM files WHERE NOT ends_with(path, '.tmp')"),
    "t2_sorted_files": (lambda s, d: incremental.sorted_files(_files(s, d).select("repo_id", "path")), f"WITH {_F} SELECT repo_id, path FROM files ORDER BY path"),
    "c7_c10_tokens_hashes": (lambda s, d: _files(s, d).select("repo_id", "path", labels.estimate_tokens(F.col("content")).alias("tokens"), labels.content_hash(F.col("content")).alias("sha256")), f"WITH {_F} SELECT repo_id, path, CASE WHEN size = 0 THEN 0 ELSE greatest(1, floor(size / 3.8::DOUBLE)) END::BIGINT AS tokens, sha256(content) AS sha256 FROM files"),
    "a5_token_savings": (lambda s, d: reports.token_savings(_files(s, d), _files(s, d).withColumn("text", F.split_part("content", F.lit("\n"), F.lit(1)))), f"""
      WITH {_F}, n AS (SELECT repo_id, sum(size) + count(*) - 1 AS r, sum(length(split_part(content, chr(10), 1))) + count(*) - 1 AS s FROM files GROUP BY repo_id),
      t AS (SELECT repo_id, CASE WHEN r = 0 THEN 0 ELSE greatest(1, floor(r / 3.8::DOUBLE)) END::BIGINT AS raw_tokens, CASE WHEN s = 0 THEN 0 ELSE greatest(1, floor(s / 3.8::DOUBLE)) END::BIGINT AS slice_tokens FROM n)
      SELECT *, greatest(0, raw_tokens - slice_tokens) AS saved, round(greatest(0, raw_tokens - slice_tokens) * 100::DOUBLE / raw_tokens, 2) AS percent FROM t"""),
    "s4_u1_changed_files": (_status_lines, f"WITH {_F} SELECT DISTINCT path FROM files WHERE (ordinal % 2 = 0 OR ordinal % 3 = 0) AND {_SRC}"),
    "s5_report_lines": (_report, f"WITH {_F} SELECT '| ' || path || ' | ' || line || ' | ' || rule || ' | ' || message || ' |' AS value FROM problems"),
    "f8_w4_rank_diagnostics": (lambda s, d: checks.rank_diagnostics(table(s, d, PROBLEMS)).select("repo_id", "path", "class", "priority", "rank"), f"WITH {_F}, k AS (SELECT *, {_CLASS} AS class, CASE WHEN {_CRIT} THEN 100 ELSE 10 END AS priority FROM problems) SELECT repo_id, path, class, priority, row_number() OVER (PARTITION BY repo_id, class ORDER BY priority DESC, ordinal)::INT AS rank FROM k"),
    "c9_suggested_fix": (lambda s, d: table(s, d, PROBLEMS).groupBy(labels.suggested_fix(F.col("rule"), F.col("message")).alias("fix")).agg(F.count(F.lit(1)).alias("n")), f"""WITH {_F} SELECT CASE WHEN rule = 'schema-attribute-missing' OR contains(message, 'does not exist on model') THEN 'declare the attribute on the model or stop using it' WHEN contains(message, 'does not match any registered') THEN 'register the route or correct the path of the call'
      WHEN contains(lower(message), 'type') THEN 'bring request and response types in line' ELSE 'inspect the place and bring both sides of the contract in line' END AS fix, count(*) AS n FROM problems GROUP BY 1"""),
    "w5_code_snippets": (_snippets, f"""
      WITH {_F}, l AS (SELECT p.repo_id, p.path, p.ordinal, p.line, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM problems p JOIN files f ON p.repo_id = f.repo_id AND p.path = f.path),
      k AS (SELECT *, greatest(1, least(len(ls), line)) AS c FROM l)
      SELECT repo_id, path, ordinal, array_to_string(list_transform(range(greatest(1, c - 1), least(len(ls), c + 1) + 1), lambda i: CASE WHEN i = line THEN '> ' ELSE '  ' END || lpad(i::VARCHAR, 4, ' ') || ' | ' || ls[i]), chr(10)) AS snippet FROM k"""),
    "j14_new_diagnostics": (_baseline, f"WITH {_F} SELECT repo_id, path, line, message FROM problems p WHERE NOT EXISTS (SELECT 1 FROM problems b WHERE b.ordinal % 3 <> 1 AND b.repo_id = p.repo_id AND b.path = p.path AND b.message = p.message AND b.line + b.ordinal % 2 = p.line)"),
    "j15_overlay_files": (lambda s, d: checks.overlay_files(table(s, d, CHANGED_FILES), _files(s, d).filter("ordinal % 5 = 4")).select("repo_id", "path", F.sha2("content", 256).alias("content"), F.length("baseline").alias("baseline")), f"""
      WITH {_F}, m AS (SELECT * FROM files WHERE ordinal % 5 = 4)
      SELECT coalesce(c.repo_id, m.repo_id) AS repo_id, coalesce(c.path, m.path) AS path, sha256(coalesce(m.content, c.content)) AS content, length(coalesce(c.content, ''))::INT AS baseline FROM cache c FULL JOIN m ON c.repo_id = m.repo_id AND c.path = m.path"""),
    "r2_incremental_index": (_decisions, _DECIDED + " SELECT * FROM decided"),
    "a7_index_report": (_indexed, _DECIDED + " SELECT repo_id, count(*) AS total, count(*) FILTER (WHERE decision = 'parse') AS parsed, count(*) FILTER (WHERE decision <> 'parse') AS hits, count(*) AS nodes, count(*) FILTER (WHERE path LIKE '%.py') AS edges FROM decided GROUP BY repo_id"),
    "f2_repository_rules": (_unignored, f"""WITH {_F} SELECT repo_id, path FROM files WHERE NOT (path LIKE 'node_modules/%' OR path LIKE 'scripts/%' OR regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR path LIKE '%!_test.ts' ESCAPE '!' OR regexp_matches(path, '(^|/)lib/de/')
      OR regexp_matches(path, '(^|/)d1[0-4].\\.') OR regexp_matches(path, '^src/en/d.\\.py$') OR regexp_matches(path, '^src/en/d[^1-8]'))"""),
    "u2_merge_index": (_merged, _DECIDED + " SELECT repo_id, path, mtime, size, sha256, CASE decision WHEN 'parse' THEN 'new' ELSE 'old' END AS parsed FROM decided"),
    "f7_search_tokens": (lambda s, d: impact.search_tokens(table(s, d, PASSAGES)), f"WITH r AS ({duck(PASSAGES)}) SELECT DISTINCT repo_id, route_id, unnest([handler, raw_path, path]) AS token FROM r"),
    "j10_map_tests": (_tested, _BENCH + " SELECT repo_id, route_id, test FROM hits"),
    "j11_untested_routes": (lambda s, d: impact.untested_routes(table(s, d, PASSAGES), _tested(s, d)).select("repo_id", "route_id"), _BENCH + " SELECT repo_id, route_id FROM routes WHERE route_id NOT IN (SELECT route_id FROM hits)"),
    "a4_test_coverage": (lambda s, d: impact.test_coverage(table(s, d, PASSAGES), _tested(s, d)), _BENCH + " SELECT repo_id, count(*) AS routes, count(*) FILTER (WHERE route_id IN (SELECT route_id FROM hits)) AS tested_routes, round(count(*) FILTER (WHERE route_id IN (SELECT route_id FROM hits)) / count(*)::DOUBLE, 3) AS coverage FROM routes GROUP BY repo_id"),
    "j12_impacted_tests": (_impacted, _BENCH + " SELECT 'bench' AS repo_id, path AS test FROM tests WHERE regexp_extract(path, '(\\d+)', 1)::BIGINT % 7 = 0 UNION SELECT repo_id, test FROM hits WHERE floor(length((SELECT any_value(raw_path) FROM routes r WHERE r.route_id = hits.route_id)) / 20) IN (SELECT floor(length(raw_path) / 20) FROM routes WHERE ordinal % 5 = 0 OR ordinal % 3 = 0) OR ordinal % 3 = 0"),
    "r1_debounced_changes": (lambda s, d: debounce_changes(table(s, d, CHANGES), GAP).select("repo_id", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("first_ts"), F.array_join("paths", ";").alias("paths"), "events"), f"""
      WITH c AS (SELECT * FROM ({duck(CHANGES)}) WHERE {_SRC}), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {GAP} THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY repo_id ORDER BY ts)),
      n AS (SELECT *, sum(new) OVER (PARTITION BY repo_id ORDER BY ts) AS island FROM g)
      SELECT repo_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS first_ts, string_agg(DISTINCT path, ';' ORDER BY path) AS paths, count(*) AS events FROM n GROUP BY repo_id, island"""),
    "w6_mtime_changes": (lambda s, d: reports.mtime_changes(table(s, d, SNAPSHOTS)).groupBy("repo_id", "path").agg(F.count(F.lit(1)).alias("changes")), f"WITH p AS ({duck(SNAPSHOTS)}), k AS (SELECT *, lag(mtime) OVER (PARTITION BY repo_id, path ORDER BY snapshot_ts) AS before FROM p) SELECT repo_id, path, count(*) AS changes FROM k WHERE before <> mtime GROUP BY ALL"),
}
