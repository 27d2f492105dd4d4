"""The given tables as tables of the library. The derivations are SQL that Spark and DuckDB both read: one text serves both."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CALLS = """
SELECT *, line AS ordinal, path || '::fetch::' || CAST(line AS STRING) AS call_id FROM (
  SELECT 'r' || CAST(o_orderkey % 4 AS STRING) AS repo_id,
         'web/' || lower(c_mktsegment) || '/f' || CAST(o_orderkey % 50 AS STRING) || '.tsx' AS path, CAST(o_orderkey AS INT) AS line,
         CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'PUT' END AS method,
         '/api/v1/' || lower(c_mktsegment) || '/orders/' || CASE WHEN o_orderkey % 3 = 0 THEN '{{orderId}}' ELSE CAST(o_orderkey AS STRING) END
           || CASE WHEN o_orderkey % 5 = 0 THEN '/items' ELSE '' END AS norm_path,
         o_orderkey % 3 = 0 AS is_template
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS t"""

ROUTES = """
SELECT *, line AS ordinal, norm_path AS raw_path, path || '::' || handler AS route_id FROM (
  SELECT 'r' || CAST(k AS STRING) AS repo_id, 'api/' || seg || '.py' AS path, CAST(shape * 10 AS INT) AS line, upper(seg) AS model_refs,
         CASE shape WHEN 1 THEN 'order_' WHEN 2 THEN 'any_' WHEN 3 THEN 'items_' ELSE 'sum_' END || seg AS handler,
         CASE shape WHEN 1 THEN '/api/v1/' || seg || '/orders/{{order_id}}' WHEN 2 THEN '/api/v1/{{segment}}/orders/{{order_id}}'
                    WHEN 3 THEN '/api/v1/' || seg || '/orders/{{order_id}}/items' ELSE '/api/v1/' || seg || '/summary' END AS norm_path,
         CASE shape WHEN 1 THEN 'GET,POST' WHEN 3 THEN 'GET,PUT' ELSE 'GET' END AS methods
  FROM (SELECT DISTINCT lower(c_mktsegment) AS seg, c_custkey % 4 AS k, c_nationkey % 4 + 1 AS shape FROM {customer} WHERE c_mktsegment <> 'BUILDING') AS d) AS t"""

CLASSES = """
SELECT *, ordinal AS line FROM (
  SELECT DISTINCT 'r' || CAST(c_custkey % 4 AS STRING) AS repo_id, 'models/m' || CAST(c_nationkey % 3 AS STRING) || '.py' AS path,
         CAST(c_nationkey AS INT) AS ordinal, upper(c_mktsegment) AS class_name, lower(c_mktsegment) AS table_name,
         'id,name' || CASE WHEN c_nationkey % 2 = 0 THEN ',plan' ELSE '' END AS fields,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'MACHINERY' ELSE 'BUILDING' END AS relationships
  FROM {customer}) AS t"""

TRADE_NODES = """
SELECT 'n' || CAST(c_nationkey AS STRING) AS repo_id, 'c::' || CAST(c_custkey AS STRING) AS id, 'frontend_component' AS node_type,
       'web/' || lower(c_mktsegment) || '.tsx' AS path, CAST(c_custkey AS INT) AS line, CAST(c_custkey AS STRING) AS symbol FROM {customer}
UNION ALL
SELECT 'n' || CAST(c_nationkey AS STRING), 'o::' || CAST(o_orderkey AS STRING), 'api_route', 'api/' || lower(o_orderpriority) || '.py', CAST(o_orderkey AS INT), CAST(o_orderkey AS STRING)
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT DISTINCT 'n' || CAST(c_nationkey AS STRING), 'p::' || CAST(p_partkey AS STRING), 'schema_model', 'models/' || lower(p_brand) || '.py', CAST(p_partkey AS INT), CAST(p_partkey AS STRING)
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey"""

TRADE_EDGES = """
SELECT 'n' || CAST(c_nationkey AS STRING) AS repo_id, 'c::' || CAST(c_custkey AS STRING) AS source, 'o::' || CAST(o_orderkey AS STRING) AS target,
       'calls' AS relation, 'FETCHES' AS relation_type,
       CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.88 WHEN '3' THEN 0.85 WHEN '4' THEN 0.7 END AS DOUBLE) AS confidence,
       substr(o_orderpriority, 1, 1) = '1' AS is_exact
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT DISTINCT 'n' || CAST(c_nationkey AS STRING), 'o::' || CAST(o_orderkey AS STRING), 'p::' || CAST(l_partkey AS STRING), 'accesses', 'USES_MODEL', CAST(NULL AS DOUBLE), CAST(NULL AS BOOLEAN)
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey"""

TRADE_SEEDS = "SELECT 'n' || CAST(c_nationkey AS STRING) AS repo_id, 'c::' || CAST(c_custkey AS STRING) AS node FROM {customer}"

GEO_NODES = """
SELECT 'geo' AS repo_id, 's::' || CAST(s_suppkey AS STRING) AS id, 'frontend' AS node_type, 'web/' || s_name || '.tsx' AS path, s_name AS symbol, '' AS title FROM {supplier}
UNION ALL SELECT 'geo', 'n::' || CAST(n_nationkey AS STRING), 'route', 'api/nations.py', n_name, '/nations/' || n_name FROM {nation}
UNION ALL SELECT 'geo', 'r::' || CAST(r_regionkey AS STRING), 'model', 'models/regions.py', r_name, '' FROM {region}"""

GEO_EDGES = """
SELECT 'geo' AS repo_id, 's::' || CAST(s_suppkey AS STRING) AS source, 'n::' || CAST(s_nationkey AS STRING) AS target, 'calls' AS relation, 'FETCHES' AS relation_type, 1.0 AS confidence FROM {supplier}
UNION ALL SELECT 'geo', 'n::' || CAST(n_nationkey AS STRING), 'r::' || CAST(n_regionkey AS STRING), 'accesses', 'USES_MODEL', NULL FROM {nation}"""

FILES = """
SELECT source AS repo_id, ordinal, content, size, mtime,
       CASE ordinal % 7 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'billing/' WHEN 3 THEN 'scripts/' WHEN 4 THEN 'app/auth/' ELSE 'lib/' END || lang || '/'
         || CASE WHEN ordinal % 5 = 0 THEN 'test_' ELSE '' END || 'd' || CAST(ordinal AS STRING) || CASE WHEN ordinal % 11 = 0 THEN '_test' ELSE '' END
         || CASE ordinal % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.test.tsx' WHEN 3 THEN '.md' WHEN 4 THEN '.JSX' ELSE '.tmp' END AS path
FROM (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, doc_id AS ordinal, coalesce(text, '') AS content, CAST(length(coalesce(text, '')) AS BIGINT) AS size, CAST(doc_id % 997 AS DOUBLE) AS mtime FROM {documents}) AS d"""

TEST_FILES = "SELECT 'bench' AS repo_id, 'tests/' || CAST(doc_id AS STRING) || '.spec.ts' AS path, coalesce(text, '') AS content FROM {documents}"

PASSAGES = """
SELECT 'bench' AS repo_id, 'api/' || CAST(item_id AS STRING) || '.py::item_' || CAST(item_id AS STRING) AS route_id, CAST(item_id AS INT) AS ordinal,
       'api/' || CAST(item_id AS STRING) || '.py' AS path, 'item_' || CAST(item_id AS STRING) AS handler, text AS raw_path, '/' AS norm_path FROM {benchmark}"""

CHANGES = """
SELECT 'u' || CAST(user_id AS STRING) AS repo_id, 'src/' || event_type || '_' || CAST(event_id % 3 AS STRING) || CASE WHEN event_id % 4 = 3 THEN '.md' ELSE '.ts' END AS path, ts FROM {events}"""

SNAPSHOTS = """
SELECT 'u' || CAST(user_id AS STRING) AS repo_id, 'src/' || event_type || '.ts' AS path, ts AS snapshot_ts, event_id, CAST(floor(value / 10) AS DOUBLE) AS mtime FROM {events}"""

PROBLEMS = """
SELECT repo_id, path, CAST(ordinal % 9 + 1 AS INT) AS line, ordinal,
       CASE ordinal % 4 WHEN 0 THEN 'Attribute does not exist on model' WHEN 1 THEN 'Endpoint does not match any registered route' WHEN 2 THEN 'Type of value' ELSE 'Other' END AS message,
       CASE ordinal % 3 WHEN 0 THEN 'warning' ELSE 'error' END AS severity,
       CASE ordinal % 5 WHEN 0 THEN 'schema-drift' WHEN 1 THEN 'schema-attribute-missing' WHEN 2 THEN 'deprecated-field' ELSE 'compiler-error' END AS rule
FROM (""" + FILES + ") AS f"

CHANGED_FILES = "SELECT repo_id, path, ordinal, mtime + CASE WHEN ordinal % 4 = 0 THEN 1 ELSE 0 END AS mtime, size, content || CASE WHEN ordinal % 8 = 0 THEN 'x' ELSE '' END AS content FROM (" + FILES + ") AS f WHERE ordinal % 10 <> 9"


def tables_of(text: str) -> list[str]:
    return sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})


def table(spark: SparkSession, sf_dir: str, text: str, **lists: str) -> DataFrame:
    """An adapter's rows; columns named in ``lists`` are split at commas."""
    given = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in tables_of(text)}
    out = spark.sql(text, **given)
    for c in lists.get("split", "").split():
        out = out.withColumn(c, F.split(c, ","))
    return out


def duck(text: str) -> str:
    """The same text for DuckDB."""
    return text.format(**{name: name for name in tables_of(text)})
