"""Registered queries on extraction: sources are written out of ``part``, and the oracles read the expected records from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.jobs.adapters import table
from tracelake.operators import checks, graph
from tracelake.sources import extract, tables
from tracelake.streaming import changes


def _parts(s: SparkSession, d: str, text: str) -> DataFrame:
    """Parts, dealt out over the cores before files are written out of them: their table is small, and few tasks would read it."""
    return tables.dealt(table(s, d, text), "p_partkey")


def _client(s: SparkSession, d: str) -> DataFrame:
    """A client file per part: a template call with options, a member call, a commented call, a bare identifier; a template in a template behind
    nested type arguments, a call in markup among quotes, and one that does not close.
    """
    part = _parts(s, d, "SELECT * FROM {part}")
    lines = F.concat(
        F.lit("// fetch('/api/skip')\nconst a = await fetch(`/api/parts/${ partId }/"), "p_size", F.lit("`, { method: '"), F.when(F.col("p_size") % 2 == 0, F.lit("put")).otherwise(F.lit("POST")), F.lit("' });\n"),
        F.lit("api.get(\"/api/parts/"), "p_partkey", F.lit("\");\nfetch(url);\nclient('plain');\napi.get<Array<Part>>(`/api/${ a ? `x/${a}` : '' }/"), "p_size", F.lit("`);\n"),
        F.lit("const v = <p title=\"it's\">it's {http.delete?.('/api/parts/"), "p_partkey", F.lit("/x')} that's</p>;\nopen('(', fetch('/api/open/"), "p_partkey", F.lit("', {method: 'patch'\n"),
    )
    return part.select((F.col("p_partkey") % 3).cast("string").alias("repo_id"), F.concat(F.lit("web/p"), "p_partkey", F.lit(".tsx")).alias("path"), lines.alias("content"))


def _server(s: SparkSession, d: str) -> DataFrame:
    """A handler file per part, a model file per part, and an application file per hundred parts that includes their routers; a package passes the
    applications on to the main file, which includes them.

    Routers, imports and includes are written in three ways: short, with calls among the arguments, and over several lines or by module.
    """
    part = _parts(s, d, "SELECT *, CAST(floor(p_partkey / 3) % 3 AS INT) AS way, CAST(p_partkey AS STRING) AS k FROM {part}")
    repo = (F.col("p_partkey") % 3).cast("string").alias("repo_id")
    of_way = lambda way, *texts: F.when(way == 0, texts[0]).when(way == 1, texts[1]).otherwise(texts[2])
    router = of_way(F.col("way"), F.lit("APIRouter(prefix='/parts')"), F.lit('APIRouter(prefix="/parts", dependencies=[Depends(auth)], tags=["a", "b"])'), F.lit("APIRouter(\n    dependencies=[Depends(auth(1))],\n    prefix='/parts',\n)"))
    handlers = F.concat(
        F.lit("from models.m"), "k", F.lit(" import Part"), "k", F.lit("\nrouter = "), router, F.lit("\n\n@router.get('/{part_id}/"), "p_size", F.lit("', response_model=PartOut)\n@limit(3)\ndef read_"), "k",
        F.lit("(part_id, db):\n    row = db.query(Part"), "k", F.lit(")\n    return row.plan, row.name, row.absent_"), "p_size", F.lit("\n\n@mcp.tool()\ndef tool_"), "k", F.lit("():\n    \"Counts.\"\n    return 1\n"),
    )
    models = F.concat(
        F.lit("class Part"), "p_partkey", F.lit("(Base):\n    __tablename__ = 'parts_"), "p_size", F.lit("'\n    id = Column(String, primary_key=True)\n    name = Column(String, nullable=False)\n    plan = mapped_column(Integer)\n    owner_id = Column(String, ForeignKey('owners.id'))\n    owner = relationship('Owner')\n"),
    )
    added = lambda way, k: of_way(
        way,
        F.concat(F.lit("from routers.h"), k, F.lit(" import router as r"), k, F.lit("\napp.include_router(r"), k, F.lit(", prefix='/api')\n")),
        F.concat(F.lit("from routers.h"), k, F.lit(" import (\n    router as r"), k, F.lit(",\n    extra as x"), k, F.lit(",\n)\napp.include_router(r"), k, F.lit(', dependencies=[Depends(auth)], prefix="/api")\n')),
        F.concat(F.lit("from routers import h"), k, F.lit(" as r"), k, F.lit("\napp.include_router(\n    r"), k, F.lit(".router,\n    prefix='/api',\n    tags=['x'],\n)\n")),
    )
    app = part.groupBy(repo, F.floor(F.col("p_partkey") / 100).alias("h")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", "way", "k"))).alias("keys")).select(
        "repo_id", F.concat(F.lit("app"), "h", F.lit(".py")).alias("path"), F.concat(F.lit("app = FastAPI()\n"), F.array_join(F.transform("keys", lambda x: added(x["way"], x["k"])), "")).alias("content")
    )
    one = part.select(repo, F.concat(F.lit("routers/h"), "p_partkey", F.lit(".py")).alias("path"), handlers.alias("content"))
    two = part.select(repo, F.concat(F.lit("models/m"), "p_partkey", F.lit(".py")).alias("path"), models.alias("content"))
    held = part.select(repo, F.floor(F.col("p_partkey") / 100).cast("string").alias("h")).distinct().groupBy("repo_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    lines = lambda path, head, of: held.select("repo_id", F.lit(path).alias("path"), F.concat(F.lit(head), F.array_join(F.transform("hs", of), "")).alias("content"))
    package = lines("apps/__init__.py", "", lambda h: F.concat(F.lit("from app"), h, F.lit(" import app as a"), h, F.lit("\n")))
    main = lines("main.py", "root = FastAPI()\n", lambda h: F.concat(F.lit("from apps import a"), h, F.lit("\nroot.include_router(a"), h, F.lit(", prefix='/root')\n")))
    return one.unionByName(two).unionByName(app).unionByName(package).unionByName(main)


def _tree(s: SparkSession, d: str) -> DataFrame:
    """The client files as a tree in the shared folder, read back; beside each a note that is no source, a copy in an ignored folder, and one in a
    folder that the tree's ignore file names. A task writes the four of a part together: a folder takes one new file at a time, so tasks that all
    write into the same one would wait for each other. The three have the file's content and are further names of it.
    """
    root = tables.new_path(s, "tree")
    files = _client(s, d).select("path", "content")
    moved = lambda old, new: F.replace("path", F.lit(old), F.lit(new))
    rules = files.limit(1).select(F.lit(".gitignore").alias("path"), F.lit("# made\nmade/\n").alias("content"))
    same = F.array(moved(".tsx", ".md"), moved("web/", "web/node_modules/"), moved("web/", "web/made/"))
    every = files.withColumn("same", same).unionByName(rules, allowMissingColumns=True)
    tables.write_source_files(every, root if "://" in root else f"file://{root.removeprefix('file:')}")
    return tables.read_source_files(s, root, "tree").select("repo_id", "path", "size", "sha256")


def _facts(s: SparkSession, d: str) -> DataFrame:
    return extract.python_facts(_server(s, d))


def _models(s: SparkSession, d: str) -> DataFrame:
    return extract.extract_models(_facts(s, d))


def _fields(s: SparkSession, d: str) -> DataFrame:
    rows = _models(s, d).select("repo_id", "class_name", "table_name", F.array_join("relationships", ",").alias("relationships"), F.explode("fields").alias("f"))
    return rows.select("repo_id", "class_name", "table_name", "relationships", F.col("f.name").alias("name"), F.col("f.data_type").alias("data_type"), F.col("f.is_primary_key").alias("is_primary_key"), F.col("f.is_nullable").alias("is_nullable"), F.col("f.foreign_key").alias("foreign_key"))


def _named(models: DataFrame) -> DataFrame:
    return models.withColumn("fields", F.transform("fields", lambda f: f["name"]))


def _routes(s: SparkSession, d: str) -> DataFrame:
    facts = _facts(s, d)
    out = extract.resolve_router_prefix(extract.extract_routes(facts), facts)
    return out.select("repo_id", "path", "line", "handler", "norm_path", F.array_join("methods", ",").alias("methods"), F.array_join("path_params", ",").alias("params"), "response_model", F.array_join("model_refs", ",").alias("model_refs"))


def _missing(s: SparkSession, d: str) -> DataFrame:
    facts = _facts(s, d)
    bindings, accesses = extract.extract_attribute_uses(facts)
    return checks.missing_attributes(accesses, bindings, _named(extract.extract_models(facts)))


def _linked(s: SparkSession, d: str) -> DataFrame:
    facts = _facts(s, d)
    return graph.link_routes_to_models(extract.extract_routes(facts), _named(extract.extract_models(facts)))


def _maintained(s: SparkSession, d: str) -> DataFrame:
    """Two flushed batches of changes; between them a repository's only file goes, and another one gets a file."""
    sent, index, stored, kept = (tables.new_path(s, x) for x in ("flushed", "index", "graph", "progress"))
    hashed = _server(s, d).withColumns({"mtime": F.lit(1.0), "size": F.length("content").cast("long"), "sha256": F.sha2("content", 256)})
    single = lambda repo: s.createDataFrame([(repo, "m.py", "class Only(Base):\n    id = Column(Integer)\n", 1.0, 40, repo)], hashed.schema)
    contents = {1: hashed.unionByName(single("gone")), 2: hashed.unionByName(single("2"))}

    def parse(misses: DataFrame) -> DataFrame:
        facts = extract.python_facts(contents[now].join(misses, ["repo_id", "path"], "left_semi"))
        held = facts.groupBy("repo_id", "path").agg(F.collect_list(F.struct(*[c for c in facts.columns if c not in ("repo_id", "path")])).alias("facts"))
        return misses.join(held, ["repo_id", "path"])

    def build(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        facts = rows.select("repo_id", "path", F.inline("facts"))
        routes, models = extract.extract_routes(facts), _named(extract.extract_models(facts))
        none = s.createDataFrame([], "repo_id string, path string, line int, ordinal int")
        matches = s.createDataFrame([], "repo_id string, call_id string, route_id string, confidence double, is_exact boolean, param_map map<string,string>")
        return graph.build_nodes(none, routes, models), graph.build_edges(matches, graph.link_routes_to_models(routes, models), graph.link_models(models))

    for now in (1, 2):
        touched = contents[1].select("repo_id") if now == 1 else s.createDataFrame([("gone",), ("2",)], "repo_id string")
        touched.distinct().withColumn("flush_ts", F.lit(now)).write.mode("append").parquet(sent)
        stream = s.readStream.schema("repo_id string, flush_ts int").parquet(sent)
        current = lambda asked: contents[now].drop("content").join(asked, "repo_id", "left_semi")
        changes.maintain_graph(stream, current, parse, build, index, stored, kept).awaitTermination()
    nodes, edges = tables.read_graph(s, stored)
    return nodes.select("repo_id", "id", "type").unionByName(edges.select("repo_id", F.concat_ws(">", "source", "target").alias("id"), F.col("relation_type").alias("type")))


_REPO = "(p_partkey % 3)::VARCHAR AS repo_id"
_WAY = "p_partkey // 3 % 3"
_MORE = f"CASE WHEN {_WAY} = 2 THEN 3 ELSE 0 END"  # lines of the long router
_CLIENT = """
  '// fetch(''/api/skip'')' || chr(10) || 'const a = await fetch(`/api/parts/${ partId }/' || p_size || '`, { method: ''' || CASE WHEN p_size % 2 = 0 THEN 'put' ELSE 'POST' END || ''' });' || chr(10)
  || 'api.get("/api/parts/' || p_partkey || '");' || chr(10) || 'fetch(url);' || chr(10) || 'client(''plain'');' || chr(10)
  || 'api.get<Array<Part>>(`/api/${ a ? `x/${a}` : '''' }/' || p_size || '`);' || chr(10) || 'const v = <p title="it''s">it''s {http.delete?.(''/api/parts/' || p_partkey || '/x'')} that''s</p>;' || chr(10)
  || 'open(''('', fetch(''/api/open/' || p_partkey || ''', {method: ''patch''' || chr(10)"""
ENTRIES = {
    "s1_source_tree": (_tree, f"SELECT 'tree' AS repo_id, 'web/p' || p_partkey || '.tsx' AS path, strlen({_CLIENT}) AS size, sha256({_CLIENT}) AS sha256 FROM part"),
    "e1_e4_calls": (lambda s, d: extract.extract_calls(_client(s, d)).select("repo_id", "path", "line", "norm_path", "method", F.array_join("path_params", ",").alias("params"), "is_template"), f"""
      SELECT {_REPO}, 'web/p' || p_partkey || '.tsx' AS path, 2 AS line, '/api/parts/{{partId}}/' || p_size AS norm_path, CASE WHEN p_size % 2 = 0 THEN 'PUT' ELSE 'POST' END AS method, 'partId' AS params, true AS is_template FROM part
      UNION ALL SELECT {_REPO}, 'web/p' || p_partkey || '.tsx', 3, '/api/parts/' || p_partkey, 'GET', '', false FROM part
      UNION ALL SELECT {_REPO}, 'web/p' || p_partkey || '.tsx', 6, '/api/{{a ? `x/${{a}}` : ''''}}/' || p_size, 'GET', 'a ? `x/${{a}}` : ''''', true FROM part
      UNION ALL SELECT {_REPO}, 'web/p' || p_partkey || '.tsx', 7, '/api/parts/' || p_partkey || '/x', 'DELETE', '', false FROM part
      UNION ALL SELECT {_REPO}, 'web/p' || p_partkey || '.tsx', 8, '/api/open/' || p_partkey, 'GET', '', false FROM part"""),
    "e5_e9_routes_j4_prefix": (_routes, f"""
      SELECT {_REPO}, 'routers/h' || p_partkey || '.py' AS path, 4 + {_MORE} AS line, 'read_' || p_partkey AS handler, '/root/api/parts/{{part_id}}/' || p_size AS norm_path, 'GET' AS methods, 'part_id' AS params, 'PartOut' AS response_model, 'Part' || p_partkey AS model_refs FROM part
      UNION ALL SELECT {_REPO}, 'routers/h' || p_partkey || '.py', 10 + {_MORE}, 'tool_' || p_partkey, 'tools/tool_' || p_partkey, 'MCP_TOOL', '', 'Counts.', '' FROM part"""),
    "e10_imports": (lambda s, d: extract.imports_and_includes(_server(s, d))[0].select("repo_id", "path", "name", "module"), f"""
      SELECT {_REPO}, 'routers/h' || p_partkey || '.py' AS path, 'Part' || p_partkey AS name, 'models.m' || p_partkey AS module FROM part
      UNION ALL SELECT {_REPO}, 'app' || p_partkey // 100 || '.py', 'r' || p_partkey, CASE WHEN {_WAY} = 2 THEN 'routers' ELSE 'routers.h' || p_partkey END FROM part
      UNION ALL SELECT {_REPO}, 'app' || p_partkey // 100 || '.py', 'x' || p_partkey, 'routers.h' || p_partkey FROM part WHERE {_WAY} = 1
      UNION ALL SELECT DISTINCT {_REPO}, 'apps/__init__.py', 'a' || p_partkey // 100, 'app' || p_partkey // 100 FROM part UNION ALL SELECT DISTINCT {_REPO}, 'main.py', 'a' || p_partkey // 100, 'apps' FROM part"""),
    "e10_includes": (lambda s, d: extract.imports_and_includes(_server(s, d))[1].drop("ordinal"), f"SELECT {_REPO}, 'app' || p_partkey // 100 || '.py' AS path, 'app' AS parent, 'r' || p_partkey || CASE WHEN {_WAY} = 2 THEN '.router' ELSE '' END AS target, '/api' AS prefix FROM part UNION ALL SELECT DISTINCT {_REPO}, 'main.py', 'root', 'a' || p_partkey // 100, '/root' FROM part"),
    "e11_e12_models": (_fields, f"""
      SELECT {_REPO}, 'Part' || p_partkey AS class_name, 'parts_' || p_size AS table_name, 'Owner' AS relationships, name, data_type, is_primary_key, is_nullable, foreign_key
      FROM part, (VALUES ('id', 'String', true, false, NULL), ('name', 'String', false, false, NULL), ('plan', 'Integer', false, true, NULL), ('owner_id', 'String', false, true, 'owners.id')) AS v(name, data_type, is_primary_key, is_nullable, foreign_key)"""),
    "e13_attribute_uses": (lambda s, d: extract.extract_attribute_uses(_server(s, d))[1].filter("path NOT LIKE 'app%.py' AND path <> 'main.py'").select("repo_id", "path", "line", "obj", "attr"), f"""
      SELECT {_REPO}, 'routers/h' || p_partkey || '.py' AS path, x.at + {_MORE} AS line, x.obj AS obj, x.attr AS attr
      FROM part, LATERAL (SELECT unnest([{{'at': 4, 'obj': 'router', 'attr': 'get'}}, {{'at': 7, 'obj': 'db', 'attr': 'query'}}, {{'at': 8, 'obj': 'row', 'attr': 'plan'}}, {{'at': 8, 'obj': 'row', 'attr': 'name'}}, {{'at': 8, 'obj': 'row', 'attr': 'absent_' || p_size}}, {{'at': 10, 'obj': 'mcp', 'attr': 'tool'}}]) AS x)"""),
    "e13_bindings": (lambda s, d: extract.extract_attribute_uses(_server(s, d))[0].select("repo_id", "path", "line", "var", "rhs"), f"""
      SELECT {_REPO}, 'routers/h' || p_partkey || '.py' AS path, 2 AS line, 'router' AS var,
             CASE {_WAY} WHEN 0 THEN 'APIRouter(prefix=''/parts'')' WHEN 1 THEN 'APIRouter(prefix="/parts", dependencies=[Depends(auth)], tags=["a", "b"])'
                         ELSE 'APIRouter(' || chr(10) || '    dependencies=[Depends(auth(1))],' || chr(10) || '    prefix=''/parts'',' || chr(10) || ')' END AS rhs FROM part
      UNION ALL SELECT {_REPO}, 'routers/h' || p_partkey || '.py', 7 + {_MORE}, 'row', 'db.query(Part' || p_partkey || ')' FROM part
      UNION ALL SELECT {_REPO}, 'models/m' || p_partkey || '.py', x.at, x.var, x.rhs
      FROM part, LATERAL (SELECT unnest([{{'at': 2, 'var': '__tablename__', 'rhs': '''parts_' || p_size || ''''}}, {{'at': 3, 'var': 'id', 'rhs': 'Column(String, primary_key=True)'}}, {{'at': 4, 'var': 'name', 'rhs': 'Column(String, nullable=False)'}},
        {{'at': 5, 'var': 'plan', 'rhs': 'mapped_column(Integer)'}}, {{'at': 6, 'var': 'owner_id', 'rhs': 'Column(String, ForeignKey(''owners.id''))'}}, {{'at': 7, 'var': 'owner', 'rhs': 'relationship(''Owner'')'}}]) AS x)
      UNION ALL SELECT DISTINCT {_REPO}, 'app' || p_partkey // 100 || '.py', 1, 'app', 'FastAPI()' FROM part UNION ALL SELECT DISTINCT {_REPO}, 'main.py', 1, 'root', 'FastAPI()' FROM part"""),
    "u3_valid_attributes": (lambda s, d: checks.valid_attributes(_named(_models(s, d))), f"SELECT {_REPO}, 'Part' || p_partkey AS class_name, unnest(['id', 'name', 'plan', 'owner_id', 'Owner', '__tablename__', 'metadata']) AS attr FROM part"),
    "j13_missing_attributes": (_missing, f"""
      SELECT {_REPO}, 'routers/h' || p_partkey || '.py' AS path, 8 + {_MORE} AS line, 'Attribute ''absent_' || p_size || ''' does not exist on model ''Part' || p_partkey || '''' AS message, 'error' AS severity, 'schema-attribute-missing' AS rule, 'python' AS source FROM part"""),
    "j5_extracted_links": (_linked, f"SELECT {_REPO}, 'routers/h' || p_partkey || '.py::read_' || p_partkey AS source, 'models/m' || p_partkey || '.py::Part' || p_partkey AS target FROM part"),
    "r3_maintain_graph": (_maintained, f"""
      SELECT {_REPO}, 'routers/h' || p_partkey || '.py::read_' || p_partkey AS id, 'api_route' AS type FROM part
      UNION ALL SELECT {_REPO}, 'routers/h' || p_partkey || '.py::tool_' || p_partkey, 'api_route' FROM part
      UNION ALL SELECT {_REPO}, 'models/m' || p_partkey || '.py::Part' || p_partkey, 'schema_model' FROM part
      UNION ALL SELECT '2', 'm.py::Only', 'schema_model'
      UNION ALL SELECT {_REPO}, 'routers/h' || p_partkey || '.py::read_' || p_partkey || '>models/m' || p_partkey || '.py::Part' || p_partkey, 'USES_MODEL' FROM part"""),
}
