"""Sources, extraction, incremental indexing, diagnostics and streams."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracelake.functions import labels
from tracelake.jobs import code_jobs
from tracelake.operators import checks, graph, impact, incremental, reports
from tracelake.sources import extract, tables, tree
from tracelake.streaming.changes import debounce_changes, maintain_index

FILES = "repo_id string, path string, content string"

APP = """
from routers.analytics import router as analytics_router
from routers.auth import auth_router
app = FastAPI()
v2 = APIRouter(prefix="/api/v2")
v2.include_router(analytics_router)
app.include_router(auth_router, prefix="/api/v2")
"""
AUTH = """
auth_router = APIRouter(prefix="/auth")

@require(1)
@auth_router.post("/login", response_model=Token)
@auth_router.get("/login/{kind:path}")
async def login(kind, db):
    user = db.query(User).first()
    return user.name, user.lost
"""
MODELS = """
class User(Base):
    __tablename__ = "users"
    id = Column(String, primary_key=True)
    name: Mapped[str] = mapped_column("n", String(40), nullable=False)
    team_id = Column(ForeignKey("teams.id"))
    team = relationship("Team")

class Plain:
    x = 1
"""


def test_extraction(spark):
    files = spark.createDataFrame([("r", "backend/app.py", APP), ("r", "backend/routers/auth.py", AUTH), ("r", "backend/models.py", MODELS), ("r", "bad.py", "def ("), ("r", "empty.py", None)], FILES)
    routes = extract.resolve_router_prefix(extract.extract_routes(files), files)
    got = {(r["handler"], r["methods"][0], r["norm_path"], r["response_model"], tuple(r["path_params"]), tuple(r["model_refs"])) for r in routes.collect()}
    assert got == {("login", "POST", "/api/v2/auth/login", "Token", (), ("User",)), ("login", "GET", "/api/v2/auth/login/{kind:path}", None, ("kind",), ("User",))}
    models = extract.extract_models(files)
    row = models.first()
    assert models.count() == 1 and row["class_name"] == "User" and row["relationships"] == ["Team"]
    assert [tuple(f) for f in row["fields"]] == [("id", "String", True, False, None), ("name", "String", False, False, None), ("team_id", "Unknown", False, True, "teams.id")]
    bindings, accesses = extract.extract_attribute_uses(files)
    found = checks.missing_attributes(accesses, bindings, models.withColumn("fields", F.transform("fields", lambda f: f["name"])))
    assert [(r["line"], r["message"]) for r in found.collect()] == [(9, "Attribute 'lost' does not exist on model 'User'")]


def test_prefixes_beside_other_arguments(spark):
    """Calls among the arguments, imports over several lines, routers named by their module, nested and circular includes."""
    app = (
        "from fastapi import FastAPI\nfrom .routers import (\n    users as people,  # one\n    teams,\n)\nfrom routers.deep.items import (router as items_router)\n"
        "app = FastAPI()\nv1: APIRouter = fastapi.APIRouter(dependencies=[Depends(auth(1))], prefix=BASE)\n"
        'v2 = APIRouter(prefix="/v2/", dependencies=[Depends(auth)])\nouter = APIRouter(prefix="/outer")\nouter.include_router(v2, dependencies=[Depends(f())])\nv2.include_router(outer)\n'
        'app.include_router(people.router, dependencies=[Depends(auth)], prefix="/api")\nv2.include_router(\n    items_router,\n    prefix="/shop",\n)\napp.include_router(router=teams.router)\n'
    )
    users = 'router = APIRouter(prefix="/users", dependencies=[Depends(auth)])\n@router.get("/{id}")\ndef one(id): pass\n'
    items = 'router = APIRouter()\n@router.get("/all")\ndef many(): pass\n'
    files = spark.createDataFrame([("r", "src/app.py", app), ("r", "src/routers/users.py", users), ("r", "src/routers/teams.py", items), ("r", "src/routers/deep/items.py", items)], FILES)
    facts = extract.python_facts(files)
    for given in (files, facts):
        prefixes = {(r["path"], r["router"]): r["prefix"] for r in extract.router_prefixes(given).filter("path = 'src/app.py'").collect()}
        assert {k[1]: v for k, v in prefixes.items()} == {"app": "", "v1": "", "v2": "/outer/v2", "outer": "/v2/outer", "people.router": "/api", "items_router": "/outer/v2/shop", "teams.router": ""}
        imports, includes = extract.imports_and_includes(given)
        assert {(r["name"], r["module"]) for r in imports.collect()} == {("FastAPI", "fastapi"), ("people", ".routers"), ("teams", ".routers"), ("items_router", "routers.deep.items")}
        assert [(r["parent"], r["target"], r["prefix"]) for r in includes.orderBy("ordinal").collect()] == [("outer", "v2", ""), ("v2", "outer", ""), ("app", "people.router", "/api"), ("v2", "items_router", "/shop"), ("app", "teams.router", "")]
        routes = extract.resolve_router_prefix(extract.extract_routes(given), given)
        assert {(r["path"], r["norm_path"]) for r in routes.collect()} == {("src/routers/users.py", "/api/users/{id}"), ("src/routers/teams.py", "/all"), ("src/routers/deep/items.py", "/outer/v2/shop/all")}


def test_client_calls(spark):
    text = "/* fetch('/no') */\nconst u = 'http://x/y' // fetch('/no')\nawait fetch(\n  `/api/${ org.id }/x`, {method: \"delete\", body: f(1)})\nhttp.get<Foo>('/a')\nfetch(url)\nrequest('plain')\naxios.request('/r', {method: 'PATCH'})\n"
    got = extract.extract_calls(spark.createDataFrame([("r", "a.tsx", text)], FILES)).orderBy("ordinal")
    assert [(r["line"], r["norm_path"], r["method"], r["path_params"]) for r in got.collect()] == [(3, "/api/{org.id}/x", "DELETE", ["org.id"]), (5, "/a", "GET", []), (8, "/r", "PATCH", [])]


def test_ignore_rules_and_test_names(spark):
    names = ["backend/main.py", "frontend/App.tsx", "node_modules/a.js", ".venv/b.py", "x/__pycache__/c.py", "gone/d.py", "a/k.secret.py", "tests/test_a.py", "README.md"]
    files = spark.createDataFrame([("r", n) for n in names], "repo_id string, path string")
    kept = incremental.drop_ignored(files, ("gone", "gone/**", "*.secret.py")).filter(incremental.is_source_file(F.col("path")))
    assert {r["path"] for r in kept.collect()} == {"backend/main.py", "frontend/App.tsx"}
    tests = files.filter(impact.is_test_file(F.col("path"))).collect()
    assert [r["path"] for r in tests] == ["tests/test_a.py"]


def test_rules_taken_apart_match_like_shell_patterns(spark):
    import fnmatch
    import random

    draw = random.Random(4)
    names = ["a", "b", "lib", "x.py", "y.test.ts", "k.secret.py", "d1", "d2.js", "[z]", "_gen", "m_gen.py"]
    files = [(r, "/".join(draw.choices(names, k=draw.randint(1, 5)))) for r in "pq" for _ in range(400)]
    made = ["a/b", "lib/*", "*.py", "*_gen.py", "a/**", "d?.js", "[!a]*.ts", "x.*", "*/lib/x.py", "**/d1", "*s", "b/lib/*", "/a/", "*secret*", "y.test.ts", "[z]", "[z", "a/*/b"]
    for rules in ([("p", x) for x in made] + [("q", "m_gen.py")], *([("p", x)] for x in made)):
        got = {tuple(r) for r in incremental.ruled_out(spark.createDataFrame(files, "repo_id string, path string"), spark.createDataFrame(rules, "repo_id string, pattern string")).collect()} if len(rules) > 1 or rules[0][1] in ("[z", "*s", "a/**", "[z]") else None
        clean = {(r, x.strip("/").replace("/**", "/*")) for r, x in rules}
        want = {(r, f) for r, f in files for q, x in clean if r == q and (fnmatch.fnmatchcase(f, x) or fnmatch.fnmatchcase(f, f"*/{x}") or any(fnmatch.fnmatchcase(y, x) for y in f.split("/")))}
        assert got is None or got == want
    many = [("p", f"none{k}/*") for k in range(1000)] + [("p", "lib/*")]
    found = incremental.ruled_out(spark.createDataFrame(files, "repo_id string, path string"), spark.createDataFrame(many, "repo_id string, pattern string"))
    assert {tuple(r) for r in found.collect()} == {(r, f) for r, f in files if r == "p" and "lib" in f.split("/")[:-1]}


def test_critical_paths_rank_first(spark):
    rows = [("r", p, k, "error", "compiler-error") for k, p in enumerate(["users/profile.py", "billing/models.py", "auth/router.py"])]
    got = checks.rank_diagnostics(spark.createDataFrame(rows, "repo_id string, path string, ordinal int, severity string, rule string")).orderBy("rank")
    assert [r["path"] for r in got.collect()] == ["billing/models.py", "auth/router.py", "users/profile.py"]


def test_cache_life_cycle(spark):
    schema = "repo_id string, path string, mtime double, size long, sha256 string"
    current = spark.createDataFrame([("r", "a", 1.0, 5, "h1"), ("r", "b", 2.0, 5, "h2"), ("r", "c", 3.0, 5, "h3")], schema)
    cold = incremental.index_report(incremental.incremental_index(current, current.limit(0))).first()
    assert (cold["parsed"], cold["hits"]) == (3, 0)
    cache = spark.createDataFrame([("r", "a", 1.0, 5, "h1"), ("r", "b", 9.0, 5, "h2"), ("r", "c", 9.0, 4, "old"), ("r", "gone", 1.0, 1, "x")], schema)
    got = {r["path"]: r["decision"] for r in incremental.incremental_index(current, cache).collect()}
    assert got == {"a": "hit", "b": "hash_hit", "c": "parse"}


def test_baseline_diff_and_snippet(spark):
    schema = "repo_id string, path string, line int, message string"
    new = checks.new_diagnostics(spark.createDataFrame([("r", "a.py", 1, "old"), ("r", "a.py", 6, "new")], schema), spark.createDataFrame([("r", "a.py", 1, "old")], schema))
    assert [r["message"] for r in new.collect()] == ["new"]
    file = spark.createDataFrame([("r", "a.py", "\n".join(f"l{k}" for k in range(1, 9)) + "\n")], FILES)
    assert reports.code_snippets(new, file).first()["snippet"] == "     5 | l5\n>    6 | l6\n     7 | l7"


def test_tokens_and_labels(spark):
    row = spark.range(1).select(labels.estimate_tokens(F.lit("")).alias("a"), labels.estimate_tokens(F.lit("abc")).alias("b"), labels.estimate_tokens(F.lit("x" * 38)).alias("c"), labels.edge_label(F.lit("calls"), F.lit(0.88), F.lit(False)).alias("d")).first()
    assert tuple(row) == (0, 1, 10, "0.88 [TEMPLATE]")


def test_graph_round_trips(spark, tmp_path):
    nodes = spark.createDataFrame([("r", f"a.py::{k}", "api_route", "a.py", k, None) for k in range(3)], "repo_id string, id string, node_type string, path string, line int, symbol string")
    edges = spark.createDataFrame([("r", "a.py::0", f"a.py::{k}", None, None, None, None) for k in (1, 2)], "repo_id string, source string, target string, relation string, relation_type string, confidence double, is_exact boolean")
    tables.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = tables.read_graph(spark, str(tmp_path / "g"))
    assert {(r["symbol"], json.loads(r["properties"])["line"]) for r in n.collect()} == {("0", 0), ("1", 1), ("2", 2)}
    assert {(r["relation"], r["relation_type"], r["confidence"]) for r in e.collect()} == {("relates_to", "ASSOCIATION", 1.0)}
    tables.export_graph_json(n, e, str(tmp_path / "j"))
    n2, e2, summary = tables.load_graph_json(spark, str(tmp_path / "j"))
    assert (n2.count(), e2.count(), summary.first()["node_count"]) == (3, 2, 3)


def test_source_tree_and_change_list(spark, tmp_path):
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / "sub" / "a.py").write_text("x = 1\n")
    (tmp_path / "t" / "b.md").write_text("no")
    row = tables.read_source_files(spark, str(tmp_path / "t"), "r").first()
    assert (row["path"], row["content"], row["size"]) == ("sub/a.py", "x = 1\n", 6)
    lines = spark.createDataFrame([(" M a.py",), ("R  b.ts -> c.ts",), ("d.tsx",), ("?? e.md",), ("",)], "value string")
    assert {r["path"] for r in tables.read_change_list(lines).collect()} == {"a.py", "c.ts", "d.tsx"}
    tables.write_report(lines, str(tmp_path / "rep"))
    assert spark.read.text(str(tmp_path / "rep")).count() == 5


def test_source_tree_opens_only_what_it_reads(spark, tmp_path, monkeypatch):
    texts = {"a.py": "a", "x/b.ts": "b", "x/y/c.JSX": "c", "node_modules/z/d.js": "d", "x/venv/e.py": "e", "x/gone/f.py": "f", "gone/g.py": "g", "x/y/k.secret.py": "h", "tests/test_a.py": "i", "scripts/s.py": "j", "note.md": "k"}
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "x" / ".gitignore").write_text("# rules\n/gone/\n!kept\n\n*.secret.py\n")
    (tmp_path / "x" / "latin.py").write_bytes("# caf\u00e9".encode("latin-1"))
    with open(tmp_path / "x" / "artefact.bin", "wb") as file:
        file.truncate(3 << 30)
    want = {"a.py": "a", "x/b.ts": "b", "x/y/c.JSX": "c", "gone/g.py": "g", "x/latin.py": "# caf\ufffd"}
    assert {r["path"]: r["content"] for r in tables.read_source_files(spark, str(tmp_path), "r").collect()} == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert {r["path"] for r in tables.read_source_files(spark, str(tmp_path), "r").filter(F.col("path").startswith("x/y")).collect()} == {"x/y/c.JSX"}
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    opened, listed, real, real_list = [], [], tree.Reader._open, tree.Reader._list
    monkeypatch.setattr(tree.Reader, "_open", lambda self, store, path, info: opened.append(path) or real(self, store, path, info))
    monkeypatch.setattr(tree.Reader, "_list", lambda self, store, base, folder: listed.append(folder.path) or real_list(self, store, base, folder))
    for most, asked, files in ((64, None, set(want)), (2, None, set(want)), (64, tree.StringStartsWith(("path",), "x/y/"), {"x/y/c.JSX"}), (64, tree.EqualTo(("path",), "a.py"), {"a.py"}), (64, tree.In(("path",), ("x/b.ts", None)), {"x/b.ts"})):
        monkeypatch.setattr(tree, "FOLDERS", most)
        opened.clear(), listed.clear()
        reader = tree.PushingReader({"path": f"file:{tmp_path}"})
        assert not asked or list(reader.pushFilters([asked])) == [asked]
        rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("path").to_pylist()]
        assert sorted(rows) == sorted(opened) == sorted(files)
        assert not {x for x in listed if "node_modules" in x or "venv" in x or "x/gone" in x} and (asked is None or "tests" not in listed)
    monkeypatch.setattr(tree, "MOST_BYTES", 0)
    assert {r[2] for p in reader.partitions() for b in reader.read(p) for r in [list(x.values()) for x in b.to_pylist()]} == {None}


def test_one_large_folder_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "t" / "web" / "made").mkdir(parents=True)
    names = {f"web/p{k}.ts" for k in range(200)} | {f"web/\u00e9{k}.py" for k in range(3)} | {"a.py"}
    for path in names | {"web/made/g.py", "web/p7.md", "web/gone1.py"}:
        (tmp_path / "t" / path).write_text(path)
    (tmp_path / "t" / "web" / ".gitignore").write_text("made/\ngone*\n")
    monkeypatch.setattr(tree, "SHARE", 16)
    for tasks in (1, 4, 100):
        reader = tree.Reader({"path": f"file:{tmp_path}/t", "tasks": str(tasks)})
        parts = reader.partitions()
        got = [[x for b in reader.read(p) for x in b.column("path").to_pylist()] for p in parts]
        assert len([p for p in parts if p.path == "web"]) == min(tasks, 13) and sorted(x for g in got for x in g) == sorted(names)
        assert max(map(len, got)) <= 204 // min(tasks, 13) * 2
    assert {r["path"] for r in tables.read_source_files(spark, str(tmp_path / "t"), "r").collect()} == names


def test_names_of_one_file_take_one_inode(spark, tmp_path, monkeypatch):
    spark.range(1, 41).select(F.col("id").alias("p_partkey"), (F.col("id") % 9).cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    monkeypatch.setattr(tables, "new_path", lambda s, name: str(tmp_path / "shared" / name))
    got = code_jobs.ENTRIES["s1_source_tree"][0](spark, str(tmp_path)).collect()
    made = [x for x in (tmp_path / "shared").rglob("*") if x.is_file()]
    assert sorted(r["path"] for r in got) == sorted(f"web/p{k}.tsx" for k in range(1, 41))
    assert len(made) == 4 * 40 + 1 and {x.suffix for x in made} == {".tsx", ".md", ""} and len({x.stat().st_ino for x in made}) == 41
    files = spark.createDataFrame([("a/x.py", "new", ["a/y.md", "b/z.py"]), ("c.py", None, None)], "path string, content string, same array<string>")
    for _ in range(2):  # a task may be tried again
        tables.write_source_files(files, f"file:{tmp_path}/again")
    assert {str(x.relative_to(tmp_path / "again")): x.read_text() for x in (tmp_path / "again").rglob("*") if x.is_file()} == {"a/x.py": "new", "a/y.md": "new", "b/z.py": "new", "c.py": ""}


def test_stream_equals_batch_and_gap_is_inclusive(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("r", "a.ts", t), ("r", "b.ts", t + timedelta(seconds=1)), ("r", "a.ts", t + timedelta(seconds=2)), ("r", "c.ts", t + timedelta(seconds=9)), ("r", "x.md", t + timedelta(seconds=3)), ("q", "z.py", t + timedelta(days=1))]
    batch = spark.createDataFrame(rows, "repo_id string, path string, ts timestamp")
    batch.write.parquet(str(tmp_path / "in"))
    want = {(r["repo_id"], tuple(r["paths"]), r["events"]) for r in debounce_changes(batch, "1 second").collect()}
    assert ("r", ("a.ts", "b.ts"), 3) in want and len(want) == 3
    stream = debounce_changes(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "1 second", "1 second")
    query = stream.writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["repo_id"], tuple(r["paths"]), r["events"]) for r in spark.table("flushed").collect()}
    assert got == {x for x in want if x[0] == "r"}  # the last session stays open until the watermark passes it


def test_maintained_index(spark, tmp_path):
    schema = "repo_id string, path string, mtime double, size long, sha256 string"
    state = {"files": spark.createDataFrame([("r", "a", 1.0, 5, "h1"), ("s", "z", 1.0, 1, "h9")], schema)}
    parse = lambda misses: misses.withColumn("parsed", F.concat(F.lit("v-"), "sha256"))
    index, seen = str(tmp_path / "index"), []
    batch = "repo_id string, first_ts timestamp"
    for k, repo in enumerate(["r", "s", "r"]):
        spark.createDataFrame([(repo, datetime(2024, 1, 1 + k))], batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "flushed"))
        if k == 2:
            state["files"] = spark.createDataFrame([("r", "a", 2.0, 5, "h1"), ("r", "b", 1.0, 5, "h2")], schema)
        stream = spark.readStream.schema(batch).parquet(str(tmp_path / "flushed"))
        query = maintain_index(stream, lambda touched: state["files"].join(touched, "repo_id", "left_semi"), parse, index, str(tmp_path / "cp"), lambda d: seen.append(sorted(r["decision"] for r in d.collect())))
        query.awaitTermination()
    got = {(r["repo_id"], r["path"], r["mtime"], r["parsed"]) for r in spark.read.parquet(index).collect()}
    assert got == {("r", "a", 2.0, "v-h1"), ("r", "b", 1.0, "v-h2"), ("s", "z", 1.0, "v-h9")}
    assert seen == [["parse"], ["parse"], ["hash_hit", "parse"]]


def test_resolve_target_ranks(spark):
    nodes = spark.createDataFrame([("r", "a.py::User", "a.py", "User"), ("r", "b.py::UserProfile", "b.py", "UserProfile")], "repo_id string, id string, path string, symbol string")
    asked = spark.createDataFrame([("r", x) for x in ("User", "b.py", "Profile", "a.py::User", "none")], "repo_id string, target string")
    got = {r["target"]: r["id"] for r in graph.resolve_target(nodes, asked).collect()}
    assert got == {"User": "a.py::User", "b.py": "b.py::UserProfile", "Profile": "b.py::UserProfile", "a.py::User": "a.py::User"}


def test_resolve_target_shuffles_no_pieces_of_names(spark, monkeypatch):
    nodes = spark.range(2000).selectExpr("'r' || id % 2 AS repo_id", "'web/f' || id % 7 || '.ts::fetch::' || id AS id", "'web/f' || id % 7 || '.ts' AS path", "CAST(NULL AS STRING) AS symbol")
    asked = spark.createDataFrame([(r, x) for r in ("r0", "r1") for x in ("fetch::12", "f3.ts::fetch", "h", "::", "eb", "fetch::1999", "\u00e9::fetch", "web\\f3.ts", "etch::199")], "repo_id string, target string")
    ids = {r: sorted(f"web/f{k % 7}.ts::fetch::{k}" for k in range(2000) if k % 2 == int(r[1])) for r in ("r0", "r1")}
    want = {(r, x): next((i for i in ids[r] if i.endswith(f":{x}")), None) or next((i for i in ids[r] if x.replace("\\", "/") in i), None) for r in ids for x in {y["target"] for y in asked.collect()}}
    for pieces in (graph.PIECES, 0):
        monkeypatch.setattr(graph, "PIECES", pieces)
        got = graph.resolve_target(nodes, asked)
        assert {(r["repo_id"], r["target"]): r["id"] for r in got.collect()} == {k: v for k, v in want.items() if v}
    names, rest = nodes.select("repo_id", "id", F.col("id").alias("own")), asked.filter("target in ('e', 'h', 'fetch::1', 'etch::199')").withColumn("wanted", F.col("target"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.undo()
    pairs = graph.containing(names, rest)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan
    assert sorted(map(tuple, pairs.collect())) == sorted((r, x, i) for r, x in ((y["repo_id"], y["target"]) for y in rest.collect()) for i in ids[r] if x in i)


def test_resolve_target_by_ends_and_by_path_with_symbol(spark):
    nodes = spark.createDataFrame(
        [("r", "a.tsx::fetch::261", "a.tsx", None), ("r", "b.tsx::fetch::26", "b.tsx", None), ("r", "src/api/u.py::get", "src/api/u.py", "get"), ("r", "src/web/u.py::get", "src/web/u.py", "get"), ("q", "b.tsx::fetch::26", "b.tsx", None)],
        "repo_id string, id string, path string, symbol string",
    )
    want = {"fetch::26": "b.tsx::fetch::26", "26": "b.tsx::fetch::26", "api/u.py::get": "src/api/u.py::get", "web\\u.py::get": "src/web/u.py::get", "get": "src/api/u.py::get", "fetch::2": "a.tsx::fetch::261", "eb": "src/web/u.py::get", "61": "a.tsx::fetch::261"}
    asked = spark.createDataFrame([("r", x) for x in [*want, "", "zz", "fetchx"]] + [("q", "get")], "repo_id string, target string")
    assert {(r["repo_id"], r["target"]): r["id"] for r in graph.resolve_target(nodes, asked).collect()} == {("r", k): v for k, v in want.items()}
