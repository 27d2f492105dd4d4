"""Client files as they are written, and Python files of any depth."""

import time

import pytest

from pyspark.sql import functions as F

from tracelake.sources import extract
from tracelake.sources.client_lexer import client_calls

FILES = "repo_id string, path string, content string"
CLIENT = r"""
const a = fetch(`/a/${x ? `p/${x}` : ''}/b`, {headers: {method: 'no'}, 'method': "post"});
api.get<Array<User>>('/g');
api
  .users()
  .delete?.(`/api/${ org.id }/${ {a: '}'}.a }`)
// fetch('/no')
const r = /fetch('\/x')/g, s = "it's (";
new client('/no'); new Api().put('/yes');
const X = () => <div title="it's" onClick={() => http.post('/click', {method: 'PUT'})}>it's {fetch('/kid')} that's <b/> fetch('/text')</div>;
fetch('/a' + id); fetch('/a' as const);
axios.request('/r', {url: f({method: 'GET'}), method: PATCH})
const g = <T,>(x: T) => fetch<Map<string, {a: T[]}>>(`/t/${x}`)
a < b && fetch('/lt'); if (a > (b)) fetch("/gt", opts);
function fetch(url) {}
this.http!.head("/h")
foo['x'].get('/sub'); (await cl).get('/par')
fetch('/open' , {
"""


def test_calls_among_templates_types_markup_and_literals():
    got = [(line, path, params, verb, option) for line, _, path, params, _, verb, option in client_calls(CLIENT)]
    assert got == [
        (2, "/a/{x ? `p/${x}` : ''}/b", ["x ? `p/${x}` : ''"], "", "post"), (3, "/g", [], "get", None), (4, "/api/{org.id}/{{a: '}'}.a}", ["org.id", "{a: '}'}.a"], "delete", None), (9, "/yes", [], "put", None),
        (10, "/click", [], "post", None), (10, "/kid", [], "", None), (12, "/r", [], "", "PATCH"), (13, "/t/{x}", ["x"], "", None), (14, "/lt", [], "", None), (14, "/gt", [], "", None), (16, "/h", [], "head", None),
        (17, "/sub", [], "get", None), (17, "/par", [], "get", None), (18, "/open", [], "", None),
    ]
    assert list(client_calls("")) == [] and list(client_calls("fetch('plain')\n<T>fetch('/ts')", markup=False))[0][1] == "/ts"


@pytest.mark.parametrize("text, calls", [("fetch('/a/b', (x\n" * 4000, 4000), ("api.get(`/a/${x}/b`, {method: 'post'});\n" * 2000, 2000), ("a" + ".get('/x')" * 8000, 8000), ("fetch(`/a/${" * 3000, 0), ("([{" * 5000 + ")" * 9000, 0), ("'" * 50001, 0), ("a<" * 20000, 0), ("<a " * 20000, 0), ("{(" * 8000 + "}" * 8000, 0)])
def test_time_grows_with_the_length(text, calls):
    began = time.process_time()
    assert sum(1 for _ in client_calls(text)) == calls
    assert time.process_time() - began < 2e-5 * len(text) + 0.2


def test_files_of_any_depth_keep_their_records(spark):
    deep = "x = " + "+".join(["a"] * 900) + "\nrow = db.query(User)\ny = row.name\n@app.get('/deep')\ndef f(): return 1\n"
    too_deep = "x = " + "(" * 3000 + ")" * 3000
    circle = "app = FastAPI()\n" + "".join(f"r{k}.include_router(r{k + 1})\n" * 2 for k in range(60)) + "r60.include_router(r0)\n"
    chain = "".join(f"r{k}.include_router(r{k + 1})\n" for k in range(3000)) + "z = 1\nz.a\n"
    files = spark.createDataFrame([("r", "deep.py", deep), ("r", "too_deep.py", too_deep), ("r", "bad.py", "def ("), ("r", "circle.py", circle), ("r", "chain.py", chain), ("r", "ü.py", "é = 'ü'; b = f(\n  'ß')\n")], FILES)
    facts = extract.python_facts(files)
    assert {(r["path"], r["reason"]) for r in extract.skipped_files(facts).collect()} >= {("bad.py", "SyntaxError")}
    assert "deep.py" not in {r["path"] for r in extract.skipped_files(facts).collect()}
    bindings, accesses = extract.extract_attribute_uses(facts)
    assert {(r["path"], r["var"]): r["rhs"] for r in bindings.collect()}["deep.py", "row"] == "db.query(User)"
    assert {(r["path"], r["var"]): r["rhs"] for r in bindings.collect()}["ü.py", "b"] == "f(\n  'ß')"
    assert {(r["path"], r["obj"], r["attr"]) for r in accesses.collect()} >= {("deep.py", "row", "name"), ("chain.py", "z", "a")}
    assert [r["norm_path"] for r in extract.extract_routes(facts).collect()] == ["/deep"]


def test_prefixes_through_files_and_packages(spark):
    """Four files deep, by a package that passes a router on, by relative modules, and in circles; each way ends before a file comes up again."""
    texts = {
        "src/main.py": "from api import router as everything\napp = FastAPI()\napp.include_router(everything, prefix='/root')\n",
        "src/api/__init__.py": "from .v1 import router\nfrom . import extra\nother = APIRouter(prefix='/other')\nother.include_router(extra.router, prefix='/more')\n",
        "src/api/v1.py": "from .routers import users, teams as crew\nrouter = APIRouter(prefix='/v1')\nrouter.include_router(users.router, prefix='/people')\nrouter.include_router(crew.router)\n",
        "src/api/extra.py": "router = APIRouter()\n@router.get('/x')\ndef x(): pass\n",
        "src/api/routers/users/__init__.py": "from ..deep.items import router as items\nrouter = APIRouter(prefix='/users')\nrouter.include_router(items, prefix='/{id}')\n@router.get('/me')\ndef me(): pass\n",
        "src/api/routers/teams.py": "router = APIRouter(prefix='/teams')\n@router.get('/all')\ndef many(): pass\n",
        "src/api/routers/deep/items.py": "router = APIRouter(prefix='/items')\n@router.get('/{item}')\ndef one(): pass\n",
        "lib/routers/teams.py": "router = APIRouter()\n@router.get('/elsewhere')\ndef far(): pass\n",
        "round/a.py": "from .b import router as b\nrouter = APIRouter(prefix='/a')\nrouter.include_router(b)\n@router.get('/in_a')\ndef in_a(): pass\n",
        "round/b.py": "from .a import router as a\nrouter = APIRouter(prefix='/b')\nrouter.include_router(a)\n@router.get('/in_b')\ndef in_b(): pass\n",
    }
    chain = {f"chain/f{k}.py": f"from .f{k + 1} import router as below\nrouter = APIRouter()\nrouter.include_router(below, prefix='/p{k}')\n" for k in range(9)} | {"chain/f9.py": "router = APIRouter()\n@router.get('/end')\ndef end(): pass\n"}
    files = spark.createDataFrame([("r", path, text) for path, text in (texts | chain).items()], FILES)
    facts = extract.python_facts(files)
    got = {r["handler"]: r["norm_path"] for r in extract.resolve_router_prefix(extract.extract_routes(facts), facts).collect()}
    assert got == {
        "me": "/root/v1/people/users/me", "many": "/root/v1/teams/all", "one": "/root/v1/people/users/{id}/items/{item}", "x": "/other/more/x", "far": "/elsewhere", "in_a": "/b/a/in_a", "in_b": "/a/b/in_b",
        "end": "/" + "/".join(f"p{k}" for k in range(9)) + "/end",
    }


def test_records_go_on_in_small_batches_and_parts_are_dealt_out(spark, monkeypatch):
    import ast

    import pyarrow as pa

    from tracelake.jobs import code_jobs

    text = "a = b.c\n" * 500
    given = pa.RecordBatch.from_arrays([pa.array(["r"] * 20), pa.array([f"f{k}.py" for k in range(20)]), pa.array([text] * 20)], ["repo_id", "path", "content"])
    monkeypatch.setattr(extract, "MOST_ROWS", 300)
    got = list(extract._per_file(extract._facts, extract.FACT_ROWS)(iter([given])))
    assert max(b.num_rows for b in got) == 300 and sum(b.num_rows for b in got) == 20 * 1001
    monkeypatch.setattr(extract, "MOST_ROWS", 10**9)
    monkeypatch.setattr(extract, "MOST_TEXT", 3 * len(text))
    assert [b.num_rows for b in extract._per_file(extract._facts, extract.FACT_ROWS)(iter([given]))] == [3003] * 6 + [2002]
    tree = ast.parse("def f(x, *y, z=1):\n    return [g(x).h for k in y if k not in z], lambda: -x\n@d.e\nclass C(B, m=1):\n    a: int = x.y[1:2]\n")
    assert list(extract._walk(tree)) == [x for x in ast.walk(tree) if not isinstance(x, ast.expr_context)]
    for files in (code_jobs._client(spark, "/root/testdata/sf0.001"), code_jobs._server(spark, "/root/testdata/sf0.001").filter("path LIKE 'routers/%'")):
        assert files.select(F.spark_partition_id()).distinct().count() >= 8  # of one row group


def test_routes_of_parts_are_dealt_out(spark):
    from tracelake.jobs import match_jobs

    routes = match_jobs._routes_of_parts(spark, "/root/testdata/sf0.001")
    assert routes.filter("route_id LIKE 'part%'").select(F.spark_partition_id()).distinct().count() >= 8  # of one row group
