"""Extraction: one source file to many records, by small helpers in the workers. The tables are the product.

Python files are read with the standard library's syntax tree (files that do not parse give no records but one that says
so); client files as tokens (``client_lexer``).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.paths import join_prefix, path_params, symbol_id
from tracelake.sources.client_lexer import client_calls
from tracelake.sources.tables import spent, written

# Names that mark a route decorator, a tool, and what is no model.
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD")
ROUTE_VERBS = ("get", "post", "put", "delete", "patch", "options", "head")
TOOLS = {"tool": "MCP_TOOL", "call_tool": "MCP_TOOL", "resource": "MCP_RESOURCE"}
NOT_MODELS = ("db", "session", "select", "query")
BASES = ("Base", "DeclarativeBase")
ROUTERS = ("APIRouter", "FastAPI")
PYTHON = r"(?i)\.py$"
#: A router's name is followed through at most so many packages that pass it on.
PASSED_ON = 10

#: Records go on after so many, or those of so many characters of text, so that a worker holds few files' records at a time.
MOST_ROWS, MOST_TEXT = 4096, 4 << 20
KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

CALL_ROWS = "repo_id string, path string, ordinal int, line int, raw_url string, norm_path string, path_params array<string>, is_template boolean, verb string, option string"
FACT_ROWS = "repo_id string, path string, kind string, line int, col int, ordinal int, name string, owner string, value string, detail string, extra string, body string"


def _per_file(one: Callable[[str, str], Iterator[tuple]], schema: str):
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [KINDS[x.split()[1]] for x in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for repo, path, text in zip(*(batch.column(c) for c in ("repo_id", "path", "content")), strict=True):
                repo, path, text = repo.as_py(), path.as_py(), text.as_py() or ""
                for row in one(text, path):
                    rows.append((repo, path, *row))
                    if len(rows) >= MOST_ROWS:
                        yield batch_of(rows)
                        rows, size = [], 0
                size += len(text)
                if rows and size >= MOST_TEXT:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


def _records(files: DataFrame, pattern: str, one, schema: str) -> DataFrame:
    own = files.filter(F.col("path").rlike(pattern)).select("repo_id", "path", "content")
    return own.mapInArrow(_per_file(one, schema), schema)


def python_facts(files: DataFrame) -> DataFrame:
    """All that is read off the Python files, in one pass and written once: a tagged row per file, route, router, import, include,
    model attribute, binding and access. The functions below take this table, or the files themselves.
    """
    return written(_records(files, PYTHON, _facts, FACT_ROWS), "facts")


def _of_kind(files: DataFrame, *kinds: str) -> DataFrame:
    rows = files if "kind" in files.columns else _records(files, PYTHON, _facts, FACT_ROWS)
    return rows.filter(F.col("kind").isin(*kinds))


def _calls(text: str, path: str) -> Iterator[tuple]:
    return ((k, *call) for k, call in enumerate(client_calls(text, not path.lower().endswith(".ts"))))


def call_method(verb: Column, option: Column) -> Column:
    """The verb of a member call, else the ``method`` among the options, else GET."""
    named = F.upper(option)
    return F.when(verb != "", F.upper(verb)).when(named.isin(*METHODS), named).otherwise(F.lit("GET"))


def extract_calls(files: DataFrame) -> DataFrame:
    """E1, E2, E4"""
    rows = _records(files, r"(?i)\.(ts|tsx|js|jsx)$", _calls, CALL_ROWS)
    return rows.select("repo_id", "path", "line", "ordinal", "raw_url", "norm_path", call_method(F.col("verb"), F.col("option")).alias("method"), "path_params", F.array().cast("array<string>").alias("query_params"), "is_template", F.lit(None).cast("string").alias("body_type"))


def _text(node: ast.expr | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _name(node: ast.expr) -> str:
    """The last part of a dotted name, or nothing."""
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def _options(call: ast.Call) -> dict[str, ast.expr]:
    return {x.arg: x.value for x in call.keywords if x.arg}


def _row(kind: str, **values) -> tuple:
    return (kind, *(values.get(c) for c in ("line", "col", "ordinal", "name", "owner", "value", "detail", "extra", "body")))


def skipped_files(files: DataFrame) -> DataFrame:
    """(repo_id, path, reason): Python files that do not parse, and what else was left out of a file."""
    return _of_kind(files, "skipped").select("repo_id", "path", F.col("detail").alias("reason"))


class _Source:
    """A text by the positions of its syntax tree, which count lines and UTF-8 bytes; nothing is written out again, so no depth of nesting matters."""

    def __init__(self, text: str):
        self.lines = [line.encode() for line in _LINE.findall(text)]

    def lines_of(self, node: ast.AST) -> str:
        return b"".join(self.lines[node.lineno - 1 : node.end_lineno]).decode()

    def __call__(self, node: ast.AST) -> str:
        own = self.lines[node.lineno - 1 : node.end_lineno]
        own[-1] = own[-1][: node.end_col_offset]
        own[0] = own[0][node.col_offset :]
        return b"".join(own).decode()


def _walk(tree: ast.AST) -> Iterator[ast.AST]:
    """The nodes in the order of ``ast.walk``, without those that say only whether a name is read or set."""
    found = [tree]
    for node in found:
        for name in node._fields:
            below = getattr(node, name, None)
            if isinstance(below, list):
                found += [x for x in below if isinstance(x, ast.AST)]
            elif isinstance(below, ast.AST) and not isinstance(below, ast.expr_context):
                found.append(below)
        yield node


def _facts(text: str, path: str) -> Iterator[tuple]:
    yield _row("file")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        yield _row("skipped", detail=type(error).__name__)
        return
    source = _Source(text)
    functions = [x for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    yield from _routes(functions, source)
    yield from _models([x for x in tree.body if isinstance(x, ast.ClassDef)], source)
    routers, includes, imports = {}, [], []
    for node in _walk(tree):
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            yield _row("access", line=node.lineno, col=node.col_offset + 1, name=node.value.id, detail=node.attr)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            to = node.targets if isinstance(node, ast.Assign) else [node.target]
            if isinstance(node, ast.Assign) and len(to) == 1 and isinstance(to[0], ast.Name):
                yield _row("binding", line=node.lineno, col=node.col_offset + 1, name=to[0].id, detail=source(node.value))
            if isinstance(node.value, ast.Call) and _name(node.value.func) in ROUTERS:
                routers |= {x.id: (_text(_options(node.value).get("prefix")) or "").strip() for x in to if isinstance(x, ast.Name)}
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "include_router" and isinstance(node.func.value, ast.Name):
            options = _options(node)
            target = node.args[0] if node.args else options.get("router")
            if isinstance(target, (ast.Name, ast.Attribute)):
                includes.append((node.lineno, node.col_offset, node.func.value.id, source(target), _text(options.get("prefix")) or ""))
        elif isinstance(node, ast.ImportFrom):
            imports += [(node.lineno, x.asname or x.name, "." * node.level + (node.module or ""), x.name) for x in node.names]
    includes.sort()
    try:
        gathered = list(_gathered(routers, includes))
    except RecursionError as error:
        yield _row("skipped", detail=f"includes: {type(error).__name__}")
        gathered = list(routers.items())
    yield from (_row("router", ordinal=k, name=name, value=prefix) for k, (name, prefix) in enumerate(gathered))
    yield from (_row("include", ordinal=k, line=line, owner=parent, name=target, value=prefix) for k, (line, _, parent, target, prefix) in enumerate(includes))
    yield from (_row("import", ordinal=k, line=line, name=name, value=module, detail=original) for k, (line, name, module, original) in enumerate(sorted(imports, key=lambda x: x[0])))


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def _routes(functions: list, source: _Source) -> Iterator[tuple]:
    k = 0
    for node in functions:
        line = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        body = None
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            head = call.func if call else d
            if not isinstance(head, ast.Attribute):
                continue
            router = source(head.value)
            options = _options(call) if call else {}
            first = _text(call.args[0]) if call and call.args else None
            if head.attr in ROUTE_VERBS and (first is not None or "path" in options):
                body = body or source.lines_of(node)
                model = options.get("response_model")
                yield _row("route", line=line, ordinal=k, name=node.name, owner=router, value=first if first is not None else _text(options["path"]) or "", detail=head.attr.upper(), extra=source(model) if model else None, body=body)
                k += 1
            elif head.attr in TOOLS:
                body = body or source.lines_of(node)
                yield _row("route", line=line, ordinal=k, name=node.name, owner="", value="tools/" + (_text(options.get("name")) or first or node.name), detail=TOOLS[head.attr], extra=ast.get_docstring(node), body=body)
                k += 1


def _gathered(own: dict[str, str], includes: list[tuple]) -> Iterator[tuple[str, str]]:
    """Each router of a file with the prefixes on its way from the outermost one: the last include that gives any decides."""
    into: dict[str, list[tuple[str, str]]] = {}
    for _, _, parent, target, prefix in includes:
        into.setdefault(target, []).insert(0, (parent, prefix))

    known: dict[str, str] = {}

    def whole(name: str, below: set[str], tried: dict[str, str]) -> tuple[str, bool]:
        """The prefix, and whether it holds from wherever it is asked for: no circle was cut on its way. In a circle each router is followed once."""
        if name in known or name in tried:
            return (known[name], True) if name in known else (tried[name], False)
        mine, free = own.get(name, ""), True
        below.add(name)
        for parent, prefix in into.get(name, []):
            outer, sure = whole(parent, below, tried) if parent not in below else ("", False)
            free &= sure
            if parts := [x for p in (outer, prefix, mine) if (x := p.strip("/"))]:
                mine = "/" + "/".join(parts)
                break
        below.discard(name)
        (known if free else tried)[name] = mine
        return mine, free

    for name in dict.fromkeys([*own, *into]):
        yield name, whole(name, set(), {})[0]


def model_refs(body: Column) -> Column:
    """Distinct sorted names in ``query(X`` and ``select(X``."""
    names = F.regexp_extract_all(body, F.lit(r"\b(?:query|select)\(\s*([A-Za-z_]\w*)"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(names), F.array(*[F.lit(x) for x in NOT_MODELS])))


def router_prefixes(files: DataFrame) -> DataFrame:
    """(repo_id, path, ordinal, router, prefix)."""
    return _of_kind(files, "router").select("repo_id", "path", "ordinal", F.col("name").alias("router"), F.col("value").alias("prefix"))


def extract_routes(files: DataFrame) -> DataFrame:
    """Routes of decorated functions and tools, with the prefix of a router of the same file."""
    rows = _of_kind(files, "route").select("repo_id", "path", "line", "ordinal", F.col("name").alias("handler"), F.col("owner").alias("router"), F.col("value").alias("raw_path"), F.col("detail").alias("method"), F.col("extra").alias("response_model"), "body")
    prefixes = router_prefixes(files).groupBy("repo_id", "path", "router").agg(F.max_by("prefix", "ordinal").alias("prefix"))
    rows = rows.join(prefixes, ["repo_id", "path", "router"], "left")
    tool = F.col("method").startswith("MCP_")
    return rows.select(
        "repo_id", "path", "line", "ordinal", "handler", "raw_path", F.when(tool, F.col("raw_path")).otherwise(join_prefix(F.col("prefix"), F.col("raw_path"))).alias("norm_path"), F.array("method").alias("methods"),
        path_params(F.col("raw_path")).alias("path_params"), "response_model", model_refs(F.col("body")).alias("model_refs"), symbol_id(F.col("path"), F.col("handler")).alias("route_id"),
    )


def _imports(files: DataFrame) -> DataFrame:
    """Of imports of one name in a file the last: (repo_id, path, name, module, original)."""
    rows = _of_kind(files, "import").groupBy("repo_id", "path", "name").agg(F.max(F.struct("ordinal", "value", "detail")).alias("x"))
    return rows.select("repo_id", "path", "name", F.col("x.value").alias("module"), F.col("x.detail").alias("original"))


def imports_and_includes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports (repo_id, path, name, module) and includes (repo_id, path, ordinal, parent, target, prefix)."""
    includes = _of_kind(files, "include").select("repo_id", "path", "ordinal", F.col("owner").alias("parent"), F.col("name").alias("target"), F.col("value").alias("prefix"))
    return _imports(files).drop("original"), includes


def _placed(rows: DataFrame, files: DataFrame, *names: str) -> DataFrame:
    """Rows (repo_id, path, module, ...) with ``found``, each file that the module names: ``m.py`` or ``m/__init__.py``, below the folder that a
    relative module starts from, else wherever a path ends so: an equi-join on path endings.
    """
    dots = F.length(F.regexp_extract("module", r"^\.*", 0))
    own = F.split("path", "/")
    folder = F.when(dots > 0, F.array_join(F.slice(own, 1, F.greatest(F.size(own) - dots, F.lit(0))), "/")).otherwise(F.lit(""))
    place = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
    whole = F.concat_ws("/", F.when(folder != "", folder), F.when(place != "", place))
    ends = F.array(F.concat(whole, F.lit(".py")), F.concat_ws("/", F.when(whole != "", whole), F.lit("__init__.py")))
    asked = rows.select("repo_id", "path", *names, (dots > 0).alias("exact"), F.explode(ends).alias("ending"))
    parts = F.split("path", "/")
    known = _of_kind(files, "file") if "kind" in files.columns else files
    endings = known.select("repo_id", F.col("path").alias("found"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("ending"))
    return asked.join(endings, ["repo_id", "ending"]).filter(~F.col("exact") | (F.col("found") == F.col("ending"))).drop("exact", "ending")


def included_files(files: DataFrame) -> DataFrame:
    """(repo_id, file, parent, added): for each file with a router that another file includes, the last such include: the including file, and the
    prefix of its router with that of the include. Names that a package only passes on lead to where they come from.
    """
    imports, includes = _imports(files), imports_and_includes(files)[1]
    parents = router_prefixes(files).groupBy("repo_id", "path", "router").agg(F.max_by("prefix", "ordinal").alias("own")).withColumnRenamed("router", "parent")
    linked = includes.withColumn("name", F.substring_index("target", ".", 1)).join(imports, ["repo_id", "path", "name"]).join(parents, ["repo_id", "path", "parent"], "left")
    # ``users.router`` is the router of the module ``users``, ``router`` that of the module it is imported from
    inner = F.concat(F.col("module"), F.when(F.col("module").rlike(r"[^.]$"), F.lit(".")).otherwise(F.lit("")), "original")
    of_module = F.contains("target", F.lit("."))
    ways = F.array_compact(F.array(F.struct(F.col("module").alias("module"), F.when(~of_module, F.col("original")).alias("wanted")), F.when(of_module, F.struct(inner.alias("module"), F.lit(None).cast("string").alias("wanted")))))
    asked = linked.select("repo_id", "path", F.col("path").alias("parent"), join_prefix(F.col("own"), F.col("prefix")).alias("added"), "ordinal", F.explode(ways).alias("way")).select("*", "way.module", "way.wanted")
    front = written(_placed(asked, files, "parent", "added", "ordinal", "wanted"), "includes")
    steps = [front]
    passed = imports.select("repo_id", F.col("path").alias("found"), F.col("name").alias("wanted"), F.col("module"), F.col("original"))
    for _ in range(PASSED_ON):
        more = front.filter("wanted is not null").drop("path").join(passed, ["repo_id", "found", "wanted"]).select("repo_id", F.col("found").alias("path"), "parent", "added", "ordinal", F.col("original").alias("wanted"), "module")
        front = written(_placed(more, files, "parent", "added", "ordinal", "wanted").filter("found <> path"), "includes")
        if front.isEmpty():
            break
        steps.append(front)
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    every = every.join(passed, ["repo_id", "found", "wanted"], "left_anti")  # a name that is passed on is included where it comes from
    last = every.filter("found <> parent").groupBy("repo_id", F.col("found").alias("file")).agg(F.max(F.struct("parent", "ordinal", "added")).alias("x"))
    out = written(last.select("repo_id", "file", "x.parent", "x.added"), "included")
    spent(*dict.fromkeys([*steps, front]))
    return out


def file_prefixes(files: DataFrame) -> DataFrame:
    """(repo_id, file, added): the prefix of each included file, through all the files on its way from the outermost one.

    By pointer doubling: a file knows the files above it and the prefix that each adds; joined with what its topmost one knows it knows twice as
    many, so that rounds grow with the logarithm of the depth. A way ends before a file comes up again.
    """
    links = included_files(files)
    state = written(links.select("repo_id", "file", F.array(F.struct(F.col("parent").alias("path"), "added")).alias("way")), "ways")
    spent(links)
    while True:
        top = F.element_at("way", -1)["path"]
        above = state.select("repo_id", F.col("file").alias("top"), F.col("way").alias("more"))
        joined = state.withColumn("top", top).join(above, ["repo_id", "top"])
        paths = F.concat(F.array("file"), F.transform("way", lambda x: x["path"]))
        again = F.filter(F.transform("more", lambda x, k: F.when(F.array_contains(paths, x["path"]), k + 1)), lambda k: k.isNotNull())
        new = F.slice("more", 1, F.coalesce(F.try_element_at(again, F.lit(1)) - 1, F.size("more")))
        longer = written(joined.select("repo_id", "file", F.concat("way", new).alias("longer"), (F.size(new) > 0).alias("grew")).filter("grew"), "longer")
        if longer.isEmpty():
            spent(longer)
            break
        merged = state.join(longer.select("repo_id", "file", "longer"), ["repo_id", "file"], "left").select("repo_id", "file", F.coalesce("longer", "way").alias("way"))
        last, state = state, written(merged, "ways")
        spent(last, longer)
    bare = F.filter(F.transform(F.reverse("way"), lambda x: F.regexp_replace(x["added"], "^/+|/+$", "")), lambda x: x != "")
    return state.select("repo_id", "file", F.concat(F.lit("/"), F.array_join(bare, "/")).alias("added"))


def resolve_router_prefix(routes: DataFrame, files: DataFrame) -> DataFrame:
    """Routes of files whose router another file includes get the prefixes from there up in front, unless they are there already."""
    added = file_prefixes(files).withColumnRenamed("file", "path")
    out = routes.join(added, ["repo_id", "path"], "left")
    tool = F.exists("methods", lambda m: m.startswith("MCP_"))
    there = F.col("added").isNull() | (F.col("added") == "/") | F.startswith("norm_path", "added") | tool
    return out.withColumn("norm_path", F.when(there, F.col("norm_path")).otherwise(join_prefix(F.col("added"), F.col("norm_path")))).drop("added")


def _models(classes: list[ast.ClassDef], source: _Source) -> Iterator[tuple]:
    k = 0
    for node in classes:
        head = source.lines_of(node)[:500]
        if not ("__tablename__" in head or "Column(" in head or "mapped_column(" in head or any(isinstance(b, ast.Name) and b.id in BASES for b in node.bases)):
            continue
        table, rows = None, []
        for x in node.body:
            target = x.targets[0] if isinstance(x, ast.Assign) else x.target if isinstance(x, ast.AnnAssign) else None
            if not isinstance(target, ast.Name) or x.value is None:
                continue
            if target.id == "__tablename__":
                table = _text(x.value)
            elif isinstance(x.value, ast.Call):
                if _name(x.value.func) in ("Column", "mapped_column"):
                    rows.append({"value": target.id, "detail": source(x.value)})
                elif _name(x.value.func) == "relationship":
                    rows.append({"extra": _text(x.value.args[0]) or source(x.value.args[0]) if x.value.args else None})
        if table is not None or rows:
            yield from (_row("model", line=node.lineno, ordinal=k, name=node.name, owner=table, **row) for row in rows or [{}])
            k += 1


def parse_field(name: Column, expr: Column) -> Column:
    """(name, data_type, is_primary_key, is_nullable, foreign_key) of a column expression."""
    key = expr.rlike(r"primary_key\s*=\s*True")
    plain = F.regexp_extract(expr, r"(?:Column|mapped_column)\(\s*(?:(?:'[^']*'|\"[^\"]*\")\s*,\s*)?(?!ForeignKey)([A-Za-z_][\w.]*)\s*(?:\(|,|\)|$)", 1)
    foreign = F.regexp_extract(expr, r"ForeignKey\(\s*['\"]([^'\"]+)['\"]", 1)
    return F.struct(
        name.alias("name"), F.when(plain == "", F.lit("Unknown")).otherwise(plain).alias("data_type"), key.alias("is_primary_key"), (~key & ~expr.rlike(r"nullable\s*=\s*False")).alias("is_nullable"), F.when(foreign == "", F.lit(None)).otherwise(foreign).alias("foreign_key")
    )


def extract_models(files: DataFrame) -> DataFrame:
    """A row per model with its fields and relationships."""
    rows = _of_kind(files, "model").select("repo_id", "path", "line", "ordinal", F.col("name").alias("class_name"), F.col("owner").alias("table_name"), F.col("value").alias("field"), F.col("detail").alias("expr"), F.col("extra").alias("relationship"))
    field = F.when(F.col("field").isNotNull(), parse_field(F.col("field"), F.col("expr")))
    return rows.groupBy("repo_id", "path", "line", "ordinal", "class_name", "table_name").agg(F.collect_list(field).alias("fields"), F.array_sort(F.collect_set("relationship")).alias("relationships"))


def extract_attribute_uses(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bindings (repo_id, path, line, var, rhs) and accesses (repo_id, path, line, col, obj, attr)."""
    return (
        _of_kind(files, "binding").select("repo_id", "path", "line", F.col("name").alias("var"), F.col("detail").alias("rhs")),
        _of_kind(files, "access").select("repo_id", "path", "line", "col", F.col("name").alias("obj"), F.col("detail").alias("attr")),
    )
