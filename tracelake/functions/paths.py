"""Column functions on URL paths, route templates and file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a placeholder and a name look like in each kind of template.
PLACEHOLDER = r"\{([a-zA-Z0-9_]+)(?::[^}]+)?\}"
EXPRESSION = r"\$\{\s*([^}]+?)\s*\}"


def segments(path: Column) -> Column:
    """The parts of a URL path before any query, without quotes and empty parts."""
    bare = F.regexp_replace(F.trim(F.split_part(path, F.lit("?"), F.lit(1))), "^['\"`]+|['\"`]+$", "")
    return F.filter(F.split(bare, "/"), lambda s: s != "")


def is_param(segment: Column) -> Column:
    """Whether a segment is ``{x}``, ``${x}`` or ``:x``."""
    return F.trim(segment).rlike(r"(?s)^(\$?\{.*\}|:.*)$")


def param_name(segment: Column) -> Column:
    """The name inside a placeholder; other segments as they are."""
    inner = F.regexp_replace(F.trim(segment), r"^[${]+|\}+$", "")
    return F.when(~is_param(segment), segment).when(F.trim(segment).startswith(":"), F.substring(F.trim(segment), 2, 1 << 20)).otherwise(inner)


def route_regex(path: Column) -> Column:
    """The anchored pattern of a route, with named groups, without a trailing slash."""
    bare = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    return F.concat(F.lit("^"), F.regexp_replace(bare, PLACEHOLDER, r"(?P<$1>[^/]+)"), F.lit("$"))


def join_prefix(prefix: Column, path: Column) -> Column:
    """C4: prefix and path with one slash between, none behind; ``/`` if both are empty."""
    part = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^/+|/+$", "")
    lead = lambda c: F.when(part(c) == "", F.lit("")).otherwise(F.concat(F.lit("/"), part(c)))
    whole = F.concat(lead(prefix), lead(path))
    return F.when(whole == "", F.lit("/")).otherwise(whole)


def normalize_file_path(path: Column, base: Column | None = None) -> Column:
    """Forward slashes, and the base folder taken off."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    if base is None:
        return slashed
    root = F.concat(F.regexp_replace(F.replace(base, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
    return F.when(F.startswith(slashed, root), F.substring(slashed, F.length(root) + 1, F.length(slashed))).otherwise(slashed)


def call_id(path: Column, line: Column) -> Column:
    """C6"""
    return F.concat_ws("::", path, F.lit("fetch"), line.cast("string"))


def symbol_id(path: Column, symbol: Column) -> Column:
    """C6"""
    return F.concat_ws("::", path, symbol)


def segment_count(pattern: Column) -> Column:
    """C11: parts after outer slashes are taken off; 0 if nothing is left."""
    bare = F.regexp_replace(pattern, "^/+|/+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "/")))


def normalize_template(raw: Column) -> Column:
    """``${expr}`` as ``{expr}``."""
    return F.regexp_replace(raw, EXPRESSION, r"{$1}")


def template_params(raw: Column) -> Column:
    """The expressions of a template, in order."""
    return F.regexp_extract_all(raw, F.lit(EXPRESSION), F.lit(1))


def path_params(route: Column) -> Column:
    """The parameter names of a route."""
    return F.regexp_extract_all(route, F.lit(PLACEHOLDER), F.lit(1))
