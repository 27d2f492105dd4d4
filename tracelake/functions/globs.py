"""Shell patterns as regular expressions, made once on the driver from a short list."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that never hold sources of their own, and default patterns.
IGNORED_FOLDERS = (".git", "node_modules", ".venv", "venv", "env", "__pycache__", ".pytest_cache", ".mypy_cache", ".gemini", "coverage", "htmlcov", "dist", "build", ".next", ".turbo", ".idea", ".vscode")
IGNORED_PATTERNS = ("tests/test_*.py", "**/test_*.py", "scripts/*", "scripts/**")
CRITICAL_PATTERNS = ("auth/**", "billing/**", "payments/**", "*auth*", "*billing*", "*payment*")
CONFIG_IGNORED = ("**/*.tmp", "**/*.cache")


def regex_of(pattern: str) -> str:
    """A full-match expression for one shell pattern; ``*`` crosses slashes."""
    return re.sub(r"^\(\?s:(.*)\)(?:\\Z|\\z)$", r"(?s:\1)", fnmatch.translate(pattern))


@cache
def matcher(patterns: tuple[str, ...]) -> Callable[[str, list[str]], bool]:
    """A test of one path and its parts: the whole path, its end behind a slash, or a part matches a pattern."""
    clean = [x.replace("\\", "/").strip("/").replace("/**", "/*") for x in patterns]
    part = re.compile("|".join(regex_of(x) for x in dict.fromkeys(clean))) if clean else None
    whole = re.compile("|".join(regex_of(x) for x in dict.fromkeys(y for x in clean for y in (x, f"*/{x}")))) if clean else None
    return lambda path, parts: whole is not None and (whole.fullmatch(path) is not None or any(part.fullmatch(x) for x in parts))


def _any(value: Column, patterns: list[str]) -> Column:
    return value.rlike("^(?:" + "|".join(regex_of(p) for p in dict.fromkeys(patterns)) + ")$") if patterns else F.lit(False)


def path_matches(path: Column, patterns: tuple[str, ...], parts: bool = True) -> Column:
    """Whether the whole path, its end behind a slash, or (with ``parts``) any part matches a pattern."""
    bare = F.regexp_replace(path, "^/+", "")
    clean = [p.replace("\\", "/").strip("/") for p in patterns]
    whole = _any(bare, [x for p in clean for x in (p, f"*/{p}")])
    return whole | F.exists(F.split(bare, "/"), lambda s: _any(s, clean)) if parts else whole


def path_contains(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether the path contains a pattern with its outer stars taken off."""
    cores = [x for p in patterns if (x := p.replace("\\", "/").strip("/").strip("*"))]
    return path.rlike("|".join(re.escape(x) for x in dict.fromkeys(cores))) if cores else F.lit(False)
