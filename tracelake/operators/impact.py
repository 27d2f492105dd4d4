"""Which tests exercise which routes, and which tests a change calls for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.graph import containing
from tracelake.sources.tables import written

# Fixed value: names of test files.
TEST_FILE = r"(^|/)(test_[^/]*\.py|[^/]*_test\.py|[^/]*\.(test|spec)\.[jt]sx?)$"


def is_test_file(path: Column) -> Column:
    """F3"""
    return path.rlike(TEST_FILE)


def search_tokens(routes: DataFrame) -> DataFrame:
    """(repo_id, route_id, token): the texts whose occurrence shows that a test is about the route."""
    some = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != "") & (F.col(c) != "/"), F.col(c))
    tokens = F.array(F.when(F.length("handler") > 3, F.col("handler")), some("raw_path"), some("norm_path"), some("path"))
    return routes.select("repo_id", "route_id", F.explode(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))).alias("token"))


def map_tests_to_routes(tokens: DataFrame, tests: DataFrame, text_bytes: int = 32 << 20, token_bytes: int = 8 << 20) -> DataFrame:
    """(repo_id, route_id, test) where a test's text contains a token of the route in its repository.

    A repository's tests and tokens are dealt into parts of about ``text_bytes`` and ``token_bytes``; each part of tests meets each part of
    tokens in one task, which scans the texts once with an automaton of the tokens. Tokens of other repositories are never looked at.
    """
    names = tokens.select("repo_id", "token").distinct()
    parts = lambda df, c, most, name: df.groupBy("repo_id").agg((F.floor(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) / most) + 1).cast("int").alias(name))
    plan = written(parts(names, "token", token_bytes, "token_parts").join(parts(tests, "content", text_bytes, "text_parts"), "repo_id"), "scan-parts")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda key, c: F.pmod(F.xxhash64(key), c).cast("int")
    texts = tests.join(plan, "repo_id").select("repo_id", dealt("path", "text_parts").alias("x"), every("token_parts").alias("y"), F.col("path").alias("test"), "content")
    words = names.join(plan, "repo_id").select("repo_id", dealt("token", "token_parts").alias("y"), every("text_parts").alias("x"), "token")
    hits = texts.groupBy("repo_id", "x", "y").cogroup(words.groupBy("repo_id", "x", "y")).applyInPandas(_scan, "repo_id string, test string, token string")
    return hits.join(tokens, ["repo_id", "token"]).select("repo_id", "route_id", "test").distinct()


def _scan(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    import ahocorasick

    if texts.empty or words.empty:
        return pd.DataFrame({"repo_id": [], "test": [], "token": []}, dtype=str)
    machine = ahocorasick.Automaton()
    for x in words["token"]:
        machine.add_word(x, x)
    machine.make_automaton()
    rows = [(repo, test, t) for repo, test, text in zip(texts["repo_id"], texts["test"], texts["content"], strict=True) if text for t in {t for _, t in machine.iter(text)}]
    return pd.DataFrame(rows, columns=["repo_id", "test", "token"], dtype=str)


def untested_routes(routes: DataFrame, route_tests: DataFrame) -> DataFrame:
    """J11"""
    return routes.join(route_tests.select("repo_id", "route_id"), ["repo_id", "route_id"], "left_anti")


def test_coverage(routes: DataFrame, route_tests: DataFrame) -> DataFrame:
    """A4: per repository: routes, tested routes, and their ratio to three places."""
    tested = route_tests.select("repo_id", "route_id", F.lit(True).alias("tested")).distinct()
    rows = routes.select("repo_id", "route_id").distinct().join(tested, ["repo_id", "route_id"], "left")
    out = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("routes"), F.count_if("tested").alias("tested_routes"))
    return out.withColumn("coverage", F.round(F.col("tested_routes") / F.col("routes"), 3))


def impacted_tests(modified: DataFrame, tests: DataFrame, route_tests: DataFrame, reached: DataFrame) -> DataFrame:
    """(repo_id, test): tests that were modified themselves, tests of routes that the change reaches (repo_id, node), and tests
    of routes whose id contains a modified path.
    """
    names = tests.select("repo_id", F.col("path").alias("test"))
    parts = F.split("test", "/")
    ends = names.withColumn("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))))
    own = ends.join(modified.select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("repo_id", "test")
    by_reach = route_tests.join(reached.select("repo_id", F.col("node").alias("route_id")), ["repo_id", "route_id"], "left_semi").select("repo_id", "test")
    ids = route_tests.select("repo_id", F.col("route_id").alias("id"), F.col("route_id").alias("own")).distinct()
    paths = modified.filter("path <> ''").select("repo_id", F.col("path").alias("target"), F.col("path").alias("wanted")).distinct()
    by_file = route_tests.join(containing(ids, paths).select("repo_id", F.col("id").alias("route_id")), ["repo_id", "route_id"], "left_semi").select("repo_id", "test")
    return own.unionByName(by_reach).unionByName(by_file).distinct()
