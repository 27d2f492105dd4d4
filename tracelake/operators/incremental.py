"""Which files to read, and which of them to read again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import globs
from tracelake.sources.tables import SOURCE, written

#: Characters by which the plain end of a pattern meets a part of a path.
END = 3


def is_source_file(path: Column) -> Column:
    """F1"""
    return path.rlike(SOURCE)


def ignore_rules(lists: DataFrame) -> DataFrame:
    """(repo_id, pattern) of ignore files (repo_id, path, content): their lines without comments, blank and negated ones; those of a nested
    file hold below its folder.
    """
    folder = F.regexp_replace(F.regexp_replace("path", "^/+", ""), "/?[^/]*$", "")
    lines = lists.select("repo_id", folder.alias("folder"), F.explode(F.split("content", "\n")).alias("line")).withColumn("line", F.trim(F.regexp_replace("line", "\r$", ""))).filter("line <> '' and line not like '#%' and line not like '!%'")
    bare = F.regexp_replace("line", "^/+|/+$", "")
    own = F.when(F.col("folder") == "", bare).otherwise(F.concat_ws("/", "folder", bare))
    return lines.select("repo_id", F.explode(F.array(own, F.concat(own, F.lit("/**")))).alias("pattern")).distinct()


def drop_ignored(files: DataFrame, extra: tuple[str, ...] = (), folders: tuple[str, ...] = globs.IGNORED_FOLDERS, rules: DataFrame | None = None) -> DataFrame:
    """files in no ignored folder and matching no ignore pattern: the standing ones, ``extra``, and ``rules`` (repo_id, pattern) of the
    repositories themselves.
    """
    path = F.regexp_replace("path", "^/+|/+$", "")
    in_folder = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in folders]))
    patterns = tuple(p.strip("/").replace("/**", "/*") for p in (*globs.IGNORED_PATTERNS, *extra))
    kept = files.filter(~in_folder & ~globs.path_matches(path, patterns))
    return kept if rules is None else kept.join(ruled_out(kept.select("repo_id", "path"), rules), ["repo_id", "path"], "left_anti")


def ruled_out(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, path): the files (repo_id, path) that a rule (repo_id, pattern) of their repository ignores.

    Rules are taken apart by kind. A plain name or path, and a folder's content (``a/b/*``), meet the places of a path that begin with their
    first part; ``*.ext`` and other plain ends meet the parts of a path by their last characters: both are equi-joins, however many rules there
    are. The other patterns of a repository are one list, compiled once per worker.
    """
    plain = F.replace(F.regexp_replace(F.replace("pattern", F.lit("\\"), F.lit("/")), "^/+|/+$", ""), F.lit("/**"), F.lit("/*"))
    asked = rules.select("repo_id", plain.alias("pattern")).filter("pattern <> ''").distinct()
    special = r"[*?\[]"
    folder, end = F.regexp_replace("pattern", r"/\*$", ""), F.regexp_replace("pattern", r"^\*+", "")
    is_folder = F.col("pattern").endswith("/*") & ~folder.rlike(special)
    is_end = F.col("pattern").startswith("*") & (F.length(end) >= END) & ~end.rlike(special) & ~F.contains("pattern", F.lit("/"))
    kind = F.when(~F.col("pattern").rlike(special), "plain").when(is_folder, "folder").when(is_end, "end").otherwise("glob")
    asked = written(asked.select("repo_id", "pattern", kind.alias("kind"), F.when(is_folder, folder).when(is_end, end).otherwise(F.col("pattern")).alias("text")), "rules")
    parts = F.split(F.regexp_replace("path", "^/+|/+$", ""), "/")
    places = files.distinct().select("repo_id", "path", F.explode(F.transform(parts, lambda x, k: F.struct(x.alias("part"), F.array_join(F.slice(parts, k + 1, F.size(parts)), "/").alias("rest")))).alias("x")).select("repo_id", "path", "x.*")
    starts = asked.filter("kind in ('plain', 'folder')").select("repo_id", F.substring_index("text", "/", 1).alias("part"), "text", "kind")
    of_start = F.when(F.col("kind") == "folder", F.startswith("rest", F.concat("text", F.lit("/")))).otherwise((F.col("rest") == F.col("text")) | (F.col("part") == F.col("text")))
    by_start = places.join(starts, ["repo_id", "part"]).filter(of_start)
    ends = asked.filter("kind = 'end'").select("repo_id", F.right("text", F.lit(END)).alias("tail"), "text")
    by_end = places.withColumn("tail", F.right("part", F.lit(END))).join(ends, ["repo_id", "tail"]).filter(F.endswith("part", "text"))
    lists = asked.filter("kind = 'glob'").groupBy("repo_id").agg(F.sort_array(F.collect_list("pattern")).alias("patterns"))
    by_glob = files.join(lists, "repo_id").select("repo_id", "path", "patterns").mapInPandas(_globbed, "repo_id string, path string")
    return by_start.select("repo_id", "path").unionByName(by_end.select("repo_id", "path")).unionByName(by_glob).distinct()


def _globbed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bare = [x.strip("/") for x in batch["path"]]
        hit = [globs.matcher(tuple(p))(x, x.split("/")) for x, p in zip(bare, batch["patterns"], strict=True)]
        yield batch[pd.Series(hit, index=batch.index, dtype=bool)][["repo_id", "path"]]


def drop_config_ignored(files: DataFrame, patterns: tuple[str, ...] = globs.CONFIG_IGNORED) -> DataFrame:
    """F5"""
    return files.filter(~globs.path_matches(F.col("path"), patterns, parts=False))


def incremental_index(current: DataFrame, cache: DataFrame) -> DataFrame:
    """R2: per current file (repo_id, path, mtime, size, sha256) whether it is a hit (same time and size), a hit by hash, or a miss.
    Contents stay out of the join.
    """
    old = cache.select("repo_id", "path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.col("sha256").alias("h"))
    joined = current.select("repo_id", "path", "mtime", "size", "sha256").join(old, ["repo_id", "path"], "left")
    decision = F.when((F.col("mtime") == F.col("m")) & (F.col("size") == F.col("s")), F.lit("hit")).when(F.col("sha256") == F.col("h"), F.lit("hash_hit")).otherwise(F.lit("parse"))
    return joined.select("repo_id", "path", "mtime", "size", "sha256", decision.alias("decision"))


def merge_index(decisions: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The new cache: kept entries with their new time and size, and fresh ones; vanished files drop out."""
    kept = decisions.filter("decision <> 'parse'").select("repo_id", "path", "mtime", "size", "sha256")
    payload = [c for c in cache.columns if c not in ("mtime", "size", "sha256")]
    return kept.join(cache.select(*payload), ["repo_id", "path"]).unionByName(fresh)


def index_report(decisions: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Per repository: files, parsed files, cache hits, and the nodes and edges of its graph where given."""
    miss = F.col("decision") == "parse"
    out = decisions.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(miss).alias("parsed"), F.count_if(~miss).alias("hits"))
    for rows, name in ((nodes, "nodes"), (edges, "edges")):
        if rows is not None:
            out = out.join(rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias(name)), "repo_id", "left").na.fill(0, [name])
    return out


def changed_files(*lists: DataFrame) -> DataFrame:
    """The distinct paths of several lists, in order."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return sorted_files(out.distinct())


def sorted_files(files: DataFrame) -> DataFrame:
    """T2"""
    return files.orderBy("path")
