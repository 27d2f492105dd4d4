"""Reading and writing tables: intermediate ones, the graph, change lists, reports, source trees."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.tree import SourceTree

NODES = "repo_id string, id string, type string, node_type string, path string, line int, symbol string, is_critical boolean, properties string"
EDGES = "repo_id string, source string, target string, relation string, relation_type string, confidence double, is_exact boolean, param_map map<string,string>, properties string"
#: Row groups of intermediate tables: small, as several tasks of an executor buffer one each.
BLOCK_BYTES = 16 << 20
#: Buckets of intermediate tables: enough for one to be sorted in memory.
BUCKETS_A_CORE = 8
#: Whether a query's shuffles are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SOURCE = r"(?i)\.(ts|tsx|js|jsx|py)$"


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Where none is set and there is but one machine, it is the warehouse's."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: loops over it keep a short lineage and survive lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys, to meet a table of ``bucketed``."""
    return df.repartition(_buckets(df.sparkSession), *keys)


def _buckets(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), BUCKETS_A_CORE * spark.sparkContext.defaultParallelism)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``written``, dealt out by the keys: joins and groups on them read the table where it lies and shuffle only the other side. The shuffles it was
    made with go at once: Spark else keeps them until its driver collects garbage, which may be never.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    label = "t_" + path.rpartition("-")[2]
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        rows = dealt(df, *keys).write.option("parquet.block.size", BLOCK_BYTES).option("compression", "zstd").option("path", path)
        rows.bucketBy(_buckets(spark), *keys).sortBy(*keys).saveAsTable(label)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.table(label)
    spark.sql(f"DROP TABLE {label}")  # the catalogue's entry alone: the files belong to ``out``
    out.written_to = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: what was made of them is written itself."""
    for df in tables:
        store, at = file_system(df.sparkSession, df.written_to)
        store.delete(at, True)


def read_source_files(spark: SparkSession, root: str, repo_id: str, folders: tuple[str, ...] | None = None, patterns: tuple[str, ...] | None = None) -> DataFrame:
    """source_files of a tree: relative path, content, mtime, size, sha256. Ignored folders (F2) are never entered, nor are other files opened."""
    spark.dataSource.register(SourceTree)
    given = {"folders": folders, "patterns": patterns}
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("source_tree").options(repo_id=repo_id, pushdown=pushdown, tasks=2 * spark.sparkContext.defaultParallelism, **{k: json.dumps(v) for k, v in given.items() if v is not None}).load(root)


def write_source_files(files: DataFrame, root: str) -> None:
    """The files (path, content) as files below ``root``, which Arrow has to know how to reach; each task writes its own. ``same`` (a column, if there
    is one) has further names of a file: links on a local file system, where every file takes an inode and a block, of which a disk has so many; else copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            paths = batch.column("path").to_pylist()
            same = batch.column("same").to_pylist() if "same" in batch.schema.names else [()] * len(paths)
            for folder in {x.rpartition("/")[0] for x in chain(paths, *(x or () for x in same))}:
                store.create_dir(f"{base}/{folder}".rstrip("/"), recursive=True)
            for path, content, names in zip(paths, batch.column("content").to_pylist(), same, strict=True):
                _write_file(store, f"{base}/{path}", content)
                for name in names or ():
                    if not _linked(store, f"{base}/{path}", f"{base}/{name}"):
                        _write_file(store, f"{base}/{name}", content)
            yield batch.select(["path"])

    files.select("path", "content", *[c for c in files.columns if c == "same"]).mapInArrow(run, "path string").agg(F.count(F.lit(1))).collect()


def _write_file(store: fs.FileSystem, path: str, content: str | None) -> None:
    with store.open_output_stream(path) as out:
        out.write((content or "").encode())


def _linked(store: fs.FileSystem, path: str, name: str) -> bool:
    """Whether ``name`` is a link to the file now; not all file systems have links, nor any number of them. What a task left that was tried before is replaced."""
    for _ in range(2 if isinstance(store, fs.LocalFileSystem) else 0):
        try:
            os.link(path, name)
            return True
        except FileExistsError:
            os.unlink(name)
        except OSError:
            break
    return False


def graph_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the stored columns: derived type, symbol, relation, and JSON properties."""
    tail = F.element_at(F.split("id", "::"), -1)
    held = nodes.select(
        "repo_id", "id", F.coalesce("node_type", F.lit("unknown")).alias("type"), F.coalesce("node_type", F.lit("unknown")).alias("node_type"), "path", F.col("line").cast("int").alias("line"),
        F.coalesce("symbol", tail).alias("symbol"), F.lit(False).alias("is_critical"), F.to_json(F.struct("path", "line", "symbol")).alias("properties"),
    )
    edges = edges if "param_map" in edges.columns else edges.withColumn("param_map", F.lit(None).cast("map<string,string>"))
    links = edges.select(
        "repo_id", "source", "target", F.coalesce("relation", F.lit("relates_to")).alias("relation"), F.coalesce("relation_type", F.lit("ASSOCIATION")).alias("relation_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.coalesce("is_exact", F.lit(False)).alias("is_exact"), F.coalesce("param_map", F.create_map().cast("map<string,string>")).alias("param_map"), F.to_json(F.struct("confidence", "is_exact", "param_map")).alias("properties"),
    )
    return held, links


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Replace the stored graph; with dynamic partition overwrite only the repositories given."""
    for name, rows in zip(("nodes", "edges"), graph_tables(nodes, edges), strict=True):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}").withColumn("repo_id", F.col("repo_id").cast("string")) for name in ("nodes", "edges"))


def export_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """S3: JSON lines, one per node or edge, and one summary per repository."""
    as_row = lambda kind, df: df.select(F.lit(kind).alias("kind"), "repo_id", F.to_json(F.struct(*df.columns)).alias("body"))
    n, e = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("node_count")), edges.groupBy("repo_id").agg(F.count(F.lit(1)).alias("edge_count"))
    summary = n.join(e, "repo_id", "full").select("repo_id", F.lit("1.0").alias("version"), F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    as_row("summary", summary).unionByName(as_row("node", nodes)).unionByName(as_row("edge", edges)).write.mode("overwrite").json(path)


def load_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: (nodes, edges, summary) of an export."""
    rows = spark.read.schema("kind string, repo_id string, body string").json(path)
    of = lambda kind, schema: rows.filter(F.col("kind") == kind).select(F.from_json("body", schema).alias("x")).select("x.*")
    return of("node", NODES), of("edge", EDGES), of("summary", "repo_id string, version string, node_count long, edge_count long")


def read_change_list(lines: DataFrame) -> DataFrame:
    """(path) of status lines (``XY path``, ``XY old -> new``) or plain names in column ``value``; sources only."""
    last = F.element_at(F.split(F.trim("value"), r"\s+"), -1)
    return lines.filter(F.trim("value") != "").select(last.alias("path")).filter(F.col("path").rlike(SOURCE))


def write_report(rows: DataFrame, path: str, sep: str = " | ") -> None:
    """A text line per row."""
    report_lines(rows, sep).write.mode("overwrite").text(path)


def report_lines(rows: DataFrame, sep: str = " | ") -> DataFrame:
    """The rows of a table as Markdown lines."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(sep, *parts), F.lit(" |")).alias("value"))


def file_system(spark: SparkSession, path: str):
    """Spark's file system for a path, and the path in its form."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has the path."""
    store, at = file_system(spark, path)
    return store.exists(at)


def drop_repositories(spark: SparkSession, path: str, gone: set[str]) -> None:
    """Delete the partitions of repositories from a table that is partitioned by ``repo_id``."""
    store, at = file_system(spark, path)
    for found in store.listStatus(at) if gone else ():
        key, _, value = found.getPath().getName().partition("=")
        if key == "repo_id" and unquote(value) in gone:
            store.delete(found.getPath(), True)
