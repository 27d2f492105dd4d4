"""Debounced file changes, and upkeep of the stored graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators import incremental
from tracelake.sources.tables import SOURCE, drop_repositories, exists, graph_tables, written


def debounce_changes(changes: DataFrame, gap: str = "300 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Per repository the distinct source files of each run of changes that a quiet ``gap`` ends.

    The same code serves a batch and a stream; on a stream, events later than ``late`` are dropped.
    """
    rows = changes.filter(F.col("path").rlike(SOURCE))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy("repo_id", F.session_window("ts", gap).alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("events"))
    return out.select("repo_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("flush_ts"), "paths", "events")


Files = Callable[[DataFrame], DataFrame]


def _replace(rows: DataFrame, touched: DataFrame, path: str) -> DataFrame:
    """Put ``rows`` in place of the touched repositories' part of a stored table; repositories without rows are gone. Returns the new rows."""
    spark = rows.sparkSession
    settled = written(rows, "settled")  # the table may be read and replaced in one step
    settled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(path)
    drop_repositories(spark, path, {r[0] for r in touched.join(settled, "repo_id", "left_anti").collect()})  # of one flushed batch
    return settled


def _reindexed(touched: DataFrame, current: Files, parse: Files, index: str) -> tuple[DataFrame, DataFrame]:
    """Bring the touched repositories' part of the stored index up to date; returns (decisions, their index rows)."""
    spark, files = touched.sparkSession, current(touched)
    cache = spark.read.parquet(index).withColumn("repo_id", F.col("repo_id").cast("string")).join(touched, "repo_id", "left_semi") if exists(spark, index) else parse(files.limit(0))
    decisions = written(incremental.incremental_index(files, cache), "decisions")
    fresh = parse(decisions.filter("decision = 'parse'").drop("decision"))
    return decisions, _replace(incremental.merge_index(decisions, cache, fresh), touched, index)


def maintain_index(flushed: DataFrame, current: Files, parse: Files, index: str, checkpoint: str, on_update: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """For each flushed batch, decide which files of the touched repositories to parse, parse them, and replace these
    repositories' part of the stored index; then call ``on_update`` with the decisions.

    ``current`` gives the present files of the repositories in its argument (repo_id, path, mtime, size, sha256);
    ``parse`` turns decided misses into index rows (repo_id, path, mtime, size, sha256, and payload columns).
    """

    def update(batch: DataFrame, _: int) -> None:
        decisions, _rows = _reindexed(written(batch.select("repo_id").distinct(), "touched"), current, parse, index)
        if on_update is not None:
            on_update(decisions)

    return flushed.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_graph(flushed: DataFrame, current: Files, parse: Files, build: Callable[[DataFrame], tuple[DataFrame, DataFrame]], index: str, graph: str, checkpoint: str, on_update: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """As ``maintain_index``, and then ``build`` turns the index rows of the touched repositories into (nodes, edges), which replace
    these repositories' part of the graph stored at ``graph``. Repositories whose files have all gone leave index and graph.
    """

    def update(batch: DataFrame, _: int) -> None:
        touched = written(batch.select("repo_id").distinct(), "touched")
        decisions, rows = _reindexed(touched, current, parse, index)
        for name, part in zip(("nodes", "edges"), graph_tables(*build(rows)), strict=True):
            _replace(part, touched, f"{graph}/{name}")
        if on_update is not None:
            on_update(decisions)

    return flushed.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
