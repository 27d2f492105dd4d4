"""R1 and W6 on streams, with state by key: changes that flush when their repository has been quiet, and changed file times.

A repository's open run of changes is kept in the state store, its paths one by one, with a timer on the clock: each change restarts it, and when it
runs out, the run is told without waiting for another event. Runs are told apart by event time as in the batch form, so that both
give the same rows for changes in order. State and timers outlive a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracelake.sources.tables import SOURCE

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNS = "repo_id string, first_ts timestamp, flush_ts timestamp, paths array<string>, events long"
CHANGED = "repo_id string, path string, snapshot_ts timestamp, mtime double, before double"


def use_keyed_state(spark: SparkSession) -> None:
    """State by key with timers is for one state store only; streams that start from here on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Runs(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap = pd.Timedelta(milliseconds=gap_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first timestamp, last timestamp, events long, timer long")
        self.paths = handle.getMapState("paths", "path string", "n long")

    def _row(self, key: tuple, first: pd.Timestamp, last: pd.Timestamp, paths: list[str], events: int) -> tuple:
        return key[0], first, last + self.gap, paths, events

    def _flush(self, key: tuple) -> list[tuple]:
        if not self.open.exists():
            return []
        first, last, events, _ = self.open.get()
        row = self._row(key, pd.Timestamp(first), pd.Timestamp(last), sorted(p[0] for p in self.paths.keys()), events)
        self.open.clear()
        self.paths.clear()
        return [row]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))[["ts", "path"]].sort_values(["ts", "path"])  # one batch's changes of one repository
        run = (given["ts"].diff() > self.gap).cumsum()
        out, timer = [], None
        if self.open.exists():
            timer = self.open.get()[3]
        for _, own in given.groupby(run):
            first, last = own["ts"].iloc[0], own["ts"].iloc[-1]
            events = len(own)
            if self.open.exists():
                held_first, held_last, held, _ = self.open.get()
                held_first, held_last = pd.Timestamp(held_first), pd.Timestamp(held_last)
                if last < held_first - self.gap:  # late, and a run of its own
                    out.append(self._row(key, first, last, sorted(set(own["path"])), events))
                    continue
                if first > held_last + self.gap:
                    out += self._flush(key)
                else:
                    first, last, events = min(first, held_first), max(last, held_last), events + held
            self.open.update((first.to_pydatetime(), last.to_pydatetime(), events, 0))
            for path in set(own["path"]):
                self.paths.updateValue((path,), (1,))
        if timer:
            self.handle.deleteTimer(timer)
        if self.open.exists():
            timer = timerValues.getCurrentProcessingTimeInMs() + int(self.gap.total_seconds() * 1000)
            self.handle.registerTimer(timer)
            self.open.update((*self.open.get()[:3], timer))
        yield _frame(out, RUNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(self._flush(key), RUNS)

    def close(self) -> None:
        pass


class Times(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "mtime double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["snapshot_ts", "mtime"])
        before = self.last.get()[0] if self.last.exists() else None
        earlier = given["mtime"].shift(fill_value=before) if before is not None else given["mtime"].shift()
        self.last.update((float(given["mtime"].iloc[-1]),))
        changed = earlier.notna() & (earlier != given["mtime"])
        yield _frame([(*key, t, m, b) for t, m, b in zip(given["snapshot_ts"][changed], given["mtime"][changed], earlier[changed], strict=True)], CHANGED)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def debounced_stream(changes: DataFrame, gap_ms: int = 300) -> DataFrame:
    """R1 on a stream (repo_id, path, ts): per repository the distinct source files of each run of changes, told when it has been quiet for ``gap_ms``.

    A change that comes after its run was told is a run of its own, or joins the one that is open within the gap.
    """
    use_keyed_state(changes.sparkSession)
    rows = changes.filter(F.col("path").rlike(SOURCE)).select("repo_id", "path", "ts")
    return rows.groupBy("repo_id").transformWithStateInPandas(statefulProcessor=Runs(gap_ms), outputStructType=RUNS, outputMode="Append", timeMode="ProcessingTime")


def mtime_changes_stream(snapshots: DataFrame) -> DataFrame:
    """W6 on a stream (repo_id, path, snapshot_ts, mtime): each time that differs from the file's last one; first sight is no change."""
    use_keyed_state(snapshots.sparkSession)
    rows = snapshots.select("repo_id", "path", "snapshot_ts", "mtime")
    return rows.groupBy("repo_id", "path").transformWithStateInPandas(statefulProcessor=Times(), outputStructType=CHANGED, outputMode="Append", timeMode="None")
