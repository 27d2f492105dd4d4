"""Conversation structure repair: the cheapest edits after which the roles read ``(s?(ua)+)?``, by a time-major dynamic program.

Rows of a conversation are kept (0), given the role user or assistant (1), deleted (2; blank and repeated rows have to be), and
empty rows are inserted before, between and behind them (5); a row without a final mark costs 5 more unless it is deleted. Of the
cheapest edits those with the ASCII-least string of initials count.

Spark sorts the rows by conversation and turn over ranges of equal size and cuts them into segments: a conversation, or a piece of
one that is long or crosses a range. Segments of like length are solved together: the costs of all states at a turn are one
tensor, updated turn by turn from the last one, and stored; edits are then read off it forwards, for all segments at once. A
conversation of several segments is put together by its segments' cost matrices (4 by 4, over minimum and sum), which give each
segment the costs behind it, and by where each of the four states leads, which gives it the state to start in. So no conversation has to
fit a task; only 16 numbers for each ``MOST_ROWS`` rows of one conversation meet.

Defined results: null roles and texts count as one space, an empty role as one that is none of the three; rows go by turn (null
first), then role, then text; equal rows stay rows of their own, of which the first is no duplicate; rows with a null id
form one conversation; very long texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import small_batches, spent, written
from tracelake.llm.textbytes import SPACE, column_bytes

MOST_ROWS, MOST_BYTES, CELLS = 8192, 4 << 20, 1 << 19
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: States: nothing yet, behind system, user, assistant. Where an inserted or rewritten row leads: to user, or from user to assistant.
NEXT = np.array([2, 2, 3, 2])
ACCEPTED = (0, 3)
#: Edits as they are stored, and their initials.
DROP, ADD_USER, ADD_ASSISTANT, HOLD, TO_USER, TO_ASSISTANT = range(1, 7)
INITIAL = np.frombuffer(b"\0DIIKRR", np.uint8)
#: Codes of rows: 0 none, 1 to be deleted, 2 + 2 * role + truncated; roles are s, u, a, any other.
_LEADS = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
_KEEP_TO = np.zeros((10, 4), np.int64)
_KEEP_COST, _REROLE_COST, _DELETE_COST = np.full((10, 4), NEVER), np.full(10, NEVER), np.full(10, DELETE)
_DELETE_COST[0] = 0
for _role in range(4):
    for _cut in range(2):
        _code = 2 + 2 * _role + _cut
        _KEEP_TO[_code] = np.maximum(_LEADS[_role], 0)
        _KEEP_COST[_code] = np.where(_LEADS[_role] < 0, NEVER, KEEP + CUT_OFF * _cut)
        _REROLE_COST[_code] = REROLE + CUT_OFF * _cut
_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True
ROWS = "array<struct<turn:long,role:string,text:string,repeated:boolean>>"
PARTS = "segment long, blank long, duplicate long, truncated long, illegal long, first_role int, last_role int, first_turn long, last_turn long, turns long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state (the last axis) when rows may be inserted first; more than two never pay."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[..., NEXT])
    return costs


END = closed(np.array([0, NEVER, NEVER, 0]))


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """codes (time, conversations), end (conversations, cases, states) to the costs of all that follows, (time + 1, ...)."""
    costs = np.empty((len(codes) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(codes) - 1, -1, -1):
        code, after = codes[t], costs[t + 1]
        keep = np.take_along_axis(after, np.broadcast_to(_KEEP_TO[code][:, None], after.shape), 2) + _KEEP_COST[code][:, None]
        rerole = after[..., NEXT] + _REROLE_COST[code][:, None, None]
        best = np.minimum(np.minimum(keep, rerole), after + _DELETE_COST[code][:, None, None])
        costs[t] = np.where(code[:, None, None] > 0, closed(best), after)
    return costs


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits (steps, conversations; 0 where there is none) from a state at the start, and the states at the end."""
    own, state = np.arange(len(state)), state.copy()
    edits = np.zeros((3 * len(codes) + 2, len(state)), np.uint8)
    for t, code in enumerate(codes):
        here, after = costs[t], costs[t + 1]
        free = code > 0
        for k in range(3):
            cost, to = here[own, state], NEXT[state]
            drop = free & (after[own, state] + DELETE == cost)
            insert = free & ~drop & (here[own, to] + INSERT == cost)
            hold = free & ~drop & ~insert & (after[own, _KEEP_TO[code, state]] + _KEEP_COST[code, state] == cost)
            rerole = free & ~drop & ~insert & ~hold
            edits[3 * t + k] = np.select([drop, insert, hold, rerole], [DROP, to, HOLD, to + 3], 0)
            state = np.select([hold, insert | rerole], [_KEEP_TO[code, state], to], state)
            free = insert
    for k in range(2):
        insert = last & ~np.isin(state, ACCEPTED)
        edits[3 * len(codes) + k] = np.where(insert, NEXT[state], 0)
        state = np.where(insert, NEXT[state], state)
    return edits, state


def _faults(rows: pa.StructArray) -> dict[str, np.ndarray]:
    """For each row: role (s, u, a, other), blank, duplicate, truncated (the first that applies), its code."""
    data, at = column_bytes(rows.field("text"))
    solid = np.flatnonzero(~SPACE[data])
    place = np.searchsorted(solid, at[1:]) - 1
    final = solid[np.maximum(place, 0)] if len(solid) else np.zeros(len(place), np.int64)
    blank = (place < 0) | (final < at[:-1])
    repeated = rows.field("repeated").to_numpy(zero_copy_only=False).astype(bool)
    truncated = ~np.isin(data[final], np.frombuffer(b".!?", np.uint8)) & ~blank & ~repeated if len(solid) else np.zeros(len(blank), bool)
    names, name_at = column_bytes(rows.field("role"))
    first = np.append(names, 0)[name_at[:-1]] * (np.diff(name_at) > 0)
    role = np.select([first == 115, first == 117, first == 97], [0, 1, 2], 3)
    return {"role": role, "blank": blank, "duplicate": repeated & ~blank, "truncated": truncated, "code": np.where(blank | repeated, 1, 2 + 2 * role + truncated)}


def _buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of segments of like length (within a factor of 1.5, so that few cells are empty), of at most CELLS rows together."""
    order = np.argsort(sizes, kind="stable")
    low = 0
    while low < len(order):
        most = max(sizes[order[low]] * 3 // 2, 4)
        high = min(int(np.searchsorted(sizes[order], most, "right")), low + max(1, CELLS // int(most)))
        high = max(high, low + 1)
        yield order[low:high]
        low = high


def _tensor(code: np.ndarray, at: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Codes (time, segments) of some segments; shorter ones begin later."""
    sizes = np.diff(at)[some]
    steps = int(sizes.max(initial=0))
    place = steps - sizes[None, :] <= np.arange(steps)[:, None]
    out = np.zeros((steps, len(some)), np.int64)
    row = at[1:][some][None, :] - (steps - np.arange(steps)[:, None])
    out[place] = code[row[place]]
    return out


def _list(batch: pa.RecordBatch) -> tuple[pa.StructArray, np.ndarray]:
    column = batch.column("rows")
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.slice(at[0], at[-1] - at[0]), at - at[0]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, at = _list(batch)
        code, out = _faults(rows)["code"], np.empty((batch.num_rows, 4, 4), np.int64)
        ends = np.where(np.eye(4, dtype=bool), 0, NEVER)
        for some in _buckets(np.diff(at)):
            costs = backward(_tensor(code, at, some), np.broadcast_to(ends, (len(some), 4, 4)).copy())
            out[some] = costs[0].transpose(0, 2, 1)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("segment"), pa.array(np.minimum(out, NEVER).reshape(len(out), 16).tolist(), pa.list_(pa.int64()))], ["id", "segment", "matrix"])


def _ends(rows: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each segment of one conversation."""
    rows = rows.sort_values("segment")
    after, out = END, []
    for matrix in reversed(rows["matrix"].tolist()):
        out.append(after.tolist())
        after = np.minimum((np.array(matrix).reshape(4, 4) + after).min(1), NEVER)
    return pd.DataFrame({"segment": rows["segment"], "end": out[::-1], "last": [False] * (len(out) - 1) + [True]})


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, at = _list(batch)
        code, to = _faults(rows)["code"], np.empty((batch.num_rows, 4), np.int64)
        end, last = np.array(batch.column("end").to_pylist()).reshape(-1, 4), batch.column("last").to_numpy(zero_copy_only=False)
        for some in _buckets(np.diff(at)):
            codes = _tensor(code, at, some)
            costs = backward(codes, end[some][:, None])[:, :, 0]
            for state in range(4):
                start = np.full(len(some), state)
                possible = costs[0, :, state] < NEVER
                to[some, state] = np.where(possible, trace(codes, costs, start, last[some])[1], -1)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("segment"), pa.array(to.tolist(), pa.list_(pa.int64()))], ["id", "segment", "to"])


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment of one conversation starts."""
    rows = rows.sort_values("segment")
    state, out = 0, []
    for to in rows["to"].tolist():
        out.append(state)
        state = int(to[state])
    return pd.DataFrame({"segment": rows["segment"], "start": out})


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, at = _list(batch)
        n, found = batch.num_rows, _faults(rows)
        start, last = batch.column("start").to_numpy().astype(np.int64), batch.column("last").to_numpy(zero_copy_only=False)
        end = np.array(batch.column("end").to_pylist(), np.int64).reshape(-1, 4)
        parts: list[np.ndarray] = [None] * n
        for some in _buckets(np.diff(at)):
            codes = _tensor(found["code"], at, some)
            edits = trace(codes, backward(codes, end[some][:, None])[:, :, 0], start[some], last[some])[0].T
            used = edits > 0
            for k, x in zip(some.tolist(), np.split(edits[used], np.cumsum(used.sum(1))[:-1]), strict=True):
                parts[k] = x
        sizes = np.array([len(x) for x in parts], np.int64)
        edits, ends = np.concatenate([np.zeros(0, np.uint8), *parts]), np.append(0, np.cumsum(sizes))
        segment = np.repeat(np.arange(n), sizes)
        made = np.isin(edits, (ADD_USER, ADD_ASSISTANT))
        row = np.cumsum(~made) - 1
        owner = np.repeat(np.arange(n), np.diff(at))
        late = np.append(found["truncated"], False)[np.where(made, len(rows), row)]
        cost = np.array([0, DELETE, INSERT, INSERT, KEEP, REROLE, REROLE])[edits] + np.where(late & (edits != DROP), CUT_OFF, 0)
        kept = edits != DROP
        texts = pa.concat_arrays([rows.field("text"), pa.array(["user", "assistant", ""])])
        roles = pa.concat_arrays([rows.field("role"), pa.array(["user", "assistant"])])
        role_at = np.select([np.isin(edits, (ADD_USER, TO_USER)), np.isin(edits, (ADD_ASSISTANT, TO_ASSISTANT))], [len(rows), len(rows) + 1], row)[kept]
        text_at = np.where(made, len(rows) + 2, row)[kept]
        bounds = np.append(0, np.cumsum(kept))[ends].astype(np.int32)
        repaired = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([roles.take(pa.array(role_at)), texts.take(pa.array(text_at))], ["role", "text"]))
        audit = pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(INITIAL[edits]))
        role, same = found["role"], owner[1:] == owner[:-1]
        illegal = same & ~_LEGAL[role[:-1], role[1:]]
        turn, known = rows.field("turn"), ~rows.field("turn").is_null().to_numpy(zero_copy_only=False)
        number = turn.fill_null(0).to_numpy()
        new = known.copy()
        new[1:] &= ~(same & known[:-1] & (number[1:] == number[:-1]))
        first_known = at[:-1] + np.bincount(owner, ~known, n).astype(np.int64)
        any_known = known[at[1:] - 1]  # nulls come first
        count = lambda x, by: pa.array(np.bincount(by, x, n).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"), batch.column("segment"), *(count(found[c], owner) for c in ("blank", "duplicate", "truncated")), count(illegal, owner[1:]), pa.array(role[at[:-1]], pa.int32()), pa.array(role[at[1:] - 1], pa.int32()),
                pa.array(number[np.minimum(first_known, len(rows) - 1)], mask=~any_known), pa.array(number[at[1:] - 1], mask=~any_known), count(new, owner), count(cost, segment), audit, repaired,
            ],
            ["id", *(x.split()[0] for x in PARTS.split(", "))],
        )


def _cut(most_rows: int):
    """Sorted rows as segments: a row each, with the rows of one conversation, or of a piece of it of about ``most_rows`` rows or MOST_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: list[pa.RecordBatch] = []
        before: pa.RecordBatch | None = None  # the last row
        begun = True  # rows of the first waiting conversation may lie before these

        def done(table: pa.Table, ends: np.ndarray, open_end: bool) -> pa.RecordBatch:
            nonlocal number, begun
            table = table.combine_chunks()
            names = ["turn", "role", "text", "repeated"]
            whole = np.ones(len(ends), bool)
            whole[0] &= not begun
            whole[-1] &= not open_end
            rows = pa.StructArray.from_arrays([table[c].combine_chunks() for c in names], names)
            out = [table["id"].combine_chunks().take(pa.array(ends - 1)), pa.array(np.arange(number, number + len(ends))), pa.array(whole), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), rows)]
            number, begun = number + len(ends), open_end
            return pa.RecordBatch.from_arrays(out, ["id", "segment", "whole", "rows"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([before, batch] if before else [batch])
            changed = [x[1:] != x[:-1] for x in (pc.dictionary_encode(own[c].combine_chunks(), null_encoding="encode").indices.to_numpy() for c in ("id", "turn", "role", "text"))]
            moved, again = changed[0], ~np.logical_or.reduce(changed)
            if not before:
                moved, again = np.append(True, moved), np.append(False, again)
            before = batch.slice(batch.num_rows - 1)
            batch = batch.set_column(4, "repeated", pc.or_(batch.column("repeated"), pa.array(again)))
            cuts, held = np.flatnonzero(moved), sum(x.num_rows for x in waiting)  # cuts: rows that begin a conversation
            if len(cuts):
                ends = cuts + held
                if ends[-1]:
                    yield done(pa.Table.from_batches([*waiting, batch.slice(0, int(cuts[-1]))]), ends[ends > 0], False)
                waiting = [batch.slice(int(cuts[-1]))]
            else:
                waiting.append(batch)
            held = sum(x.num_rows for x in waiting)
            if held >= most_rows or sum(x.nbytes for x in waiting) >= MOST_BYTES:
                yield done(pa.Table.from_batches(waiting), np.array([held]), True)
                waiting = []
        if waiting:
            yield done(pa.Table.from_batches(waiting), np.array([sum(x.num_rows for x in waiting)]), True)

    return run


def segments(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """(id, segment, whole, rows): the rows in order, with a mark on those whose role and text came before; written."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = small_batches(turns).select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    rows = rows.withColumn("content", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    seen = rows.groupBy(F.col("id").alias("i"), F.col("content").alias("c")).agg(F.min(order).alias("seen"), F.max(order).alias("final")).filter("seen != final").drop("final")
    seen = written(seen, "seen")  # settled first: Spark then knows that it is small, and leaves the texts where they are
    rows = rows.join(seen, F.col("id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("c")), "left").withColumn("repeated", F.coalesce(order > F.col("seen"), F.lit(False)))
    key = ["id", "turn", F.left("role", F.lit(32)), F.left("text", F.lit(64))]
    placed = rows.select("id", "turn", "role", "text", "repeated").repartitionByRange(*key).sortWithinPartitions(*key, "role", "text")
    kind = placed.schema["id"].dataType.simpleString()
    out = written(placed.mapInArrow(_cut(most_rows), f"id {kind}, segment long, whole boolean, rows {ROWS}"), "segments")
    spent(seen)
    return out


def repair(cut: DataFrame) -> DataFrame:
    """The edits of each of the ``segments``: faults, cost, audit, repaired rows (PARTS), with ``whole`` of the segment."""
    kind = cut.schema["id"].dataType.simpleString()
    alone = cut.filter("whole").select("id", "segment", "rows", F.lit(0).alias("start"), F.array(*[F.lit(int(x)) for x in END]).cast("array<long>").alias("end"), F.lit(True).alias("last"))
    pieces = cut.filter("not whole").select("id", "segment", "rows")
    ends = written(pieces.mapInArrow(_matrices, f"id {kind}, segment long, matrix array<long>").groupBy("id").applyInPandas(_ends, "segment long, end array<long>, last boolean"), "ends")
    behind = pieces.join(ends, "segment").select("id", "segment", "rows", "end", "last")
    starts = written(behind.mapInArrow(_leads, f"id {kind}, segment long, to array<long>").groupBy("id").applyInPandas(_starts, "segment long, start int"), "starts")
    known = behind.join(starts, "segment").select("id", "segment", "rows", "start", "end", "last")
    solve = lambda df, whole: df.mapInArrow(_solve, f"id {kind}, {PARTS}").withColumn("whole", F.lit(whole))
    out = written(solve(alone, True).unionByName(solve(known, False)), "repaired")
    spent(cut, ends, starts)
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order as a row per conversation."""
    names = ("id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    own: dict | None = None
    done: list[tuple] = []

    def finish() -> None:
        gaps = own["high"] - own["low"] + 1 - own["turns"] if own["low"] is not None else 0
        done.append((own["id"], gaps, *(own[c] for c in names[2:7]), "".join(own["audit"]), own["hash"].hexdigest()))

    def flush(schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * len(names)
        done.clear()
        kinds = [schema.field("id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], list(names))

    schema = None
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if own is None or own["id"] != row["id"]:
                if own is not None:
                    finish()
                own = {"id": row["id"], "low": None, "high": None, "turns": 0, "role": None, "audit": [], "hash": hashlib.sha256(), "lines": 0} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                own[c] += row[c]
            own["illegal"] += own["role"] is not None and not _LEGAL[own["role"], row["first_role"]]
            own["role"] = row["last_role"]
            if row["first_turn"] is not None:
                own["turns"] += row["turns"] - (own["high"] == row["first_turn"])
                own["low"], own["high"] = row["first_turn"] if own["low"] is None else own["low"], row["last_turn"]
            own["audit"].append(row["audit"])
            if row["repaired"]:
                own["hash"].update(("\n" * (own["lines"] > 0) + "\n".join(f"{x['role']}:{x['text']}" for x in row["repaired"])).encode())
                own["lines"] += len(row["repaired"])
        if done:
            yield flush(schema)
    if own is not None:
        finish()
        yield flush(schema)


def report(parts: DataFrame) -> DataFrame:
    """A row per conversation of ``repair``: faults, cost, audit, digest of the repaired rows; pieces are put together in their order, one at a time."""
    kind = parts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    in_order = parts.filter("not whole").drop("whole").repartition("id").sortWithinPartitions("id", "segment")
    return parts.filter("whole").drop("whole").mapInArrow(_report, schema).unionByName(in_order.mapInArrow(_report, schema))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the checksum of ``conv_id:turn``: rows that go, lose their text or its final marks, come twice, or become the user's."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.filter("fault != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def audited(turns: DataFrame) -> DataFrame:
    """Every conversation after damage and repair: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    found = report(repair(segments(damaged(turns))))
    ids = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return ids.join(found, ids["conv_id"].eqNullSafe(found["id"]), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256"))
