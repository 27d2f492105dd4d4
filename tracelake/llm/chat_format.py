"""Chat formatting by columnar byte assembly.

Turns of a conversation become one text: ``<|turn|>ROLE<|text|>TEXT<|end|>`` for each turn. Inside roles and
texts every ``<``, backslashes, ``|`` gets one backslash more, so that no ``<|`` of the template can occur there,
and taking one away again gives back the exact text. The loss mask covers the texts of assistant turns.

The bytes of a whole batch are laid out at once: lengths of all segments, their running sum, and scatter
indices that copy headers and contents into one preallocated buffer, which becomes the Arrow column.

Defined results: null role or text counts as empty; turns go by number (null first), then role, then text; rows
with a null id form one conversation; an empty table gives an empty result; other columns are ignored. A
conversation is one output row and so has to fit a task, as any text of the result does; past 2 GiB it is an error that says so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import small_batches
from tracelake.llm.textbytes import column_bytes

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(CLOSE), re.S)
_SLICE = 1 << 20
MOST_TEXT = (1 << 31) - 1


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _escaped(column: pa.Array) -> pa.Array:
    column = pc.fill_null(column, "")
    if not pc.any(pc.match_substring(column, "<")).as_py():
        return column
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy row k of (data, offsets) to out[at[k]:], through index arrays of bounded size."""
    shift = at - offsets[:-1]
    for low in range(0, len(data), _SLICE):
        high = min(low + _SLICE, len(data))
        first, last = np.searchsorted(offsets, [low, high], "right") - [1, 0]
        last = min(last, len(shift))
        share = np.minimum(offsets[first + 1 : last + 1], high) - np.maximum(offsets[first:last], low)
        out[np.repeat(shift[first:last], share) + np.arange(low, high)] = data[low:high]


def assemble(roles: pa.Array, texts: pa.Array, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Conversations (``ends``: the number of turns up to the end of each) as one Arrow string column.

    Also the place of each turn's escaped text: its start in code points within the conversation, and its length.
    """
    roles, texts = _escaped(roles), _escaped(texts)
    (role_bytes, role_at), (text_bytes, text_at) = column_bytes(roles), column_bytes(texts)
    n, marks = len(roles), [np.frombuffer(x.encode(), np.uint8) for x in (OPEN, MIDDLE, CLOSE)]
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0::2] = [len(x) for x in marks]
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    stops = np.cumsum(lengths.ravel())
    starts = (stops - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(stops[-1]) if n else 0, np.uint8)
    for k, mark in zip((0, 2, 4), marks, strict=True):
        out[starts[:, k, None] + np.arange(len(mark))] = mark
    _scatter(out, starts[:, 1], role_bytes, role_at)
    _scatter(out, starts[:, 3], text_bytes, text_at)
    bounds = np.concatenate([[0], stops.reshape(n, 5)[ends - 1, 4]])
    if bounds[-1] > MOST_TEXT:
        raise ValueError(f"{bounds[-1]} bytes of formatted turns: a conversation has to stay below {MOST_TEXT}, as any text of a table")
    points = np.stack([np.full(n, len(OPEN)), pc.utf8_length(roles).to_numpy(), np.full(n, len(MIDDLE)), pc.utf8_length(texts).to_numpy(), np.full(n, len(CLOSE))], 1).astype(np.int64)
    before = np.cumsum(points.ravel()).reshape(n, 5) - points
    firsts = np.concatenate([[0], ends[:-1]])
    own = before[:, 3] - np.repeat(before[firsts, 0], ends - firsts)
    column = pa.StringArray.from_buffers(len(ends), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
    return column, own, points[:, 3]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation, as conversations; the last one of a batch waits for the next batch."""

    def done(turns: pa.Table) -> pa.RecordBatch:
        turns = turns.combine_chunks()
        ids = turns["id"].combine_chunks()
        ends = np.append(np.flatnonzero(_changes(ids)) + 1, len(ids))
        roles, texts = turns["role"].combine_chunks(), turns["text"].combine_chunks()
        formatted, at, points = assemble(roles, texts, ends)
        assistant = pc.fill_null(pc.equal(roles, ASSISTANT), False).to_numpy(zero_copy_only=False)
        span_ends = np.concatenate([[0], np.cumsum(assistant)[ends - 1]]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(span_ends), pa.StructArray.from_arrays([pa.array(at[assistant]), pa.array(points[assistant])], ["start", "length"]))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(ends - 1)), pa.array(np.diff(ends, prepend=0)), formatted, spans], ["id", "n_turns", "formatted", "loss_spans"])

    # batches are small, so that what is laid out at once is a batch and one conversation at most
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.flatnonzero(_changes(batch.column("id")))
        joins = waiting and waiting[-1].column("id")[-1].as_py() == batch.column("id")[0].as_py()
        if not joins and waiting:
            yield done(pa.Table.from_batches(waiting))
            waiting = []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield done(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting:
        yield done(pa.Table.from_batches(waiting))


def _changes(ids: pa.Array) -> np.ndarray:
    """For each row but the last, whether the next one has another id."""
    codes = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, formatted, loss_spans (start and length in code points of ``formatted``)."""
    rows = small_batches(turns).select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    done = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").drop("turn").mapInArrow(_format, f"id {kind}, n_turns long, formatted string, loss_spans array<struct<start:long,length:long>>")
    return done.withColumnRenamed("id", id_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = parse(formatted)
            whole = hashlib.sha256()
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            loss, n = hashlib.sha256(), 0
            for x in spans:
                text = unescape(formatted[x["start"] : x["start"] + x["length"]])
                loss.update(text.encode())
                n += len(text)
            rows.append((len(turns), whole.hexdigest(), n, loss.hexdigest(), len(formatted)))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Read formatted conversations back: turns and loss text, as digests."""
    rows = small_batches(formatted).select(id_col, "formatted", "loss_spans")
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
