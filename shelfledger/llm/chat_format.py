"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn>`` role newline text ``</turn>`` newline. Inside roles and
texts every backslash and ``<`` gets a backslash before it, so no text can open
or close a turn, and dropping those backslashes gives the text back; a newline
in a role becomes ``\\n``. A task sorts its conversations by turn and assembles an
Arrow batch at a time: segment lengths, cumulative offsets and scatter indices in
numpy, then one copy into a preallocated buffer. A conversation of any length
streams through in parts of bounded size; nothing holds it whole.

A null text is empty, a null role is an empty role, a null conversation id is a
conversation of its own. Turns are ordered by turn (null first), then role, then
text; repeated rows are repeated turns.
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

from shelfledger.llm.columns import bytes_of

OPEN, BREAK, CLOSE = b"<turn>", b"\n", b"</turn>\n"
LEARNED = "assistant"

PARTS = "conv_id long, part long, formatted string, mask_from array<long>, mask_to array<long>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _escaped(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same column with a backslash before every backslash and ``<``."""
    special = (data == 0x5C) | (data == 0x3C)
    shift = np.concatenate([[0], np.cumsum(special)])
    out = np.full(len(data) + shift[-1], 0x5C, np.uint8)
    out[np.arange(len(data)) + shift[1:]] = data
    return offsets + shift[offsets], out


def _scatter(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copies segment i of ``data`` to ``out[at[i]:]``."""
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(at - offsets[:-1], lengths)] = data


def _constant(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(n + 1) * len(text), np.tile(np.frombuffer(text, np.uint8), n)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turn offsets, bytes, and the byte range of every turn's text."""
    n = len(roles)
    role = pc.replace_substring(pc.fill_null(roles.cast(pa.string()), ""), "\\", "\\\\")
    role = pc.replace_substring(pc.replace_substring(role, "<", "\\<"), "\n", "\\n")
    segments = [_constant(OPEN, n), bytes_of(role), _constant(BREAK, n), _escaped(*bytes_of(texts)), _constant(CLOSE, n)]
    lengths = np.stack([np.diff(o) for o, _ in segments])
    ends = np.concatenate([[0], np.cumsum(lengths.sum(axis=0))])
    starts = ends[:-1] + np.concatenate([np.zeros((1, n), np.int64), np.cumsum(lengths, axis=0)[:-1]])
    out = np.empty(ends[-1], np.uint8)
    for at, (offsets, data) in zip(starts, segments, strict=True):
        _scatter(out, at, offsets, data)
    return ends, out, starts[3], starts[3] + lengths[3]


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()),
         ("mask_from", pa.list_(pa.int64())), ("mask_to", pa.list_(pa.int64()))]
    )
    last, part, chars = object(), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id")
        ends, out, text_from, text_to = assemble(batch.column("role"), batch.column("text"))
        lead = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
        learned = np.array([r == LEARNED for r in batch.column("role").to_pylist()])
        keys = ids.to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        columns: tuple[list, ...] = ([], [], [], [], [])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[a] != last or not isinstance(last, (int, type(None))):
                last, part, chars = keys[a], 0, 0
            own = np.flatnonzero(learned[a:b]) + a
            shift = chars - lead[ends[a]]
            row = (keys[a], part, out[ends[a] : ends[b]].tobytes().decode(), lead[text_from[own]] + shift, lead[text_to[own]] + shift)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            part += 1
            chars += int(lead[ends[b]] - lead[ends[a]])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted conversations as parts: conv_id, part, formatted, mask_from, mask_to.

    A conversation is its parts in order; most have one. The mask lists where the
    escaped text of each learned turn starts and ends, in code points of the whole
    conversation. An empty table gives no rows.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format_batches, PARTS)


TURN = re.compile(r"<turn>((?:[^\\<\n]|\\.)*)\n((?:[^\\<]|\\.)*)</turn>\n", re.S)
ESCAPE = re.compile(r"\\(.)", re.S)


def _plain(text: str) -> str:
    return ESCAPE.sub(lambda m: m[1], text)


def _plain_role(text: str) -> str:
    return ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
         ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )
    begun, key = False, None
    n = loss = chars = 0
    turns_hash = loss_hash = None
    done: list[tuple] = []

    def close() -> None:
        if begun:
            done.append((key, n, turns_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))

    for batch in batches:
        for row in batch.to_pylist():
            if not begun or row["part"] == 0 or row["conv_id"] != key:
                close()
                begun, key, n, loss, chars = True, row["conv_id"], 0, 0, 0
                turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
            text, at = row["formatted"], 0
            while at < len(text):
                m = TURN.match(text, at)
                if m is None:
                    raise ValueError(f"conversation {key}: no turn at {chars + at}")
                n += 1
                turns_hash.update(f"{_plain_role(m[1])}\n{_plain(m[2])}\n".encode())
                at = m.end()
            for a, b in zip(row["mask_from"], row["mask_to"], strict=True):
                learned = _plain(text[a - chars : b - chars])
                loss += len(learned)
                loss_hash.update(learned.encode())
            chars += len(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True) if done else [[]] * 6, schema, strict=True)],
            schema=schema,
        )
        done = []
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def read_conversations(parts: DataFrame) -> DataFrame:
    """Reads formatted parts back: one row of counts and digests per conversation.

    ``parts`` must come from :func:`format_conversations` unshuffled, or be dealt and
    sorted by (conv_id, part).
    """
    return parts.mapInArrow(_read_batches, READ)
