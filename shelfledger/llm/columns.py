"""Arrow string columns as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def pieces(column: pa.Array, limit: int = 2 << 20):
    """Slices of a string column of about ``limit`` bytes each, one row at least."""
    offsets, _ = bytes_of(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield column.slice(a, b - a)
        a = b


#: What ends a word: space and \t \n \v \f \r.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+`` of all texts."""
    ink = ~BLANK[data]
    inner = offsets[:-1][np.diff(offsets) > 0]
    after_blank = np.ones(len(data), bool)
    after_blank[1:] = ~ink[:-1]
    after_blank[inner] = True
    before_blank = np.ones(len(data), bool)
    before_blank[:-1] = after_blank[1:]
    before_blank[:-1] |= ~ink[1:]
    starts = np.flatnonzero(ink & after_blank)
    ends = np.flatnonzero(ink & before_blank) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def numbered(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for every segment of ``data``, equal for equal bytes, and how many there are."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    held = data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    coded = array.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def combined(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """One number per row, equal where all keys are equal; keys come with their number of values."""
    out, size = keys[0]
    for key, count in keys[1:]:
        if size * count >= 1 << 62:
            distinct, out = np.unique(out, return_inverse=True)
            size = len(distinct)
        out, size = out * count + key, size * count
    return out
