"""Statistics of whole texts, computed for many documents at once.

Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words, lines or
characters, and all its statistics are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from shelfledger.llm.columns import combined, numbered, pieces, word_spans
from shelfledger.llm.columns import bytes_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a model reads of a document.
FEATURES = (
    "log_words", "mean_word", "symbols_per_word", "dup_lines", "repeat_words", "upper", "digits", "shouts",
    "stops", "other_marks", "accents", "pipes", "distinct_words", "words_per_line", "mean_line",
)

_BLANK, _BREAK, _SYMBOL, _PIPE, _UPPER, _LOWER, _DIGIT, _SHOUT, _STOP, _OTHER, _TRAIL, _LEAD = range(12)
_KINDS = 12
_KIND = np.full(256, _OTHER, np.int64)
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _BLANK
_KIND[0x0A] = _BREAK
_KIND[list(b"#*$%&<>")] = _SYMBOL
_KIND[ord("|")] = _PIPE
_KIND[ord("A") : ord("Z") + 1] = _UPPER
_KIND[ord("a") : ord("z") + 1] = _LOWER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[list(b"!?")] = _SHOUT
_KIND[list(b".,;:")] = _STOP
_KIND[0x80:0xC0] = _TRAIL
_KIND[0xC0:] = _LEAD


def _repeated_words(number: np.ndarray, distinct: int, row: np.ndarray, n: int) -> np.ndarray:
    """Words per row that lie in a window of three words found twice or more in the row."""
    if len(number) < 3:
        return np.zeros(n, np.int64)
    inside = np.flatnonzero(row[2:] == row[:-2])
    keys = [(number[inside + k], distinct) for k in range(3)]
    _, which, times = np.unique(combined((row[inside], n), *keys), return_inverse=True, return_counts=True)
    again = inside[times[which] > 1]
    covered = np.zeros(len(number), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(row[covered], minlength=n)


def _repeated_lines(offsets: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word per row, and how many of them equal an earlier one."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    row = np.sort(np.concatenate([np.arange(n), row_of_break]), kind="stable")
    last = np.append(row[1:] != row[:-1], True)
    ends = np.where(last, offsets[row + 1], np.append(starts[1:], 0) - 1)
    ink = np.concatenate([[0], np.cumsum(_KIND[data] > _BREAK)])
    full = ink[ends] > ink[starts]
    starts, ends, row = starts[full], ends[full], row[full]
    lines = np.bincount(row, minlength=n)
    if not len(starts):
        return lines, lines
    number, distinct = numbered(starts, ends, data)
    _, first = np.unique(combined((row, n), (number, distinct)), return_index=True)
    return lines, lines - np.bincount(row[first], minlength=n)


def _piece(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = bytes_of(texts)
    n = len(texts)
    row = np.repeat(np.arange(n) * _KINDS, np.diff(offsets))
    kinds = np.bincount(row + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    starts, ends, word_row = word_spans(offsets, data)
    n_words = np.bincount(word_row, minlength=n)
    number, distinct = numbered(starts, ends, data)
    repeat_words = _repeated_words(number, distinct, word_row, n)
    lines, dup_lines = _repeated_lines(offsets, data, n)
    _, first = np.unique(combined((word_row, n), (number, max(distinct, 1))), return_index=True)
    distinct_words = np.bincount(word_row[first], minlength=n)
    word_chars = kinds[:, _SYMBOL:].sum(axis=1) - kinds[:, _TRAIL]
    n_symbols = kinds[:, _SYMBOL] + kinds[:, _PIPE]
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    counts = np.stack([n_words, word_chars, n_symbols, dup_lines, repeat_words], axis=1)
    features = np.stack(
        [
            np.log1p(n_words), word_chars / words, n_symbols / words, dup_lines / np.maximum(lines, 1), repeat_words / words,
            kinds[:, _UPPER] / chars, kinds[:, _DIGIT] / chars, kinds[:, _SHOUT] / words, kinds[:, _STOP] / words,
            kinds[:, _OTHER] / words, kinds[:, _LEAD] / chars, kinds[:, _PIPE] / words, distinct_words / words,
            n_words / np.maximum(lines, 1), word_chars / np.maximum(lines, 1),
        ],
        axis=1,
    )
    return counts, features


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (whole numbers) and FEATURES (floats), a row per text."""
    done = [_piece(p) for p in pieces(texts)]
    if not done:
        return np.empty((0, len(COUNTS)), np.int64), np.empty((0, len(FEATURES)))
    return tuple(np.concatenate(parts) for parts in zip(*done, strict=True))
