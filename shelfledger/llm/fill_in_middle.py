"""Fill-in-the-middle samples, cut with a wavelet matrix over character classes.

Every byte of an Arrow batch has a class: whether it begins a code point, a word
and a line. A wavelet matrix over the classes answers how many bytes of a class
lie before any place; sums of such ranks over the classes of a unit count its
boundaries, and bisection on these counts finds the byte at which a given unit
begins, for both cuts of all documents at once.

Form and cuts follow from a digest of the id, so a rerun gives the same samples.
``psm`` is prefix, suffix, middle behind their marks, ``spm`` suffix, prefix,
middle. A text that is empty or holds a mark stays ``plain``, so every output can
be cut at its marks again.

A null or empty text gives an empty plain output. A null id draws like an empty
one; repeated rows give equal samples. Columns besides doc_id and text are not
read. Bytes that are not UTF-8 stay as they are; one that continues no code point
belongs to what lies before it. A text of any length is handled whole; a worker
holds a few MB of texts at a time, or one text, of which classes and matrix take
about twice its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import pairwise, permutations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.columns import BLANK, bytes_of, pieces
from shelfledger.session import small_batches, stage

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
FIM_PERCENT, SPM_PERCENT, SEED = 90, 20, 1
PLAIN, PSM, SPM = "plain", "psm", "spm"

# A class is the sum of what begins at its byte; every word and line begins with a code point.
POINT, WORD, LINE = 1, 2, 4
CLASS_BITS = 3
UNITS = {
    "point": tuple(c for c in range(8) if c & POINT),
    "word": tuple(c for c in range(8) if c & WORD),
    "line": tuple(c for c in range(8) if c & LINE),
}

#: Bytes or symbols that are worked on at a time, a multiple of 64.
BLOCK = 1 << 20

SAMPLES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
REPORT = SAMPLES.removesuffix("output string") + "output_sha256 string, restored_sha256 string"


def classes(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The class of every byte of all texts."""
    out = np.empty(len(data), np.uint8)
    starts = offsets[:-1][np.diff(offsets) > 0]
    for a in range(0, len(data), BLOCK):
        here = data[a : a + BLOCK]
        before = np.concatenate([data[a - 1 : a] if a else here[:1], here[:-1]])
        first = np.zeros(len(here), bool)
        first[starts[np.searchsorted(starts, a) : np.searchsorted(starts, a + len(here))] - a] = True
        word = ~BLANK[here] & (first | BLANK[before])
        line = first | (before == 0x0A)
        out[a : a + BLOCK] = ((here & 0xC0) != 0x80) * np.uint8(POINT) + word * np.uint8(WORD) + line * np.uint8(LINE)
    return out


class Bits:
    """A bit vector that counts its ones before any place."""

    def __init__(self, size: int):
        self.packed = np.zeros(size // 64 * 8 + 8, np.uint8)

    def put(self, at: int, bits: np.ndarray) -> None:
        """Sets the bits from ``at`` on, a multiple of 8."""
        held = np.packbits(bits, bitorder="little")
        self.packed[at // 8 : at // 8 + len(held)] = held

    def close(self) -> None:
        self.words = self.packed.view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of the symbols of a sequence, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in reversed(range(bits)):
            ones = Bits(len(symbols))
            for a in range(0, len(symbols), BLOCK):
                ones.put(a, symbols[a : a + BLOCK] >> shift & 1)
            ones.close()
            zeros = int(len(symbols) - ones.before[-1])
            self.levels.append((shift, ones, zeros))
            if shift:
                symbols = self._parted(symbols, shift, zeros)

    @staticmethod
    def _parted(symbols: np.ndarray, shift: int, zeros: int) -> np.ndarray:
        """The symbols without the bit, then those with it, both in their order."""
        out, z, o = np.empty_like(symbols), 0, zeros
        for a in range(0, len(symbols), BLOCK):
            here = symbols[a : a + BLOCK]
            bit = here >> shift & 1 == 1
            n = len(here) - int(bit.sum())
            out[z : z + n], out[o : o + len(here) - n] = here[~bit], here[bit]
            z, o = z + n, o + len(here) - n
        return out

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``."""
        begin, end = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for shift, ones, zeros in self.levels:
            if symbol >> shift & 1:
                begin, end = zeros + ones.rank(begin), zeros + ones.rank(end)
            else:
                begin, end = begin - ones.rank(begin), end - ones.rank(end)
        return end - begin

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), np.int64))

    def find(self, symbols: tuple[int, ...], number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the ``number``-th of ``symbols`` (from 0), or ``high`` if it lies not before that."""
        low, high = low.astype(np.int64), high.astype(np.int64)
        while len(low) and (low < high).any():
            middle = (low + high) // 2
            here = self.count(symbols, middle + 1) > number
            low, high = np.where(here | (low >= high), low, middle + 1), np.where(here, middle, high)
        return low


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str) -> dict[str, np.ndarray]:
    """Units per text, where both cuts lie in bytes, and the code points before them.

    A cut falls after ``draw % (units + 1)`` units; the smaller one ends the prefix.
    """
    offsets, data = bytes_of(texts)
    matrix = WaveletMatrix(classes(offsets, data), CLASS_BITS)
    begin, end = offsets[:-1], offsets[1:]
    passed = matrix.count(UNITS[unit], offsets)
    n = np.diff(passed)
    a, b = first % (n + 1), second % (n + 1)
    points = matrix.count(UNITS["point"], offsets)[:-1]
    out = {"n": n}
    for name, k in (("prefix", np.minimum(a, b)), ("middle", np.maximum(a, b))):
        at = np.where(k == 0, begin, matrix.find(UNITS[unit], passed[:-1] + k, begin, end))
        out[name] = at - begin
        out[f"{name}_points"] = matrix.count(UNITS["point"], at) - points
    return out


def _arranged(text: memoryview, a: int, b: int, form: str, marks: tuple[bytes, ...]) -> tuple[bytes | memoryview, ...]:
    """The parts of an output in their order."""
    if form == PLAIN:
        return (text,)
    p, s, m = marks
    if form == PSM:
        return p, text[:a], s, text[b:], m, text[a:b]
    return s, text[b:], p, text[:a], m, text[a:b]


def _samples(ids: pa.Array, texts: pa.Array, draws: list[np.ndarray], unit: str, marks: tuple[bytes, ...], fim: int, spm: int) -> pa.RecordBatch:
    found = cut(texts, draws[0], draws[1], unit)
    offsets, data = bytes_of(texts)
    plain = (np.diff(offsets) == 0) | (draws[2] % 100 >= fim)
    for mark in marks:
        plain |= pc.match_substring(texts.cast(pa.large_binary()), mark).fill_null(False).to_numpy(zero_copy_only=False)
    forms = np.where(plain, PLAIN, np.where(draws[3] % 100 < spm, SPM, PSM))
    whole, begin = memoryview(data), offsets.tolist()
    parts = [
        part
        for (a, b), prefix, middle, form in zip(pairwise(begin), found["prefix"].tolist(), found["middle"].tolist(), forms.tolist(), strict=True)
        for part in _arranged(whole[a:b], prefix, middle, form, marks)
    ]
    lengths = np.diff(offsets) + np.where(plain, 0, sum(map(len, marks)))
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    # Put together as bytes: Arrow's cast would end the job at a text that is not UTF-8.
    output = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(parts))])
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(found["n"]), pa.array(forms.tolist(), pa.string()),
            pa.array(found["prefix_points"], mask=plain),
            pa.array(found["middle_points"] - found["prefix_points"], mask=plain),
            output,
        ],
        names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def _sample(batches: Iterator[pa.RecordBatch], unit: str, marks: tuple[str, ...], fim: int, spm: int) -> Iterator[pa.RecordBatch]:
    coded = tuple(m.encode() for m in marks)
    for batch in batches:
        at = 0
        for texts in pieces(batch.column(1)):
            ids, *draws = (batch.column(k).slice(at, len(texts)) for k in (0, 2, 3, 4, 5))
            at += len(texts)
            yield _samples(ids, texts, [d.to_numpy() for d in draws], unit, coded, fim, spm)
        texts = batch = None  # not held while the next one comes


def _finished(
    batches: Iterator[pa.RecordBatch], sample: Callable[..., Iterator[pa.RecordBatch]], finish: Callable[[pa.RecordBatch], pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    return map(finish, sample(batches))


def _restored(output: memoryview, form: str, at: tuple[int, ...], marks: tuple[bytes, ...]) -> tuple[memoryview, ...]:
    """The parts of the text that an output was made from, in their order; ``at`` is where the marks begin."""
    if form == PLAIN:
        return (output,)
    (p, s, m), (prefix, suffix, middle) = at, (a + len(mark) for a, mark in zip(at, marks, strict=True))
    if form == PSM:
        return output[prefix:s], output[middle:], output[suffix:m]
    return output[prefix:m], output[middle:], output[suffix:p]


def _digests(samples: pa.RecordBatch, marks: tuple[str, ...]) -> pa.RecordBatch:
    """Samples with digests in place of their outputs."""
    coded = tuple(m.encode() for m in marks)
    outputs = samples.column("output")
    offsets, data = bytes_of(outputs)
    whole, forms = memoryview(data), samples.column("form").to_pylist()
    places = zip(*(pc.find_substring(outputs, mark).to_pylist() for mark in coded), strict=True)
    made, back = [], []
    for (a, b), form, at in zip(pairwise(offsets.tolist()), forms, places, strict=True):
        made.append(hashlib.sha256(whole[a:b]).hexdigest())
        text = hashlib.sha256()
        for part in _restored(whole[a:b], form, at, coded):
            text.update(part)
        back.append(text.hexdigest())
    kept = samples.drop_columns(["output"])
    return kept.append_column("output_sha256", pa.array(made, pa.string())).append_column("restored_sha256", pa.array(back, pa.string()))


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that stay apart from each other and from any text without them."""
    for a, b in permutations(marks, 2):
        if a in b:
            raise ValueError(f"mark {b!r} holds {a!r}")
    for a, b in product(marks, marks):
        if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
            raise ValueError(f"marks {a!r} and {b!r} can run into each other")
    return marks


def transform(
    docs: DataFrame,
    unit: str = "point",
    marks: tuple[str, str, str] = MARKS,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    seed: int = SEED,
    finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None,
    columns: str = SAMPLES,
) -> DataFrame:
    """One sample per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` counts the text's units (``point``, ``word`` or ``line``); lengths are code
    points, null for a plain sample. Of all texts that can be cut, ``fim_percent`` in
    a hundred are, of these ``spm_percent`` as ``spm``. Write long texts within
    ``session.small_batches``; otherwise a task holds batches of the session's size.

    ``finish`` makes rows of ``columns`` from each batch of samples in the worker, so
    that Spark need not copy outputs which a caller only reads.
    """
    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"draw{k}") for k in range(4)]
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), *draws)
    sample = partial(_sample, unit=unit, marks=_checked(marks), fim=fim_percent, spm=spm_percent)
    return rows.mapInArrow(partial(_finished, sample=sample, finish=finish) if finish else sample, columns)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from."""
    p, s, m = _checked(marks)
    # Each mark is there once. Spark looks for it in the bytes; a pattern would need the text as a Java string.
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    prefix = F.when(form == PSM, between(p, s)).otherwise(between(p, m))
    suffix = F.when(form == PSM, between(s, m)).otherwise(between(s, p))
    return F.when(form == PLAIN, output).otherwise(F.concat(prefix, F.substring_index(output, m, -1), suffix))


def sample_report(docs: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Cuts of every document with digests of its output and of the text rebuilt from it.

    The rows are staged, as texts go to the workers in small batches.
    """
    report = transform(docs, marks=marks, finish=partial(_digests, marks=marks), columns=REPORT)
    with small_batches(docs.sparkSession):
        return stage(report, "fill-in-middle")
