"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt by ranges of their id and sorted, encoded a few MB of text at
a time, and closed into segments of whole documents. Texts are cut where the
tokenizer never joins both sides, and a task has the library encode each distinct
piece once. A segment is one file:

* magic and, as big-endian 64-bit numbers, shard, number in the shard, documents,
  ids, blocks, exceptions, bytes of packed values
* per document its id, whether it is null, and where its ids begin
* per block the smallest id, the width, where its packed values begin, and its
  first exception
* per exception its place in the block and its whole difference
* the packed values, and a CRC-32 of all before it; a newline ends the file

A block is ``BLOCK`` ids. Its smallest id is subtracted, and the differences are
packed at the width that ``PERCENTILE`` of them fit in; those that do not fit are
exceptions. Block starts are indexed, so a range of ids is read without the rest.
Arrays are little-endian.

Files are written by Spark's text writer, one segment a record and a file, so
Spark's commit rules hold and a lost task leaves nothing behind. A manifest with
the ids in every segment, read off the headers, gives the ids before it.

A null or empty text has the end id alone. Null document ids come first; rows of
equal id are ordered by text. Repeated rows are kept each on its own. Columns
besides doc_id and text are not read. An empty table gives no files and no rows.
A text longer than a segment makes a longer one.
"""

from __future__ import annotations

import os
import re
import struct
import sys
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from types import ModuleType
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfledger.llm.columns import bytes_of, pieces
from shelfledger.session import stage

MAGIC = b"PFORIDS1"
HEADER = ">8s7q"
BLOCK = 256
PERCENTILE = 0.9
#: A segment is closed at so many ids.
SEGMENT_IDS = 8_000_000
END_ID = 0
#: Bytes of text that are encoded at a time.
PIECE = 4 << 20
#: Blocks that are packed or unpacked at a time.
STEP = 2048
DOCUMENTS = "shard long, segment long, doc_id long, before long, n_tokens long, ids"


# --- blocks ---------------------------------------------------------------------------------


def _to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values packed at ``width`` bits each."""
    rows, n = values.shape
    if width in (8, 16, 32):
        return values.astype(f">u{width // 8}").view(np.uint8).reshape(rows, n * width // 8)
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(rows, n, 4), axis=2)
    return np.packbits(bits[:, :, 32 - width :].reshape(rows, n * width), axis=1)


def _from_bits(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = len(packed)
    if width in (8, 16, 32):
        return packed.view(f">u{width // 8}").astype(np.uint32)
    bits = np.zeros((rows, n, 32), np.uint8)
    bits[:, :, 32 - width :] = np.unpackbits(packed, axis=1).reshape(rows, n, width)
    return np.packbits(bits, axis=2).reshape(rows, n * 4).view(">u4").astype(np.uint32)


def _by_width(widths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for width in np.unique(widths):
        if width:
            yield int(width), np.flatnonzero(widths == width)


class Blocks:
    """The blocks of a run of ids."""

    def __init__(self, n, base, width, place, value, first, packed):
        self.n, self.base, self.width = n, base, width
        #: Exceptions, and the first one of every block.
        self.place, self.value, self.first = place, value, first
        self.starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
        self.packed = packed

    @classmethod
    def pack(cls, ids: np.ndarray, percentile: float = PERCENTILE) -> Blocks:
        packer = Packer(percentile)
        packer.add(ids)
        return packer.blocks()

    @staticmethod
    def _pack_some(ids: np.ndarray, percentile: float) -> tuple[np.ndarray, ...]:
        rows = -(-len(ids) // BLOCK)
        full = np.full(rows * BLOCK, ids[-1], np.uint32)  # the last block is filled with its last id
        full[: len(ids)] = ids
        blocks = full.reshape(rows, BLOCK)
        base = blocks.min(axis=1)
        over = blocks - base[:, None]
        bits = np.frexp(over.astype(np.float64))[1]  # bits that a value takes
        kth = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
        width = np.partition(bits, kth, axis=1)[:, kth].astype(np.uint8)
        outside = bits > width[:, None]
        row, place = np.nonzero(outside)
        value = over[outside]
        over[outside] = 0
        starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
        packed = np.empty(starts[-1], np.uint8)
        for w, at in _by_width(width):
            packed[starts[at][:, None] + np.arange(w * BLOCK // 8)] = _to_bits(over[at], w)
        return base, width, place.astype(np.uint16), value, np.bincount(row, minlength=rows), packed

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids from ``begin`` to before ``end``; only their blocks are unpacked."""
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = begin // BLOCK, -(-end // BLOCK)
        parts = [self._unpack(a, min(a + STEP, last)) for a in range(first, last, STEP)]
        return np.concatenate(parts)[begin - first * BLOCK : end - first * BLOCK]

    def _unpack(self, a: int, b: int) -> np.ndarray:
        over = np.zeros((b - a, BLOCK), np.uint32)
        for w, at in _by_width(self.width[a:b]):
            raw = self.packed[self.starts[a:b][at][:, None] + np.arange(w * BLOCK // 8)]
            over[at] = _from_bits(raw, w, BLOCK)
        c, d = self.first[a], self.first[b]
        row = np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1]))
        over[row, self.place[c:d]] = self.value[c:d]
        return (over + self.base[a:b, None]).ravel()


class Packer:
    """Takes ids as they come and holds them as packed blocks."""

    def __init__(self, percentile: float = PERCENTILE):
        self.percentile, self.n = percentile, 0
        self.rest = np.empty(0, np.uint32)
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // BLOCK * BLOCK
        self._pack(ids[:full])
        self.rest = ids[full:].copy()

    def _pack(self, ids: np.ndarray) -> None:
        for a in range(0, len(ids), STEP * BLOCK):
            self.parts.append(Blocks._pack_some(ids[a : a + STEP * BLOCK], self.percentile))

    def blocks(self) -> Blocks:
        """All blocks, the last one of them perhaps in part; nothing can be added after it."""
        self._pack(self.rest)
        kinds = (np.uint32, np.uint8, np.uint16, np.uint32, np.int64, np.uint8)
        columns = zip(*self.parts, strict=True) if self.parts else [()] * len(kinds)
        base, width, place, value, held, packed = (
            np.concatenate([*column, np.empty(0, kind)]).astype(kind) for column, kind in zip(columns, kinds, strict=True)
        )
        return Blocks(self.n, base, width, place, value, np.concatenate([[0], np.cumsum(held)]).astype(np.int64), packed)


# --- segments -------------------------------------------------------------------------------


def segment_bytes(shard: int, number: int, doc_ids: list, starts: np.ndarray, blocks: Blocks) -> bytes:
    """A segment of documents whose ids begin at ``starts`` (one more than documents)."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    header = struct.pack(HEADER, MAGIC, shard, number, len(doc_ids), blocks.n, len(blocks.base), len(blocks.value), len(blocks.packed))
    arrays = [
        named, null, starts.astype("<i8"), blocks.base.astype("<u4"), blocks.width, blocks.starts.astype("<i8"),
        blocks.first.astype("<i8"), blocks.place.astype("<u2"), blocks.value.astype("<u4"), blocks.packed,
    ]
    sections = [header, *(memoryview(np.ascontiguousarray(a)).cast("B") if a.size else b"" for a in arrays)]
    check = 0
    for piece in sections:
        check = crc32(piece, check)
    return b"".join([*sections, struct.pack("<I", check)])


class Segment:
    """A segment read back."""

    def __init__(self, raw: bytes):
        magic, self.shard, self.number, n_docs, self.n_ids, n_blocks, n_out, n_packed = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = struct.calcsize(HEADER)

        def array(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, count, at)
            at += found.nbytes
            return found

        named, null = array("<i8", n_docs), array("u1", n_docs)
        self.doc_ids = pa.array(named, mask=null.astype(bool))
        self.starts = array("<i8", n_docs + 1)
        base, width, _ = array("<u4", n_blocks), array("u1", n_blocks), array("<i8", n_blocks + 1)
        first, place, value = array("<i8", n_blocks + 1), array("<u2", n_out), array("<u4", n_out)
        packed = array("u1", n_packed)
        if struct.unpack_from("<I", raw, at)[0] != crc32(memoryview(raw)[:at]):
            raise ValueError(f"segment {self.number} of shard {self.shard} is damaged")
        self.blocks = Blocks(self.n_ids, base, width, place, value, first, packed)

    def ids(self, document: int) -> np.ndarray:
        return self.blocks.read(int(self.starts[document]), int(self.starts[document + 1]))


# --- words ----------------------------------------------------------------------------------

_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _LINE = range(1, 7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("'")], _CLASS[0x20], _CLASS[0x0A] = _QUOTE, _SPACE, _LINE


def _parted(left: int, right: int) -> bool:
    if not _LETTER <= left <= _QUOTE:
        return False
    if right in (_SPACE, _LINE):
        return True
    return _LETTER <= right <= _QUOTE and left != right and left != _QUOTE and (left, right) != (_MARK, _QUOTE)


#: Whether two neighbours are parted, by 8 * kind + kind.
_PARTED = np.array([_parted(k >> 3, k & 7) for k in range(64)])


def safe_cuts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Places where the tokenizer never joins what lies on both sides, text starts among them.

    Its pieces are runs of letters, of digits or of other marks, with one space
    before them, contractions such as ``'s``, and runs of white space whose last
    character may go to the next piece. So a visible character and white space, or
    visible characters of two kinds, are parted, unless a quote comes first, and so
    are a single line break and what follows it. Elsewhere, as beside most
    characters outside ASCII, nothing is cut; that only makes longer pieces.
    """
    kind = _CLASS[data]
    high = np.flatnonzero(data >= 0xC3)
    lead, at = data[high], high[(data[high] == 0xC3) & (high + 1 < len(data))]
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kind[at] = kind[at + 1] = _LETTER  # U+00C0 to U+00FF
    cut = np.zeros(len(data), bool)
    cut[1:] = _PARTED[(kind[:-1] << 3) | kind[1:]]
    lines = np.flatnonzero(kind[1:-1] == _LINE) + 1
    seen = (kind[lines - 1] - 1 < _QUOTE) & (kind[lines + 1] - 1 < _QUOTE)  # kinds from 1 on: 0 wraps round
    cut[lines[seen] + 1] = True
    # Characters of two or three bytes that are no white space, before a space.
    for length, last in ((2, 0xDF), (3, 0xEF)):
        after = high[(lead <= last) & ((lead >= 0xE4) | (length == 2))] + length
        after = after[after < len(data)]
        cut[after[kind[after] == _SPACE]] = True
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


#: Pieces that are one word to the tokenizer: a space at most, then characters of one kind.
_ONE_WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[^\x97\xb7])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: How a byte-level model writes bytes: those that cannot be seen come after the others.
_SEEN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_WRITTEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}
_SPACE_MARK = chr(_WRITTEN[0x20])
#: The module that holds a worker's encoder.
_WORKER = "_token_files_worker"


class Encoder:
    """The library's ids of whole texts, with a piece between safe cuts encoded once."""

    #: Pieces that are remembered; then memory starts afresh.
    HELD = 400_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        import tokenizers

        self.path = path
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.library.model
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """The one of this Python worker, which goes from task to task.

        Functions and classes reach a worker anew with every task, so it hangs on a
        module of its own.
        """
        held = sys.modules.setdefault(_WORKER, ModuleType(_WORKER)).__dict__
        if held.get("path") != path:
            held.update(path=path, encoder=cls(path))
        return held["encoder"]

    def _learn(self, words: list[bytes]) -> None:
        """Remembers the ids of pieces as packed 32-bit numbers.

        A piece of one word goes to the library's model at once, others through
        the whole tokenizer.
        """
        whole, tokenize = [], self.model.tokenize
        for word in words:
            spaced = word[:1] == b" "
            if (word[1:] if spaced else word).isalpha():  # letters of ASCII are written as they are
                found = tokenize(_SPACE_MARK + word[1:].decode() if spaced else word.decode())
            elif _ONE_WORD.fullmatch(word):
                found = tokenize(word.decode("latin-1").translate(_WRITTEN))
            else:
                whole.append(word)
                continue
            self.known[word] = array("I", [t.id for t in found]).tobytes()
        encoded = self.library.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)
        for word, found in zip(whole, encoded, strict=True):
            self.known[word] = array("I", found.ids).tobytes()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and how many each has."""
        offsets, data = bytes_of(texts)
        starts = safe_cuts(offsets, data)
        # The pieces lie one behind the other, from the first byte to the last.
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64) if len(starts) else np.zeros(1, np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        words, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > self.HELD:
            self.known.clear()
        lists = list(map(self.known.get, words))
        new = [k for k, held in enumerate(lists) if held is None]
        self._learn([words[k] for k in new])
        for k in new:
            lists[k] = self.known[words[k]]
        # The end id is one more piece, which follows the last one of every text.
        ends = np.searchsorted(starts, offsets)
        number = np.insert(number, ends[1:], len(lists))
        lists.append(array("I", [end_id]).tobytes())
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) >> 2
        flat = np.frombuffer(b"".join(lists), np.uint32)
        begins, n = (np.cumsum(sizes) - sizes)[number], sizes[number]
        upto = np.cumsum(n)
        step = np.ones(int(upto[-1]) if len(upto) else 0, np.int64)
        if len(step):  # from one id to the next: by one inside a piece, to the begin of the next after it
            step[0] = begins[0]
            full = n > 0
            piece = np.flatnonzero(full)
            step[upto[piece[:-1]]] = begins[piece[1:]] - (begins[piece[:-1]] + n[piece[:-1]]) + 1
        ids = flat[np.cumsum(step)]
        passed = np.concatenate([[0], upto])[ends + np.arange(len(ends))]
        return ids, np.diff(passed)


# --- jobs -----------------------------------------------------------------------------------


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int, limit: int, percentile: float) -> Iterator[pa.RecordBatch]:
    encoder, shard, number, held = Encoder.of_worker(path), TaskContext.get().partitionId(), 0, 0
    doc_ids: list = []
    sizes: list[np.ndarray] = []
    packer = Packer(percentile)

    def closed() -> pa.RecordBatch:
        nonlocal number, held, packer
        starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        raw = segment_bytes(shard, number, doc_ids, starts, packer.blocks())
        number, held, packer = number + 1, 0, Packer(percentile)
        doc_ids.clear()
        sizes.clear()
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["value"])

    for batch in batches:
        at = 0
        for texts in pieces(batch.column(1), PIECE):
            names = batch.column(0).slice(at, len(texts)).to_pylist()
            at += len(texts)
            ids, counts = encoder.encode(texts, end_id)
            ends = np.cumsum(counts)
            a = 0
            while a < len(names):  # up to the document that fills the segment
                passed = int(ends[a - 1]) if a else 0
                b = min(len(names), int(np.searchsorted(ends, passed + limit - held, "left")) + 1)
                doc_ids += names[a:b]
                packer.add(ids[passed : ends[b - 1]])
                sizes.append(counts[a:b])
                held += int(ends[b - 1]) - passed
                if held >= limit:
                    yield closed()
                a = b
    if doc_ids:
        yield closed()


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, percentile: float = PERCENTILE
) -> None:
    """Writes ``folder/data``, files of ids in ascending order of doc_id, and ``folder/manifest``.

    ``tokenizer`` is the path of a tokenizer file that every machine holds. Texts are
    shuffled once. Rows of one id are told apart by a hash of the text and a row
    number, so that no range of ids is bound to one task.
    """
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    told = rows.select("*", F.xxhash64("text").alias("told"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "told", "row"]
    ranged = told.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    pack = partial(_segments, path=tokenizer, end_id=end_id, limit=segment_ids, percentile=percentile)
    files = ranged.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    with _batches_of(docs.sparkSession, 500):
        files.write.option("maxRecordsPerFile", 1).text(f"{folder}/data")
    _headers(docs.sparkSession, folder).write.parquet(f"{folder}/manifest")


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of that many texts or files go to a worker at a time, so that a batch stays small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/data").where(F.col("length") > 0)


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per segment: shard, segment, n_docs, n_ids and before, the ids of all segments before it.

    Sums run over the segments of a shard and over the shards, never over all segments.
    """
    field = lambda k: F.conv(F.hex(F.substring("content", 9 + 8 * k, 8)), 16, 10).cast("long")
    names = ("shard", "segment", "n_docs", "n_ids")
    heads = _files(spark, folder).select(*[field(k).alias(n) for k, n in enumerate(names)], "path")
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("all"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("all").over(earlier(Window.orderBy("shard"))), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("shard").orderBy("segment"))), F.lit(0))
    return heads.select("*", inside.alias("inside")).join(shards, "shard").select(*names, "path", (F.col("ahead") + F.col("inside")).alias("before"))


def _spans_of(segment: Segment, ids: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about so many ids: first, last, their ids, and where each begins in these."""
    a, n = 0, len(segment.starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(segment.starts, segment.starts[a] + ids, "right")) - 1)
        found = segment.blocks.read(int(segment.starts[a]), int(segment.starts[b])).astype("<u4")
        yield a, b, found, segment.starts[a : b + 1] - segment.starts[a]
        a = b


def _documents(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            segment = Segment(content.as_py())
            for a, b, ids, ends in _spans_of(segment):
                raw = pa.py_buffer(ids)
                if digest:
                    view = memoryview(raw)
                    bounds = (ends * 4).tolist()
                    last = pa.array([crc32(view[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)], pa.int64())
                else:
                    last = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((ends * 4).astype(np.int64)), raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(b - a, segment.shard)), pa.array(np.full(b - a, segment.number)),
                        segment.doc_ids.slice(a, b - a), pa.array(segment.starts[a:b]), pa.array(np.diff(ends)), last,
                    ],
                    names=["shard", "segment", "doc_id", "before", "n_tokens", "ids"],
                )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens and ids.

    ``ids`` are little-endian unsigned 32-bit integers, the end id among them.
    """
    return _placed(spark, folder, digest=False)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ``ids_crc32`` instead of the ids, which then need not leave the tasks that read them."""
    return _placed(spark, folder, digest=True).withColumnRenamed("ids", "ids_crc32")


def _placed(spark: SparkSession, folder: str, digest: bool) -> DataFrame:
    manifest = spark.read.parquet(f"{folder}/manifest").select("shard", "segment", F.col("before").alias("ahead"))
    form = DOCUMENTS + (" long" if digest else " binary")
    found = _files(spark, folder).select("content").mapInArrow(partial(_documents, digest=digest), form)
    start = (F.col("ahead") + F.col("before")).alias("start")
    return found.join(manifest, ["shard", "segment"]).select("doc_id", start, "n_tokens", "ids")


def file_report(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes the files and gives, read back, where each document lies and a CRC of its ids."""
    write(docs, folder, tokenizer)
    with _batches_of(docs.sparkSession, 1):
        return stage(digests(docs.sparkSession, folder), "token-digests")
