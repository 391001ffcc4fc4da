"""Byte-level BPE with every distinct word encoded once.

Texts are cut into pre-tokens in blocks of whole documents. A block lists its
distinct words, dealt into buckets by a hash, and for every document the word at
each position. One exchange brings a bucket's words from all blocks together,
where each distinct one is encoded once, and takes the positions to where their
block is put together; a second one brings the ids back to the blocks. A
frequent word thus travels once per block and not once per occurrence, and lists
of words, ids and positions travel packed.

Decoding joins ids with the table of token bytes. That table has one row per
token of the vocabulary, about 50,000, so it goes to the tasks as two arrays.

A null text is empty and has no ids. Rows are encoded each on its own: repeated
ids and texts give repeated rows. Words of any length are merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import partial
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block is closed at so many distinct words or pre-tokens.
BLOCK_WORDS, BLOCK_TOKENS = 250_000, 4_000_000
#: Rows of the first exchange: the positions of a block, or its words in one bucket.
POSITIONS, WORDS = 0, 1
DEALT = "to long, kind int, block long, bucket int, payload binary, uses binary, doc_ids array<long>, sizes array<long>"
IDS = "to long, bucket int, payload binary"
ENCODED = "doc_id long, n_tokens long, ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank merges first, leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts here ends; -1: no part starts here
    before = list(range(-1, n))
    queue: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if end[i] < n:
            rank = ranks.get(word[i : end[end[i]]])
            if rank is not None:
                heapq.heappush(queue, (rank, i, end[end[i]]))

    for i in range(n):
        offer(i)
    while queue:
        _, i, stop = heapq.heappop(queue)
        if end[i] < 0 or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two parts has changed since
        middle = end[i]
        end[i], end[middle] = stop, -1
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers in few bytes: the bytes of one place together, then compressed."""
    places = numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(8, "little") + pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    places = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(places.T).view("<i4").ravel()


def _packed_words(words: list[bytes]) -> bytes:
    lengths = _packed(np.array([len(w) for w in words], np.int32))
    return len(lengths).to_bytes(8, "little") + lengths + pa.compress(b"".join(words), codec="zstd", asbytes=True)


def _unpacked_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    ends = np.cumsum(_unpacked(data[8 : 8 + n]), dtype=np.int64).tolist()
    joined = pa.decompress(data[8 + n :], ends[-1] if ends else 0, codec="zstd", asbytes=True)
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def _packed_lists(lists: list[list[int]]) -> bytes:
    lengths = _packed(np.array([len(x) for x in lists], np.int32))
    flat = np.fromiter(chain.from_iterable(lists), np.int32)
    return len(lengths).to_bytes(8, "little") + lengths + _packed(flat)


def _unpacked_lists(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    return _unpacked(data[8 : 8 + n]), _unpacked(data[8 + n :])


class _Block:
    """Documents that are packed together."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.doc_ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, found: list[str]) -> None:
        known = self.known
        self.codes.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
        self.doc_ids.append(doc_id)
        self.tokens += len(found)

    def full(self) -> bool:
        return self.tokens >= BLOCK_TOKENS or len(self.known) >= BLOCK_WORDS

    def rows(self, place: tuple, buckets: int) -> Iterator[tuple]:
        """The DEALT rows. Words are in the order of (bucket, word); a position holds
        the rank of its word by frequency, which packs well. ``place`` tells blocks of
        equal content apart and is the same when a task is run again."""
        words = [w.encode() for w in self.known]
        bucket = [crc32(w) % buckets for w in words]
        order = np.array(sorted(range(len(words)), key=lambda i: (bucket[i], words[i])), np.int64)
        codes = np.concatenate([*self.codes, np.empty(0, np.int32)])
        uses = np.bincount(codes, minlength=len(words))[order] if len(words) else np.empty(0, np.int64)
        rank = np.empty(len(words), np.int32)
        rank[order[np.argsort(-uses, kind="stable")]] = np.arange(len(words), dtype=np.int32)
        payload = _packed(rank[codes] if len(words) else codes)
        in_order = [words[i] for i in order]
        mark = hashlib.blake2b(repr((place, self.doc_ids[:1], self.doc_ids[-1:], self.tokens)).encode() + payload, digest_size=8)
        for word in in_order:
            mark.update(len(word).to_bytes(8, "little") + word)
        # Blocks take the numbers below 0 and buckets those from 0.
        block = int.from_bytes(mark.digest(), "little") % (1 << 63) - (1 << 63)
        yield block, POSITIONS, block, 0, payload, _packed(uses), self.doc_ids, [len(c) for c in self.codes]
        held = np.array(bucket, np.int64)[order] if words else np.empty(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(held)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                yield int(held[a]), WORDS, block, int(held[a]), _packed_words(in_order[a:b]), None, None, None


def _cut(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int) -> Iterator[pa.RecordBatch]:
    find = regex.compile(pattern).findall
    schema = pa.schema(
        [("to", pa.int64()), ("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()),
         ("uses", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
    )
    block, made, partition = _Block(), 0, TaskContext.get().partitionId()

    def closed() -> pa.RecordBatch:
        columns = zip(*block.rows((partition, made), buckets), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block.add(doc_id, find(text.as_py() or ""))
            if block.full():
                yield closed()
                block, made = _Block(), made + 1
    if block.doc_ids:
        yield closed()


def _encode_words(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Ids for the words of each bucket; rows come sorted by bucket, and an equal word is encoded once."""
    ranks = read_ranks(ranks_path)
    bucket, known = None, {}
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        rows = zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("kind", "block", "bucket", "payload")), strict=True)
        for kind, block, own, payload in rows:
            if kind.as_py() != WORDS:
                continue
            if own.as_py() != bucket:
                bucket, known = own.as_py(), {}
            lists = []
            for word in _unpacked_words(payload.as_py()):
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = merge(word, ranks)
                lists.append(ids)
            for column, value in zip(out, (block.as_py(), bucket, _packed_lists(lists)), strict=True):
                column.append(value)
        types = (pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["to", "bucket", "payload"])


def _assemble(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """Documents of one block from the ids of its words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    lists = [_unpacked_lists(p) for p in words.sort_by("bucket").column("payload").to_pylist()]
    lengths = np.concatenate([*(n for n, _ in lists), np.empty(0, np.int32)]).astype(np.int64)
    flat = np.concatenate([*(f for _, f in lists), np.empty(0, np.int32)])
    starts = np.cumsum(lengths) - lengths
    tables = []
    for payload, uses, doc_ids, sizes in zip(
        *(blocks.column(n).to_pylist() for n in ("payload", "uses", "doc_ids", "sizes")), strict=True
    ):
        by_rank = np.argsort(-_unpacked(uses), kind="stable")
        if len(by_rank) != len(lengths):
            raise ValueError("a block and its words do not belong together")
        at = by_rank[_unpacked(payload)]
        n = lengths[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], n)]
        offsets = ends[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        tables.append(pa.Table.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(np.diff(offsets)), listed], schema=schema))
    return pa.concat_tables(tables) if tables else schema.empty_table()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row of ``docs``; ``ranks_path`` is readable on every worker.

    Special tokens are ordinary text. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(partial(_cut, pattern=pattern, buckets=parts), DEALT).repartition(parts, "to")
    encode_words = partial(_encode_words, ranks_path=ranks_path)
    ids = dealt.sortWithinPartitions("to").mapInArrow(encode_words, IDS)
    # Spark computes the exchange once for both its readers if neither pushes a filter
    # below it, hence a condition that is not deterministic in form and implies nothing.
    blocks = dealt.where(F.expr(f"coalesce(kind, -1) + CAST(rand() AS INT) = {POSITIONS}"))
    return blocks.groupBy("to").cogroup(ids.groupBy("to")).applyInArrow(_assemble, ENCODED)


def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token table as offsets by id and joined bytes; ids without a token are empty."""
    ranks = read_ranks(ranks_path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), np.frombuffer(b"".join(tokens), np.uint8)


def joined(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> bytes:
    """The bytes of a sequence of ids."""
    lengths = offsets[ids + 1] - offsets[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) + np.repeat(offsets[ids] - (ends - lengths), lengths)].tobytes()


def _decode(batches: Iterator[pa.RecordBatch], ranks_path: str, digests: bool) -> Iterator[pa.RecordBatch]:
    table = token_bytes(ranks_path)
    for batch in batches:
        lists = batch.column("ids")
        offsets, flat = lists.offsets.to_numpy(), np.asarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
        spans = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        texts = [joined(s.astype(np.int64), *table) for s in spans]
        if digests:
            columns = [
                batch.column("doc_id"), batch.column("n_tokens"),
                pa.array([hashlib.sha256(s.tobytes()).hexdigest() for s in spans], pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of :func:`encode`'s result."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        partial(_decode, ranks_path=ranks_path, digests=False), "doc_id long, decoded binary"
    )


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids (little-endian, 32 bits) and of the bytes decoded from them."""
    return encode(docs, ranks_path, pattern).mapInArrow(
        partial(_decode, ranks_path=ranks_path, digests=True),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
