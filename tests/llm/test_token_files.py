import uuid
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from shelfledger.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tokens")
    return lambda: str(root / uuid.uuid4().hex)


def by_hand(rows):
    """(doc_id, start, n_tokens, crc) of (doc_id, text) in order of ids, where ids are distinct."""
    library = tokenizers.Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    out, start = [], 0
    for doc_id, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment_ids", [1, 50_000, token_files.SEGMENT_IDS])
def test_whole_table(spark, folder, segment_ids):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    at = folder()
    token_files.write(docs, at, PATH, segment_ids=segment_ids)
    got = [(r.doc_id, r.start, r.n_tokens, crc32(r.ids)) for r in token_files.read(spark, at).collect()]
    assert sorted(got) == by_hand([(r.doc_id, r.text) for r in docs.collect()])
    segments = spark.read.parquet(f"{at}/manifest").count()
    assert segments == (len(got) if segment_ids == 1 else segments) and segments >= 1
    # Plain reading of the files, in order of names, gives the ids in order.
    raw = b"".join(r.content for r in spark.read.format("binaryFile").load(f"{at}/data").orderBy("path").collect() if len(r.content))
    assert raw.count(token_files.MAGIC) == segments


def test_odd_rows(spark, folder, odd_docs):
    got = token_files.file_report(odd_docs, folder(), PATH).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert len(got) == len(rows)
    library = tokenizers.Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    wanted = sorted(repr((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1)) for i, t in rows)
    assert sorted(repr((r.doc_id, r.n_tokens)) for r in got) == wanted
    # Starts are gapless and follow the ids, nulls first.
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert next(r.n_tokens for r in got if r.doc_id == 1) == 1


def test_empty_table(spark, folder, no_docs):
    assert token_files.file_report(no_docs, folder(), PATH).collect() == []


def test_clashing_columns(spark, folder, odd_docs):
    clash = odd_docs.withColumns({c: odd_docs.n_words for c in ("told", "ids", "shard", "before", "value")})
    rows = lambda d: sorted(map(repr, token_files.file_report(d, folder(), PATH).collect()))
    assert rows(clash) == rows(odd_docs)


def test_blocks_round_trip_and_ranges():
    rng = np.random.default_rng(5)
    for n in (0, 1, 255, 256, 257, 5000, token_files.STEP * token_files.BLOCK + 3):
        for kind in ("same", "small", "outliers", "wide"):
            ids = {
                "same": np.full(n, 77),
                "small": rng.integers(0, 50_257, n),
                "outliers": np.where(rng.random(n) < 0.03, (1 << 32) - 1, rng.integers(100, 140, n)),
                "wide": rng.integers(0, 1 << 32, n),
            }[kind].astype(np.uint32)
            for percentile in (0.0, 0.9, 1.0):
                blocks = token_files.Blocks.pack(ids, percentile)
                assert np.array_equal(blocks.read(0, n), ids)
                if kind == "outliers" and percentile == 0.9 and n > 256:
                    assert blocks.width.max() <= 6 and 0 < len(blocks.value) < 0.1 * n + token_files.BLOCK
                if percentile == 1.0:
                    assert not len(blocks.value)
            for a, b in [(0, 0), (n // 3, n // 2), (n - 1, n), (250, 260)]:
                if 0 <= a <= b <= n:
                    assert np.array_equal(blocks.read(a, b), ids[a:b])


def test_ids_that_come_in_parts():
    """Packed as if they came at once."""
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 50_257, 3000).astype(np.uint32)
    for sizes in ([0, 1, 255, 256, 257, 2231], [3000], [0]):
        packer = token_files.Packer()
        at = 0
        for size in sizes:
            packer.add(ids[at : at + size])
            at += size
        found, whole = packer.blocks(), token_files.Blocks.pack(ids[:at])
        for name in ("base", "width", "place", "value", "first", "packed", "starts"):
            assert np.array_equal(getattr(found, name), getattr(whole, name))
        assert np.array_equal(found.read(0, at), ids[:at])


def test_documents_by_place_and_damage():
    ids = np.arange(1000, dtype=np.uint32)
    raw = token_files.segment_bytes(3, 4, [9, None, 11], np.array([0, 10, 10, 1000]), token_files.Blocks.pack(ids))
    segment = token_files.Segment(raw + b"\n")
    assert (segment.shard, segment.number, segment.doc_ids.to_pylist()) == (3, 4, [9, None, 11])
    assert segment.ids(0).tolist() == list(range(10)) and len(segment.ids(1)) == 0 and segment.ids(2)[0] == 10
    for at in (70, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.Segment(bytes(bad))
    with pytest.raises(ValueError):
        token_files.Segment(b"x" * 100)


def test_safe_cuts_change_no_id(monkeypatch):
    """Pieces put together are what the library gives for whole texts."""
    library = tokenizers.Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    rng = np.random.default_rng(8)
    parts = [
        "it", "'s", "'", "'t", "''", "the", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\x85", "12", "3.5", "½",
        "é", "ß", "×", "÷", "ñandú", "漢字", "🙂", "e\u0301", "-", "...", "(", "\"", "<|endoftext|>", "_", "\x00", "\x1c", "я", "א", "'ll", "'LL", "a'b",
    ]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(3000)] + [" ", "", "'", "\n"]
    texts += [a + b + c for a in parts for b in parts for c in ("x", " ", "'s", "\n", "é")]
    wanted = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    monkeypatch.setattr(token_files.Encoder, "HELD", 500)
    encoder = token_files.Encoder(PATH)
    for a in range(0, len(texts), 700):
        ids, sizes = encoder.encode(pa.array(texts[a : a + 700]), 0)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == wanted[a : a + 700]
    ids, sizes = encoder.encode(pa.array([None, "a", None], pa.string()), 7)
    assert sizes.tolist() == [1, 2, 1] and ids.tolist() == [7, library.encode("a").ids[0], 7, 7]
