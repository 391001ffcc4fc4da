import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfledger.llm import byte_bpe
from shelfledger.llm.entries import PATTERN, RANKS, op1_byte_bpe

SF = "/root/testdata/sf0.001"
RANK = byte_bpe.read_ranks(RANKS)
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANK, special_tokens={})


@given(st.text(min_size=1, max_size=40))
@settings(max_examples=300, deadline=None)
def test_merge_is_the_library_s(word):
    whole = [t for piece in byte_bpe.regex.findall(PATTERN, word) for t in byte_bpe.merge(piece.encode(), RANK)]
    assert whole == OWN.encode_ordinary(word)


def test_pattern_cuts_every_character_like_the_library():
    """Blanks, letters and digits are the same classes in both regex engines."""
    for begin in range(0, 0x110000, 0x400):
        text = "".join(f"a{chr(c)}1{chr(c)}{chr(c)} " for c in range(begin, begin + 0x400) if not 0xD800 <= c < 0xE000)
        mine = [t for piece in byte_bpe.regex.findall(PATTERN, text) for t in byte_bpe.merge(piece.encode(), RANK)]
        if mine != OWN.encode_ordinary(text):
            bad = [hex(c) for c in range(begin, begin + 0x400) if not 0xD800 <= c < 0xE000 and differs(chr(c))]
            pytest.fail(f"cut differently around {bad[:20]}")


def differs(c):
    text = f"a{c}1{c}{c} "
    return [t for p in byte_bpe.regex.findall(PATTERN, text) for t in byte_bpe.merge(p.encode(), RANK)] != OWN.encode_ordinary(text)


def expected(text):
    ids = OWN.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def test_round_trip_of_odd_rows(spark, odd_docs):
    found = byte_bpe.round_trip(odd_docs, RANKS, PATTERN).collect()
    wanted = [(r.doc_id, *expected(r.text)) for r in odd_docs.collect()]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, wanted))


def test_small_blocks_give_the_same(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 3)
    found = {(r.doc_id, tuple(r.ids)) for r in byte_bpe.encode(odd_docs, RANKS, PATTERN).collect()}
    assert found == {(r.doc_id, tuple(OWN.encode_ordinary(r.text or ""))) for r in odd_docs.collect()}


def test_tasks_with_equal_content(spark, odd_docs):
    """A table delivered twice, and equal rows that fill one partition each."""
    docs = odd_docs.select("doc_id", "text")
    found = sorted(str((r.doc_id, r.ids)) for r in byte_bpe.encode(docs.union(docs), RANKS, PATTERN).collect())
    assert found == sorted(2 * [str((r.doc_id, OWN.encode_ordinary(r.text or ""))) for r in docs.collect()])
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(1, "a b")] * 3, 3), "doc_id long, text string")
    assert [tuple(r.ids) for r in byte_bpe.encode(rows, RANKS, PATTERN).collect()] == [tuple(OWN.encode_ordinary("a b"))] * 3


def test_null_ids_of_equal_shape(spark):
    texts = ["a b", "c d", "e f", "a b"]
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(None, t) for t in texts], 4), "doc_id long, text string")
    found = sorted(tuple(r.ids) for r in byte_bpe.encode(rows, RANKS, PATTERN).collect())
    assert found == sorted(tuple(OWN.encode_ordinary(t)) for t in texts)


def test_empty_table(spark, no_docs):
    assert byte_bpe.round_trip(no_docs, RANKS, PATTERN).count() == 0


def test_decode_gives_the_bytes_back(spark, odd_docs):
    encoded = byte_bpe.encode(odd_docs, RANKS, PATTERN)
    found = sorted(bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS).collect())
    assert found == sorted((r.text or "").encode() for r in odd_docs.collect())


def test_query_on_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: tuple(r)[1:] for r in op1_byte_bpe(spark, SF).collect()}
    assert found == {i: expected(t) for i, t in docs.items()}
