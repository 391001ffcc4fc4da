import hashlib
from pathlib import Path

import pyarrow as pa
import pytest
from compare import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfledger.llm import chat_format
from shelfledger.llm.entries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
odd_text = st.one_of(st.none(), st.text(alphabet="\\<turn>/n\né🙂", max_size=20))


@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "a\\<\nb"])), odd_text), max_size=8))
@settings(max_examples=200, deadline=None)
def test_assembled_turns_read_back(turns):
    roles, texts = pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())
    ends, out, start, stop = chat_format.assemble(roles, texts)
    for i, (role, text) in enumerate(turns):
        m = chat_format.TURN.fullmatch(out[ends[i] : ends[i + 1]].tobytes().decode())
        assert (chat_format._plain_role(m[1]), chat_format._plain(m[2])) == (role or "", text or "")
        assert chat_format._plain(out[start[i] : stop[i]].tobytes().decode()) == (text or "")


ROWS = [
    (1, 1, "assistant", "b"), (1, 0, "user", "a</turn>\n"), (1, 2, None, None), (2, None, "assistant", "\\<"), (2, 0, "assistant", "é🙂"),
    (None, 0, "user", "x"), (None, 0, "user", "x"), (3, 0, "user", "y" * 50_000), (3, 1, "assistant", "z" * 50_000), (1, 1, "assistant", "b"),
]


def wanted(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[1:])
    out = []
    for key, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        learned = "".join(t or "" for _, r, t in turns if r == "assistant")
        out.append((key, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_conversations_in_parts(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'x' AS formatted")
        parts = chat_format.format_conversations(turns)
        found = [tuple(r)[:5] for r in chat_format.read_conversations(parts).collect()]
        assert sorted(map(str, found)) == sorted(map(str, wanted(ROWS)))
        assert chat_format.read_conversations(chat_format.format_conversations(turns.where("turn = 99"))).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_against_sql(spark, name):
    extra, missing, rows = compare(spark, connect(SF), QUERIES[name], ORACLE[name], SF)
    assert not extra and not missing and rows


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.stage(apply(spark, docs, SF), "t")
        assert docs.columns == columns and 0 < docs.count() and (name == "mixing" or docs.count() <= before)
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert encoded.count() == docs.count()
    assert sorted(map(str, QUERIES["pipeline"](spark, SF).collect())) == sorted(map(str, encoded.collect()))


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows, further columns and empty tables pass through every stage."""
    import corpus_pipeline

    model = corpus_pipeline.quality_rules.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    for docs in (odd_docs, no_docs):
        rows = docs.count()
        good = corpus_pipeline.stage(corpus_pipeline.quality_rules.keep_good(docs, model), "t")
        assert good.columns == docs.columns and good.count() <= rows
        kept = docs
        for name in ("exact dedup", "near dedup", "mixing"):
            kept = corpus_pipeline.stage(stages[name](spark, kept, SF), "t")
            assert kept.columns == docs.columns, name
            texts = [r.text or "" for r in kept.select("text").collect()]
            if name != "mixing":
                assert len(texts) == len(set(texts)) and len(texts) <= rows
        encoded = stages["byte bpe"](spark, kept, SF).collect()
        assert len(encoded) == kept.count() and (rows > 0) == (len(encoded) > 0)


def test_names():
    assert [n.split("_")[0] for n in QUERIES][:13] == [f"op{i}" for i in range(1, 14)]
    assert Path("/root/testdata").exists()
