import hashlib
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shelfledger.llm import fill_in_middle as fim


def by_hand(doc_id, text):
    """The contract's sample of one text, by Python strings."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return len(text), form, len(p), len(m), out


def test_equals_brute_force_on_odd_rows(spark, odd_docs):
    more = spark.createDataFrame(
        [(100, "a <P> b"), (101, "<S>"), (102, "tail <M>"), (103, "almost <P <S> no"), (104, "<" * 50), (105, "P>" * 50)]
        + [(i, "é🙂 word\nline\r\n\tx " * (i % 7)) for i in range(200, 400)],
        "doc_id long, text string",
    )
    docs = odd_docs.select("doc_id", "text").union(more)
    got = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(repr, [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got])) == sorted(
        map(repr, [(i, *by_hand(i, t)) for i, t in texts])
    )
    assert sorted(repr((r.doc_id, r.back)) for r in got) == sorted(repr((i, t or "")) for i, t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in fim.sample_report(docs).collect()}
    for r in docs.collect():
        n, form, p, m, out = by_hand(r.doc_id, r.text)
        g = got.pop(r.doc_id)
        assert (g.n, g.form, g.prefix_chars, g.middle_chars) == (n, form, p, m)
        assert g.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert g.restored_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert not got


def test_empty_table_and_clashing_columns(no_docs, odd_docs):
    assert fim.transform(no_docs).collect() == []
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("n", "form", "output", "draw0", "prefix_chars")})
    assert fim.transform(clash).collect() == fim.transform(odd_docs).collect()


@pytest.mark.parametrize("unit", ["point", "word", "line"])
def test_units_by_wavelet_ranks(unit):
    texts = ["", "one two\n\nthree", "  lead\nx", "é é\n", "no break", "\n\n", "🙂" * 70 + " a" * 40]
    # The begin of every unit, in code points.
    begins = {
        "point": lambda t: list(range(len(t))),
        "word": lambda t: [i for i, c in enumerate(t) if not c.isspace() and (i == 0 or t[i - 1].isspace())],
        "line": lambda t: [i for i, c in enumerate(t) if i == 0 or t[i - 1] == "\n"],
    }[unit]
    for draw in range(0, 300, 7):
        first = np.full(len(texts), draw)
        got = fim.cut(pa.array(texts), first, first // 2, unit)
        for i, text in enumerate(texts):
            at = begins(text)
            assert got["n"][i] == len(at)
            for name, k in zip(("prefix", "middle"), sorted((draw % (len(at) + 1), draw // 2 % (len(at) + 1))), strict=True):
                points = 0 if k == 0 else at[k] if k < len(at) else len(text)
                assert got[f"{name}_points"][i] == points
                assert got[name][i] == len(text[:points].encode())


def test_ranks_against_counting():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n, dtype=np.uint8)
        matrix = fim.WaveletMatrix(symbols, 3)
        at = np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]
        places = np.flatnonzero(np.isin(symbols, (1, 6)))
        number = np.arange(len(places))
        low, high = np.zeros(len(places), np.int64), np.full(len(places), n)
        assert matrix.find((1, 6), number, low, high).tolist() == places.tolist()


def test_marks_must_stay_apart(odd_docs):
    for marks in [("<P>", "<P>", "<M>"), ("ab", "ba", "c"), ("aa", "b", "c"), ("x", "yxz", "w"), ("", "a", "b")]:
        with pytest.raises(ValueError):
            fim.transform(odd_docs, marks=marks)


def test_shares_follow_parameters(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('word ', 20) AS text")
    forms = {r.form: r["count"] for r in fim.transform(docs, "word", fim_percent=50, spm_percent=50).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 2000) < 200 and abs(forms["psm"] - 1000) < 150 and abs(forms["spm"] - 1000) < 150


def test_bytes_that_are_not_utf8_stay(spark):
    raw = [b"ab\xff\xfecd efg" * 3, b"\xe6\xbc", b"\x80\x80 abc", b"plain text", b"a\xed\xa0\x80b", b"\xf0\x9f\x99" * 4, b"caf\xe9 cr\xe8me"]
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, raw binary").selectExpr("doc_id", "CAST(raw AS string) AS text")
    got = {r.doc_id: r for r in fim.sample_report(docs).collect()}
    assert {r.form for r in got.values()} > {"plain"}
    for i, text in enumerate(raw):
        assert got[i].restored_sha256 == hashlib.sha256(text).hexdigest()
        assert got[i].n == sum(b & 0xC0 != 0x80 for b in text)


SMALL_HEAP = """
import sys
from shelfledger.llm import fill_in_middle
from shelfledger.session import build_session, ship_package
ship_package()
folder = sys.argv[1]
spark = build_session("small heap", "local[2]", spark__driver__memory="512m", spark__checkpoint__dir=folder + "/shared")
fill_in_middle.sample_report(spark.read.parquet(folder + "/docs.parquet")).write.parquet(folder + "/out")
"""


def test_long_texts_of_a_row_group_in_a_small_heap(spark, tmp_path):
    texts = [f"{i} " + "é🙂 word\nline\t" * 5000 for i in range(3000)]  # 100 KB each
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "docs.parquet", use_dictionary=False)
    run = subprocess.run(
        [sys.executable, "-c", SMALL_HEAP, str(tmp_path)], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=600
    )
    assert run.returncode == 0, run.stderr[-3000:]
    got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, form, p, m, out = by_hand(i, text)
        g = got[i]
        assert (g.n, g.form, g.prefix_chars, g.middle_chars) == (n, form, p, m)
        assert g.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert g.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_batches_are_small_only_while_the_report_is_made(spark, odd_docs, monkeypatch):
    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"]
    before, during, staged = [spark.conf.get(k) for k in names], [], fim.stage

    def seen(*args):
        during.extend(int(spark.conf.get(k)) for k in names)
        return staged(*args)

    monkeypatch.setattr(fim, "stage", seen)
    fim.sample_report(odd_docs)
    assert during[0] <= 4 << 20 and during[1] <= 16
    assert [spark.conf.get(k) for k in names] == before


def test_a_long_text_is_cut_within_four_times_its_bytes():
    text = "é🙂 word\nline\t" * 1_000_000
    texts, draw = pa.array([text]), np.array([1 << 20])
    size = len(text.encode())
    tracemalloc.start()
    got = fim.cut(texts, draw, draw * 9, "point")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * size
    assert [got[k][0] for k in ("n", "prefix_points", "middle_points")] == [len(text), 1 << 20, 9 << 20]
    assert got["prefix"][0] == len(text[: 1 << 20].encode())


@pytest.mark.parametrize("unit", ["point", "word", "line"])
def test_blocks_do_not_change_cuts(unit, monkeypatch):
    rng = np.random.default_rng(5)
    texts = pa.array(["".join(rng.choice(list("ab \n\té🙂"), k)) for k in rng.integers(0, 300, 60)])
    draws = rng.integers(0, 1 << 32, (2, len(texts)))
    whole = fim.cut(texts, *draws, unit)
    monkeypatch.setattr(fim, "BLOCK", 64)
    parted = fim.cut(texts, *draws, unit)
    assert {k: v.tolist() for k, v in parted.items()} == {k: v.tolist() for k, v in whole.items()}


@pytest.mark.parametrize("marks", [fim.MARKS, ("<|fim_prefix|>", "[é]", "#")])
def test_report_digests_the_outputs(spark, odd_docs, marks):
    more = spark.createDataFrame([(i, "é🙂 <word\nP> line\r\n\tx " * (i % 7)) for i in range(100, 200)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    samples = fim.transform(docs, marks=marks)
    back = fim.restored(F.col("output"), F.col("form"), marks)
    digests = samples.withColumn("restored_sha256", F.sha2(back, 256)).withColumn("output_sha256", F.sha2("output", 256))
    got = fim.sample_report(docs, marks)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, digests.select(*got.columns).collect()))
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
