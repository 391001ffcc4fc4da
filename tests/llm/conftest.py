import pytest

SF = "/root/testdata/sf0.001"

#: Texts that operators of every kind must bear.
ODD_TEXTS = [
    None, "", " ", "\n\n \t\n", "a", "a\n a  a\r\n\x0b\x0c", "É ß ﬁ 漢字 🙂 e\u0301", "x" * 70_000, "ab " * 20_000,
    "7" * 5_000, "the quick brown fox " * 3, "The Quick BROWN fox\u00a0jumps\u2003over \x1c\x1d\x85 it's we'LL'll", "\x00\x01",
    "same text", "same text", "same text", "<|endoftext|> \\ <turn> </turn>\n",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with repeated rows, null ids and columns whose names an operator might use itself."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[0], rows[-1], rows[-1], (None, "same text", None, "s1"), (None, None, None, None)]
    rows = [(*r, 1, "k", {"a": 1}) for r in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_words int, `key` string, `row` map<string,int>"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")
