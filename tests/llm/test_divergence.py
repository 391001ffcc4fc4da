import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfledger.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def by_hand(rows, least=30, top=50):
    """The contract's rows for (lang, source, text)."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in docs:
        kept = [t for t in docs[lang] if docs[lang][t] >= least]
        groups = {s: c for (la, s), c in count.items() if la == lang}

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def rows_of(docs):
    return [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]


@pytest.mark.parametrize(("least", "top"), [(30, 50), (1, 3), (2, 50), (10_000, 5)])
def test_equals_brute_force(spark, least, top):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    got = sorted(map(tuple, divergence.divergences(docs, least, top).collect()))
    assert got == by_hand(rows_of(docs), least, top)


@pytest.mark.parametrize("least", [1, 2, 30])
def test_odd_rows(spark, odd_docs, least):
    more = spark.createDataFrame(
        [("x", "only", "Tie tie TIE"), ("x", "", "tie"), ("x", None, "é É z_z `a{b@c[d"), ("silent", "a", "1 2 3"), ("silent", "b", None), ("lone", "s", "")],
        "lang string, source string, text string",
    )
    docs = odd_docs.select("lang", "source", "text").union(more)
    assert sorted(map(tuple, divergence.divergences(docs, least).collect())) == by_hand(rows_of(docs), least)


def test_empty_table(no_docs):
    assert divergence.divergences(no_docs).collect() == []


def test_clashing_columns(odd_docs):
    names = ("n", "docs", "term", "at", "value", "rank", "item", "part", "v")
    clash = odd_docs.withColumns({c: odd_docs.n_words for c in names})
    assert sorted(divergence.divergences(clash, 1).collect()) == sorted(divergence.divergences(odd_docs, 1).collect())


def test_counts_given_out_early(monkeypatch, spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    import pyarrow as pa

    table = docs.select("lang", "source", "text").toArrow()
    monkeypatch.setattr(divergence, "HELD_COUNTS", 500)
    monkeypatch.setattr(divergence, "pieces", lambda c: (c.slice(i, 7) for i in range(0, len(c), 7)))
    parts = list(divergence._count(iter(table.combine_chunks().to_batches())))
    assert len(parts) > 1
    total = divergence.merged([pa.Table.from_batches(parts)])
    assert sum(total["n"].to_pylist()) == sum(len(TERM.findall(t or "")) for t in table["text"].to_pylist())


def test_shares_stay_exact():
    rng = np.random.default_rng(0)
    total = rng.integers(1, divergence.MOST, 1000)
    count = (total * rng.random(1000)).astype(np.int64)
    count[:10] = total[:10]
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]


def test_many_terms_in_steps():
    whole = divergence._Language(["a", "b", "c"], [10, 0, 7], 4)
    steps = divergence._Language(["a", "b", "c"], [10, 0, 7], 4)
    terms, number, source, n = ["t0", "t1", "t2", "t3"], np.array([0, 1, 2, 3, 3]), np.array([0, 0, 0, 0, 2]), np.array([1, 4, 2, 3, 7])
    whole.add(terms, number, source, n, 2)
    for k in range(4):
        at = number == k
        steps.add(terms[k : k + 1], number[at] - k, source[at], n[at], 2)
    assert sorted(whole.found("x")) == sorted(steps.found("x"))
