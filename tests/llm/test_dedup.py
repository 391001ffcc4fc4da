import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfledger.llm import exact_dedup, near_dedup
from shelfledger.llm.entries import op5_near_dedup

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_force(docs):
    """doc_id -> (n_shingles, smallest id reachable), over all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= 80 * (len(a) + len(b) - shared):
                    p, q = sorted((root(i), root(j)))
                    parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def brute_force_of_many(docs):
    """Smallest id reachable, from the overlaps of all pairs as one matrix product."""
    ids = sorted(docs)
    sets = [shingles(docs[i]) for i in ids]
    times = Counter(e for s in sets for e in s)
    column = {e: k for k, e in enumerate(e for e, n in times.items() if n > 1)}
    held = np.zeros((len(ids), len(column)), np.float32)
    for row, s in enumerate(sets):
        held[row, [column[e] for e in s if e in column]] = 1
    sizes = np.array([len(s) for s in sets])
    shared = (held @ held.T).astype(np.int64)
    near = 100 * shared >= 80 * (sizes[:, None] + sizes - shared)
    np.fill_diagonal(near, True)
    label = np.arange(len(ids))
    while True:
        low = np.array([label[row].min() for row in near])
        if (low == label).all():
            return {i: ids[k] for i, k in zip(ids, label, strict=True)}
        label = low


def test_exact_marks_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    wanted = []
    for r in rows:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        wanted.append((r.doc_id, keep, len(ids), r.doc_id == keep))
    found = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_copies(odd_docs).collect()]
    assert sorted(map(str, found)) == sorted(map(str, wanted))
    assert exact_dedup.mark_copies(no_docs).count() == exact_dedup.drop_copies(no_docs).count() == 0


def test_exact_keeps_one_row_per_text(spark, odd_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in odd_docs.collect()})


def test_exact_keeps_the_rest_of_the_row(spark):
    docs = spark.createDataFrame([(1, "t", "x"), (3, "t", "y"), (3, "t", "z"), (2, "u", None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, exact_dedup.drop_copies(docs).collect())) == [(2, "u", None), (3, "t", "z")]
    assert exact_dedup.drop_copies(docs.select("doc_id", "text")).count() == 2


@pytest.mark.parametrize("width", [4, 5])
def test_shingle_sets_have_the_right_sizes(width):
    rng = random.Random(width)
    texts = [" ".join(rng.choices("abcXYZ", k=rng.randint(0, 30))) for _ in range(200)] + [None, "", "\n"]
    values, offsets = near_dedup.shingle_sets(pa.array(texts), width)
    assert list(np.diff(offsets)) == [len(shingles(t, width)) for t in texts]
    for i, j in ((0, 1), (5, 9), (10, 10)):
        mine = len(np.intersect1d(values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]]))
        assert mine == len(shingles(texts[i], width) & shingles(texts[j], width))


def test_signature_is_unbiased():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
    values = np.concatenate([np.sort(a), np.sort(b)])
    _, sketch = near_dedup.signatures(values, np.array([0, 500, 920]))
    planes = (sketch[0] ^ sketch[1]).view(np.uint64).reshape(near_dedup.PLANES, -1)
    apart = sum(int(x).bit_count() for x in np.bitwise_or.reduce(planes, axis=0))
    assert abs(1 - 16 / 15 * apart / (near_dedup.BANDS * near_dedup.ROWS) - 400 / 520) < 0.12


def test_near_odd_rows(spark, odd_docs, no_docs):
    docs = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    wanted = brute_force(docs)
    found = near_dedup.cluster(odd_docs).collect()
    assert len(found) == odd_docs.count()
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == wanted[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.cluster(no_docs).count() == near_dedup.keep_one(no_docs).count() == 0
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns


def test_near_chain_and_star(spark):
    """A long chain of links whose ends differ, and a base with copies that differ from each other."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(1000 + i, " ".join(words[3 * i : 3 * i + 120])) for i in range(90)]
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(150)]
    for i in range(80):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(150)] = f"n{rng.randint(0, 10**6)}"
        rows.append((5000 - i, " ".join(copy)))
    wanted = brute_force(dict(rows))
    found = near_dedup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == wanted


def test_near_query_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_near_dedup(spark, SF).collect()}
    assert found == brute_force(docs)


def test_empty_texts_under_the_id_of_another(spark):
    """Such a row has no shingles; the id's other text finds its near copies all the same."""
    near = [(2 * i + k, " ".join(f"w{i}x{j}" for j in range(60)) + " end" * k) for i in range(15) for k in (0, 1)]
    empty = [(2 * i, t) for i in range(15) for t in ("", None, " ")]
    docs = spark.createDataFrame(empty + near, "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.component_id) for r in near_dedup.cluster(docs).collect() if r.n_shingles}
    assert found == {(2 * i + k, 2 * i) for i in range(15) for k in (0, 1)}


@pytest.mark.parametrize(("copies", "with_base"), [(1000, False), (2000, True), (4000, False)])
def test_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch, copies, with_base):
    """Near copies of one text, with similarities on both sides of the limit."""
    rng = random.Random(copies)
    base = [f"b{rng.randint(0, 10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))] * with_base
    for i in range(1, copies):
        copy = list(base)
        for k in rng.sample(range(200), rng.randint(1, 24)):
            copy[k] = f"n{rng.randint(0, 10**6)}"
        rows.append(((i * 7919) % 100_003 + 1, " ".join(copy)))
    confirm, compared = near_dedup._confirmed, []

    def counted(pairs, *more):
        compared.append(pairs.count())
        return confirm(pairs, *more)

    monkeypatch.setattr(near_dedup, "_confirmed", counted)
    found = near_dedup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    print(compared)
    assert sum(compared) <= 5 * copies
    assert {r.doc_id: r.component_id for r in found} == brute_force_of_many(dict(rows))


def test_one_id_with_three_texts(spark):
    """The classes of all its texts are one component."""
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(3)]
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(9, t) for t in texts] + [(20, "quite another text than these")]
    found = {r.doc_id: r.component_id for r in near_dedup.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20}
