import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfledger.llm import boosting, quality_classifier, quality_rules
from shelfledger.llm.entries import op2_quality_rules, op3_quality_classifier
from shelfledger.llm.text_stats import COUNTS, FEATURES, statistics

SF = "/root/testdata/sf0.01"


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#|é\x0b1", max_size=60)), max_size=12)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_counts_of_many_texts_at_once(rows):
    counts, features = statistics(pa.array(rows, pa.string()))
    assert [tuple(c) for c in counts] == [counted(t) for t in rows]
    assert features.shape == (len(rows), len(FEATURES)) and np.isfinite(features).all()


def test_forest_is_monotone_where_asked():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.4 * rng.random(4000) < 0.7).astype(float)
    forest = boosting.fit(x, y, {0: -1}, trees=40)
    line = np.repeat([[0.0, 0.4, 0.5]], 200, axis=0)
    for other in (0.1, 0.5, 0.9):
        line[:, 0], line[:, 1] = np.linspace(0, 1, 200), other
        assert (np.diff(forest.score(line)) <= 1e-12).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.8


def test_flat_walk_equals_a_walk_by_hand():
    rng = np.random.default_rng(2)
    x = rng.random((500, 4))
    forest = boosting.fit(x, (x[:, 2] > 0.4).astype(float), trees=10, depth=3)

    def by_hand(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = (forest.left if row[forest.feature[node]] <= forest.threshold[node] else forest.right)[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [by_hand(r) for r in x])


def test_no_labels_gives_one_half(spark, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality_rules.judge(odd_docs, quality_rules.learn(odd_docs, labels)).collect()
    assert {r.score for r in found} == {0.5}
    assert {r.score for r in quality_classifier.classify(odd_docs, quality_classifier.learn(odd_docs, labels)).collect()} == {0.5}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (8, 0), (10, 1), (None, 1), (3, None)], "doc_id long, quality int")
    rules = quality_rules.learn(odd_docs, labels)
    found = quality_rules.judge(odd_docs, rules)
    assert sorted(map(str, (tuple(r[c] for c in ("doc_id", *COUNTS)) for r in found.collect()))) == sorted(
        map(str, ((r.doc_id, *counted(r.text)) for r in odd_docs.collect()))
    )
    kept = quality_rules.keep_good(odd_docs, rules)
    assert kept.columns == odd_docs.columns and kept.count() == found.where("kept").count()
    assert quality_rules.judge(no_docs, rules).count() == quality_rules.keep_good(no_docs, rules).count() == 0
    assert quality_classifier.classify(no_docs, rules).count() == 0


def test_rules_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op2_quality_rules(spark, SF).collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in rows} == {i: counted(t) for i, t in texts.items()}
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    clean = [r for r in rows if marks.get(r.doc_id) == 1 and not r.base_failed]
    assert all(r.kept for r in clean)


def test_classifier_on_the_held_out_fold(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op3_quality_classifier(spark, SF).collect() if r.held_out and r.doc_id in marks]
    good = np.array([r.score for r in rows if marks[r.doc_id] == 1])
    bad = np.array([r.score for r in rows if marks[r.doc_id] == 0])
    assert len(good) and len(bad)
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
