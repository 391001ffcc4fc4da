"""Quality rules: a base rule, then boosted trees with monotonic constraints.

The trees read document statistics and learn from a bounded sample of labelled
documents. Their score may only fall as symbols, repeated lines, repeated words or
shouting rise. A document that fails the base rule goes; any other stays unless
the trees give it less than ``threshold``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.boosting import SAMPLE, Forest, fit, labelled_sample
from shelfledger.llm.text_stats import COUNTS, FEATURES, statistics

#: The score may only fall as these rise.
FALLING = ("symbols_per_word", "dup_lines", "repeat_words", "shouts", "pipes")
THRESHOLD = 0.3
LEAST_WORDS, MOST_REPEATED = 50, 50

JUDGED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Forest:
    """Rules from ``labels.quality``; with no labelled document every score is one half."""
    rows = labelled_sample(docs, labels, limit)
    return fit(
        rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float), {FEATURES.index(f): -1 for f in FALLING}
    )


def verdicts(texts: pa.Array, rules: Forest, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """COUNTS, base_failed, kept and score of every text."""
    counts, features = statistics(texts)
    n_words, repeated = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    score = rules.score(features)
    return counts, failed, ~failed & (score >= threshold), score


def _judge(batches, rules: Forest, threshold: float):
    for batch in batches:
        counts, failed, kept, score = verdicts(batch.column(1), rules, threshold)
        columns = [batch.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(kept), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "score"])


def judge(docs: DataFrame, rules: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, COUNTS, base_failed, kept, score.

    Null and empty texts have no words and fail. Repeated rows are judged alike;
    an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_judge, rules=rules, threshold=threshold), JUDGED)


def keep_good(docs: DataFrame, rules: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(verdicts(texts, rules, threshold)[2])

    return docs.where(good(F.col("text").cast("string")))
