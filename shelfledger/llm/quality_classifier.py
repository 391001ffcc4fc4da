"""Quality classifier: histogram gradient-boosted trees over document statistics.

Labels are learnt only from documents outside the held-out fold, which is where
crc32 of the id's digits is a multiple of ``FOLDS``; the trees read nothing but
statistics of the text, and score a batch of documents by walking flat arrays.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.boosting import SAMPLE, Forest, fit, labelled_sample
from shelfledger.llm.text_stats import FEATURES, statistics

FOLDS = 5
CUT = 0.3


def held_out(doc_id: Column) -> Column:
    """True in the fold that no label is learnt from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Forest:
    """A classifier from at most ``limit`` labels outside the held-out fold; without any, one half for all."""
    rows = labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), limit)
    return fit(rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float), trees=80)


def _score(batches, model: Forest):
    for batch in batches:
        score = model.score(statistics(batch.column(2))[1])
        columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype("int32"))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])


def classify(docs: DataFrame, model: Forest) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts are scored like a text without words. Repeated rows are
    scored alike; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(partial(_score, model=model), "doc_id long, held_out boolean, score double, predicted int")
