"""Histogram gradient-boosted trees for two classes, kept as flat arrays.

Training data are a bounded sample in memory. A forest is five arrays over all
nodes of all trees; scoring walks every document through every tree one level at
a time with numpy. Features can be held monotonic: +1 lets the score only rise
with the feature, -1 only fall.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.text_stats import FEATURES, statistics


@dataclass
class Forest:
    feature: np.ndarray  # of inner nodes; 0 at leaves
    threshold: np.ndarray  # values up to it go left; infinite at leaves
    left: np.ndarray  # a leaf leads to itself
    right: np.ndarray
    value: np.ndarray  # of leaves
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for every row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        if len(self.roots):
            node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total = total + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Split points between the column's values, at most ``bins - 1``."""
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(
    x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4,
    rate: float = 0.2, bins: int = 64, smoothing: float = 1.0, least: float = 5.0,
) -> Forest:
    """Trees on the logistic loss. Without rows, or with one class, the forest is its prior."""
    n, width = x.shape
    rise = np.array([(monotone or {}).get(f, 0) for f in range(width)])
    prior = (y.sum() + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    arrays: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node() -> int:
        i = len(arrays["feature"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", 0.0)):
            arrays[k].append(v)
        return i

    edges = [_edges(x[:, f], bins) for f in range(width)] if n else []
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1) if n else None
    total = np.full(n, base)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        roots.append(node())
        grown = [(roots[-1], -np.inf, np.inf)]  # nodes of this level with the bounds of their values
        at = np.zeros(n, np.int64)  # place in `grown`; -1: in a leaf
        out = np.zeros(n)
        for level in range(depth + 1):
            live = at >= 0
            slots = len(grown)
            sum_g = np.bincount(at[live], g[live], slots)
            sum_h = np.bincount(at[live], h[live], slots)
            values = -sum_g / (sum_h + smoothing)
            best_gain, best = np.full(slots, 1e-6), [None] * slots
            for f in range(width) if level < depth else ():
                size = len(edges[f]) + 1
                cell = at[live] * size + binned[live, f]
                gl = np.bincount(cell, g[live], slots * size).reshape(slots, size).cumsum(axis=1)[:, :-1]
                hl = np.bincount(cell, h[live], slots * size).reshape(slots, size).cumsum(axis=1)[:, :-1]
                gr, hr = sum_g[:, None] - gl, sum_h[:, None] - hl
                wl, wr = -gl / (hl + smoothing), -gr / (hr + smoothing)
                gain = gl * gl / (hl + smoothing) + gr * gr / (hr + smoothing) - (sum_g * sum_g / (sum_h + smoothing))[:, None]
                gain = np.where((hl >= least / 4) & (hr >= least / 4) & (rise[f] * (wr - wl) >= 0), gain, 0)
                if size > 1:
                    cut = gain.argmax(axis=1)
                    for s in np.flatnonzero(gain[np.arange(slots), cut] > best_gain):
                        best_gain[s], best[s] = gain[s, cut[s]], (f, cut[s], wl[s, cut[s]], wr[s, cut[s]])
            following, place = [], np.full((slots, 2), -1)
            for s, (i, low, high) in enumerate(grown):
                if best[s] is None:
                    arrays["value"][i] = float(rate * np.clip(values[s], low, high))
                    continue
                f, cut, wl, wr = best[s]
                arrays["feature"][i], arrays["threshold"][i] = f, float(edges[f][cut])
                middle = float(np.clip((wl + wr) / 2, low, high))
                ends = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(rise[f])]
                for side, name in enumerate(("left", "right")):
                    place[s, side] = len(following)
                    arrays[name][i] = node()
                    following.append((arrays[name][i], *ends[side]))
            step = np.full(n, -1)
            for s, (i, _, _) in enumerate(grown):
                mine = at == s
                if best[s] is None:
                    out[mine] = arrays["value"][i]
                else:
                    f, cut = best[s][:2]
                    step[mine] = np.where(binned[mine, f] <= cut, place[s, 0], place[s, 1])
            at, grown = step, following
            if not grown:
                break
        total += out
    return Forest(
        *(np.array(arrays[k], t) for k, t in (("feature", np.int64), ("threshold", float), ("left", np.int64), ("right", np.int64), ("value", float))),
        np.array(roots, np.int64), depth, base,
    )


#: Rows that a model learns from, at most.
SAMPLE = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> pd.DataFrame:
    """FEATURES and ``quality`` of at most ``limit`` labelled documents.

    Labels are taken in the order of a hash of their id; of several labels for one
    id the mean counts, rounded half up. Null labels and ids are left out. The chosen
    ids are broadcast, ``limit`` of them at most, so texts are not shuffled.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(limit)
    )
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), F.col("doc_id") == F.col("labelled")
    )
    fields = ", ".join(f"{f} double" for f in FEATURES)
    rows = met.select("text", "quality", "doc_id").mapInArrow(_features, f"quality int, doc_id long, {fields}")
    return (
        rows.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES)
        .limit(limit)
        .toPandas()
    )


def _features(batches):
    for batch in batches:
        _, features = statistics(batch.column(0))
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), *(pa.array(c) for c in features.T)], names=["quality", "doc_id", *FEATURES]
        )
