"""How far the word use of sources lies apart, language by language.

Texts are cut and counted in Arrow's own kernels: ``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode`` and a hash ``group_by`` turn every
batch into counts per (lang, source, term), which a task merges before it gives
them out. Spark adds them up, keeps the terms that enough documents of the
language hold, and deals these, each with its counts in all sources, to shards.
A shard works on columns of terms against rows of sources: it adds up the
differences of every pair of sources and keeps the best terms of every source.
Shards only send such sums and best terms on.

The share of a term in a group is ``1 + floor(SCALE * (count + SMOOTH) / (N +
SMOOTH * V))`` with N occurrences of V kept terms; all arithmetic is on whole
numbers. N + SMOOTH * V may reach 9e15 (Spark's exact sums are checked against
it), far beyond 100 TB of text.

Null text, lang and source count as ''. A group without terms takes part with
counts of 0; a language without kept terms gives pairs of value 0. Repeated rows
count each time. An empty table gives no rows. What is held per language is one
number per source and, in a shard, per pair of its sources, as the result has
one row for each pair; a frequent term or a large source is only counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfledger.llm.columns import pieces
from shelfledger.session import stage

#: What lies between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30
SMOOTH, SCALE = 5, 1_000_000_000
TOP_TERMS = 50
#: A task gives its counts out when it holds so many.
HELD_COUNTS = 400_000
#: Divisors up to this keep the long division within 64 bits.
MOST = 9_000_000_000_000_000
#: Cells of sources times terms that a shard works on at once.
CELLS = 1 << 20

COUNTS = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"
_KEYS = ["lang", "source", "term"]


def counted(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """Occurrences ``n`` and documents ``docs`` per (lang, source, term).

    The term '' with counts of 0 marks that a group occurs.
    """
    split = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), BETWEEN)
    terms = split.flatten().dictionary_encode()
    row = pc.list_parent_indices(split)
    of_row = pa.table({"row": row, "term": terms.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    held = pc.take(terms.dictionary, of_row["term"])
    spoken = pc.not_equal(held, "")
    at = of_row["row"]
    each = pa.table(
        {
            "lang": pc.take(langs, at),
            "source": pc.take(sources, at),
            "term": held,
            "n": pc.if_else(spoken, of_row["count_all"], 0),
            "docs": pc.cast(spoken, pa.int64()),
        }
    )
    # Every group is there even if none of its texts begins or ends between terms.
    zeros = pa.array(np.zeros(len(texts), np.int64))
    marks = pa.table({"lang": langs, "source": sources, "term": pa.array([""] * len(texts)), "n": zeros, "docs": zeros})
    return merged([each, marks])


def merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*_KEYS, "n_sum", "docs_sum"]).rename_columns([*_KEYS, "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        at = 0
        for texts in pieces(batch.column(2)):
            langs, sources = (batch.column(k).slice(at, len(texts)) for k in (0, 1))
            at += len(texts)
            held.append(counted(langs, sources, texts))
            rows += len(held[-1])
            if rows > HELD_COUNTS:
                one = merged(held)
                held, rows = [one], len(one)
                if rows > HELD_COUNTS // 2:
                    yield from one.to_batches()
                    held, rows = [], 0
    if held:
        yield from merged(held).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """Exact counts per (lang, source, term) over all documents; the term '' marks each group."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    partial_counts = docs.select(whole("lang"), whole("source"), whole("text")).mapInArrow(_count, COUNTS)
    return partial_counts.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * count / total)`` for 0 <= count <= total <= MOST, by long division."""
    rest, out = count, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):  # SCALE is 1000 ** 3
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


class _Language:
    """What a shard holds of one language: sums per pair of sources, and best terms per source."""

    def __init__(self, sources: list[str], totals: list[int], v: int):
        self.sources = sources
        self.below = np.array(totals, np.int64)[:, None] + SMOOTH * v
        self.below_all = sum(totals) + SMOOTH * v
        if self.below_all > MOST:
            raise ValueError(f"{self.below_all} occurrences of terms do not fit exact shares")
        self.apart = np.zeros((len(sources), len(sources)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in sources]

    def add(self, terms: list[str], number: np.ndarray, source: np.ndarray, n: np.ndarray, top: int) -> None:
        """Counts ``n`` of (term number, source)."""
        counts = np.zeros((len(self.sources), len(terms)), np.int64)
        counts[source, number] = n
        p = shares(counts + SMOOTH, self.below)
        for i in range(1, len(p)):
            self.apart[i, :i] += np.abs(p[:i] - p[i]).sum(axis=1)
        q = shares(counts.sum(axis=0) + SMOOTH, np.int64(self.below_all))
        more = np.where(counts > 0, p - q, 0)
        for i, row in enumerate(more):
            ahead = np.flatnonzero(row > 0)
            if len(ahead) > top:  # those below the last value of the first ``top`` cannot be listed
                least = np.partition(row[ahead], -top)[-top]
                ahead = ahead[row[ahead] >= least]
            found = self.best[i] + [(-int(row[k]), terms[k].encode()) for k in ahead]
            self.best[i] = sorted(found)[:top]

    def found(self, lang: str) -> Iterator[tuple]:
        for i, source in enumerate(self.sources):
            for j in range(i):
                yield lang, source, "pair", self.sources[j], int(self.apart[i, j])
            for value, term in self.best[i]:
                yield lang, source, "term", term.decode(), -value


def _compare(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, term, at, n, sources, totals, v), ordered by lang."""
    name, language = None, None
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def given() -> Iterator[pa.RecordBatch]:
        rows = [] if language is None else list(language.found(name))
        for a in range(0, len(rows), 50_000):
            columns = zip(*rows[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        langs = batch.column(0).to_pylist()
        begins = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
        for a, b in zip(begins, begins[1:], strict=False):
            if a == b:
                continue
            if language is None or langs[a] != name:
                yield from given()
                name = langs[a]
                sources, totals, v = (batch.column(k)[a].as_py() for k in (4, 5, 6))
                language = _Language(sources, totals, v)
            step = max(1, CELLS // len(language.sources))
            for c in range(a, b, step):
                part = batch.slice(c, min(step, b - c))
                held, n = part.column(2), part.column(3).flatten().to_numpy()
                number = pc.list_parent_indices(held).to_numpy()
                language.add(part.column(1).to_pylist(), number, held.flatten().to_numpy(), n, top)
    yield from given()


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair``: the summed difference to every other source of the language.
    Part ``term``: the ``top_terms`` terms whose share in the source lies furthest
    above that in the language. Ranks are by value descending, then item.
    """
    counts = stage(term_counts(docs), "divergence-counts")
    # A source's place among those of its language; one row per source.
    groups = counts.where("term = ''").select("lang", "source")
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at")
    groups = stage(groups.select("lang", "source", place), "divergence-groups")
    numbered = counts.where("term <> ''").join(groups, ["lang", "source"])
    terms = numbered.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("at", "n")).alias("held"))
    terms = stage(terms.where(F.col("docs") >= least_docs).select("lang", "term", "held"), "divergence-terms")

    spoken = terms.select("lang", F.inline("held")).groupBy("lang", "at").agg(F.sum("n").alias("n"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    entry = F.struct("at", "source", F.coalesce("n", F.lit(0)).alias("n"))
    languages = (
        groups.join(spoken, ["lang", "at"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(entry)).alias("of"))
        .join(kept, "lang", "left")
        .select("lang", F.col("of.source").alias("sources"), F.col("of.n").alias("totals"), F.coalesce("v", F.lit(0)).alias("v"))
    )
    languages = stage(languages, "divergence-languages")

    dealt = terms.repartition("lang", "term").join(languages, "lang").sortWithinPartitions("lang")
    shard = dealt.select("lang", "term", F.col("held.at").alias("at"), F.col("held.n").alias("n"), "sources", "totals", "v")
    found = stage(shard.mapInArrow(partial(_compare, top=top_terms), FOUND), "divergence-found")

    # Every pair is listed from either side, also where no term is kept.
    here = languages.select("lang", "sources", F.explode("sources").alias("source"))
    every = here.select("lang", "source", F.explode("sources").alias("item")).where("source <> item")
    zero = F.lit(0).cast("long").alias("value")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = (
        every.select("lang", "source", "item", zero)
        .unionByName(sums)
        .unionByName(turned)
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")
    best = found.where("part = 'term'").select("*", ranked).where(F.col("rank") <= top_terms)
    return pairs.select("*", ranked).unionByName(best)
