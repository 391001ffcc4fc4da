"""Near-duplicates by min-max hashing.

A document's set is its distinct shingles of ``width`` words, A-Z lower-cased;
documents with equal sets form a class, and only the class's smallest id goes on.
Every permutation is evaluated once and gives two signature values, its minimum
and its maximum, so ``BANDS * ROWS`` values need half as many evaluations. Bands
of the signature put classes into buckets.

Links are confirmed on full sets, without comparing all pairs of a bucket. The
links found join classes into components, and only buckets with several
components are open. Turn by turn, every member of an open bucket outside its
pivot's component meets one pivot, so a turn confirms no more pairs than there
are documents. The first pivots are members with few shingles that no other set
has, which lie in the middle of a group of near copies; later ones are drawn by
hash, so that a large component offers most of them and no bad pivot stays. Turns
go on while they join a fair share of what they compare, at most ``TURNS`` times.
Pairs that then still share a bucket but not a component are all confirmed,
unless their sketches, the number of shingles that they share with any document
at all, or their counts of shingles by part of the hash space rule the similarity
out. The two counts are bounds, so they lose nothing; shingles of one set alone
are left out of the latter. After every turn only the
links between the components of the turn before are followed, never those inside.

At a similarity of 0.8 a pair misses all buckets with probability 1.2e-6, and a
sketch hides it with 4e-6. Shingles are compared by 64-bit hashes.

A null or empty text has no shingles and is linked with nothing. Rows with a
null id are linked with nothing either: their component is null and they are
kept. Rows sharing an id count as one document.
"""

from __future__ import annotations

import hashlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfledger.llm.columns import bytes_of, numbered, pieces, word_spans
from shelfledger.session import stage

WIDTH = 4
PERCENT = 80
BANDS, ROWS = 45, 6
SEED = 7
#: Turns in which a member meets one pivot before open pairs are listed: the first ones in the
#: middle of groups, at least LEAST_TURNS, then others while one pair in FAIR is a link.
TURNS, LEAST_TURNS, FAIR = 8, 3, 50
#: A sketch holds PLANES bits of every signature value. Two sketches may differ in so many
#: of the BANDS * ROWS values: 4.5 standard deviations above the mean at a similarity of 0.8.
PLANES = 4
SKETCH_WORDS = (BANDS * ROWS + 63) // 64
MOST_DIFFERENT = 79

_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>"
_SETS = "doc_id long, shingles binary"
_SIZES = "doc_id long, size long, common long, parts array<smallint>"
#: Parts of the hash space in which a set's common shingles are counted, and the size up to which the counts hold.
PARTS, COUNTED = 256, 4_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from its bytes alone."""
    number, distinct = numbered(starts, ends, data)
    first = np.empty(distinct, np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    raw = data.tobytes()
    hashes = [hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[first], ends[first], strict=True)]
    return np.frombuffer(b"".join(hashes), "<u8")[number]


def shingle_sets(texts: pa.Array, words: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, joined, and where each text's begin and end."""
    offsets, data = bytes_of(texts)
    n = len(texts)
    data = _FOLD[data]
    starts, ends, row = word_spans(offsets, data)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    hashed = _word_hashes(starts, ends, data)
    n_words = np.bincount(row, minlength=n)
    first = np.cumsum(n_words) - n_words
    width = np.minimum(n_words, words)[row]  # short documents are one shingle
    place = np.arange(len(row)) - first[row]
    at = np.flatnonzero(place + width <= n_words[row])
    shingle = _mixed(width[at].astype(np.uint64))
    for k in range(words):
        more = width[at] > k
        value = hashed[np.minimum(at + k, len(hashed) - 1)]
        shingle = np.where(more, _mixed(shingle * np.uint64(3) + value), shingle)
    order = np.lexsort((shingle, row[at]))
    rows, values = row[at][order], shingle[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    rows, values = rows[new], values[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes and sketches of the non-empty sets."""
    full = np.flatnonzero(np.diff(offsets))
    begins = offsets[:-1][full]
    half = BANDS * ROWS // 2
    keys = np.random.default_rng(SEED).integers(0, 1 << 63, (2, half), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    found = np.empty((BANDS * ROWS, len(full)), np.uint64)
    for i in range(half):
        hashed = (values ^ keys[0, i]) * keys[1, i]
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        if len(full):
            found[2 * i] = np.minimum.reduceat(hashed, begins)
            found[2 * i + 1] = np.maximum.reduceat(hashed, begins)
    mixed = _mixed(found)
    bands = np.empty((len(full), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(full), b, np.uint64)
        for r in range(ROWS):
            key = _mixed(key * np.uint64(3) + mixed[b * ROWS + r])
        bands[:, b] = key
    bits = np.zeros((len(full), PLANES, SKETCH_WORDS * 64), np.uint8)
    for p in range(PLANES):
        bits[:, p, : BANDS * ROWS] = ((mixed >> np.uint64(p)) & np.uint64(1)).T
    packed = np.packbits(bits.reshape(len(full), -1), axis=1, bitorder="little")
    return bands.view(np.int64), packed.view(np.int64)


def _lists(rows: np.ndarray, full: np.ndarray, n: int) -> pa.Array:
    """A list column with the given rows at ``full`` and null elsewhere."""
    index = np.full(n, -1, np.int64)
    index[full] = np.arange(len(full))
    held = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))
    return held.take(pa.array(index, mask=index < 0))


def _sign(batches, width: int):
    for batch in batches:
        for ids, texts in _both(batch):
            values, offsets = shingle_sets(texts, width)
            counts = np.diff(offsets)
            bands, sketch = signatures(values, offsets)
            full = np.flatnonzero(counts)
            raw = values.tobytes()
            digests = [
                hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if a < b else None
                for a, b in zip(offsets[:-1], offsets[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts), pa.array(digests, pa.binary()), _lists(bands, full, len(ids)), _lists(sketch, full, len(ids))],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )


def _both(batch):
    at = 0
    for texts in pieces(batch.column(1)):
        yield batch.column(0).slice(at, len(texts)), texts
        at += len(texts)


def _sets(batches, width: int):
    for batch in batches:
        for ids, texts in _both(batch):
            values, offsets = shingle_sets(texts, width)
            raw = values.tobytes()
            sets = [raw[8 * a : 8 * b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def _sizes(batches):
    """Sizes of sets, and how many of their shingles other sets hold too, in all and by part."""
    for batch in batches:
        sizes, common, parts = [], [], []
        for held, alone in zip(batch.column(1), batch.column(2), strict=True):
            values = np.frombuffer(held.as_py(), "<u8")
            own = np.array(alone.as_py() or [], np.int64).view(np.uint64)
            counts = np.bincount((values % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
            counts -= np.bincount((own % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
            sizes.append(len(values))
            common.append(len(values) - len(own))
            parts.append(np.minimum(counts, 32767).astype(np.int16))
        offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * PARTS)
        listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.empty(0, np.int16)])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(common, pa.int64()), listed], names=["doc_id", "size", "common", "parts"]
        )


def _singles(batches):
    for batch in batches:
        sets = [np.frombuffer(x, "<i8") for x in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        flat = np.concatenate([*sets, np.empty(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(ids)], names=["shingle", "doc_id"])


def _confirm(batches, percent: int):
    """Components (of_a, of_b) of pairs whose sets are similar enough."""
    for batch in batches:
        similar = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            both = np.concatenate([one, two])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            similar.append(100 * shared >= percent * (len(both) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["of_a", "of_b"]).filter(pa.array(similar, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("two"))
    met = pairs.join(two, "b").join(one, "a").select("of_a", "of_b", "one", "two")
    return met.mapInArrow(partial(_confirm, percent=percent), "of_a long, of_b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b): the smallest id that each can reach.

    Rounds of taking the smallest label among neighbours and then the label's own
    label, each written to shared storage; a chain of n nodes takes about log n.
    """
    both = stage(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "near-labels")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("theirs"))
        offered = both.join(of, "b").groupBy("a").agg(F.min("theirs").alias("offer"))
        # A label that is itself a node hands on the smaller offer too, so that trees of labels merge.
        moved = labels.join(offered, labels.node == offered.a).select("node", "label", F.least("label", "offer").alias("next"))
        up = moved.groupBy("label").agg(F.min("next").alias("best")).select(F.col("label").alias("root"), "best")
        hooked = stage(
            moved.join(up, F.col("label") == F.col("root")).select("node", "label", F.least("next", "best").alias("next")), "near-hooks"
        )
        jump = hooked.select(F.col("node").alias("to"), F.col("next").alias("far"))
        labels = stage(
            hooked.join(jump, F.col("next") == F.col("to")).select("node", "label", F.least("next", "far").alias("next")), "near-round"
        )
        changed = labels.where("next < label").limit(1).count()
        labels = labels.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")


def _open(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """The rows (doc_id, bucket, own, component) of buckets with more than one component."""
    if label is None:
        return shared.withColumn("component", F.col("doc_id"))
    named = label.withColumnRenamed("node", "doc_id")
    held = shared.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = held.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return held.join(several.select("bucket"), "bucket", "left_semi")


def _one_pivot_each(open_: DataFrame, turn: int) -> DataFrame:
    """At most one pair (a, b) for each member of an open bucket, with the two components in order.

    Members meet the pivot of one of their buckets that is in another component.
    """
    middle = F.col("own") if turn < LEAST_TURNS - 1 else F.lit(0)
    rank = F.struct(middle.alias("own"), F.xxhash64(F.lit(turn), "doc_id").alias("mixed"), "doc_id", "component")
    pivots = open_.groupBy("bucket").agg(F.min(rank).alias("pivot"))
    met = open_.join(pivots, "bucket").where("component <> pivot.component")
    chosen = met.groupBy("doc_id", "component").agg(F.min("pivot").alias("pivot"))
    return chosen.select(
        F.least("doc_id", "pivot.doc_id").alias("a"), F.greatest("doc_id", "pivot.doc_id").alias("b"),
        F.least("component", "pivot.component").alias("of_a"), F.greatest("component", "pivot.component").alias("of_b"),
    ).distinct()


def _joined(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after ``links`` (of_a, of_b) between components; every label is a smallest id."""
    merged = components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))
    if label is None:
        return merged
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # A component of one document has no label so far.
    alone = merged.join(label, "node", "left_anti")
    return stage(kept.unionByName(alone), "near-joined")


def cluster(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``kept`` marks the smallest id of a component. An empty table gives no rows;
    other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(rows.mapInArrow(partial(_sign, width=width), _SIGNED), "near-signed")
    able = signed.where("doc_id is not null and digest is not null")

    classes = able.groupBy("digest").agg(F.min("doc_id").alias("head"))
    heads = able.join(classes, "digest").select("digest", "doc_id", "head")
    # One signature per class: that of its smallest id.
    single = able.join(classes, ["digest"]).where("doc_id = head").select("doc_id", "bands").dropDuplicates(["doc_id"])
    spread = single.select("doc_id", F.explode("bands").alias("bucket"))
    several = spread.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = stage(spread.join(several.select("bucket"), "bucket", "left_semi"), "near-buckets")

    needed = shared.select("doc_id").distinct()
    listed = rows.join(needed, "doc_id", "left_semi").mapInArrow(partial(_sets, width=width), _SETS)
    # An empty text under the id of another one has no set to compare.
    sets = stage(listed.where(F.octet_length("shingles") > 0).dropDuplicates(["doc_id"]), "near-sets")
    # A set shares no shingle that no other has, which bounds its similarity with any other.
    alone = (
        sets.mapInArrow(_singles, "shingle long, doc_id long")
        .groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))
        .where("n = 1")
        .groupBy("doc_id")
        .agg(F.collect_list("shingle").alias("alone"))
    )
    met = sets.join(alone, "doc_id", "left").select("doc_id", "shingles", "alone")
    sizes = stage(met.mapInArrow(_sizes, _SIZES), "near-sizes")
    able_to = sizes.where(100 * F.col("common") >= percent * F.col("size"))
    own = (F.lit(32) * (F.col("size") - F.col("common")) / F.col("size")).cast("int").alias("own")
    shared = stage(shared.join(able_to.select("doc_id", own), "doc_id"), "near-able")
    # Rows sharing an id are one document: their classes are linked.
    several = heads.groupBy("doc_id").agg(F.min("head").alias("of_a"), F.max("head").alias("last")).where("of_a < last")
    same = heads.join(several, "doc_id").where("of_a < head").select("of_a", F.col("head").alias("of_b")).distinct()
    same = stage(same, "near-same")
    label = None if same.isEmpty() else _joined(None, same)
    for turn in range(TURNS):
        open_ = stage(_open(shared, label), "near-open")
        pairs = stage(_one_pivot_each(open_, turn), "near-pairs")
        found = stage(_confirmed(pairs, sets, percent), "near-found")
        compared, linked = pairs.count(), found.count()
        if linked:
            label = _joined(label, found.distinct())
        shared = open_.drop("component")  # what is closed stays closed
        if not compared or (turn + 1 >= LEAST_TURNS and linked * FAIR < compared):
            break
    open_ = _open(shared, label)
    sketches = signed.where("sketch is not null").select(F.col("doc_id").alias("of"), "sketch").dropDuplicates(["of"])
    bits = [F.col("sketch")[i].alias(f"s{i}") for i in range(PLANES * SKETCH_WORDS)]
    open_ = open_.join(sizes, "doc_id").join(sketches, F.col("doc_id") == F.col("of"))
    mine = F.collect_set("bucket").over(Window.partitionBy("doc_id")).alias("mine")
    open_ = stage(open_.select("doc_id", "bucket", "component", "size", "common", "parts", mine, *bits), "near-open")
    # Within a bucket, the members of all components but the largest meet the others.
    counts = open_.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("most")).select("bucket", F.col("most.component").alias("major"))
    lesser = open_.join(largest, "bucket").where("component <> major")
    l, r = lesser.alias("l"), open_.join(largest, "bucket").alias("r")
    planes = [[F.col(f"l.s{i}").bitwiseXOR(F.col(f"r.s{i}")) for i in range(w, PLANES * SKETCH_WORDS, SKETCH_WORDS)] for w in range(SKETCH_WORDS)]
    apart = sum((F.bit_count(reduce(Column.bitwiseOR, word)) for word in planes), F.lit(0))
    most = F.least("l.common", "r.common")
    # Part by part, two sets share no more shingles than the smaller count of common ones.
    overlap = F.aggregate(F.zip_with("l.parts", "r.parts", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    pairs = (
        l.join(
            r,
            (F.col("l.bucket") == F.col("r.bucket"))
            & (F.col("l.component") != F.col("r.component"))
            & ((F.col("r.component") == F.col("r.major")) | (F.col("l.doc_id") < F.col("r.doc_id")))
            & ((100 + percent) * most >= percent * (F.col("l.size") + F.col("r.size")))
            & (apart <= MOST_DIFFERENT)
            # A pair that shares several buckets is listed in one of them.
            & (F.array_min(F.array_intersect("l.mine", "r.mine")) == F.col("l.bucket"))
            & ((F.greatest("l.size", "r.size") > COUNTED) | ((100 + percent) * overlap >= percent * (F.col("l.size") + F.col("r.size")))),
        )
        .select(
            F.least("l.doc_id", "r.doc_id").alias("a"), F.greatest("l.doc_id", "r.doc_id").alias("b"),
            F.least("l.component", "r.component").alias("of_a"), F.greatest("l.component", "r.component").alias("of_b"),
        )
        .distinct()
    )
    late = stage(_confirmed(pairs, sets, percent), "near-late")
    if not late.isEmpty():
        label = _joined(label, late.distinct())
    if label is None:
        label = signed.sparkSession.createDataFrame([], "node long, component long")

    of_class = heads.join(label.withColumnRenamed("node", "head"), "head", "left").select(
        "doc_id", "digest", F.coalesce("component", "head").alias("component_id")
    )
    by_class = of_class.groupBy("digest").agg(F.min("component_id").alias("component_id"))
    return signed.join(by_class, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        (F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")) | F.col("doc_id").isNull()).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all columns.

    Only ids that go are gathered; rows with a null id stay.
    """
    gone = cluster(docs, percent, width).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return packed.join(gone, F.col("id") == F.col("_gone"), "left_anti").select("row.*")
