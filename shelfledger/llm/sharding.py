"""Resharding by minimum-cost flow.

Rows belong to blocks by a digest of their text, so equal texts share a block and
a shard. A block above ``SPLIT`` of a shard's capacity is cut into sub-blocks by
more of the same digest. Only a text whose own copies weigh more than ``WHOLE``
capacities, and so fit no shard, is dealt out by id; every other group of equal
texts has one shard. Old
shard sizes and new capacities make a transport problem: keeping bytes costs
nothing, moving a byte costs one, and successive shortest paths give the flow that
moves the fewest bytes. Each flow is then carried out with whole blocks, and only
files of shards that give or take a block are written again.

The driver sees one row per block, sub-block and piece of a heavy text, a number
set by ``BLOCKS``, ``SPLIT``, ``WHOLE`` and ``CUTS`` and not by the data.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 4096
#: A block above this part of the new capacity is cut into CUTS sub-blocks.
SPLIT = 1 / 64
#: A text whose copies exceed so many new capacities is cut into CUTS pieces.
WHOLE = 1
CUTS = 1024
#: What is placed as one: a block, a sub-block, or a piece of a heavy text.
UNIT = ["block", "sub", "part"]
OLD_SHARDS, NEW_SHARDS = 12, 16


def _size() -> Column:
    """UTF-8 bytes + 1, null: 1."""
    return (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long")


def _digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _block(digest: Column) -> Column:
    return F.pmod(digest, F.lit(BLOCKS)).cast("int")


def _cut(digest: Column) -> Column:
    """Sub-block by bits of the digest that do not choose the block."""
    return F.pmod(F.shiftright(digest, BLOCKS.bit_length() - 1), F.lit(CUTS)).cast("int")


def _piece() -> Column:
    return F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.lit(CUTS)).cast("int")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1, null: 1), text_crc32, digest, block, cut and piece of every row."""
    return docs.select(
        "doc_id",
        _size().alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        _digest().alias("digest"),
        _block(_digest()).alias("block"),
        _cut(_digest()).alias("cut"),
        _piece().alias("piece"),
    )


def min_cost_flow(have: list[int], room: list[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """The cheapest flow that places all of ``have`` into ``room``.

    Successive shortest paths with potentials over old shards x new shards; the
    amounts are whole numbers, ties go to the lower shard numbers.
    """
    n, m = len(have), len(room)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # to, room left, cost, index of the way back

    def link(a: int, b: int, capacity: int, price: int) -> None:
        graph[a].append([b, capacity, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, amount in enumerate(have):
        link(source, i, amount, 0)
        for j in range(m):
            link(i, n + j, amount, cost(i, j))
    for j, amount in enumerate(room):
        link(n + j, sink, amount, 0)

    height = [0] * len(graph)
    while True:
        far, way, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, left, price, _) in enumerate(graph[a]):
                step = d + price + height[a] - height[b]
                if left and step < far.get(b, step + 1):
                    far[b], way[b] = step, (a, k)
                    heapq.heappush(queue, (step, b))
        if sink not in far:
            break
        for a in range(len(graph)):
            height[a] += far.get(a, far[sink])
        path, b = [], sink
        while b != source:
            path.append(way[b])
            b = way[b][0]
        amount = min(graph[a][k][1] for a, k in path)
        for a, k in path:
            graph[a][k][1] -= amount
            graph[graph[a][k][0]][graph[a][k][3]][1] += amount
    return {
        (i, b - n): graph[b][back][1]
        for i in range(n)
        for b, _, _, back in graph[i]
        if n <= b < n + m and graph[b][back][1]
    }


def assign_blocks(sizes: dict, old: dict, n_new: int) -> dict:
    """New shard of every block, given block sizes and old shards.

    The flow says how many bytes go where; blocks are taken largest first while
    they fit. What is left over by rounding is then levelled: a block moves from
    the fullest to the emptiest shard as long as that narrows the gap.
    """
    have = [0] * (max(old.values(), default=0) + 1)
    for b, s in sizes.items():
        have[old[b]] += s
    total = sum(have)
    room = [total * (j + 1) // n_new - total * j // n_new for j in range(n_new)]
    flow = min_cost_flow(have, room, lambda i, j: int(i != j))

    owned: dict[int, list] = defaultdict(list)
    for b in sorted(sizes, key=lambda b: (-sizes[b], b)):
        owned[old[b]].append(b)
    new: dict = {}
    for i, blocks in owned.items():
        left = {j: flow[i, j] for j in range(n_new) if (i, j) in flow}
        for b in blocks:
            j = max(left, key=lambda j: (left[j] >= sizes[b], j == i, left[j], -j))
            new[b] = j
            left[j] -= sizes[b]

    held: dict[int, set] = defaultdict(set)
    load = [0] * n_new
    for b, j in new.items():
        held[j].add(b)
        load[j] += sizes[b]
    for _ in range(len(sizes)):
        top, low = max(range(n_new), key=load.__getitem__), min(range(n_new), key=load.__getitem__)
        gap = load[top] - load[low]
        fitting = [b for b in held[top] if 0 < sizes[b] < gap]
        if not fitting:
            break
        b = min(fitting, key=lambda b: (abs(gap - 2 * sizes[b]), b))
        held[top].remove(b)
        held[low].add(b)
        load[top] -= sizes[b]
        load[low] += sizes[b]
        new[b] = low
    return new


def _layout(docs: DataFrame, old_shards: int, new_shards: int) -> tuple[dict[str, Column], DataFrame]:
    """How rows with block, cut, piece and digest find their unit, and the shards of every unit.

    The first holds the columns of ``UNIT`` and ``lane``, which spreads the rows of
    a large unit over tasks; the second UNIT, old_shard and shard.
    """
    spark = docs.sparkSession
    rows = measured(docs)
    blocks = {r.block: r.size for r in rows.groupBy("block").agg(F.sum("size").alias("size")).collect()}
    capacity = sum(blocks.values()) / new_shards
    limit = max(1, capacity * SPLIT)
    cut = sorted(b for b, s in blocks.items() if s > limit)
    place = F.col("block").cast("long") * CUTS + F.col("cut")

    def among(column: Column, values: list[int]) -> Column:
        return column.isin(values) if values else F.lit(False)

    sizes = {(b, -1, -1): s for b, s in blocks.items() if s <= limit}
    heavy: list[int] = []
    if cut:
        in_cut = rows.where(among(F.col("block"), cut)).groupBy("block", "cut").agg(F.sum("size").alias("size"))
        sizes |= {(r.block, r.cut, -1): r.size for r in in_cut.collect()}
    # A heavy text lies in a heavy sub-block, and there are no more than new_shards / WHOLE of those.
    doubtful = sorted(b * CUTS + c for (b, c, _), s in sizes.items() if c >= 0 and s > capacity * WHOLE)
    if doubtful:
        texts = rows.where(among(place, doubtful)).groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        heavy = sorted(r.digest for r in texts.where((F.col("size") > capacity * WHOLE) & (F.col("n") > 1)).collect())
    if heavy:
        pieces = rows.where(among(F.col("digest"), heavy)).groupBy("block", "cut", "piece").agg(F.sum("size").alias("size"))
        for r in pieces.collect():
            sizes[r.block, r.cut, r.piece] = r.size
            sizes[r.block, r.cut, -1] -= r.size
    sizes = {key: s for key, s in sizes.items() if s}
    large = sorted(b * CUTS + c for (b, c, p), s in sizes.items() if c >= 0 and p < 0 and s > limit)
    is_heavy = among(F.col("digest"), heavy)
    columns = {
        "sub": F.when(among(F.col("block"), cut), F.col("cut")).otherwise(-1),
        "part": F.when(is_heavy, F.col("piece")).otherwise(-1),
        "lane": F.when(~is_heavy & among(place, large), F.col("piece")).otherwise(-1),
    }
    old = {key: key[0] % old_shards for key in sizes}
    new = assign_blocks(sizes, old, new_shards)
    table = [(*key, old[key], new[key]) for key in sizes] or [(-1, -1, -1, 0, 0)]
    return columns, F.broadcast(spark.createDataFrame(table, "block int, sub int, part int, old_shard int, shard int"))


def _assigned(docs: DataFrame, old_shards: int, new_shards: int) -> DataFrame:
    """The measured rows with sub (-1: block not cut), part (-1: text not cut), lane, old_shard and shard."""
    columns, target = _layout(docs, old_shards, new_shards)
    return measured(docs).withColumns(columns).join(target, UNIT)


def reshard(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard.

    Rows of equal texts share a shard unless they exceed ``WHOLE`` of its capacities.
    Sizes of the new shards differ by at most about one small block where the groups
    allow it; the law is ``bytes``. Slots count from 0 in each shard, block by block.
    An empty table gives no rows; null texts weigh one byte; repeated rows get slots
    of their own.
    """
    rows = _assigned(docs, old_shards, new_shards)
    key = ["shard", *UNIT, "lane"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(*UNIT, "lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(*key).orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, key)
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "old_shard",
        )
    )


def rewrite(docs: DataFrame, folder: str, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS) -> DataFrame:
    """Writes the shards that change into ``folder`` (shard=N) and returns the moves: old_shard, shard, bytes.

    A shard's rows are spread over its blocks' tasks, so no task writes a whole
    shard; shards that neither give nor take a block keep their files. A shard that
    gives all its blocks away is left as an empty table over its old files.
    """
    columns, target = _layout(docs, old_shards, new_shards)
    moves = measured(docs).withColumns(columns).join(target, UNIT).groupBy("old_shard", "shard").agg(F.sum("size").alias("bytes"))
    changed = {s for r in moves.collect() if r.old_shard != r.shard for s in (r.old_shard, r.shard)}
    keyed = docs.select(
        F.struct("*").alias("row"), _digest().alias("digest"), _block(_digest()).alias("block"),
        _cut(_digest()).alias("cut"), _piece().alias("piece"),
    )
    out = keyed.withColumns(columns).join(target.withColumnRenamed("shard", "_shard"), UNIT)
    out = out.where(F.col("_shard").isin(sorted(changed)) if changed else F.lit(False))
    out.select("row.*", F.col("_shard").alias("shard")).write.partitionBy("shard").option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").parquet(folder)
    # The overwrite is of the partitions that it writes; what others held is elsewhere now.
    spark = docs.sparkSession
    held = spark.read.schema("shard int").parquet(folder)
    emptied = changed - {r.shard for r in moves.collect()}
    for r in held.where(F.col("shard").isin(sorted(emptied)) if emptied else F.lit(False)).select("shard").distinct().collect():
        spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(f"{folder}/shard={r.shard}")
    return moves
