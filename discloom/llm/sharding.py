"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Equal texts form one group, which never leaves its shard.  Differencing starts
with one partial partition per item (the item in one slot, the others empty)
and repeatedly combines the two partial partitions of largest spread, the slots
of one in opposite order to those of the other, until one partition is left.

A task never holds more than a bounded number of items.  Above four times
``per_cell`` items, they are dealt by hash into cells; each cell is differenced by itself
and its slots become the items of the next level.  Items too large to be
bundled, and all items of the first cell, skip the levels, so that the last
differencing has items of every size with which to close the remaining gaps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloom.llm.support import cut, fresh

#: Items differenced in one task.
PER_CELL = 8192


def difference(sizes: list[int], k: int) -> list[int]:
    """Slot (0 to ``k`` - 1) of each item after k-way differencing.

    Ties go to the earlier item.  No items give an empty list.
    """
    if not sizes:
        return []
    empty = -1
    left, right = [empty] * len(sizes), [empty] * len(sizes)  # trees of merged items
    heap = []
    for i, x in enumerate(sizes):
        heap.append((-x, i, [x] + [0] * (k - 1), [i] + [empty] * (k - 1)))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, trees_a = heapq.heappop(heap)
        _, _, sums_b, trees_b = heapq.heappop(heap)
        slots = []
        for s in range(k):
            a, b = trees_a[s], trees_b[k - 1 - s]
            if a != empty and b != empty:
                left.append(a)
                right.append(b)
                tree = len(left) - 1
            else:
                tree = a if b == empty else b
            slots.append((sums_a[s] + sums_b[k - 1 - s], tree))
        slots.sort(key=lambda x: -x[0])
        least = slots[-1][0]
        heapq.heappush(heap, (least - slots[0][0], made, [x - least for x, _ in slots], [t for _, t in slots]))
        made += 1
    out = [0] * len(sizes)
    for slot, tree in enumerate(heap[0][3]):
        todo = [tree] if tree != empty else []
        while todo:
            node = todo.pop()
            if node < len(sizes):
                out[node] = slot
            else:
                todo += [left[node], right[node]]
    return out


def _differenced(k: int):
    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "k1", "k2"], ascending=[False, True, True], kind="stable")
        pdf["slot"] = np.array(difference(pdf["bytes"].tolist(), k), dtype=np.int32)
        return pdf[["k1", "k2", "bytes", "cell", "slot"]]

    return cell


def place_groups(groups: DataFrame, k: int, per_cell: int = PER_CELL) -> DataFrame:
    """Shards of distinct items ``(k1 long, k2 long >= 0, bytes long)``.

    Returns ``(k1, k2, shard int)``.  An empty input gives an empty result.
    """
    schema = "k1 long, k2 long, bytes long, cell long, slot int"
    items, parents, level = groups.select("k1", "k2", "bytes"), [], 0
    while True:
        n, total = items.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        cells = -(-n // per_cell)
        if cells <= 4:
            break
        level += 1
        # At most 4 k such items exist at any level: larger than a quarter of an even shard.
        big = F.col("bytes") * 4 * k >= F.lit(total)
        dealt = items.withColumn("cell", F.pmod(F.xxhash64("k1", "k2", F.lit(level)), F.lit(cells)))
        direct = dealt.filter(big | (F.col("cell") == 0)).select("k1", "k2", "bytes")
        bundled = cut(dealt.filter(~big & (F.col("cell") != 0)).groupBy("cell").applyInPandas(_differenced(k), schema))
        up_1, up_2 = F.col("cell") * k + F.col("slot"), F.lit(-level).cast("long")
        parents.append(bundled.select("k1", "k2", up_1.alias("p1"), up_2.alias("p2")))
        bundles = bundled.groupBy(up_1.alias("k1"), up_2.alias("k2")).agg(F.sum("bytes").alias("bytes"))
        items = direct.unionByName(bundles)
    top = items.withColumn("cell", F.lit(0).cast("long")).groupBy("cell").applyInPandas(_differenced(k), schema)
    placed = cut(top.select("k1", "k2", F.col("slot").alias("shard")))
    for pairs in reversed(parents):
        below = pairs.join(placed.withColumnsRenamed({"k1": "p1", "k2": "p2"}), ["p1", "p2"]).select("k1", "k2", "shard")
        placed = placed.unionByName(below)
    return placed.filter("k2 >= 0")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, k: int = 16, text: str = "text", id_col: str = "doc_id", per_cell: int = PER_CELL) -> DataFrame:
    """Put documents into ``k`` shards of near equal bytes, equal texts together.

    Returns ``id_col, size long, text_crc32 long, law string, shard int,
    slot long, grown_shard int``; slots count from 0 without gaps in each
    shard.  Null texts form one group, as do empty ones; a null text has size 1
    and no crc32.  Repeated rows, rows of one id and rows without an id stay as
    they are, each with its own slot.  A text of any length is one group's.  An
    empty table has no rows.  Other columns of ``docs`` are ignored, whatever
    their names.
    """
    t = F.col(text)
    crc = F.crc32(t.cast("binary"))
    size = text_size(t)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        crc.alias("text_crc32"),
        # xxhash64 passes over nulls, so a null text needs a key of its own.
        F.when(t.isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(t)).alias("k1"),
        (F.shiftleft(F.coalesce(crc, F.lit(0)), 31) + size - t.isNull().cast("long")).alias("k2"),
    )
    groups = cut(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")))
    placed = cut(place_groups(groups, k, per_cell))
    part = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(max(1, docs.sparkSession.sparkContext.defaultParallelism * 16)))
    out = cut(rows.join(placed, ["k1", "k2"]).select("doc_id", "size", "text_crc32", "shard", part.alias("part")))
    # Gapless slots in two steps: rows of each part of a shard, then where each part begins.
    begins = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    begins = begins.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id"))
    out = out.withColumn("within", within).join(begins.drop("n"), ["shard", "part"])
    return out.select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("within") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, k: int = 16, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the shard of each row, as ``shard`` (or ``_shard``).

    Groups are equal texts, null texts being one, however long; ids play no
    part, so rows with null or repeated ids are sharded like any other, and no
    row is dropped or repeated.
    """
    t = F.col(text)
    name = fresh(docs, "shard")
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    crc, size = F.coalesce(F.crc32(t.cast("binary")), F.lit(0)), text_size(t)
    keyed = docs.withColumns(
        {
            k1: F.when(t.isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64(t)),
            k2: F.shiftleft(crc, 31) + size - t.isNull().cast("long"),
        }
    )
    groups = cut(keyed.groupBy(F.col(k1).alias("k1"), F.col(k2).alias("k2")).agg(F.sum(size).alias("bytes")))
    placed = cut(place_groups(groups, k)).withColumnsRenamed({"k1": k1, "k2": k2, "shard": name})
    return keyed.join(placed, [k1, k2]).drop(k1, k2)
