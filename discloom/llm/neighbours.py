"""Exact nearest neighbours by a block matrix join on int8 product tiles.

Queries and candidates are dealt into blocks; every query block meets every
candidate block in one tile.  In a tile both sides are quantised to int8 and
one matrix product gives all approximate distances.  The lengths of the
quantisation residues bound the error of each, so that only candidates whose
lower bound reaches the k-th smallest upper bound are recomputed, in double
precision, from the original vectors.  Each tile keeps the k best of each
query, and heaps merge the tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloom.shared import written

#: Vectors of one candidate block and of one query block, and queries whose distances are in memory at once.
CANDIDATE_BLOCK, QUERY_BLOCK, TURN = 8192, 8192, 512


def usable(vector: Column) -> Column:
    """Not null, not empty or zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and lengths of the residues of the rows of ``x``."""
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1  # a row of numbers too small to be scaled
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(1))


def tile(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its number, the survivors and their exact distances.

    ``own[i, j]`` marks candidates that are no neighbours of query i.
    """
    # Bounds are worked out for vectors of components up to one, whose squares neither overflow nor vanish.
    unit = max(np.abs(queries).max(), np.abs(candidates).max())
    scaled, others = queries / unit, candidates / unit
    a, sa, ea = quantised(scaled)
    b, sb, eb = quantised(others)
    # Products of int8 codes add up exactly in float32 for up to 1040 components.
    kind = np.float32 if queries.shape[1] <= 1040 else np.float64
    codes, cc = b.astype(kind).T, (others**2).sum(1)
    for low in range(0, len(queries), TURN):
        turn = slice(low, low + TURN)
        product = (a[turn].astype(kind) @ codes).astype(np.float64) * sa[turn, None] * sb
        qq = (scaled[turn] ** 2).sum(1)
        near = qq[:, None] + cc - 2 * product
        slack = 2 * ((np.sqrt(qq) + ea[turn])[:, None] * eb + ea[turn, None] * np.sqrt(cc)) + 1e-9 * (qq[:, None] + cc) + 1e-300
        upper = np.where(own[turn], np.inf, near + slack)
        if upper.shape[1] > k:
            bound = np.partition(upper, k - 1, axis=1)[:, k - 1]
        else:
            bound = np.full(len(qq), np.inf)
        alive = ~(near - slack > bound[:, None]) & ~own[turn]
        for i in range(len(qq)):
            at = np.flatnonzero(alive[i])
            yield low + i, at, distances(queries[low + i], candidates[at])


def distances(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, added up component by component, in order, as a scalar loop would.

    Where squares overflow, they are those of the vectors divided by the largest component.
    """
    if not len(candidates):
        return np.empty(0)
    with np.errstate(over="ignore"):
        out = np.sqrt(np.cumsum((candidates - query) ** 2, axis=1)[:, -1])
        far = np.flatnonzero(~np.isfinite(out))
        if len(far):
            unit = max(np.abs(query).max(), np.abs(candidates[far]).max())
            out[far] = np.sqrt(np.cumsum((candidates[far] / unit - query / unit) ** 2, axis=1)[:, -1]) * unit
    return out


def _tiles(k: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # one query block and one candidate block
        dim = key[0].as_py()
        ids = rows.column("vec_id").to_numpy()
        vectors = rows.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64, copy=False).reshape(-1, dim)
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        q_ids, c_ids = ids[asks], ids[~asks]
        out: list[tuple[int, int, float]] = []
        if len(q_ids) and len(c_ids):
            for i, at, distance in tile(vectors[asks], vectors[~asks], q_ids[:, None] == c_ids, k):
                order = np.lexsort((c_ids[at], distance))[:k]
                out += [(q_ids[i], c_ids[at[j]], distance[j]) for j in order]
        q, v, s = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _merged(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for q, v, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                heap, item = heaps.setdefault(q, []), (-s, -v)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        rows = [(q, rank, -v, -s) for q, heap in heaps.items() for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        q, rank, v, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int64()), pa.array(rank, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "rank", "vec_id", "score"]
        )

    return run


def nearest(vectors: DataFrame, asked: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of each row that ``asked`` (on the id) selects.

    Returns ``query_id long, rank int, vec_id long, score double``: Euclidean
    distances in double precision, nearest first, ties to the smaller id.  All
    candidates are exact; none is missed.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null id, take no part.
    Only vectors of equal length are compared.  A query is compared with every
    row of another id; of several rows with the query's id, the least vector
    asks.  Repeated candidates each count, and many rows of one id are dealt
    over all blocks.  A distance too large for a double is infinite.  Other
    columns are ignored, whatever their names; no rows give no rows.
    """
    # Vectors of floats are shuffled as such; tasks turn them into doubles.
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    # Written with what deals them, so that rows that are read again after a loss are in the blocks that they were in.
    rows = written(rows.withColumn("dealt", F.xxhash64("vec_id", F.monotonically_increasing_id())))
    asks = rows.drop("dealt").filter(asked).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    n, m = rows.count(), asks.count()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    right = rows.withColumn("c", F.pmod(F.col("dealt"), F.lit(c_blocks)).cast("int"))
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asks.select("dim", "vec_id", "vector", F.lit(True).alias("asks"), each(c_blocks).alias("c"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q"))
    right = right.select("dim", "vec_id", "vector", F.lit(False).alias("asks"), "c", each(q_blocks).alias("q"))
    tiles = left.unionByName(right).groupBy("dim", "c", "q").applyInArrow(_tiles(k), "query_id long, vec_id long, score double")
    return tiles.repartition("query_id").mapInArrow(_merged(k), "query_id long, rank int, vec_id long, score double")
