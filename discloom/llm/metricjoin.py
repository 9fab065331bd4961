"""N-gram Jaccard join as a join in a metric space, with pivots, regions and windows.

The distance of two sets of word shingles is 1 minus their overlap over their
union; it is a metric.  Sets at a distance of ``r`` or less are linked.

1. Rows with equal sets form one class.  Shingles are ordered, rarest first, by a
   sketch of their counts that is merged in Spark.  Two classes within a distance
   have a shingle that is among the first of both (how many those are follows from
   the distance and the set's size), so all classes near a pivot are met under its
   first shingles.  Those that the sketch counts once meet nothing and are left out,
   as are, after a look at each bucket, classes too different in size from all others
   there, or whose shingle comes too late in the order, for a link.  Buckets of the
   same classes become one, and parities of hashed codes, about a bit for each code,
   which bound how many codes two sets don't share, tell which of these can't link.
2. Pivots are classes that come first in all their buckets, so that no bucket has
   two.  Every class gets its exact distance to each pivot that it meets.
3. A class within ``r`` of pivots is in the Voronoi region of the nearest one and
   is linked to it.  Whatever a member links with is at most ``2 r`` from the
   pivot, by the triangle inequality: so classes between ``r`` and ``2 r`` are
   replicated to the region, in windows.  One at distance ``d`` is compared only
   with members that are at least ``d - r`` away from the pivot.
4. Classes in no region are joined with each other in the same way, with pivots
   of their own.  What is left after some rounds is compared bucket by bucket, in
   tiles of bounded size, so no link is lost.  Tiles of regions and buckets are
   read twice: first with these parities.  Whole sets are moved only of groups of
   rows that may be linked with each other, and once of a group that several tiles
   have.
5. Components of the links are found by distributed union-find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloom.llm.components import UnionFind, components
from discloom.llm.neardup import BLOCK, _rows, grouped, shingle_sets, tile_links
from discloom.llm.support import bit_of, cut, filter_bits, has_bit
from discloom.llm.wordcode import U64, mix64
from discloom.shared import sent

#: Cells of the sketch, least and most; two bits for each are sent to tasks.  Bytes of text for each cell.
LEAST_CELLS, MOST_CELLS, CELL_BYTES = 1 << 22, 1 << 27, 4
#: Cells in one slice of the sketch, merged in one place; counts at which the levels of the order begin.
SLICE, LEVELS = 1 << 16, (2, 8, 64)
#: Shingles of a task that are sorted by cell at once.
HELD = 2_000_000
#: Members of a bucket that are looked through for partners at once; those of larger buckets all stay.
MET = 1 << 12
#: Codes of sets of which first ones are taken at once.
TAKEN = 1 << 19
#: Rounds of pivots before what is left is compared bucket by bucket.
ROUNDS = 3
#: Windows in which the members of a region are kept, from 0 to ``r``.
WINDOWS = 2


def _cells(codes: np.ndarray, cells: int) -> np.ndarray:
    return (mix64(codes ^ U64(0x9E3779B97F4A7C15)) & U64(cells - 1)).astype(np.int64)


def packed(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^21 in bytes of 7 bits, low ones first, of which all but a number's last have the eighth bit; and where each number ends."""
    some = np.stack([np.ones(len(gaps), bool), gaps >= 1 << 7, gaps >= 1 << 14], 1)
    parts = np.stack([gaps & 127, gaps >> 7 & 127, gaps >> 14], 1).astype(np.uint8)
    parts[:, :2] |= some[:, 1:].astype(np.uint8) << 7
    return parts[some], np.cumsum(some.sum(1))


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`packed`."""
    begin = np.flatnonzero(np.append(True, data < 128)[: len(data)])
    place = np.arange(len(data)) - np.repeat(begin, np.diff(begin, append=len(data)))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin) if len(data) else np.empty(0, np.int64)


def _sketch(width: int, cells: int):
    """The cells of all shingles of the task: for each slice, gaps between places in it, as often as they occur."""

    def flush(seen: list[np.ndarray]) -> pa.RecordBatch:
        cell = np.sort(np.concatenate(seen or [np.empty(0, np.int64)]))
        number = cell // SLICE
        low = np.flatnonzero(np.append(True, np.diff(number) != 0)[: len(cell)])
        gap = np.diff(cell, prepend=0)
        gap[low] = cell[low] % SLICE
        data, end = packed(gap)
        return pa.RecordBatch.from_arrays([pa.array(number[low].astype(np.int32)), pa.array([x.tobytes() for x in np.split(data, end[low[1:] - 1])][: len(low)], pa.binary())], ["slice", "gaps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for b in batches:
            for *_, code, _ in shingle_sets(b.column(0), width):
                seen.append(_cells(code, cells))
                held += len(code)
                if held >= HELD:
                    yield flush(seen)
                    seen, held = [], 0
        yield flush(seen)

    return run


def _merge(k: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of one slice, two bits a cell."""
    counts = np.zeros(SLICE, np.int64)
    for b in batches:
        for gaps in b.column(1):
            counts += np.bincount(np.cumsum(unpacked(np.frombuffer(gaps.as_buffer(), np.uint8))), minlength=SLICE)
    level = np.searchsorted(LEVELS, counts, "right").astype(np.uint8).reshape(-1, 4)
    packed = level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6
    yield pa.RecordBatch.from_arrays([pa.array([k[0].as_py()], pa.int32()), pa.array([packed.tobytes()])], ["slice", "levels"])


class Order:
    """The order of shingles: by the level of their counts, then by a hash."""

    def __init__(self, levels: bytes) -> None:
        self.levels, self.cells = np.frombuffer(levels, np.uint8), 4 * len(levels)

    def first(self, codes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The codes under which sets meet all that overlap by ``percent`` of the union, where each set's begin, and how many are ahead.

        Codes of level 0, which are ahead, are in no other set and are left out.
        """
        cell = _cells(codes, self.cells)
        level = self.levels[cell >> 2] >> (2 * (cell & 3)).astype(np.uint8) & 3
        size = np.diff(bounds)
        doc = np.repeat(np.arange(len(size)), size)
        many = np.where(size > 0, size - -(-size * percent // 100) + 1, 0)
        # Only of sets that have more codes of level 0 than first ones is nothing left.
        ahead = np.bincount(doc, level == 0, len(size)).astype(np.int64)
        some = np.flatnonzero((level > 0) & (ahead < many)[doc])
        order = some[np.lexsort((mix64(codes[some]), level[some], doc[some]))]
        begin = np.searchsorted(doc[order], np.arange(len(size)))
        place = np.arange(len(order)) - begin[doc[order]] + ahead[doc[order]]
        keep = order[place < many[doc[order]]]
        return codes[keep], np.searchsorted(doc[keep], np.arange(len(size) + 1)), ahead


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(codes))


def _prints(code: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Size of each set and two prints of it."""
    found = [pa.array(np.diff(bounds))]
    for salt in (1, 2):
        total = np.zeros(len(code) + 1, U64)
        np.cumsum(mix64(code ^ U64(salt * 0xA0761D6478BD642F % (1 << 64))), out=total[1:])
        found.append(_signed(total[bounds[1:]] - total[bounds[:-1]]))
    return found


def _marks(code: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Of each set its size, and parities of how many of its codes fall on each of ``2 ** k`` bits, of which there are as many as codes or up to twice as many, 64 at least."""
    size = np.diff(bounds)
    words = np.array([1 << max(0, (n - 1) >> 6).bit_length() for n in size.tolist()], np.int64)
    begin = np.concatenate([[0], np.cumsum(words)])
    at = (mix64(code ^ U64(0xE7037ED1A0B428DB)) & np.repeat(64 * words - 1, size).astype(U64)).astype(np.int64)
    odd = np.bincount(np.repeat(64 * begin[:-1], size) + at, minlength=64 * begin[-1]).astype(np.uint8) & 1
    bits = np.packbits(odd, bitorder="little").view(U64)
    return _lists(np.insert(bits, begin[:-1], size.astype(U64)), begin + np.arange(len(begin)))


def may_link(sizes: np.ndarray, marks: list[np.ndarray], meets: np.ndarray, percent: int) -> np.ndarray:
    """Groups of sets that may overlap by ``percent`` of the union with another one that they meet: the least place of each set's group, -1 for sets of none.

    Bits in which the parities of two sets differ are no more than the codes that only one of them has.
    Parities of twice as many bits are folded to be compared: sets that can be linked differ by no more.
    """
    order = np.lexsort((list(map(len, marks)), sizes))
    size, groups, some = sizes[order], UnionFind(), np.zeros(len(sizes), bool)
    length = np.array([len(marks[i]) for i in order])
    low = {int(n): int(np.searchsorted(length, n)) for n in np.unique(length)}
    whole = {n: np.stack([marks[i] for i in order[length == n]]) for n in low}
    half = {n: x[:, : n // 2] ^ x[:, n // 2 :] for n, x in whole.items() if n > 1}
    last = np.searchsorted(size, size * 100 // percent, "right")
    for i in range(len(order)):
        n = int(length[i])
        mine = whole[n][i - low[n]]
        others = [whole[n][i + 1 - low[n] : last[i] - low[n]]]
        if 2 * n in low:
            others.append(half[2 * n][: max(0, last[i] - low[2 * n])])
        apart = np.concatenate([np.bitwise_count(x ^ mine).sum(1, dtype=np.int64) for x in others])
        j = np.arange(i + 1, i + 1 + len(apart))
        both = (size[i] + size[j] - apart) // 2
        found = j[meets[order[i], order[j]] & (100 * both >= percent * (size[i] + size[j] - both))]
        if len(found):
            some[order[i]] = some[order[found]] = True
        for k in order[found].tolist():
            groups.union(int(order[i]), k)
    return np.array([groups.find(i) if x else -1 for i, x in enumerate(some.tolist())], np.int64)


def _hopeful(percent: int):
    """Of rows ``key, x, y, side, cls, comp, marks`` sorted by tile those that may be linked with another one of their tile.

    Each group of them is a tile of its own, whose key is made of its rows: equal groups are equal rows.
    """

    def made(tile: list[tuple]) -> pa.RecordBatch:
        side, comp = (np.array([r[i] for r in tile]) for i in (3, 5))
        meets = ((side[:, None] != side) | (side == 2)) & (comp[:, None] != comp)
        group = may_link(np.array([int(r[6][0]) for r in tile]), [r[6][1:] for r in tile], meets, percent)
        found = []
        for g in np.unique(group[group >= 0]).tolist():
            rows = sorted((r[4], r[3], r[5]) for r, own in zip(tile, group.tolist(), strict=True) if own == g)
            x, y = np.frombuffer(hashlib.blake2b(np.array([r[:2] for r in rows], np.int64).tobytes(), digest_size=16).digest(), np.int64).tolist()
            found += [(len(rows), x, y, side, cls, comp) for cls, side, comp in rows]
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "x", "y", "side", "cls", "comp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: list[tuple] = []
        for row in _rows(batches):
            if tile and tile[0][:3] != row[:3]:
                yield made(tile)
                tile = []
            tile.append((*row[:6], row[6].copy()))
        if tile:
            yield made(tile)

    return run


def _described(width: int, percent: int, levels):
    """Each row's set: its size, two prints, its first codes and how many are ahead of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(levels.value)
        for b in batches:
            for low, high, code, bounds in shingle_sets(b.column(2), width):
                ids = [b.column(i).slice(low, high - low) for i in (0, 1)]
                first, begin, ahead = order.first(code, bounds, percent)
                yield pa.RecordBatch.from_arrays([*ids, *_prints(code, bounds), pa.array(ahead), _lists(first, begin)], ["id", "t", "n", "p1", "p2", "ahead", "first"])

    return run


def partnered(group: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which rows, sorted by group and size ``n``, may be linked with another one of their group, if the group's code is the first that both have.

    They have no more codes in common than ``rest``, how many of either set are not
    before that code, so neither is larger than the other's ``most``.
    """
    most = rest * (100 + percent) // percent - n
    at, step = np.arange(len(n)), max(int(n.max(initial=0)), int(most.max(initial=0))) + 1
    begin = np.searchsorted(group, group)
    end = np.searchsorted(group * step + n, group * step + most, "right")
    greatest = [most]  # of 1, 2, 4, ... rows from each on
    while (half := 1 << len(greatest) - 1) * 2 <= len(n):
        greatest.append(np.maximum(greatest[-1][:-half], greatest[-1][half:]))
    found = np.zeros(len(n), bool)
    for low, high in ((begin, np.minimum(at, end)), (at + 1, end)):
        for k, x in enumerate(greatest):
            i = np.flatnonzero((high - low >= 1 << k) & (high - low < 2 << k))
            found[i] |= np.maximum(x[low[i]], x[high[i] - (1 << k)]) >= n[i]
    return found


def _partners(percent: int):
    """Of rows ``code, turn, n, rest, cls, members`` sorted by code, turn and size those that may be linked with another one under the code.

    Their key is made of the group's classes: codes with the same ones have one key.
    ``whole`` tells that all members were looked through, of which ``kept`` stay.
    """

    def kept(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        code, turn, n, rest, members = (rows.column(x).to_numpy() for x in ("code", "turn", "n", "rest", "members"))
        group = np.cumsum(np.append(False, (code[1:] != code[:-1]) | (turn[1:] != turn[:-1])))
        stay = partnered(group, n, rest, percent) | (members > MET)
        group, cls, members = group[stay], rows.column("cls").to_numpy()[stay], members[stay]
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
        count = np.diff(begin, append=len(group))
        sums = [np.add.reduceat(mix64(cls.view(U64) ^ U64(salt * 0xA0761D6478BD642F % (1 << 64))), begin) if len(begin) else np.empty(0, U64) for salt in (1, 2)]
        key = np.where(members[begin] > MET, mix64(code[stay][begin].view(U64)), mix64(sums[0] ^ mix64(sums[1])))
        columns = [_signed(np.repeat(key, count)), pa.array(cls), pa.array(members), pa.array(np.repeat(count, count)), pa.array(members <= MET)]
        return pa.RecordBatch.from_arrays(columns, ["key", "cls", "members", "kept", "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                # The last group may go on in the next batch.
                code, turn = b.column(0).to_numpy(), b.column(1).to_numpy()
                last = int(np.flatnonzero((code != code[-1]) | (turn != turn[-1])).max(initial=-1)) + 1
                if last:
                    held.append(b.slice(0, last))
                if held and (last or (held[-1].column(0)[-1], held[-1].column(1)[-1]) != (b.column(0)[0], b.column(1)[0])):
                    yield kept(held)
                    held = []
                held.append(b.slice(last))
        if held:
            yield kept(held)

    return run


def _sets(width: int, bits: bytes, what: str):
    """``codes`` or ``marks`` of sets of the rows whose bit is in a filter, with their prints, by which their classes are known."""
    made = {"codes": _lists, "marks": _marks}[what]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(has_bit(bits, b.column(1).to_numpy())))
            for *_, code, bounds in shingle_sets(b.column(0), width) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([*_prints(code, bounds), made(code, bounds)], ["n", "p1", "p2", what])

    return run


def _firsts(percent: int, levels):
    """Adds to rows ``cls, n, fame, codes`` the first codes of their sets, and marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(levels.value)
        for b in batches:
            ends = np.cumsum(b.column(1).to_numpy()) // TAKEN
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(low, high - low)
                lists = part.column(3)
                code, bounds = lists.flatten().to_numpy().view(U64), lists.offsets.to_numpy().astype(np.int64)
                bounds = bounds - bounds[0]
                first, begin, ahead = order.first(code, bounds, percent)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ahead), _lists(first, begin), _marks(code, bounds), lists], ["cls", "n", "fame", "ahead", "first", "marks", "codes"])

    return run


def _shared(bits: bytes):
    """First codes that several classes may have, and how many codes of the set follow each, itself included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds = b.column(4).offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            codes = b.column(4).flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            rest = (b.column(1).to_numpy() - b.column(2).to_numpy())[row] - (np.arange(len(codes)) - bounds[:-1][row])
            keep = np.flatnonzero(has_bit(bits, b.column(5).flatten().to_numpy()))
            begin = np.searchsorted(row[keep], np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(begin), pa.array(x[keep])) for x in (codes, rest.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *lists], ["cls", "n", "fame", "first", "rest"])

    return run


def _distances(window: int, percent: int):
    """Distances from pivots, of rows sorted by pivot and turn, the pivot itself first in each turn."""

    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pivot", "cls", "distance", "linked"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            lists = b.column(4)
            values, bounds = lists.flatten().to_numpy().view(U64), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            for i, row in enumerate(zip(*(b.column(j).to_pylist() for j in range(4)), strict=True)):
                yield *row, values[bounds[i] : bounds[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, turn, middle = [], None, np.empty(0, U64)
        for pivot, salt, member, cls, codes in rows(batches):
            if not member:
                turn, middle = (pivot, salt), codes.copy()
            elif turn == (pivot, salt):
                at = np.minimum(np.searchsorted(middle, codes), len(middle) - 1)
                both = int((middle[at] == codes).sum())
                union = len(middle) + len(codes) - both
                if 100 * both >= window * union:
                    found.append((pivot, cls, (union - both) / union, 100 * both >= percent * union))
            if len(found) >= 10_000:
                yield made(found)
                found = []
        yield made(found)

    return run


def _round(firsts: DataFrame, sets: DataFrame, window: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``(pivots (cls), near (pivot, cls, distance, linked))`` of one round.

    ``firsts (cls, n, fame, first, rest)`` has the first codes of classes.  ``near``
    holds all classes that overlap with a pivot by ``window`` percent of their union.
    What follows the first code that two have bounds their overlap, so most that
    share only frequent codes are told apart before their sets are moved.
    """
    posted = firsts.select("cls", "n", "fame", F.explode(F.arrays_zip("first", "rest")).alias("x")).select("cls", "n", "fame", F.col("x.first").alias("code"), F.col("x.rest").alias("rest"))
    rank = F.struct(F.floor(F.log2(F.col("fame") + 1)).alias("fame"), F.xxhash64("cls").alias("salt"), "cls", "n", "rest")
    leads = posted.groupBy("code").agg(F.max(rank).alias("lead"))
    leads = cut(leads.select("code", F.col("lead.cls").alias("lead"), F.col("lead.n").alias("size"), F.col("lead.rest").alias("others")))
    met = cut(posted.join(leads, "code").groupBy("cls", "lead", "n", "size").agg(F.least(F.max("rest"), F.max("others")).alias("most")))
    pivots = cut(met.groupBy("cls").agg(F.min((F.col("lead") == F.col("cls")).cast("int")).alias("all")).filter("all = 1").select("cls"))
    met = met.filter(f"cls <> lead and {100 + window} * most >= {window} * (n + size)").select("cls", "lead")
    pairs = cut(met.join(pivots.withColumnRenamed("cls", "lead"), "lead").withColumnRenamed("lead", "pivot"))
    turns = F.expr(f"(count(*) + {BLOCK - 1}) div {BLOCK}")
    degrees = cut(pairs.groupBy("pivot").agg(turns.alias("turns")))
    members = pairs.join(degrees, "pivot").select("pivot", F.pmod(F.xxhash64("cls"), F.col("turns")).alias("turn"), F.lit(1).alias("member"), "cls")
    middles = degrees.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("member"), F.col("pivot").alias("cls"))
    # Few numbers are sent to the sets, so that a round moves only the sets that it compares.
    rows = sets.select("cls", "codes").join(sent(members.unionByName(middles)), "cls").select("pivot", "turn", "member", "cls", "codes")
    rows = rows.repartition("pivot", "turn").sortWithinPartitions("pivot", "turn", "member")
    return pivots, cut(rows.mapInArrow(_distances(window, percent), "pivot long, cls long, distance double, linked boolean"))


def _tiled(rows: DataFrame, sets: DataFrame, part: str) -> DataFrame:
    rows = sets.select("cls", part).join(sent(rows), "cls").select("key", "x", "y", "side", "cls", "comp", part)
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def _hoped(rows: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    return _tiled(rows, marks, "marks").mapInArrow(_hopeful(percent), "key long, x long, y long, side int, cls long, comp long")


def _tiles(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of ``rows (key, x, y, side, cls, comp)``, tile by tile; whole sets are moved of rows that may have some."""

    rows = _tiled(_hoped(rows, sets, percent).distinct(), sets, "codes")
    return cut(rows.mapInArrow(tile_links(percent), "u long, v long").distinct())


def _count(n: str) -> F.Column:
    return F.expr(f"greatest(1, ({n} + {BLOCK - 1}) div {BLOCK})")


def _upto(n: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _regions(near: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of regions and the classes that are replicated to them.

    Members are in windows of their distance from the pivot; a replicated class
    meets those windows whose members are at least its distance less ``r`` away.
    """
    r = max(1 - percent / 100, 1e-9)
    window = F.least(F.floor(F.col("distance") * (WINDOWS / r)), F.lit(WINDOWS - 1)).cast("int")
    comp = lambda column: F.coalesce("root", column)
    inside = near.filter("linked")
    homes = inside.groupBy("cls").agg(F.min(F.struct("distance", "pivot")).alias("home")).select("cls", "home.pivot", "home.distance")
    homes = homes.join(comps, F.col("cls") == F.col("node"), "left").select("pivot", "cls", window.alias("window"), comp("cls").alias("comp"))
    beside = near.filter("NOT linked")
    beside = beside.join(comps, F.col("cls") == F.col("node"), "left").select("pivot", "cls", "distance", comp("cls").alias("comp"))
    beside = beside.join(comps.select(F.col("node").alias("pivot"), F.col("root").alias("own")), "pivot", "left").filter("comp <> coalesce(own, pivot)")
    least = F.greatest(F.floor((F.col("distance") - r - 1e-9) * (WINDOWS / r)), F.lit(0)).cast("int")
    beside = beside.select("pivot", "cls", "comp", F.explode(F.sequence(least, F.lit(WINDOWS - 1))).alias("window"))
    inner = cut(homes.groupBy("pivot", "window").agg(F.count("*").alias("n")).select("pivot", "window", _count("n").alias("ins")))
    outer = cut(beside.groupBy("pivot", "window").agg(F.count("*").alias("n")).select("pivot", "window", _count("n").alias("outs")))
    sizes = cut(inner.join(outer, ["pivot", "window"]))
    key = F.xxhash64("pivot", "window").alias("key")
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    members = homes.join(sizes, ["pivot", "window"]).select(key, block("ins").alias("x"), _upto("outs").alias("y"), F.lit(0).alias("side"), "cls", "comp")
    guests = beside.join(sizes, ["pivot", "window"]).select(key, _upto("ins").alias("x"), block("outs").alias("y"), F.lit(1).alias("side"), "cls", "comp")
    return _tiles(members.unionByName(guests), sets, percent)


def _leaves(posted: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of classes of different components that share a key of first codes, all compared."""
    placed = posted.join(comps, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("root", "cls").alias("comp"))
    held = placed.groupBy("key").agg(F.count("*").alias("n"), (F.min("comp") != F.max("comp")).alias("apart"))
    held = cut(held.filter("apart").select("key", _count("n").alias("blocks")))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    rows = placed.join(held, "key").withColumn("block", block).select("key", "cls", "comp", "block", _upto("blocks").alias("other"))
    side = F.expr("case when other = block then 2 when other > block then 0 else 1 end")
    return _tiles(rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), "cls", "comp"), sets, percent)


def links(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets and confirmed links between them, as many as their components need.

    Returns ``(rows, classes, edges)``: ``rows (id, t, n, p1, p2)`` has each row
    of ``docs``, a hash of its text, its set's size and two prints of its set;
    ``classes (n, p1, p2, cls, rep)`` has each class of equal sets that aren't
    empty, its number, and the row that stands for it, ``struct<none, id, t>``;
    ``edges (u, v)`` link classes.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50, so that windows end below the greatest distance")
    window = 2 * percent - 100
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    texts = own.select("text")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // CELL_BYTES).bit_length()))
    merged = texts.mapInArrow(_sketch(width, cells), "slice int, gaps binary").groupBy("slice").applyInArrow(_merge, "slice int, levels binary")
    sketch = bytearray(cells // 4)
    for r in merged.toLocalIterator():  # a bounded number of slices of a fixed size
        sketch[r["slice"] * SLICE // 4 : (r["slice"] + 1) * SLICE // 4] = r["levels"]
    levels = docs.sparkSession.sparkContext.broadcast(sketch)

    described = cut(own.mapInArrow(_described(width, percent, levels), "id long, t long, n long, p1 long, p2 long, ahead long, first array<long>"))
    stands = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    classes = cut(described.filter("n > 0").groupBy("n", "p1", "p2").agg(stands.alias("rep"), F.first("ahead").alias("ahead"), F.first("first").alias("first")))
    classes = classes.withColumn("cls", F.monotonically_increasing_id())  # of a written table: always the same
    posted = classes.select("cls", "n", "ahead", F.posexplode("first").alias("at", "code"))
    posted = posted.select("code", "cls", "n", (F.col("n") - F.col("ahead") - F.col("at")).alias("rest"))
    several = cut(posted.groupBy("code").agg(F.count("*").alias("members")).filter("members > 1"))
    turn = F.pmod(F.xxhash64("cls"), F.expr(f"(members + {MET - 1}) div {MET}"))
    posted = posted.join(several, "code").select("code", turn.alias("turn"), "n", "rest", "cls", "members")
    posted = posted.repartition("code", "turn").sortWithinPartitions("code", "turn", "n")
    posted = posted.mapInArrow(_partners(percent), "key long, cls long, members long, kept long, whole boolean")
    # Buckets of the same classes are one from here on.
    posted = cut(posted.groupBy("key", "cls", "kept", "whole").agg(F.sum("members").alias("members")))
    fame = cut(posted.groupBy("cls").agg(F.sum("members").alias("fame"), F.max(~F.col("whole") | (F.col("kept") > BLOCK)).alias("stays")))

    # Only classes that have a partner under a first code can be linked; what tells of their sets is made again from the texts.
    involved = cut(fame.join(classes.drop("ahead", "first"), "cls"))

    def made(involved: DataFrame, what: str) -> DataFrame:
        bits = filter_bits(involved.select(F.col("rep.id").alias("id"), F.col("rep.t").alias("t")), "id", "t")
        rows = own.select("text", bit_of("id", "t").alias("bit")).mapInArrow(_sets(width, bits, what), f"n long, p1 long, p2 long, {what} array<long>")
        return rows.groupBy("n", "p1", "p2").agg(F.min(what).alias(what)).join(involved.drop("rep"), ["n", "p1", "p2"])

    # Groups that fit in one tile are compared by marks before sets are made; classes of larger ones all stay.
    marks = made(involved, "marks").select("cls", "marks")
    tiles = posted.filter(f"whole AND kept <= {BLOCK}").select("key", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(2).alias("side"), "cls", F.col("cls").alias("comp"))
    hopeful = _hoped(tiles, cut(marks), percent).select("cls")
    hopeful = cut(hopeful.union(fame.filter("stays").select("cls")).distinct())
    involved, posted = cut(involved.join(hopeful, "cls")), cut(posted.join(hopeful, "cls").select("key", "cls"))
    sets = made(involved, "codes")
    sets = sets.select("cls", "n", "fame", "codes").mapInArrow(_firsts(window, levels), "cls long, n long, fame long, ahead long, first array<long>, marks array<long>, codes array<long>")
    sets = cut(sets)

    # Joins by window need more first codes than those by link.
    firsts, nears = sets.select("cls", "n", "ahead", "fame", "first", F.transform("first", lambda c: bit_of(c)).alias("bits")), []
    several = firsts.select(F.explode("first").alias("code")).groupBy("code").agg(F.count("*").alias("members")).filter("members > 1")
    firsts = cut(firsts.mapInArrow(_shared(filter_bits(several, "code")), "cls long, n long, fame long, first array<long>, rest array<int>"))
    settled = None
    for _ in range(rounds):
        pivots, near = _round(firsts, sets, window, percent)
        nears.append(near)
        done = cut(near.filter("linked").select("cls").union(pivots).distinct())
        settled = done if settled is None else settled.union(done)
        firsts = cut(firsts.join(done, "cls", "left_anti"))
        if firsts.isEmpty():
            break
    narrow = posted.join(settled, "cls", "left_anti")
    near = nears[0]
    for more in nears[1:]:
        near = near.union(more)
    edges = near.filter("linked").select(F.col("pivot").alias("u"), F.col("cls").alias("v"))
    comps = cut(components(edges))
    edges = edges.union(_regions(near, comps, sets, percent)).union(_leaves(narrow, comps, sets, percent))
    return described.select("id", "t", "n", "p1", "p2"), classes.select("n", "p1", "p2", "cls", "rep"), edges


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of ``docs``.

    ASCII capitals count as small letters.  Rows are linked if their sets of
    ``width``-word shingles overlap by ``percent`` of their union or more; a text
    of fewer words has its whole sequence as one shingle.  ``component_id`` is the
    smallest id that links reach, itself included.  Null texts and texts without
    words have no shingles and no links.  Every row is linked by its own set, also
    where ids are repeated or null; a null ``component_id`` means that no row of the
    group has an id.  Very long texts are compared whole; other columns are
    ignored, whatever their names.
    """
    rows = grouped(*links(docs, width, percent, text, id_col, rounds))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("one").isNull(), F.col("id")).otherwise(F.col("one.id")).alias("component_id"))
