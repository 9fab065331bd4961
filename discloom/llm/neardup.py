"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Every text becomes its set of word shingles.  SuperMinHash gives each
   shingle a random permutation of the signature's slots and fills slot p(j)
   with j plus a random fraction; a slot keeps its least value.  Once all slots
   of a document are below j + 1 no later step can change it, so long documents
   need about two steps.
2. Documents with equal sets form one class with one representative.
3. Signatures are cut into bands.  In each band's bucket the member in the most
   populous buckets becomes the centre: of a base text and its variants, that
   is the base.  Links to centres are confirmed on full sets.
4. In buckets that this leaves in several components, all members are compared
   in tiles of bounded size, so no pair that shares a bucket is left out.
5. Components of the confirmed links are found by distributed union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloom.llm.components import UnionFind, components
from discloom.llm.support import bit_of, cut, filter_bits, fresh, has_bit
from discloom.llm.wordcode import LOWER_ASCII, U64, mix64, pieces, run_prints, split_words, word_prints

#: Seed of the codes of words.
SEED = 23
#: Signature slots, and slots in each band.  A pair at similarity 0.8 shares no
#: band with probability (1 - 0.8 ** 5) ** 40, about one in eight million.
SLOTS, BAND = 200, 5
#: Steps after which the few sets that are still open get explicit permutations.
IMPLICIT_STEPS = 9
#: Members compared with a centre, or dealt into one block, in one task's turn.
BLOCK = 192
#: Codes and columns of a tile's membership matrices that are made at once.
RANGE_CODES, MATRIX_COLUMNS = 1 << 20, 4096


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows: first row, last, sorted distinct codes, where each row's begin.

    A text with fewer words than ``width`` has its whole sequence as one
    shingle; a text without words has none.
    """
    for low, high, data, bounds in pieces(texts, 1 << 19):
        data = LOWER_ASCII[data]
        w = split_words(data, bounds)
        codes, _ = word_prints(data, w.start, w.end, SEED)
        counts = np.diff(w.first)
        parts, docs = [], []
        if len(codes) >= width:
            whole = w.doc[: len(codes) - width + 1] == w.doc[width - 1 :]
            parts.append(run_prints(codes, width)[0][whole])
            docs.append(w.doc[: len(whole)][whole])
        for n in range(1, width):
            short = np.flatnonzero(counts == n)
            if len(short):
                parts.append(mix64(run_prints(codes, n)[0][w.first[short]] + U64(n)))
                docs.append(short)
        code = np.concatenate(parts) if parts else np.empty(0, U64)
        doc = np.concatenate(docs) if docs else np.empty(0, np.int64)
        order = np.argsort(doc, kind="stable")
        code, doc = code[order], doc[order]
        first = np.searchsorted(doc, np.arange(high - low + 1))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            code[a:b].sort()
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        code, doc = code[new], doc[new]
        yield low, high, code, np.searchsorted(doc, np.arange(high - low + 1))


def super_minhash(code: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of sets given by codes and where each set begins.

    Values are step number and random fraction in one integer; slots of an
    empty set hold the largest integer.
    """
    n = len(first) - 1
    sig = np.full(n * slots, np.iinfo(np.uint64).max, U64)
    doc = np.repeat(np.arange(n), np.diff(first))
    swaps: list[np.ndarray] = []
    order = None  # explicit permutations, once only few elements are left
    for j in range(slots):
        rnd = mix64(code + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = (j + (rnd >> U64(40)) % U64(slots - j)).astype(np.int64)
        if order is None:
            place = pick.copy()
            for i in range(j - 1, -1, -1):
                was = swaps[i]
                place = np.where(place == was, i, np.where(place == i, was, place))
            swaps.append(pick)
        else:
            rows = np.arange(len(code))
            place = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, j]
        value = (U64(j) << U64(48)) | (mix64(rnd) >> U64(16))
        np.minimum.at(sig, doc * slots + place, value)
        live = np.flatnonzero(np.bincount(doc, minlength=n))
        open_docs = np.zeros(n, bool)
        open_docs[live] = sig.reshape(n, slots)[live].max(1) >= U64((j + 1) << 48)
        keep = open_docs[doc]
        if not keep.any():
            break
        code, doc = code[keep], doc[keep]
        swaps = [s[keep] for s in swaps]
        if order is not None:
            order = order[keep]
        elif j == IMPLICIT_STEPS - 1:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(code), 1))
            rows = np.arange(len(code))
            for i, was in enumerate(swaps):
                moved = order[rows, was].copy()
                order[rows, was] = order[:, i]
                order[:, i] = moved
            swaps = []
    return sig.reshape(n, slots)


def band_keys(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key for each band of each signature."""
    n, slots = sig.shape
    bands = slots // band
    odd = mix64(np.arange(1, band + 1, dtype=U64)) | U64(1)
    key = (sig.reshape(n, bands, band) * odd).sum(2, dtype=U64)
    return mix64(key + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(values: pa.Array, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), values)


def _set_prints(code: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Size of each set and two prints of it."""
    prints = [pa.array(np.diff(first))]
    for salt in (1, 2):
        total = np.zeros(len(code) + 1, U64)
        np.cumsum(mix64(code ^ U64(salt * 0xA0761D6478BD642F % (1 << 64))), out=total[1:])
        prints.append(_signed(total[first[1:]] - total[first[:-1]]))
    return prints


def _signatures(width: int, slots: int, band: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high, code, first in shingle_sets(b.column(2), width):
                some = np.diff(first) > 0
                keys = band_keys(super_minhash(code, first, slots)[some], band)
                at = np.concatenate([[0], np.cumsum(some)]) * (slots // band)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, high - low), b.column(1).slice(low, high - low), *_set_prints(code, first), _lists(_signed(keys.ravel()), at)],
                    ["id", "t", "n", "p1", "p2", "bands"],
                )

    return run


def _sets(width: int, bits: bytes):
    """Sets of the rows whose bit is in a filter, with their prints, by which their classes are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(has_bit(bits, b.column(1).to_numpy())))
            if b.num_rows:
                for *_, code, first in shingle_sets(b.column(0), width):
                    yield pa.RecordBatch.from_arrays([*_set_prints(code, first), _lists(_signed(code), first)], ["n", "p1", "p2", "codes"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap by ``percent`` of their union or more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) * 100 < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Scalars of each row, and its list of codes as an array."""
    for b in batches:
        lists = b.column(b.num_columns - 1)
        values, first = lists.flatten().to_numpy().view(U64), lists.offsets.to_numpy()
        first = first - first[0]
        plain = [b.column(i).to_pylist() for i in range(b.num_columns - 1)]
        for i, row in enumerate(zip(*plain, strict=True)):
            yield *row, values[first[i] : first[i + 1]]


def _edges(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _star_links(percent: int):
    """Rows sorted by centre and turn, the centre itself first in each turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, turn, middle = [], [], None, None
        for centre, salt, member, node, codes in _rows(batches):
            if not member:
                turn, middle = (centre, salt), codes.copy()
            elif turn == (centre, salt) and similar(middle, codes, percent):
                us.append(node)
                vs.append(centre)
            if len(us) >= 10_000:
                yield _edges(us, vs)
                us, vs = [], []
        yield _edges(us, vs)

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets of codes, by products of membership matrices.

    Codes are taken in ranges that hold about ``RANGE_CODES`` of them, and only
    those that two sets have become columns.
    """
    both = np.zeros((len(sets), len(sets)), np.float32)
    ranges = -(-sum(map(len, sets)) // RANGE_CODES)
    cuts = np.array([(r << 64) // ranges for r in range(1, ranges)], U64)
    edges = [np.searchsorted(s, cuts) for s in sets]
    for r in range(ranges):
        parts = [s[e[r - 1] if r else 0 : e[r] if r < ranges - 1 else len(s)] for s, e in zip(sets, edges, strict=True)]
        _, column, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        row, keep = np.repeat(np.arange(len(sets)), list(map(len, parts))), count[column] > 1
        row, column = row[keep], shared[column[keep]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
            a, b = np.searchsorted(column, [low, low + MATRIX_COLUMNS])
            member = np.zeros((len(sets), min(MATRIX_COLUMNS, int(column[-1]) + 1 - low)), np.float32)
            member[row[a:b], column[a:b] - low] = 1
            both += member @ member.T
    return both.astype(np.int64)


def tile_links(percent: int):
    """Rows sorted by tile; links of members of different components."""

    def links(tile: list[tuple]) -> pa.RecordBatch:
        if not tile:
            return _edges([], [])
        side, node, comp, codes = (list(x) for x in zip(*tile, strict=True))
        sets, us, vs = UnionFind(), [], []
        size, sides, comps = np.array(list(map(len, codes))), np.array(side), np.array(comp)
        both = overlaps(codes)
        # Both of one side only where the tile is a block with itself (side 2).
        meets = ((sides[:, None] != sides) | (sides == 2)) & (comps[:, None] != comps) & (both > 0)
        meets &= 100 * both >= percent * (size[:, None] + size - both)
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(meets, 1))), strict=True):
            if sets.union(comp[i], comp[j]):
                us.append(node[i])
                vs.append(node[j])
        return _edges(us, vs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, []
        for key, x, y, side, node, comp, codes in _rows(batches):
            if at != (key, x, y):
                yield links(tile)
                at, tile = (key, x, y), []
            tile.append((side, node, comp, codes.copy()))
        yield links(tile)

    return run


def links(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id", slots: int = SLOTS, band: int = BAND) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal sets and confirmed links between them.

    Returns ``(rows, classes, edges)``: ``rows (id, t, n, p1, p2)`` has each row
    of ``docs``, a hash of its text, its set's size and two prints of its set;
    ``classes (n, p1, p2, cls, rep)`` has each class of equal sets that aren't
    empty, its number, and the row that stands for it, ``struct<none, id, t>``,
    which is the one with the smallest id; ``edges (u, v)`` link classes.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("text"))
    signed = cut(own.mapInArrow(_signatures(width, slots, band), "id long, t long, n long, p1 long, p2 long, bands array<long>"))
    # The row of a class: its smallest id; rows without an id come last.
    stands = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    classes = signed.filter("n > 0").groupBy("n", "p1", "p2").agg(stands.alias("rep"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("cls", F.xxhash64("n", "p1", "p2")))
    banded = classes.select("cls", F.explode("bands").alias("key"))
    # Written tables have no partitioning, so in their joins by key Spark can split a hot key.
    counted = cut(banded.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"))
    shared = cut(banded.join(counted, "key"))

    # The centre of a bucket is the member whose buckets have the most members.
    fame = shared.groupBy("cls").agg(F.sum("members").alias("fame"))
    famed = shared.join(fame, "cls")
    centres = cut(famed.groupBy("key").agg(F.min(F.struct(-F.col("fame"), F.col("cls").alias("cls")))["cls"].alias("centre")))
    pairs = cut(shared.join(centres, "key").filter("cls <> centre").select("centre", "cls").distinct())

    involved = classes.join(shared.select("cls").distinct(), "cls", "left_semi").select("rep.id", "rep.t")
    # A filter of fixed size keeps most uninvolved documents out of the set table; the few others meet nothing.
    # Sets know their class by their own prints, so they are moved once to be one of each.
    bits = filter_bits(involved, "id", "t")
    sets = own.select("text", bit_of("id", "t").alias("bit")).mapInArrow(_sets(width, bits), "n long, p1 long, p2 long, codes array<long>")
    sets = cut(sets.filter("n > 0").groupBy(F.xxhash64("n", "p1", "p2").alias("id")).agg(F.min("codes").alias("codes")))

    turns = F.expr(f"(degree + {BLOCK - 1}) div {BLOCK}")
    degrees = cut(pairs.groupBy("centre").agg(F.count("*").alias("degree")).select("centre", turns.alias("turns")))
    members = pairs.join(degrees, "centre").select("centre", F.pmod(F.xxhash64("cls"), F.col("turns")).alias("turn"), F.lit(1).alias("member"), F.col("cls").alias("id"))
    middles = degrees.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(0).alias("member"), F.col("centre").alias("id"))
    rows = members.unionByName(middles).join(sets, "id").select("centre", "turn", "member", "id", "codes")
    rows = rows.repartition("centre", "turn").sortWithinPartitions("centre", "turn", "member")
    edges = cut(rows.mapInArrow(_star_links(percent), "u long, v long"))

    # Buckets of three or more members that are still in several components.
    comps = components(edges)
    placed = shared.filter("members > 2").join(comps, F.col("cls") == F.col("node"), "left")
    placed = placed.select("key", "cls", F.coalesce("root", "cls").alias("comp"))
    held = placed.groupBy("key", "comp").agg(F.count("*").alias("size"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK))
    most = F.max("size")
    mixed = held.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("size", "comp"))["comp"].alias("main"), blocks(F.sum("size") - most).alias("outs"), blocks(most).alias("ins"))
    mixed = cut(mixed.filter("comps > 1"))
    placed = placed.join(mixed, "key").withColumn("out", F.col("comp") != F.col("main"))
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("cls"), F.when(F.col("out"), F.col("outs")).otherwise(F.col("ins"))))
    # Members of the main component meet all others; blocks of others meet each other and themselves.
    zero = F.lit(0).cast("long")
    meet_outs = F.transform(F.sequence(zero, F.col("outs") - 1), lambda y: F.struct((-F.col("block") - 1).alias("x"), y.alias("y"), F.lit(0).alias("side")))
    meet_ins = F.transform(F.sequence(zero, F.col("ins") - 1), lambda x: F.struct((-x - 1).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side")))
    meet_each = F.transform(
        F.sequence(zero, F.col("outs") - 1),
        lambda o: F.struct(
            F.least(o, F.col("block")).alias("x"),
            F.greatest(o, F.col("block")).alias("y"),
            F.when(o == F.col("block"), 2).when(o > F.col("block"), 0).otherwise(1).alias("side"),
        ),
    )
    tiles = dealt.select("key", "cls", "comp", F.explode(F.when(F.col("out"), F.concat(meet_ins, meet_each)).otherwise(meet_outs)).alias("t"))
    tiles = tiles.select("key", "t.x", "t.y", "t.side", F.col("cls").alias("id"), "comp")
    tiles = tiles.join(sets, "id").select("key", "x", "y", "side", "id", "comp", "codes")
    tiles = tiles.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    more = cut(tiles.mapInArrow(tile_links(percent), "u long, v long").distinct())
    return signed.select("id", "t", "n", "p1", "p2"), classes.select("n", "p1", "p2", "cls", "rep"), edges.union(more)


def grouped(rows: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, t, n, one struct<none, id, t>`` of every row of :func:`links`: ``one`` is the row that stands for its group; null without words."""
    # Groups are settled among classes, before their rows, which may be very many: one join of rows, of which Spark can split a hot class.
    placed = classes.join(components(edges), F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    placed = cut(placed.select("n", "p1", "p2", "rep", "root"))
    stands = cut(placed.groupBy("root").agg(F.min("rep").alias("one")))
    placed = cut(placed.join(stands, "root").select("n", "p1", "p2", "one"))
    return rows.join(placed, ["n", "p1", "p2"], "left").select("id", "t", "n", "one")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id", slots: int = SLOTS, band: int = BAND) -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked if their shingle sets overlap by ``percent`` of their
    union or more; ``component_id`` is the smallest id that links reach, itself
    included, and the row with that id is kept.  Null texts and texts without
    words have no shingles and no links.  Every row is linked by its own set,
    also where rows share an id or have none.  A row with a null id is kept only
    in a group without any id, whose ``component_id`` is null.  Very long texts
    are compared whole.  Other columns are ignored, whatever their names.
    """
    rows = grouped(*links(docs, width, percent, text, id_col, slots, band))
    found = rows.select("id", "n", F.when(F.col("one").isNull(), F.col("id")).otherwise(F.col("one.id")).alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their columns, without all but one document of each group.

    The one with the smallest id stays, of texts that share it the one of least
    hash; a row without an id stays only in a group without any.  Rows that
    share an id are told apart by their texts: those in different groups stay.
    Of rows equal in id and text, one stays.  Null texts and texts without words
    are in no group and stay.
    """
    rows = grouped(*links(docs, width, percent, text, id_col))
    stays = F.col("one").isNull() | (F.col("id").eqNullSafe(F.col("one.id")) & (F.col("t") == F.col("one.t")))
    # Keys without nulls, so that reduced rows and the join are dealt alike and texts move once.
    mine, its = ([fresh(docs, f"{x}_{y}") for y in ("id", "none", "mark")] for x in ("own", "gone"))
    number = F.col(id_col).cast("long")
    keyed = docs.withColumns(dict(zip(mine, (F.coalesce(number, F.lit(0)), number.isNull(), F.xxhash64(F.col(text))), strict=True)))
    gone = rows.filter(~stays).select(F.coalesce("id", F.lit(0)).alias(its[0]), F.col("id").isNull().alias(its[1]), F.col("t").alias(its[2])).distinct()
    # Equal rows are reduced before they are dealt, however many there are.
    same = [F.col(a) == F.col(b) for a, b in zip(mine, its, strict=True)]
    return keyed.dropDuplicates(mine).join(gone.hint("shuffle_hash"), same, "left_anti").drop(*mine)
