"""Removal of long word sequences that occur more than once.

A window is a fixed number of consecutive words of one document; every word
covered by a window that also starts anywhere else is removed.

1. A first pass over the texts fills a count-min sketch in each task and the
   partial sketches are merged slice by slice in Spark.  It counts anchors: the
   anchor of a window is its run of ``ANCHOR`` words with the least code, so
   equal windows have equal anchors, and the estimate for an anchor can only
   exceed the number of places where any of its windows starts.  Neighbouring
   windows share most anchors, so there are several times fewer of them.
2. A second pass exactly groups only the windows whose anchors may be repeated.
   Tasks first add up equal windows; a window counted once was a false alarm.
3. A third pass removes the words of all windows that may be repeated, save for
   the false alarms, which are few and are looked up by the text's fingerprint.

The merged sketch is one bit a cell.  Its size follows the texts' up to a bound,
for tasks hold it whole.  With more anchors than cells it lets more windows
through to the exact grouping and loses none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloom.llm.support import cut
from discloom.llm.wordcode import U64, flat, mix64, pieces, run_prints, split_words, word_prints

#: Seed of the codes of words.
SEED = 31
#: Words of an anchor.
ANCHOR = 15
#: Cells in each of the sketch's rows, least and most, and rows; a bit for each is sent to tasks.
LEAST_CELLS, MOST_CELLS, ROWS = 1 << 22, 1 << 28, 2
#: Bytes of text for each cell; some 60 bytes of prose have one anchor.
CELL_BYTES = 8
#: Cells in one slice of the sketch, merged in one place.
SLICE = 1 << 20


def _least_places(codes: np.ndarray, width: int) -> np.ndarray:
    """First place of the least of each ``width`` consecutive values, by doubling."""
    place, have = np.arange(len(codes)), 1
    while have < width:
        step = min(have, width - have)
        a, b = place[: len(place) - step], place[step:]
        place, have = np.where(codes[b] < codes[a], b, a), have + step
    return place


class Windows:
    """Codes of all windows of some documents and of their anchors."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int) -> None:
        self.words = w = split_words(data, bounds)
        self.codes, self.others = word_prints(data, w.start, w.end, SEED)
        n = max(0, len(self.codes) - width + 1)
        self.at = np.flatnonzero(w.doc[:n] == w.doc[len(w.doc) - n :])  # first words of windows
        anchor = min(ANCHOR, width)
        runs, self.runs = run_prints(self.codes, anchor, width) if n else (self.codes[:0], self.codes[:0])
        self.places = _least_places(runs, width - anchor + 1)[self.at] if n else self.at
        self.anchors = runs[self.places]
        self.width = width

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Two codes of each window, of independent codes of its words."""
        return self.runs[self.at], run_prints(self.others, self.width)[0][self.at] if len(self.at) else self.others[:0]


def _cells(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    """The anchor's cell in each row of the sketch, numbered through."""
    return [(mix64(anchors ^ U64(r * 0xA0761D6478BD642F % (1 << 64))) % U64(cells)).astype(np.int64) + r * cells for r in range(ROWS)]


def _sketch(width: int, cells: int):
    """Counts (one, or more) of the task's anchors: slices of sorted cells."""

    def flush(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not seen:
            return
        cell, count = np.unique(np.concatenate(seen), return_counts=True)
        cuts = np.flatnonzero(np.diff(cell // SLICE)) + 1
        for c, n in zip(np.split(cell, cuts), np.split(count, cuts), strict=True):
            if len(c):
                where = (c % SLICE).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(c[0]) // SLICE], pa.int32()), pa.array([where[n == 1].tobytes()]), pa.array([where[n > 1].tobytes()])],
                    ["slice", "once", "more"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        for b in batches:
            for _, _, data, bounds in pieces(b.column(0)):
                w = Windows(data, bounds, width)
                if len(w.at):
                    # An anchor counts once for each place.  Equal windows have their
                    # anchors equally far from their starts, so in different places.
                    new = np.ones(len(w.at), bool)
                    new[1:] = w.places[1:] != w.places[:-1]
                    found = w.anchors[new]
                    seen += _cells(found, cells)
                    held += ROWS * len(found)
                if held > 4_000_000:
                    yield from flush(seen)
                    seen, held = [], 0
        yield from flush(seen)

    return run


def _merge(k: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits of one slice: cells whose counts add up to two or more."""
    counts = np.zeros(SLICE, np.uint8)
    for b in batches:
        for once, more in zip(b.column(1), b.column(2), strict=True):
            where = np.frombuffer(once.as_py(), np.uint32)
            counts[where] = np.minimum(counts[where] + 1, 2)
            counts[np.frombuffer(more.as_py(), np.uint32)] = 2
    bits = np.packbits(counts >= 2, bitorder="little").tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([k[0].as_py()], pa.int32()), pa.array([bits])], ["slice", "bits"])


def _suspects(anchors: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Which anchors all rows of the sketch have twice or more."""
    out = np.ones(len(anchors), bool)
    for cell in _cells(anchors, cells):
        out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return out


def _text_prints(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the bytes of each text."""
    view = memoryview(np.ascontiguousarray(data))
    prints = b"".join(hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    return np.frombuffer(prints, np.int64)


def _fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(_text_prints(*flat(texts)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _candidates(width: int, cells: int, sketch):
    """Distinct suspected windows of each stretch of the task, with one place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sketch.value, np.uint8)
        for b in batches:
            for _, _, data, bounds in pieces(b.column(0)):
                w = Windows(data, bounds, width)
                hit = np.flatnonzero(_suspects(w.anchors, bits, cells))
                if not len(hit):
                    continue
                one, two = (x[hit] for x in w.prints())
                # Equal windows of this stretch of texts are one row with their number.
                key, first, count = np.unique(one ^ mix64(two), return_index=True, return_counts=True)
                at = w.at[hit[first]]
                doc = w.words.doc[at]
                place = np.where(count == 1, at - w.words.first[doc], -1)
                order = np.argsort(at)  # neighbours share their text's print
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(one[first][order]),
                        pa.array(two[first][order].astype(np.uint32).view(np.int32)),
                        pa.array(_text_prints(data, bounds)[doc][order]),
                        pa.array(place[order].astype(np.int32)),
                    ],
                    ["one", "two", "text", "at"],
                )

    return run


def _cleaned(width: int, cells: int, sketch, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sketch.value, np.uint8)
        for b in batches:
            ids, alarms = b.column(0), b.column(2)
            for low, high, data, bounds in pieces(b.column(1)):
                w = Windows(data, bounds, width)
                bad = _suspects(w.anchors, bits, cells)
                starts = np.zeros(len(w.codes) + 1, np.int32)
                starts[w.at[bad]] = 1
                for d in range(high - low):
                    x = alarms[low + d]
                    if x.is_valid:
                        starts[w.words.first[d] + np.array(x.as_py(), np.int64)] = 0
                total = np.cumsum(starts[:-1])
                ended = np.zeros_like(total)
                ended[width:] = total[:-width]
                gone = total - ended > 0
                yield _result(ids.slice(low, high - low), data, w, gone, with_text)

    return run


def _result(ids: pa.Array, data: np.ndarray, w: Windows, gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
    first, words = w.words.first, w.words
    lost = np.concatenate([[0], np.cumsum(gone)])
    # Kept words joined by one space: their bytes and one byte after each word.
    take = np.flatnonzero(~gone)
    size = words.end[take] - words.start[take] + 1
    out = np.concatenate([[0], np.cumsum(size)])
    joined = np.full(out[-1], 0x20, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start[take]] += 1
    inside[words.end[take]] -= 1
    space = np.ones(len(joined), bool)
    space[out[1:] - 1] = False
    joined[space] = data[np.cumsum(inside[:-1]) > 0]
    ends = out[np.searchsorted(take, first)]
    view = memoryview(joined)
    spans = [view[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    columns = [ids, pa.array(np.diff(first)), pa.array(lost[first[1:]] - lost[first[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in spans], pa.string())]
    names = ["id", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        columns.append(pa.array([bytes(x).decode() for x in spans], pa.string()))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, width: int = 35, text: str = "text", id_col: str = "doc_id", with_text: bool = True, cells: int | None = None) -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` and maybe ``kept_text`` for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``; kept words are joined by one space.  Null
    texts have no words, and texts of fewer than ``width`` words no window.
    Rows are judged by their texts alone: rows with equal texts, equal ids or a
    null id each count and are each returned.  Texts of any length are taken
    whole.  Other columns are ignored, whatever their names.  ``cells`` of the
    sketch, a multiple of 2 ** 20, follow the size of the texts by default; any
    number gives the same rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    if cells is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // CELL_BYTES).bit_length()))
    parts = texts.mapInArrow(_sketch(width, cells), "slice int, once binary, more binary")
    merged = parts.groupBy("slice").applyInArrow(_merge, "slice int, bits binary")
    sketch = bytearray(ROWS * cells // 8)
    for r in merged.toLocalIterator():  # a fixed number of slices of a fixed size
        at = r["slice"] * SLICE // 8
        sketch[at : at + SLICE // 8] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(sketch))
    found = texts.mapInArrow(_candidates(width, cells, shared), "one long, two int, text long, at int")
    single = found.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("text").alias("text"), F.min("at").alias("at"))
    single = single.filter("n = 1 AND at >= 0")
    alarms = cut(single.groupBy("text").agg(F.collect_list("at").alias("alarms")))
    # The same bytes that the fingerprint in tasks is made of.
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    if alarms.isEmpty():
        judged = keyed.withColumn("alarms", F.lit(None).cast("array<int>"))
    else:
        keyed = keyed.withColumn("print", F.arrow_udf(_fingerprint, "long")("text"))
        judged = keyed.join(alarms.select(F.col("text").alias("print"), "alarms").hint("shuffle_hash"), "print", "left").select("id", "text", "alarms")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return judged.mapInArrow(_cleaned(width, cells, shared, with_text), schema).withColumnRenamed("id", id_col)
