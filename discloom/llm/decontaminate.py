"""Benchmark decontamination by pigeonhole edit matching.

An item of L characters may occur with up to k = L * rate edits.  It is split
into k + 1 pieces, of which any such occurrence has at least one unchanged.
One automaton finds all pieces in a whole text; around each hit, Myers'
bit-parallel algorithm finds the least edit distance between the item and any
part of the text.

An item is searched for in time that grows with its length times that of the
text around its hits, divided by the bits of a machine word; periodic items of
many thousands of characters have many hits and are slow, not wrong.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discloom.llm.support import cut, fresh

#: Edits allowed for each character of an item.
RATE = 0.05
#: Bytes of items searched for at once, which take some 50 times as much in each
#: Python worker; a larger benchmark takes several passes.  Items whose masks a worker keeps.
ITEM_BYTES, KEPT_MASKS = 8 << 20, 4096
#: Letters and digits before this code point are of scripts that put spaces between words.
SPACED = 0x0E00


def normal(text: str) -> str:
    """Lower case, with single spaces."""
    return " ".join(text.lower().split())


def edits(item: str, text: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text``, and where that part ends."""
    m = len(item)
    if not m:
        return 0, 0
    masks = masks or _masks(item)
    every, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = every, 0, m
    best, at = m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (every & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & every, (down << 1) & every
        plus, minus = down | (every & ~(vertical | up)), up & vertical
        if score < best:
            best, at = score, i
    return best, at


def apart(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` cuts no word at either end."""

    def joined(at: int) -> bool:
        return 0 < at < len(text) and all(c.isalnum() and ord(c) < SPACED for c in text[at - 1 : at + 1])

    return not joined(start) and not joined(end)


def _masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Finds items in texts; ``items`` are normal texts, each with the keys of the texts it stands for."""

    def __init__(self, items: dict[str, list[str]], rate: float, whole_words: bool = False) -> None:
        self.items = [(text, int(len(text) * rate), keys) for text, keys in items.items()]
        self.whole_words = whole_words
        self.masks: dict[int, dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (text, k, _) in enumerate(self.items):
            cuts = [i * len(text) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.some = bool(pieces)

    def find(self, text: str, any_one: bool = False) -> list[tuple[int, int, int]]:
        """(item number, least distance, start) of all items within their budgets."""
        if not self.some:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - size - offset)
        found = []
        for n, at in sorted(starts.items()):
            if (hit := self._best(n, sorted(at), text)) is not None:
                found.append((n, *hit))
                if any_one:
                    break
        return found

    def _best(self, n: int, starts: list[int], text: str) -> tuple[int, int] | None:
        item, k, _ = self.items[n]
        strict = self.whole_words and not k
        for s in starts:
            if s >= 0 and text.startswith(item, s) and not (strict and not apart(text, s, s + len(item))):
                return 0, s
        if strict:
            return None
        if n not in self.masks:
            if len(self.masks) >= KEPT_MASKS:
                self.masks.clear()
            self.masks[n] = _masks(item)
        masks = self.masks[n]
        best, i = None, 0
        while i < len(starts):  # starts close to each other share one stretch of the text
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= k:
                j += 1
            low = max(0, starts[i] - k)
            distance, end = edits(item, text[low : starts[j] + len(item) + k], masks)
            if distance <= k and (best is None or distance < best[0]):
                # The part that matches is at most k longer or shorter than the item.
                best = distance, max(0, low + end - len(item))
            i = j + 1
        return best


def item_texts(benchmark: DataFrame, text: str) -> DataFrame:
    """The texts of the items that aren't null, with repeats, as ``text`` and its key ``h``."""
    return benchmark.select(F.col(text).alias("text"), F.md5(F.col(text).cast("binary")).alias("h")).filter("text is not null")


def slices(items: DataFrame, limit: int = ITEM_BYTES) -> int:
    """Number of slices of about ``limit`` bytes each; a longer item is in a slice of more."""
    total = items.distinct().agg(F.coalesce(F.sum(F.octet_length("text") + 48), F.lit(0))).first()[0]
    return max(1, -(-total // limit))


def item_slice(items: DataFrame, number: int, count: int) -> dict[str, list[str]]:
    """Normal texts of the items of a slice, each with the keys of the texts that it stands for.

    Equal texts come to the driver once.  Blank ones are left out: they occur nowhere.
    """
    own: dict[str, list[str]] = {}
    for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == number).distinct().orderBy("h").collect():  # about ``limit`` bytes
        if t := normal(r["text"]):
            own.setdefault(t, []).append(r["h"])
    return own


def _shared(spark: SparkSession, items: dict[str, list[str]], rate: float, whole_words: bool) -> tuple[Callable[[], Matcher], Broadcast]:
    """A way for tasks to get the matcher, built once in each Python process, and what is sent for it."""
    sent, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

    def get() -> Matcher:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Matcher(sent.value, rate, whole_words)
        return _BUILT[name]

    return get, sent


def _each_slice(benchmark: DataFrame, item_text: str, rate: float, item_bytes: int, whole_words: bool, search: Callable[[Callable[[], Matcher]], DataFrame]) -> tuple[DataFrame, int]:
    """What ``search`` finds with the matcher of each slice, together, and the number of slices.

    With several slices, what each finds is written before the next is sent; nothing else is.
    """
    items = item_texts(benchmark, item_text)
    count, found = slices(items, item_bytes), []
    for s in range(count):
        matcher, sent = _shared(benchmark.sparkSession, item_slice(items, s, count), rate, whole_words)
        own = search(matcher)
        if count > 1:
            own = cut(own)
            sent.unpersist()
        found.append(own)
    return reduce(DataFrame.unionByName, found), count


_BUILT: dict[str, Matcher] = {}


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    text: str = "text",
    id_col: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    item_bytes: int = ITEM_BYTES,
    whole_words: bool = False,
) -> DataFrame:
    """Which rows of ``docs`` hold which items: ``id_col, item_id, distance, budget, start``.

    One row for each row of ``docs`` and item found in it, with the least
    distance and where in the normal text (lower case, single spaces) that
    place begins, to within the budget.  An item too short for a budget is found
    anywhere, also inside words, or with ``whole_words`` only where it cuts no
    word.  Null and empty texts hold nothing, an empty benchmark finds nothing,
    items of equal text are all reported, and repeated rows are each reported.
    Texts of any length are searched whole.  Other columns are ignored.

    The documents are read once for each slice of the benchmark (``item_bytes``)
    and never written.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter("text is not null")

    def search(matcher: Callable[[], Matcher]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = matcher()
            for b in batches:
                at, rest = [], []
                for i, t in enumerate(b.column(1)):
                    for n, distance, start in m.find(normal(t.as_py())):
                        for key in m.items[n][2]:
                            at.append(i)
                            rest.append((key, distance, m.items[n][1], start))
                key, distance, budget, start = zip(*rest, strict=True) if rest else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int32())), pa.array(key, pa.string()), pa.array(distance, pa.int32()), pa.array(budget, pa.int32()), pa.array(start, pa.int64())],
                    ["id", "h", "distance", "budget", "start"],
                )

        return own.mapInArrow(run, f"id {kind}, h string, distance int, budget int, start long")

    found, _ = _each_slice(benchmark, item_text, rate, item_bytes, whole_words, search)
    named = benchmark.select(F.md5(F.col(item_text).cast("binary")).alias("h"), F.col(item_id).cast("long").alias("item_id")).filter("h is not null")
    return found.join(named, "h").select(F.col("id").alias(id_col), "item_id", "distance", "budget", "start")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    text: str = "text",
    item_text: str = "text",
    item_id: str = "item_id",
    item_bytes: int = ITEM_BYTES,
    whole_words: bool = False,
) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no item of the benchmark.

    Null and empty texts stay, as do all rows where the benchmark is empty.  Ids
    play no part: repeated rows go or stay together, and items without an id
    count.  Texts of any length are searched whole.  ``whole_words`` is as for
    :func:`contaminated`.

    With one slice this is a filter.  With more, the documents are read once for
    each, of which only the keys of contaminated texts are written, and these
    texts are taken away by one join at the end.
    """
    key = F.md5(F.col(text).cast("binary"))
    holds = []

    def search(matcher: Callable[[], Matcher]) -> DataFrame:
        holds.append(_holds(matcher)(F.col(text)))
        return docs.filter(holds[-1]).select(key.alias("h")).distinct()

    found, count = _each_slice(benchmark, item_text, rate, item_bytes, whole_words, search)
    if count == 1:
        return docs.filter(~holds[0])
    mark = fresh(docs, "contaminated_key")
    return docs.join(found.distinct().withColumnRenamed("h", mark), key == F.col(mark), "left_anti")


def _holds(matcher: Callable[[], Matcher]):
    def holds(texts: pa.Array) -> pa.Array:
        m = matcher()
        return pa.array([t.is_valid and bool(m.find(normal(t.as_py()), any_one=True)) for t in texts], pa.bool_())

    return F.arrow_udf(holds, "boolean")
