"""Maximal runs of repeated words by Crochemore's partition refinement.

1. Positions of a document are put in classes: in the classes of length l are
   the positions where equal factors of l words begin.
2. Classes of length l + 1 are refined from those of length l.  Where a class
   was split, only its smaller parts are worked on: the positions before them
   leave their own classes, what is left before the largest part stays.  Each
   position is moved a logarithmic number of times at most.
3. Members of a class are linked in order.  Two neighbours in a class of length
   l that are l words apart begin a square of period l, and its root is no
   power of a shorter one, as the class would have members in between.
4. Squares of one period that begin at neighbouring positions are one run.

A run of four periods or more has three or more members in each class that its
squares need, so classes with fewer are given up at once; this loses no such run.
All documents of a batch are refined together, length by length, in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloom.llm.wordcode import distinct_words, pieces, split_words

#: Runs are at least so many words long, and at least so many times their period.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Members that a class needs to show the squares of a run.
LEAST_MEMBERS = LEAST_EXPONENT - 1
#: Bytes of text that are refined together.
BATCH_BYTES = 1 << 22
#: Up to so many positions are moved one by one, which takes less time than vectors do.
FEW = 12


class Classes:
    """Positions in classes of equal factors, with links in order of position; class 0 is given up."""

    def __init__(self, ids: np.ndarray, first: np.ndarray) -> None:
        n, lengths = len(ids), np.diff(first)
        self.level = 1
        self.number = np.zeros(n, np.int32)
        self.next, self.before = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.since = np.ones(n, np.int32)  # length from which on the next member is what it is
        self.limit = np.repeat((lengths // LEAST_EXPONENT).astype(np.int32), lengths)
        self.begins = np.zeros(n, bool)
        self.begins[first[:-1][lengths > 0]] = True
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

        doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
        key = doc * (int(ids.max()) + 1 if n else 1) + ids
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if n else np.empty(0, np.int64)
        count = np.diff(np.append(start, n))
        live = count >= LEAST_MEMBERS
        named = np.where(live, np.cumsum(live), 0)
        self.used = int(live.sum()) + 1
        self.size, self.head = np.zeros(self.used, np.int32), np.full(self.used, -1, np.int32)
        self.size[named[live]], self.head[named[live]] = count[live], order[start[live]]
        self.number[order] = np.repeat(named, count)
        self._link(order[np.repeat(live, count)])
        # All letters of a document but its most frequent one are the first smaller parts.
        by_doc = np.lexsort((np.where(live, count, 0), doc[order[start]] if n else start))
        largest = by_doc[np.append(np.diff(doc[order[start]][by_doc]) != 0, True)] if n else by_doc
        small = np.ones(len(start), bool)
        small[largest[live[largest]]] = False
        ends = first[1:][lengths > 0] - 1  # what reaches over the end of a text recurs nowhere
        moved = order[np.repeat(small, count)]
        moved = moved[~self.begins[moved]]
        self.work = np.concatenate([moved - 1, ends])
        self.cause = np.concatenate([self.number[moved], np.zeros(len(ends), np.int32)])

    def _link(self, members: np.ndarray) -> None:
        """Link ``members``, whole classes one after the other, each in order of position."""
        same = self.number[members[1:]] == self.number[members[:-1]]
        self.next[members], self.before[members] = -1, -1
        self.next[members[:-1][same]] = members[1:][same]
        self.before[members[1:][same]] = members[:-1][same]

    def _squares(self, at: np.ndarray, upto: np.ndarray | int) -> None:
        """Note the squares that positions began until now, as their next member is to change."""
        gap = self.next[at] - at
        shown = (self.next[at] >= 0) & (gap >= self.since[at]) & (gap <= upto) & (gap <= self.limit[at])
        if shown.any():
            self.found.append((at[shown], gap[shown]))

    def _members(self, number: int) -> list[int]:
        at, found = int(self.head[number]), []
        while at >= 0:
            found.append(at)
            at = self.next.item(at)
        return found

    def refine(self) -> bool:
        """Go from one length to the next; false once nothing can change."""
        own = self.number[self.work]
        moving = (own > 0) & (self.limit[self.work] > self.level)
        at, own, cause = self.work[moving], own[moving], self.cause[moving]
        if not len(at):
            return False
        if len(at) <= FEW:
            self._refine_few(at.tolist(), own.tolist(), cause.tolist())
            return True
        order = np.lexsort((at, cause, own))
        at, own, cause = at[order], own[order], cause[order]
        # Parts: members of one class whose next words are in one smaller part.
        start = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (cause[1:] != cause[:-1])]))
        count = np.diff(np.append(start, len(at)))
        whole = np.concatenate([[True], own[start][1:] != own[start][:-1]])
        group, of = np.flatnonzero(whole), np.cumsum(whole) - 1
        parent = own[start][group]
        rest = self.size[parent] - np.add.reduceat(count, group)
        weight = np.where((cause[start] > 0) & (count >= LEAST_MEMBERS), count, 0)
        most = np.maximum.reduceat(weight, group)
        top = np.flatnonzero(weight == most[of])
        best = top[np.searchsorted(of[top], np.arange(len(group)))]
        # A class of which nothing is left keeps its largest part.
        leaves = np.ones(len(start), bool)
        leaves[best[(rest == 0) & (most > 0)]] = False
        gone = at[np.repeat(leaves, count)]
        if len(gone):
            self._take_out(gone, own[np.repeat(leaves, count)])
        self.size[parent] = np.where(rest > 0, rest, most)
        self._put_in(gone, leaves, weight, count)
        self.since[gone] = self.level + 1

        thin = parent[(rest > 0) & (rest < LEAST_MEMBERS)]
        fallen = [m for c in thin.tolist() for m in self._members(c)]
        if fallen:
            fallen = np.array(fallen, np.int64)
            self._squares(fallen, self.level)
            self.number[fallen] = 0
        # Next: all parts but the largest, and what was given up.
        kept_rest = (rest >= LEAST_MEMBERS) & (rest >= most)
        small = np.ones(len(start), bool)
        small[best[(most > 0) & ~kept_rest]] = False
        rests = parent[(rest >= LEAST_MEMBERS) & ~kept_rest]
        walked = [m for c in rests.tolist() for m in self._members(c)]
        moved = np.concatenate([at[np.repeat(small, count)], np.array(walked, np.int64), np.asarray(fallen, np.int64)])
        moved = moved[~self.begins[moved]]
        self.work, self.cause = moved - 1, self.number[moved]
        self.level += 1
        return True

    def _refine_few(self, at: list[int], own: list[int], cause: list[int]) -> None:
        """The same step for a few positions."""
        parts: dict[int, dict[int, list[int]]] = {}
        for i, c, k in sorted(zip(at, own, cause, strict=True)):
            parts.setdefault(c, {}).setdefault(k, []).append(i)
        moved: list[int] = []
        for c, groups in parts.items():
            rest = self.size.item(c) - sum(map(len, groups.values()))
            live = [k for k, members in groups.items() if k and len(members) >= LEAST_MEMBERS]
            best = max(live, key=lambda k: len(groups[k]), default=None)
            for k, members in groups.items():
                if rest or k != best:
                    for i in members:
                        self._take_one(i, c)
                    if k in live:
                        self._put_in(np.array(members), np.ones(1, bool), np.array([len(members)]), np.array([len(members)]))
                        self.since[members] = self.level + 1
                    else:
                        self.number[members] = 0
            self.size[c] = rest or (len(groups[best]) if live else 0)
            largest = best
            if 0 < rest < LEAST_MEMBERS:
                fallen = self._members(c)
                self._squares(np.array(fallen), self.level)
                self.number[fallen] = 0
                moved += fallen
            elif rest:
                if best is None or rest >= len(groups[best]):
                    largest = None
                else:
                    moved += self._members(c)
            for k, members in groups.items():
                if k != largest or largest is None:
                    moved += members
        self.work = np.array([i - 1 for i in moved if not self.begins.item(i)], np.int64)
        self.cause = self.number[self.work + 1]
        self.level += 1

    def _take_one(self, i: int, own: int) -> None:
        left, right = self.before.item(i), self.next.item(i)
        for j in (i, left):
            gap = self.next.item(j) - j if j >= 0 else -1
            if self.since.item(j) <= gap <= min(self.level, self.limit.item(j)):
                self.found.append((np.array([j]), np.array([gap])))
        if left < 0:
            self.head[own] = right
        else:
            self.next[left] = right
            self.since[left] = self.level + 1
        if right >= 0:
            self.before[right] = left

    def _take_out(self, gone: np.ndarray, own: np.ndarray) -> None:
        """Take positions out of their classes' links; neighbours among them go as one chain."""
        self._squares(gone, self.level)
        order = np.lexsort((gone, own))
        gone, own = gone[order], own[order]
        cut = np.concatenate([[True], self.next[gone[:-1]] != gone[1:]])
        low = np.flatnonzero(cut)
        high = np.append(low[1:], len(gone)) - 1
        left, right = self.before[gone[low]], self.next[gone[high]]
        inner = left[left >= 0]
        self._squares(inner, self.level)
        self.next[inner] = right[left >= 0]
        self.since[inner] = self.level + 1
        self.head[own[low][left < 0]] = right[left < 0]
        self.before[right[right >= 0]] = left[right >= 0]

    def _put_in(self, gone: np.ndarray, leaves: np.ndarray, weight: np.ndarray, count: np.ndarray) -> None:
        """Make classes of the parts that left; those too small are given up."""
        weight, count = weight[leaves], count[leaves]
        live = weight > 0
        fresh = int(live.sum())
        while self.used + fresh > len(self.size):
            self.size = np.concatenate([self.size, np.zeros(len(self.size) + 16, np.int32)])
            self.head = np.concatenate([self.head, np.full(len(self.head) + 16, -1, np.int32)])
        named = np.where(live, self.used + np.cumsum(live) - 1, 0)
        self.used += fresh
        self.number[gone] = np.repeat(named, count)
        self.size[named[live]] = count[live]
        self.head[named[live]] = gone[(np.cumsum(count) - count)[live]]
        self._link(gone)

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and periods of the squares that were found."""
        while self.refine():
            pass
        left = np.flatnonzero((self.number > 0) & (self.next >= 0))
        self._squares(left, self.limit[left])
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, period = (np.concatenate(x).astype(np.int64) for x in zip(*self.found, strict=True))
        return at, period


def find_runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of documents given by word numbers and where each begins.

    Starts count from the first word of all; runs are in order of start and period.
    """
    at, period = Classes(ids, first).squares()
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(at)) - 1
    start, period = at[low], period[low]
    length = at[high] - start + 2 * period if len(low) else start
    long = (length >= LEAST_LENGTH) & (length >= LEAST_EXPONENT * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for b in batches:
        for low, high, data, bounds in pieces(b.column(1), BATCH_BYTES):
            w = split_words(data, bounds)
            start, length, period = find_runs(distinct_words(data, w.start, w.end)[0], w.first)
            # Words after a run's first period go.
            change = np.zeros(len(w.start) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            # Each word that stays brings the separator before it, which becomes a space.
            text, change = data.copy(), np.zeros(len(data) + 1, np.int8)
            ahead = np.ones(len(kept), np.int64)
            ahead[np.flatnonzero(np.append(True, np.diff(w.doc[kept]) != 0)[: len(kept)])] = 0
            text[(w.start[kept] - 1)[ahead > 0]] = 0x20
            change[w.start[kept] - ahead] += 1
            change[w.end[kept]] -= 1
            stays = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
            size = np.concatenate([[0], np.cumsum(stays)])
            offsets = size[bounds].astype(np.int64)
            texts = pa.Array.from_buffers(pa.large_string(), high - low, [None, pa.py_buffer(offsets), pa.py_buffer(text[stays])])
            doc = w.doc[start] if len(start) else start
            runs = pa.StructArray.from_arrays([pa.array(start - w.first[doc] if len(start) else start), pa.array(length), pa.array(period)], fields=list(run_type))
            each = pa.array(np.searchsorted(doc, np.arange(high - low + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(low, high - low), pa.array(np.diff(w.first)), pa.ListArray.from_arrays(each, runs), pc.cast(texts, pa.string())],
                ["id", "n_words", "runs", "collapsed"],
            )


def collapse_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, n_words, runs, collapsed`` of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte.  ``runs`` lists
    every ``struct<start, length, period>`` in order of start and period: a
    stretch of words with that smallest period, at least 6 words and 4 periods
    long, which no neighbouring word extends; starts count from 0.
    ``collapsed`` is the text, joined by single spaces, without the words that
    come after the first period of any run.  Null and empty texts have no words,
    no runs and an empty text.  Whole texts are worked on, one at a time where
    they are long; time grows with n log n.  Rows stay where they are, so it
    doesn't matter if ids are null, repeated or frequent; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    found = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_collapse, schema)
    return found.withColumnRenamed("id", id_col)
