"""Word, shingle and window codes of whole texts, computed on Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``.  All separators are single ASCII bytes, so
the UTF-8 buffer of an Arrow string column can be split without decoding it.

Codes that tell words apart (:func:`word_prints`) mix after each eight bytes, and
codes of runs of words (:func:`run_prints`) at each doubling; neither is linear in
what it is made of, so that no known words or runs have equal codes.
Codes of features (:class:`Coder`) are 64-bit polynomial hashes from prefix sums
modulo 2**64, which cost a few vector operations per byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[ord("A") : ord("Z") + 1] += 32
#: Masks of the first bytes of eight, none to all.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Bytes above which words are hashed one by one.
LONG_WORD = 512
#: Bytes of text worked on at once; arrays of eight bytes for each are made.
CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser that spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int) -> None:
        self.base = int(random_words(seed, 1)[0]) | 1
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            step = np.full(size, self.base, U64)
            back = np.full(size, pow(self.base, -1, 1 << 64), U64)
            step[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(step), np.multiply.accumulate(back)
        return self.up[:n], self.down[:n]


class Coder:
    """One family of hashes of words by their bytes, for features: some words of a thousand letters and more share a code."""

    def __init__(self, seed: int) -> None:
        self.letters = random_words(seed, 256)
        self.byte_powers = Powers(seed + 1)
        self.salt = random_words(seed + 3, 1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Codes of byte spans, which may overlap.

        Prefix sums are taken over ``CHUNK_BYTES`` at a time and looked up at
        the spans' edges, so time and memory are linear whatever their lengths.
        """
        if not len(starts):
            return np.empty(0, U64)
        apart = bool((ends[:-1] <= starts[1:]).all())  # as words are: their edges are in order as they stand
        edges = np.stack([starts, ends], 1).ravel() if apart else np.sort(np.concatenate([starts, ends]))
        low, high = int(edges[0]), int(edges[-1])
        sums, back = np.empty(len(edges), U64), np.empty(len(edges), U64)
        total, scale = U64(0), 1  # sum of all before this chunk; power of the base at its beginning
        while True:
            part = data[low : min(low + CHUNK_BYTES, high)]
            a, b = np.searchsorted(edges, [low, low + CHUNK_BYTES]) if low + CHUNK_BYTES < high else (np.searchsorted(edges, low), len(edges))
            up, down = self.byte_powers.upto(len(part) + 1)
            run = np.zeros(len(part) + 1, U64)
            np.cumsum(self.letters[part] * up[:-1], out=run[1:])
            run = run * U64(scale) + total
            at = edges[a:b] - low
            sums[a:b], back[a:b] = run[at], down[at] * U64(pow(scale, -1, 1 << 64))
            if b == len(edges):
                break
            total, scale, low = run[-1], scale * pow(self.byte_powers.base, len(part), 1 << 64) % (1 << 64), low + CHUNK_BYTES
        first = np.arange(0, len(edges), 2) if apart else np.searchsorted(edges, starts)
        last = first + 1 if apart else np.searchsorted(edges, ends)
        return mix64((sums[last] - sums[first]) * back[first] + (ends - starts).astype(U64) * self.salt)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, and the distinct words; ``starts`` and ``ends`` in order, not overlapping."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit codes of each word.

    Eight bytes at a time are mixed into what came before; words of more than
    ``LONG_WORD`` bytes are hashed one by one.
    """
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    salts = random_words(seed, 2)
    one, two = (mix64(size.astype(U64) + salt) for salt in salts)
    live, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(live):
        x = eights[starts[live] + at] & FIRST_BYTES[np.minimum(size[live] - at, 8)]
        one[live] = mix64(one[live] ^ x)
        two[live] = mix64(two[live] ^ (x * U64(0xD6E8FEB86659FD93)))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        hashed = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, salt=salts.tobytes()).digest()
        one[i], two[i] = np.frombuffer(hashed, U64)
    return one, two


def run_prints(codes: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width, codes of all runs of so many consecutive words; widths in ascending order.

    A run of 2 n words is coded from its halves, any other from two runs that
    overlap; what two codes make is mixed before it is used again.
    """

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((a ^ U64(0xD6E8FEB86659FD93)) * U64(0xA0761D6478BD642F) + b)

    found, have = [], 1
    for width in widths:
        while 2 * have <= width:
            codes, have = joined(codes[:-have], codes[have:]), 2 * have
        step = width - have
        found.append(codes if not step else joined(codes[:-step], codes[step:]))
    return found


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(bounds):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with about ``limit`` bytes: first, last, bytes, offsets."""
    data, bounds = flat(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1)
        yield low, high, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


@dataclass
class Words:
    """Words of some documents, in order: byte spans and document numbers."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # number of the first word of each document, one more at the end


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    keep = ~IS_SEPARATOR[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = keep[:-1], keep[1:]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    start, end = np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1
    first = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(start, end, doc, first)
