"""Decoder of losslessly compressed one-bit audio frames, many frames at a time.

The format is that of the published standard for lossless coding of oversampled
audio (ISO/IEC 14496-3, subpart 10).  A frame of 1/75 s says how its channels are
cut into segments, which prediction filter and which table of probabilities each
segment uses, and then holds one arithmetic code of all channels' prediction
errors, bit by bit.  Each bit needs all bits before it, so a frame can't be cut;
but frames don't depend on each other.  The decoder therefore takes one step of
all frames of a batch at once, in NumPy: the bits of one sample of every frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Bits of a channel in a frame: 2 822 400 bits a second, 75 frames a second.
FRAME_BITS = 37_632
MOST_CHANNELS = 6
# Fixed values of the format: prediction of coefficients and of probabilities from those before them, by method.
FILTER_METHODS = ((-8,), (-16, 8), (-9, -5, 6))
TABLE_METHODS = ((-8,), (-16, 8), (-24, 24, -8))
FILTER_SEGMENTS, LEAST_FILTER_SEGMENT = 4, 1024
TABLE_SEGMENTS, LEAST_TABLE_SEGMENT = 8, 32
CODE_BITS = 12
#: Bits to shift until a 12-bit interval is at least half of its range.
SHIFTS = np.array([CODE_BITS] + [CODE_BITS - n.bit_length() for n in range(1, 1 << CODE_BITS)], np.int64)
#: The 256th part of an interval, whose last bit is also set where the next one is.
PARTS = np.arange(1 << CODE_BITS) >> 8 | np.arange(1 << CODE_BITS) >> 7 & 1
ONES = (1 << np.arange(CODE_BITS + 1)) - 1
#: Probabilities of a table, filled up with its last one.
TABLE_LENGTH = 64
#: Signs of the bits of all bytes, last bit first.
SIGNS = (np.arange(256) >> np.arange(8)[:, None] & 1) * 2 - 1


class Bits:
    """Reads bits of a frame, first bits first."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int = 1) -> int:
        if n > self.left:
            raise ValueError("it ends within its description")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (value >> n - 1 << n)

    def rice(self, low_bits: int) -> int:
        high = 0
        while not self.take():
            high += 1
        value = high << low_bits | self.take(low_bits)
        return -value if value and self.take() else value


@dataclass
class Frame:
    """A frame's description; ends of segments in bits, one list for each channel, each with its filter or table."""

    filters: list[list[int]]
    tables: list[list[int]]
    filter_segments: list[list[tuple[int, int]]]
    table_segments: list[list[tuple[int, int]]]
    half: list[bool]
    code_at: int


def _segments(bits: Bits, channels: int, most: int, least: int) -> list[list[int]]:
    """Where each channel's segments end."""
    size, resolution = FRAME_BITS // 8, 0
    same, ends = bits.take(), []
    for _ in range(1 if same else channels):
        own, begin = [], 0
        while not bits.take():
            if len(own) + 1 >= most:
                raise ValueError("it has too many segments")
            if not resolution:
                resolution = bits.take((size - least // 8).bit_length())
                if not 0 < resolution <= size - least // 8:
                    raise ValueError("its segments have no resolution")
            length = 8 * resolution * bits.take(((size - least // 8 - begin // 8) // resolution).bit_length())
            if length < least or begin + length > FRAME_BITS - least:
                raise ValueError("its segments are too short or too long")
            begin += length
            own.append(begin)
        ends.append([*own, FRAME_BITS])
    return ends * channels if same else ends


def _mapped(bits: Bits, ends: list[list[int]]) -> tuple[list[list[tuple[int, int]]], int]:
    """Each segment's number of a filter or table, and how many there are."""
    known, out = 0, []
    same = bits.take()
    if same and len({len(e) for e in ends}) > 1:
        raise ValueError("its channels share numbers but not segments")
    for own in ends[:1] if same else ends:
        numbered = []
        for end in own:
            number = bits.take(known.bit_length()) if known else 0
            if number > known:
                raise ValueError("its numbers of filters or tables have gaps")
            known += number == known
            numbered.append((end, number))
        out.append(numbered)
    if known > 2 * len(ends):
        raise ValueError("it has too many filters or tables")
    return (out * len(ends) if same else out), known


def _coefficients(bits: Bits, length: int, methods: tuple[tuple[int, ...], ...], one: Callable[[], int], low: int, high: int) -> list[int]:
    """A filter's coefficients or a table's probabilities, as they are or as differences from what those before foretell."""
    if not bits.take():
        return [one() for _ in range(length)]
    method = bits.take(2)
    if method >= len(methods) or len(methods[method]) > length:
        raise ValueError("its coefficients have no known method")
    weights = methods[method]
    out = [one() for _ in weights]
    low_bits = bits.take(3)
    while len(out) < length:
        foretold = sum(w * x for w, x in zip(weights, reversed(out), strict=False))
        value = bits.rice(low_bits) + (-((foretold + 4) // 8) if foretold >= 0 else (-foretold + 3) // 8)
        if not low <= value <= high:
            raise ValueError("its coefficients are out of range")
        out.append(value)
    return out


def describe(data: bytes, channels: int) -> Frame | None:
    """The description of a compressed frame; None of one that holds its samples as they are."""
    bits = Bits(data)
    if not bits.take():
        bits.take()
        if bits.take(6):
            raise ValueError("its reserved bits aren't zero")
        if len(data) - 1 < FRAME_BITS // 8 * channels:
            raise ValueError("it has too few samples")
        return None
    same = bits.take()
    filter_ends = _segments(bits, channels, FILTER_SEGMENTS, LEAST_FILTER_SEGMENT)
    table_ends = filter_ends if same else _segments(bits, channels, TABLE_SEGMENTS, LEAST_TABLE_SEGMENT)
    same = bits.take()
    filter_segments, n_filters = _mapped(bits, filter_ends)
    if same:
        if filter_ends != table_ends:
            raise ValueError("its tables share numbers with filters but not segments")
        table_segments, n_tables = filter_segments, n_filters
    else:
        table_segments, n_tables = _mapped(bits, table_ends)
    half = [bool(bits.take()) for _ in range(channels)]
    filters = [_coefficients(bits, bits.take(7) + 1, FILTER_METHODS, lambda: bits.signed(9), -256, 255) for _ in range(n_filters)]
    tables = []
    for _ in range(n_tables):
        length = bits.take(6) + 1
        tables.append(_coefficients(bits, length, TABLE_METHODS, lambda: bits.take(7) + 1, 1, 128) if length > 1 else [128])
    if bits.take():
        raise ValueError("its code doesn't begin with zero")
    return Frame(filters, tables, filter_segments, table_segments, half, 8 * len(data) - bits.left)


def decode_frames(frames: list[bytes], channels: int) -> list[bytes]:
    """Samples of frames: a byte of each channel in turn, first bits first.

    A malformed frame is an error that names its place in ``frames``.
    """
    if not 1 <= channels <= MOST_CHANNELS:
        raise ValueError(f"frames of {channels} channels")
    size = FRAME_BITS // 8 * channels
    out: list[bytes] = [b""] * len(frames)
    packed, described = [], []
    for i, data in enumerate(frames):
        try:
            frame = describe(data, channels)
        except ValueError as e:
            raise ValueError(f"frame {i} is malformed: {e}") from None
        if frame is None:
            out[i] = data[1 : 1 + size]
        else:
            packed.append(i)
            described.append(frame)
    if packed:
        for i, samples in zip(packed, _decode([frames[i] for i in packed], described, channels), strict=True):
            out[i] = samples.tobytes()
    return out


def _decode(frames: list[bytes], described: list[Frame], channels: int) -> np.ndarray:
    n = len(frames)
    # The code as 32-bit words that begin at each byte; zeros follow the end, enough for eight bits of all channels.
    width = max(map(len, frames)) + 12 * channels + 8
    padded = np.zeros((n, width + 4), np.uint8)
    for i, data in enumerate(frames):
        padded[i, : len(data)] = np.frombuffer(data, np.uint8)
    words = (padded[:, :-4].astype(np.int64) << 24 | padded[:, 1:-3].astype(np.int64) << 16 | padded[:, 2:-2].astype(np.int64) << 8 | padded[:, 3:-1]).ravel()
    row = np.arange(n) * width * 8
    place = row + np.array([f.code_at for f in described])
    ends = row + np.array([8 * len(x) + 8 for x in frames])

    # What each byte of the past adds to a prediction, for all filters; and all tables.
    filters, tables = [f for d in described for f in d.filters], [t for d in described for t in d.tables]
    taps = np.zeros((len(filters), 128), np.int32)
    for i, f in enumerate(filters):
        taps[i, : len(f)] = f
    adds = (taps.reshape(-1, 8) @ SIGNS).astype(np.int64).ravel()
    chances = np.array([(t + [t[-1]] * TABLE_LENGTH)[:TABLE_LENGTH] for t in tables], np.int64).ravel()
    first_filter = np.concatenate([[0], np.cumsum([len(d.filters) for d in described])])
    first_table = np.concatenate([[0], np.cumsum([len(d.tables) for d in described])])
    taps_bytes = -(-max(map(len, filters)) // 8)  # bytes of the past that any filter looks at
    taps_at = np.empty((taps_bytes, channels, n), np.int64)
    chances_at = np.empty((channels, n), np.int64)
    half = np.zeros((channels, n), np.int64)
    changes: dict[int, list[tuple[bool, int, int, int]]] = {}
    for b, d in enumerate(described):
        for c in range(channels):
            begin = 0
            for end, number in d.filter_segments[c]:
                changes.setdefault(begin, []).append((True, b, c, int(first_filter[b]) + number))
                begin = end
            begin = 0
            for end, number in d.table_segments[c]:
                changes.setdefault(begin, []).append((False, b, c, int(first_table[b]) + number))
                begin = end
            if d.half[c]:
                half[c, b] = len(d.filters[d.filter_segments[c][0][1]])
    most_half = int(half.max())

    past = np.full((2, channels, n), 0xAAAAAAAAAAAAAAAA, np.uint64)
    past_bytes = past.view(np.uint8).reshape(2, channels, n, 8)  # the latest first
    lately = [past_bytes[k // 8, :, :, k % 8] for k in range(taps_bytes)]
    out = np.empty((FRAME_BITS // 8, channels, n), np.uint8)
    interval = np.full(n, (1 << CODE_BITS) - 1, np.int64)
    code = words[place >> 3] >> (32 - CODE_BITS - (place & 7)) & ((1 << CODE_BITS) - 1)
    place += CODE_BITS
    upper, lower, shift, at, more = (np.empty(n, np.int64) for _ in range(5))
    low = np.empty(n, bool)

    def bit(chance: np.ndarray) -> np.ndarray:
        """One bit of each frame's code; true is the lower part of the interval."""
        np.multiply(PARTS.take(interval, out=upper, mode="clip"), chance, out=upper)
        np.subtract(interval, upper, out=lower)
        np.less(code, lower, out=low)
        np.copyto(interval, upper)
        np.copyto(interval, lower, where=low)
        np.copyto(lower, 0, where=low)
        np.subtract(code, lower, out=code)
        SHIFTS.take(interval, out=shift, mode="clip")
        np.left_shift(interval, shift, out=interval)
        np.left_shift(code, shift, out=code)
        words.take(np.right_shift(place, 3, out=at), out=more, mode="clip")
        np.add(np.bitwise_and(place, 7, out=at), shift, out=at)
        np.right_shift(more, np.subtract(32, at, out=at), out=more)
        np.bitwise_or(code, np.bitwise_and(more, ONES.take(shift, out=at, mode="clip"), out=more), out=code)
        np.add(place, shift, out=place)
        return low

    first = np.array([d.filters[0][0] & 127 for d in described])
    bit(np.array([int(f"{x:07b}"[::-1], 2) + 1 for x in range(128)])[first])
    one, last = np.uint64(1), np.uint64(63)
    values = np.empty((channels, n), bool)
    index, foretold = np.empty((channels, n), np.int64), np.empty((channels, n), np.int64)
    added, chance = np.empty((channels, n), np.int64), np.empty(n, np.int64)
    carry = np.empty((channels, n), np.uint64)
    for i in range(FRAME_BITS):
        if i in changes:
            for is_filter, b, c, number in changes[i]:
                if is_filter:
                    taps_at[:, c, b] = number * 4096 + 256 * np.arange(taps_bytes)
                else:
                    chances_at[c, b] = number * TABLE_LENGTH
        foretold[:] = 0
        for k in range(taps_bytes):
            adds.take(np.add(taps_at[k], lately[k], out=index), out=added, mode="clip")
            np.add(foretold, added, out=foretold)
        np.less(foretold, 0, out=values)
        np.right_shift(np.abs(foretold, out=foretold), 3, out=foretold)
        np.minimum(foretold, TABLE_LENGTH - 1, out=foretold)
        np.add(foretold, chances_at, out=foretold)
        for c in range(channels):
            chances.take(foretold[c], out=chance, mode="clip")
            if i < most_half:
                np.copyto(chance, 128, where=i < half[c])
            np.bitwise_xor(values[c], bit(chance), out=values[c])
        np.right_shift(past[0], last, out=carry)
        np.left_shift(past, one, out=past)
        np.bitwise_or(past[1], carry, out=past[1])
        np.bitwise_or(past[0], values, out=past[0])
        if i & 7 == 7:
            out[i >> 3] = past_bytes[0, :, :, 0]
            np.minimum(place, ends, out=place)  # zeros at the end of a code may be left out
    return np.ascontiguousarray(out.transpose(2, 0, 1))


class Decoder:
    """Decodes frames of a number of channels, one by one or, which is much faster for each, many at once."""

    def __init__(self, channels: int) -> None:
        self.channels = channels

    def __call__(self, frame: bytes) -> bytes:
        return self.many([frame])[0]

    def many(self, frames: list[bytes]) -> list[bytes]:
        return decode_frames(frames, self.channels)
