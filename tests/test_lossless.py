"""An encoder written for these tests, from the format's rules and apart from the decoder, makes frames to decode."""

import random

import numpy as np
import pytest

from discloom.operators import lossless, pcm

BITS = lossless.FRAME_BITS
#: A frame of silence as a disc holds it.
SILENCE = bytes([0xFF, 0x06, 0x00, 0x80, 0x38, 0x10, 0x10, 0x60, 0x01, 0x49, 0x80])


class Code:
    """The arithmetic code of bits, as the least number in the last interval."""

    def __init__(self):
        self.low, self.size, self.bits = 0, 4095, 12

    def put(self, bit, chance):
        k = (self.size >> 8) | ((self.size >> 7) & 1)
        upper = k * chance
        if bit:
            self.size -= upper
        else:
            self.low += self.size - upper
            self.size = upper
        while self.size < 2048:
            self.size, self.low, self.bits = 2 * self.size, 2 * self.low, self.bits + 1


def binary(value, n):
    return format(value & ((1 << n) - 1), f"0{n}b")


def rice(value, m):
    low = binary(abs(value), m) if m else ""
    return "0" * (abs(value) >> m) + "1" + low + (("1" if value < 0 else "0") if value else "")


def coefficients(values, width, offset, weights):
    """``values`` as they are, or by what ``weights`` foretell."""
    if weights is None or len(values) < len(weights):
        return "0" + "".join(binary(v - offset, width) for v in values)
    out = "1" + binary(len(weights) - 1, 2) + "".join(binary(v - offset, width) for v in values[: len(weights)]) + binary(3, 3)
    for i in range(len(weights), len(values)):
        x = sum(w * values[i - 1 - k] for k, w in enumerate(weights))
        guess = -int((x + 4) / 8) if x >= 0 else int((-x + 3) / 8)
        out += rice(values[i] - guess, 3)
    return out


def segments(ends, least, resolution, same):
    """Ends of segments in bits, a list for each channel."""
    out, told = str(int(same)), False
    for own in ends[:1] if same else ends:
        begin = 0
        for end in own[:-1]:
            room = BITS // 8 - least // 8
            out += "0" + ("" if told else binary(resolution, room.bit_length()))
            told = True
            out += binary((end - begin) // 8 // resolution, ((room - begin // 8) // resolution).bit_length())
            begin = end
        out += "1"
    return out


def mapped(numbers, same):
    out, known, first = str(int(same)), 0, True
    for own in numbers[:1] if same else numbers:
        for n in own:
            out += "" if first else binary(n, known.bit_length())
            known, first = max(known, n + 1), False
    return out


def encode(samples, filters, tables, half, filter_map=None, table_map=None, filter_ends=None, table_ends=None, weights=(None, None), resolution=8):
    """A frame of ``samples (bits, channels)``."""
    channels = samples.shape[1]
    filter_ends, table_ends = filter_ends or [[BITS]] * channels, table_ends or [[BITS]] * channels
    filter_map, table_map = filter_map or [[0]] * channels, table_map or [[0]] * channels
    alike = lambda x: all(y == x[0] for y in x)
    head = "1"
    head += str(int(filter_ends == table_ends)) + segments(filter_ends, 1024, resolution, alike(filter_ends))
    if filter_ends != table_ends:
        head += segments(table_ends, 32, resolution, alike(table_ends))
    shared = filter_map == table_map and filter_ends == table_ends
    head += str(int(shared)) + mapped(filter_map, alike(filter_map) and alike(filter_ends))
    if not shared:
        head += mapped(table_map, alike(table_map) and alike(table_ends))
    head += "".join(str(int(h)) for h in half)
    for f in filters:
        head += binary(len(f) - 1, 7) + coefficients(f, 9, 0, weights[0])
    for t in tables:
        head += binary(len(t) - 1, 6) + (coefficients(t, 7, 1, weights[1]) if len(t) > 1 else "")
    head += "0"

    taps = [np.array(f) for f in filters]
    pasts = [np.array([(-1) ** (k + 1) for k in range(BITS + 128)]) for _ in range(channels)]
    for c in range(channels):  # latest first: position BITS + k is k + 1 samples before the frame
        pasts[c][:BITS] = 2 * samples[::-1, c] - 1
    code = Code()
    code.put(0, int(binary(filters[0][0], 7)[::-1], 2) + 1)
    at = lambda ends, i: next(k for k, e in enumerate(ends) if i < e)
    for i in range(BITS):
        for c in range(channels):
            f = filter_map[c][at(filter_ends[c], i)]
            t = tables[table_map[c][at(table_ends[c], i)]]
            begin = BITS - i
            foretold = int(taps[f] @ pasts[c][begin : begin + len(taps[f])])
            chance = t[min(abs(foretold) >> 3, len(t) - 1)]
            if half[c] and i < len(filters[filter_map[c][0]]):
                chance = 128
            code.put(int(samples[i, c]) ^ int(foretold < 0), chance)
    text = head + binary(code.low, code.bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def packed(samples):
    return np.packbits(samples.reshape(BITS // 8, 8, -1), axis=1).reshape(BITS // 8, -1).tobytes()


def noise(rng, channels):
    return rng.integers(0, 2, (BITS, channels))


def tone(rng, channels):
    """One-bit sound: the running error of a wave decides each bit."""
    out, error = np.empty((BITS, channels), np.int64), np.zeros(channels)
    for i in range(BITS):
        wave = 0.5 * np.sin(i / 900 + np.arange(channels))
        out[i] = error + wave > 0
        error += wave - (2 * out[i] - 1)
    return out


def test_a_frame_of_a_disc_is_silence():
    """One pattern of as many ones as zeros, to the end: nothing but the right decoder makes it of these eleven bytes."""
    assert lossless.decode_frames([SILENCE], 2) == [b"\xd2" * 9408]


def test_frames_come_back():
    rng = np.random.default_rng(1)
    a, b, c = noise(rng, 2), tone(rng, 2), tone(rng, 2)
    spread = [int(x) for x in rng.integers(-60, 60, 40)]
    table = [128, 100, 80, 40, 20, 9, 3, 1]
    frames = [
        encode(a, [[5, -3, 250, -256]], [[128]], [False, False]),
        encode(b, [[64, 32, -8], spread], [table, [90] * 20], [True, False], filter_map=[[0], [1]], table_map=[[0], [1]], weights=((-16, 8), (-8,))),
        SILENCE,
        b"\x00" + packed(a),
        encode(
            c, [[100], spread, [1] * 128], [table, [60, 50], [128]], [True, True],
            filter_ends=[[8000, BITS], [BITS]], filter_map=[[0, 1], [2]], table_ends=[[32 * 8, 16_000, BITS], [64, BITS]], table_map=[[0, 1, 0], [2, 1]], weights=((-9, -5, 6), None), resolution=4,
        ),
        b"\x40" + packed(b) + b"more",
    ]
    want = [packed(a), packed(b), b"\xd2" * 9408, packed(a), packed(c), packed(b)]
    assert lossless.decode_frames(frames, 2) == want
    assert lossless.Decoder(2)(frames[1]) == want[1]


def test_six_channels():
    rng = np.random.default_rng(2)
    x = tone(rng, 6)
    same = encode(x, [[60, 30, -9, 4]], [[120, 60, 30, 10, 2]], [True] * 6, weights=((-8,), (-24, 24, -8)))
    assert lossless.decode_frames([same], 6) == [packed(x)]


@pytest.mark.parametrize(
    ("data", "why"),
    [
        (b"", "within its description"),
        (b"\xff", "within its description"),
        (b"\x01" + bytes(9408), "reserved"),
        (b"\x00" + bytes(9407), "too few samples"),
        (bytes([0xFF, 0x06, 0x00, 0x80, 0x38, 0x10, 0x10, 0x60, 0x01, 0xC9, 0x80]), "begin with zero"),
        (bytes([0xFF, 0x07, 0xC0, 0x00]), "no known method"),
    ],
)
def test_malformed_frames_are_errors(data, why):
    with pytest.raises(ValueError, match=f"frame 1 is malformed: .*{why}"):
        lossless.decode_frames([SILENCE, data], 2)


def test_noise_never_hangs():
    rng = random.Random(4)
    for _ in range(300):
        try:
            lossless.describe(bytes([0xC0 | rng.randrange(64)]) + rng.randbytes(60), 2)
        except ValueError:
            continue


def test_tables_of_frames(spark):
    rows = [(i, 2, SILENCE if i % 3 else None) for i in range(20)] + [(20, 1, b"\x00" + b"\x69" * 4704)]
    df = spark.createDataFrame(rows, "n int, channels int, raw binary").coalesce(2)
    got = {r.n: r.raw for r in pcm.decode(df, lossless.Decoder).collect()}
    assert got == {n: None if raw is None else b"\x69" * 4704 if c == 1 else b"\xd2" * 9408 for n, c, raw in rows}
