"""Column functions over BINARY values: integers, texts, bits and PCM bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The hexadecimal digits 0 to F with their four bits reversed.
REVERSED_DIGITS = "084C2A6E195D3B7F"
#: Every byte with its bits reversed.
REVERSED_BYTES = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel()


def part(data: Column, offset, size) -> Column:
    """``size`` bytes from ``offset``, counted from 0; both may be columns."""
    at = offset + 1 if isinstance(offset, Column) else F.lit(offset + 1)
    return F.substring(data, at, size if isinstance(size, Column) else F.lit(size))


def be_uint(data: Column, offset, size: int) -> Column:
    """Unsigned big-endian integer as BIGINT; null where the bytes are missing."""
    own = part(data, offset, size)
    value = F.conv(F.hex(own), 16, 10).cast("long")
    return F.when(F.length(own) == size, value)


def be_bytes(value: Column, size: int) -> Column:
    """An integer in big-endian bytes, cut to ``size`` bytes."""
    digits = F.lpad(F.hex(value.cast("long")), max(16, size * 2), "0")
    return F.unhex(F.right(digits, F.lit(size * 2)))


def le_bytes(value: Column, size: int) -> Column:
    """An integer in little-endian bytes."""
    digits = F.hex(be_bytes(value, size))
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]
    return F.unhex(F.concat(*pairs))


def sync_safe(value: Column) -> Column:
    """A 28-bit integer as four bytes of seven bits."""
    groups = [F.shiftright(value.cast("int"), 7 * i).bitwiseAND(0x7F) for i in (3, 2, 1, 0)]
    return F.concat(*(be_bytes(g, 1) for g in groups))


def bits(value: Column, low: int, count: int) -> Column:
    """``count`` bits of an integer from bit ``low``."""
    return F.shiftright(value, low).bitwiseAND((1 << count) - 1)


def reverse_bits(data: Column) -> Column:
    """Every byte with its bits in opposite order."""
    digits = F.translate(F.hex(data), "0123456789ABCDEF", REVERSED_DIGITS)
    return F.unhex(F.regexp_replace(digits, "(.)(.)", "$2$1"))


def before_nul(data: Column) -> Column:
    """The bytes before the first NUL, or all of them."""
    digits = F.hex(data)
    return F.unhex(F.regexp_extract(digits, "^((?:(?!00)..)*)", 1))


def strict_text(data: Column, offset) -> Column:
    """NUL-ended UTF-8 at an offset; null if the offset is 0 or the bytes aren't UTF-8. Not trimmed."""
    own = F.expr("1=1") & (offset > 0) & (offset < F.length(data))
    return F.when(own, F.try_validate_utf8(before_nul(part(data, offset, F.length(data) - offset)).cast("string")))


def lossy_text(data: Column) -> Column:
    """NUL-ended text with replacement characters for what isn't UTF-8. Not trimmed."""
    return F.make_valid_utf8(before_nul(data).cast("string"))


def trimmed(text: Column) -> Column:
    """Without white space at the ends, whatever Unicode's kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lossy_field(data: Column) -> Column:
    """Fixed-length text: lossy UTF-8 without NULs at its end, trimmed."""
    return trimmed(F.regexp_replace(F.make_valid_utf8(data.cast("string")), "\\x00+$", ""))


def latin_field(data: Column) -> Column:
    """Fixed-length text up to the first NUL, one character for each byte, trimmed."""
    return trimmed(F.decode(before_nul(data), "ISO-8859-1"))


def latin_bytes(text: Column) -> Column:
    """ISO-8859-1 bytes, with ``?`` for other characters."""
    return F.encode(F.regexp_replace(text, "[^\\x{00}-\\x{FF}]", "?"), "ISO-8859-1")


def sanitized(name: Column) -> Column:
    """A text that can be part of a file name."""
    return trimmed(F.regexp_replace(name, r'(?U)[/\\:*?"<>|\p{Cntrl}]', "_"))


def nul_padded(data: Column, size: int) -> Column:
    """Filled up with NULs to ``size`` bytes."""
    return F.rpad(data, size, F.lit(b"\x00"))


def _reversed_bits(data: pa.Array) -> pa.Array:
    return pa.array([None if not x.is_valid else REVERSED_BYTES[np.frombuffer(x.as_py(), np.uint8)].tobytes() for x in data], pa.binary())


def reverse_bits_vectorised(data: Column) -> Column:
    """The same as :func:`reverse_bits` for long values: one table look-up a byte."""
    return F.arrow_udf(_reversed_bits, "binary")(data)


def channels(data: Column, count: int) -> Column:
    """Byte-interleaved samples as an array of one binary for each channel."""

    def split(samples: pa.Array) -> pa.Array:
        out = []
        for x in samples:
            flat = np.frombuffer(x.as_py() or b"", np.uint8) if x.is_valid else np.empty(0, np.uint8)
            out.append([flat[c::count].tobytes() for c in range(count)] if x.is_valid else None)
        return pa.array(out, pa.list_(pa.binary()))

    return F.arrow_udf(split, "array<binary>")(data)
