"""Timecodes of minutes, seconds and 75 frames a second, and format dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAMES_A_SECOND = 75
FRAMES_A_MINUTE = 60 * FRAMES_A_SECOND
SAMPLE_RATE = 2_822_400
#: Decoded bytes of one frame and channel.
FRAME_BYTES = SAMPLE_RATE // FRAMES_A_SECOND // 8

# Dimensions of the disc format.
GENRES = [
    "Not used", "Not defined", "Adult Contemporary", "Alternative Rock", "Children's Music", "Classical", "Contemporary Christian", "Country", "Dance",
    "Easy Listening", "Erotic", "Folk", "Gospel", "Hip Hop", "Jazz", "Latin", "Musical", "New Age", "Opera", "Operetta", "Pop Music", "RAP", "Reggae",
    "Rock Music", "Rhythm & Blues", "Sound Effects", "Sound Track", "Spoken Word", "World Music",
]
CATEGORIES = ["Not used", "General", "Japanese"]
CHARACTER_SETS = ["US-ASCII", "ISO646-JP", "ISO-8859-1", "SHIFT_JISX0213", "KSC5601.1987-0", "GB2312.1980-0", "BIG5", "ISO-8859-1"]
FRAME_FORMATS = {
    0: "DST (compressed)", 1: "Reserved", 2: "DSD 3-in-14 (uncompressed)", 3: "DSD 3-in-16 (uncompressed)", 4: "DSD format 4 (uncompressed)",
    5: "DSD format 5 (uncompressed)", 6: "DSD format 6 (uncompressed)", 7: "DSD format 7 (uncompressed)",
}
#: Sectors of three frames by frame format.
SECTORS_OF_THREE_FRAMES = {0: 14, 2: 14, 3: 16, 4: 14, 5: 14, 6: 14, 7: 14}
CHANNEL_TYPES = {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 7}
TEXT_KINDS = {1: "title", 2: "performer", 3: "songwriter", 4: "composer", 5: "arranger", 6: "message", 7: "extra_message", 8: "copyright"}
TEXT_KINDS |= {0x80 + k: f"{v}_phonetic" for k, v in TEXT_KINDS.items()}


def frame_count(minutes: Column, seconds: Column, frames: Column) -> Column:
    return (minutes * FRAMES_A_MINUTE + seconds * FRAMES_A_SECOND + frames).cast("int")


def clock(count: Column) -> Column:
    """``struct<m, s, f>`` of a frame count; minutes don't wrap."""
    own = count.cast("int")
    return F.struct(
        F.floor(own / FRAMES_A_MINUTE).cast("int").alias("m"), (F.floor(own / FRAMES_A_SECOND) % 60).cast("int").alias("s"), (own % FRAMES_A_SECOND).alias("f")
    )


def clock_text(m: Column, s: Column, f: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", m, s, f)


def in_range(tc: Column, start: Column, end: Column) -> Column:
    """Half-open range; an unknown timecode passes."""
    return F.coalesce((tc >= start) & (tc < end), F.lit(True))


def looked_up(code: Column, names: dict, otherwise=None) -> Column:
    """A small dimension as one CASE."""
    items = list(names.items())
    out = F.when(code == items[0][0], items[0][1])
    for k, v in items[1:]:
        out = out.when(code == k, v)
    return out if otherwise is None else out.otherwise(otherwise)


def genre_name(category: Column, genre: Column) -> Column:
    """Name of a genre of the general table; null for other categories or numbers."""
    return F.when(category == 1, looked_up(genre, dict(enumerate(GENRES))))


def category_name(category: Column) -> Column:
    return looked_up(category, dict(enumerate(CATEGORIES)))


def character_set(code: Column) -> Column:
    return looked_up(code.bitwiseAND(7), dict(enumerate(CHARACTER_SETS)))


def frame_format_name(code: Column) -> Column:
    return F.coalesce(looked_up(code, FRAME_FORMATS), F.concat(F.lit("Unknown ("), code.cast("string"), F.lit(")")))


def sectors_of_three_frames(code: Column) -> Column:
    return looked_up(code, SECTORS_OF_THREE_FRAMES)


def channel_type(code: Column) -> Column:
    return looked_up(code, CHANNEL_TYPES, 2)


def channel_hint(info_bits: Column) -> Column:
    """Channels that the two lowest bits of a frame info hint at."""
    low = info_bits.bitwiseAND(3)
    return F.when(low == 2, 6).when(low == 1, 5).otherwise(2)
