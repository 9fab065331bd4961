"""Byte layouts of the fixed structures, declared once and turned into columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from discloom.functions.binary import be_uint, part

# Name, offset, and size of an unsigned integer, or "b" and a size for bytes.
MASTER_FIELDS = [
    ("version_major", 8, 1), ("version_minor", 9, 1), ("album_set_size", 16, 2), ("album_seq", 18, 2), ("album_catalog_bytes", 24, "b16"),
    ("area1_toc1", 64, 4), ("area1_toc2", 68, 4), ("area2_toc1", 72, 4), ("area2_toc2", 76, 4), ("disc_flags", 80, 1), ("area1_size", 84, 2),
    ("area2_size", 86, 2), ("disc_catalog_bytes", 88, "b16"), ("year", 120, 2), ("month", 122, 1), ("day", 123, 1), ("text_area_count", 128, 1),
]
ALBUM_GENRES, DISC_GENRES, LOCALES = (40, 4), (104, 4), (136, 8)
#: Pointers to the texts of the master text sector.
MASTER_TEXTS = {
    "album_title": 16, "album_artist": 18, "album_publisher": 20, "album_copyright": 22,
    "disc_title": 32, "disc_artist": 34, "disc_publisher": 36, "disc_copyright": 38,
}
AREA_FIELDS = [
    ("version_major", 8, 1), ("version_minor", 9, 1), ("size", 10, 2), ("max_byte_rate", 16, 4), ("fs_code", 20, 1), ("format_byte", 21, 1),
    ("channel_count", 32, 1), ("config_byte", 33, 1), ("max_channels", 34, 1), ("mute", 35, 1), ("copy_byte", 48, 1), ("play_m", 64, 1),
    ("play_s", 65, 1), ("play_f", 66, 1), ("track_offset", 68, 1), ("track_count", 69, 1), ("track_start", 72, 4), ("track_end", 76, 4),
    ("text_area_count", 80, 1), ("track_text_ptr", 128, 2), ("index_list_ptr", 130, 2), ("access_list_ptr", 132, 2), ("description_ptr", 144, 2),
    ("copyright_ptr", 146, 2),
]
AREA_LOCALES = (88, 8)
MASTER_SIGNATURE, TEXT_SIGNATURE = b"SACDMTOC", b"SACDText"
AREA_SIGNATURES = {"stereo": b"TWOCHTOC", "multichannel": b"MULCHTOC"}
TRACK_TEXT, TRACK_TIMES, TRACK_SECTORS, TRACK_CODES = b"SACDTTxt", b"SACDTRL2", b"SACDTRL1", b"SACD_IGL"
#: The code of areas of 2 822 400 bits a second and channel.
RATE_CODE = 4
MASTER_LSN, TEXT_LSN, SLOTS = 510, 511, 255


def fields(data: Column, layout: list[tuple]) -> list[Column]:
    """A column for each field of a layout."""
    return [(part(data, at, int(kind[1:])) if isinstance(kind, str) else be_uint(data, at, kind)).alias(name) for name, at, kind in layout]


def genres(data: Column, where: tuple[int, int]) -> Column:
    """``array<struct<category, genre>>`` of consecutive four-byte genres."""
    at, n = where
    return F.array(*(F.struct(be_uint(data, at + 4 * i, 1).alias("category"), be_uint(data, at + 4 * i + 2, 2).alias("genre")) for i in range(n)))


def locales(data: Column, where: tuple[int, int]) -> Column:
    """``array<struct<lang binary, charset>>`` of consecutive four-byte locales."""
    at, n = where
    return F.array(*(F.struct(part(data, at + 4 * i, 2).alias("lang"), be_uint(data, at + 4 * i + 2, 1).alias("charset")) for i in range(n)))
