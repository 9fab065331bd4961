"""ID3v2.3 tags as one binary column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloom.functions.binary import be_bytes, before_nul, latin_bytes, latin_field, sync_safe
from discloom.functions.timecode import GENRES
from discloom.operators.toc import first_general


def _bytes(value: bytes) -> Column:
    return F.lit(bytearray(value))


def text_payload(text: Column) -> Column:
    return F.concat(_bytes(b"\x00"), latin_bytes(text), _bytes(b"\x00"))


def frame(name: str, payload: Column) -> Column:
    return F.concat(_bytes(name.encode()), be_bytes(F.length(payload), 4), _bytes(b"\x00\x00"), payload)


def text_frame(name: str, text: Column) -> Column:
    """A text frame; empty where the text is null."""
    return F.when(text.isNotNull(), frame(name, text_payload(text))).otherwise(_bytes(b""))


def user_frame(key: str, text: Column) -> Column:
    """A described text frame; empty where the text is null."""
    payload = F.concat(_bytes(b"\x00" + key.encode() + b"\x00"), latin_bytes(text), _bytes(b"\x00"))
    return F.when(text.isNotNull(), frame("TXXX", payload)).otherwise(_bytes(b""))


def tag_fields() -> dict[str, Column]:
    """What each frame holds, null where there is no such frame.

    Columns are those of a track joined with its disc; two frames of a kind are
    told apart by a suffix.
    """
    c = F.col
    album, disc = c("album_title"), c("disc_title")
    performer = F.coalesce("performer", "performer_phonetic")
    disc_cat, album_cat = F.nullif(latin_field(c("disc_catalog_bytes")), F.lit("")), F.nullif(latin_field(c("album_catalog_bytes")), F.lit(""))
    parts = [c("isrc")[n] for n in ("country", "owner", "year", "designation")]
    some = F.lit(False)
    for p in parts:
        some = some | (F.substring(p, 1, 1) != _bytes(b"\x00"))
    own = F.when(c("genre")["category"] == 1, c("genre"))
    genre = F.coalesce(own, first_general("disc_genre"), first_general("album_genre"))["genre"]
    names = F.array(*map(F.lit, GENRES))
    return {
        "TIT2": F.coalesce("title", "title_phonetic", F.lit("no track title")),
        "TALB": F.coalesce(album, disc),
        "DISCSUBTITLE": F.when(album.isNotNull() & ((disc != album) | (c("album_set_size") > 1)), disc),
        "TPE1": F.coalesce(performer, c("disc_artist"), c("album_artist")),
        "TPE2": c("album_artist"),
        "PERFORMER": performer,
        "TCOM": F.coalesce("composer", "composer_phonetic"),
        "Catalog Number": F.coalesce(disc_cat, album_cat),
        "Album Catalog Number": F.when(disc_cat.isNotNull() & (album_cat != disc_cat), album_cat),
        "TSRC": F.when(some, F.concat(*(F.decode(before_nul(p), "ISO-8859-1") for p in parts))),
        "TPOS": F.concat_ws("/", c("album_seq"), F.greatest(c("album_set_size"), F.lit(1))),
        "TCON": F.when((genre > 0) & (genre < len(GENRES)), F.get(names, genre.cast("int"))),
        "TYER": F.format_string("%04d", c("year")),
        "TDAT": F.format_string("%02d%02d", c("day"), c("month")),
        "TRCK": F.concat_ws("/", c("track_no"), c("track_count")),
    }


def with_tags(tracks: DataFrame, discs: DataFrame, column: str = "id3") -> DataFrame:
    """Tracks with their tag, a binary; ``discs`` is joined on ``image``."""
    frames = [text_frame(k, v) if len(k) == 4 and k.isupper() else user_frame(k, v) for k, v in tag_fields().items()]
    clash = [x for x in discs.columns if x in tracks.columns and x != "image"]
    joined = tracks.join(discs.drop(*clash), "image").withColumn("_f", F.concat(*frames))
    tag = F.concat(_bytes(b"ID3\x03\x00\x00"), sync_safe(F.length("_f")), F.col("_f"))
    return joined.withColumn(column, tag).select(*tracks.columns, column)
