"""Tables of contents as DataFrames: discs, areas, tracks and their texts.

All functions take sectors ``(image, lsn, data)`` of any number of images, or
images that are read by spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from discloom import layouts as L
from discloom.functions.binary import be_uint, lossy_field, lossy_text, part, strict_text, trimmed
from discloom.functions.timecode import FRAMES_A_MINUTE, FRAMES_A_SECOND, TEXT_KINDS
from discloom.sources.sectors import Images

#: Encodings of the character sets that texts may be in.
CHARSETS = {0: "ascii", 1: "ascii", 2: "latin-1", 3: "shift_jis_2004", 4: "euc_kr", 5: "gb2312", 6: "big5", 7: "latin-1"}

#: Contents whose tracks, up to 255 of each, are held as rows at once.
HELD_CONTENTS = 16


def _sector(sectors: DataFrame, lsn: int, signature: bytes) -> DataFrame:
    return sectors.filter((F.col("lsn") == lsn) & (part(F.col("data"), 0, 8) == F.lit(signature)))


def _flagged(fields: DataFrame) -> DataFrame:
    return fields.withColumns(
        {
            "hybrid": F.col("disc_flags").bitwiseAND(0x80) != 0,
            "two_channel": F.col("area1_toc1") != 0,
            "multi_channel": F.col("area2_toc1") != 0,
            "album_catalog": lossy_field(F.col("album_catalog_bytes")),
            "disc_catalog": lossy_field(F.col("disc_catalog_bytes")),
        }
    )


def master_texts(sectors: DataFrame) -> DataFrame:
    """``image`` and the album's and disc's texts; null where there is none. No row without the text sector."""
    d = F.col("data")

    def text(at: int) -> Column:
        pointer = be_uint(d, at, 2)
        own = trimmed(lossy_text(F.substring(d, (pointer + 1).cast("int"), F.length(d))))
        return F.when((pointer > 0) & (pointer < F.length(d)), F.nullif(own, F.lit("")))

    return _sector(sectors, L.TEXT_LSN, L.TEXT_SIGNATURE).select("image", *(text(at).alias(name) for name, at in L.MASTER_TEXTS.items()))


def as_images(sectors: DataFrame | Images) -> Images:
    return sectors if isinstance(sectors, Images) else Images(sectors)


def discs(images: DataFrame | Images, strict: bool = True) -> DataFrame:
    """One row for each image: the master table of contents and its texts.

    An image whose master sector is missing or isn't one is an error, or with
    ``strict`` off is left out.
    """
    images = as_images(images)
    sectors, d = images.between(L.MASTER_LSN, L.TEXT_LSN + 1), F.col("data")
    master = _sector(sectors, L.MASTER_LSN, L.MASTER_SIGNATURE).select(
        "image", *L.fields(d, L.MASTER_FIELDS), L.genres(d, L.ALBUM_GENRES).alias("album_genre"), L.genres(d, L.DISC_GENRES).alias("disc_genre"), L.locales(d, L.LOCALES).alias("locales")
    )
    out = _flagged(master).join(master_texts(sectors), "image", "left")
    if not strict:
        return out
    # The first MiB of an image shows that it is there.  The error hangs on the name, so no empty join hides it.
    names = images.names(L.MASTER_LSN).withColumnRenamed("image", "_of")
    bad = F.raise_error(F.concat(F.lit("no master table of contents: "), F.col("_of"))).cast("string")
    out = names.join(out, F.col("_of") == F.col("image"), "left")
    return out.withColumn("image", F.coalesce(F.col("image"), bad)).drop("_of")


def first_general(genres: str) -> Column:
    """The first genre of the general table in an array; null if there is none."""
    return F.get(F.filter(genres, lambda g: g["category"] == 1), F.lit(0))


def area_sectors(images: DataFrame | Images, discs: DataFrame) -> DataFrame:
    """``image, area, toc, lsn, nth, data``: the sectors of each copy of each area's contents."""
    copies = F.array(
        *(
            F.struct(F.lit(area).alias("area"), F.lit(copy).alias("toc"), F.col(f"area{n}_toc{copy}").alias("first"), F.col(f"area{n}_size").alias("count"))
            for n, area in ((1, "stereo"), (2, "multichannel"))
            for copy in (1, 2)
        )
    )
    wanted = discs.select("image", F.explode(copies).alias("c")).select("image", "c.*").filter("first > 0 AND count > 0")
    spans = wanted.select("image", "area", "toc", "first", F.col("first").alias("low"), (F.col("first") + F.col("count")).alias("high"))
    return as_images(images).within(spans).withColumn("nth", F.col("lsn") - F.col("first")).drop("first")


def area_contents(images: DataFrame | Images, discs: DataFrame, permissive: bool = False) -> DataFrame:
    """``image, area, toc, data``: each copy as one value, if it begins with the area's signature.

    A pointer to track texts that leads nowhere spoils the whole copy; with
    ``permissive`` only its texts are missing.
    """
    own = area_sectors(images, discs)
    whole = own.groupBy("image", "area", "toc").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY nth)").alias("data"), F.min("nth").alias("_first"))
    right = F.lit(False)
    for area, signature in L.AREA_SIGNATURES.items():
        right = right | ((F.col("area") == area) & (part(F.col("data"), 0, 8) == F.lit(signature)))
    whole = whole.filter((F.col("_first") == 0) & right).drop("_first")
    return whole if permissive else whole.filter(_text_section_ok())


def _text_section_ok() -> Column:
    """A pointer to track texts that leads nowhere spoils the whole copy."""
    d = F.col("data")
    at = be_uint(d, 128, 2) * 2048
    return (at == 0) | (part(d, at.cast("int"), 8) == F.lit(L.TRACK_TEXT))


def resolve_copies(contents: DataFrame, value: str = "data", keys: tuple[str, ...] = ("image", "area")) -> DataFrame:
    """The copy to trust: the second where both are there, else the one that is.

    Adds ``differ``, true where there are two that aren't equal.
    """
    copy = lambda n: F.max(F.when(F.col("toc") == n, F.col(value)))
    both = contents.groupBy(*keys).agg(copy(1).alias("_1"), copy(2).alias("_2"))
    differ = F.col("_1").isNotNull() & F.col("_2").isNotNull() & (F.col("_1") != F.col("_2"))
    return both.select(*keys, F.coalesce("_2", "_1").alias(value), differ.alias("differ"))


def areas(contents: DataFrame) -> DataFrame:
    """One row for each resolved area; ``contents`` has ``image, area, data``."""
    d = F.col("data")
    out = contents.select("image", "area", *[c for c in contents.columns if c == "differ"], "data", *L.fields(d, L.AREA_FIELDS), L.locales(d, L.AREA_LOCALES).alias("languages"))
    return out.select(
        *[c for c in out.columns if c not in ("data", "format_byte", "config_byte", "copy_byte", "play_m", "play_s", "play_f", "description_ptr", "copyright_ptr")],
        F.col("format_byte").bitwiseAND(0x0F).alias("frame_format"),
        F.shiftright("config_byte", 5).alias("extra_setting"),
        F.col("config_byte").bitwiseAND(0x1F).alias("loudspeaker"),
        F.col("copy_byte").bitwiseAND(0x0F).alias("track_attribute"),
        F.struct(F.col("play_m").alias("m"), F.col("play_s").alias("s"), F.col("play_f").alias("f")).alias("play_time"),
        part(d, 0, 8).cast("string").alias("area_id"),
        strict_text(d, F.col("description_ptr").cast("int")).alias("description"),
        strict_text(d, F.col("copyright_ptr").cast("int")).alias("copyright"),
    )


def _list_at(data: bytes, signature: bytes) -> int | None:
    """Where a list's slots begin: in the first sector after the first one that has its signature."""
    for at in range(2048, 2048 * min(int.from_bytes(data[10:12], "big"), len(data) // 2048), 2048):
        if data[at : at + 8] == signature:
            return at + 8
    return None


def _texts_of(data: bytes, track: int, charset: str) -> Iterator[tuple[int, str]]:
    """Kind and text of each item of a track's texts, as they stand; one without its NUL is none."""
    base = int.from_bytes(data[128:130], "big") * 2048
    at = base + 8 + 2 * track
    offset = int.from_bytes(data[at : at + 2], "big") if base and data[base : base + 8] == L.TRACK_TEXT else 0
    at = base + offset
    if not offset or at + 4 > len(data):
        return
    count, at = data[at], at + 4
    for _ in range(count):
        end = data.find(b"\x00", at + 2)
        if at + 2 >= len(data) or end < 0:
            return
        yield data[at], data[at + 2 : end].decode(charset, "replace")
        at = end
        while at < len(data) and not data[at]:
            at += 1


def _charset(data: bytes, decoded: bool) -> str:
    """Name of the encoding of an area's first language."""
    return CHARSETS.get(data[90] & 7 if len(data) > 90 else 0, "utf-8") if decoded else "utf-8"


def _track(data: bytes, i: int, lists: dict[str, int | None], charset: str) -> dict:
    """What the lists hold of a track, counted from 0."""
    slot = lambda name, at, n: None if lists[name] is None else data[lists[name] + at : lists[name] + at + n]
    number = lambda b: None if b is None or len(b) < 4 else int.from_bytes(b, "big")
    time = lambda b: None if b is None else dict(zip(("m", "s", "f", "flags"), b, strict=False))
    code, genre = slot("codes", 12 * i, 12), slot("codes", L.SLOTS * 12 + 4 * i, 4)
    start, duration = (slot("times", 4 * (L.SLOTS * n + i), 4) for n in (0, 1))
    frames = lambda b: None if b is None or len(b) < 3 else b[0] * FRAMES_A_MINUTE + b[1] * FRAMES_A_SECOND + b[2]
    texts = {TEXT_KINDS[kind]: text for kind, text in _texts_of(data, i, charset) if text and kind in TEXT_KINDS}  # the last one counts
    return texts | {
        "start": time(start), "duration": time(duration), "start_lsn": number(slot("sectors", 4 * i, 4)), "length_lsn": number(slot("sectors", 4 * (L.SLOTS + i), 4)),
        "isrc": code if code is None else {"country": code[:2], "owner": code[2:5], "year": code[5:7], "designation": code[7:]},
        "genre": None if genre is None or len(genre) < 4 else {"category": genre[0], "genre": int.from_bytes(genre[2:], "big")}, "start_fc": frames(start), "duration_fc": frames(duration),
    }


TIME = "struct<m: bigint, s: bigint, f: bigint, flags: bigint>"
TRACK = (
    f"start {TIME}, duration {TIME}, start_lsn bigint, length_lsn bigint, isrc struct<country: binary, owner: binary, year: binary, designation: binary>, "
    "genre struct<category: bigint, genre: bigint>, start_fc int, duration_fc int"
)


def tracks(contents: DataFrame, charsets: bool = False) -> DataFrame:
    """One row for each track of each area, with its slots of all lists, null where a list is missing.

    ``start, duration (struct<m, s, f, flags>), start_fc, duration_fc,
    start_lsn, length_lsn, isrc struct<country, owner, year, designation>,
    genre struct<category, genre>`` and all texts.  Of several texts of a kind
    the last that isn't empty counts.  Texts are read as UTF-8, or with
    ``charsets`` in the encoding that the area's first language names.
    """
    schema = T.StructType([contents.schema["image"], *T.StructType.fromDDL(f"area string, track_no int, track_count bigint, {TRACK}, " + ", ".join(f"{n} string" for n in TEXT_KINDS.values()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The items of a track's texts follow one another at lengths that only reading tells, so all of a content is read in one go.
        # Spark's batches have thousands of contents; only some at a time become Python values.
        for b in (whole.slice(low, HELD_CONTENTS) for whole in batches for low in range(0, whole.num_rows, HELD_CONTENTS)):
            of, rows = [], []
            for n, (area, data) in enumerate(zip(b.column("area").to_pylist(), b.column("data").to_pylist(), strict=True)):
                lists = {"times": _list_at(data, L.TRACK_TIMES), "sectors": _list_at(data, L.TRACK_SECTORS), "codes": _list_at(data, L.TRACK_CODES)}
                count = data[69] if len(data) > 69 else 0
                for i in range(count):
                    of.append(n)
                    rows.append({"area": area, "track_no": i + 1, "track_count": count} | _track(data, i, lists, _charset(data, charsets)))
            table = pa.Table.from_pylist(rows, arrow)
            image = b.column("image").take(pa.array(of, pa.int64()))
            yield from table.add_column(0, "image", pa.chunked_array([image])).to_batches()

    arrow = to_arrow_schema(T.StructType(schema.fields[1:]))
    return contents.select("image", "area", "data").mapInArrow(parse, schema)


def redundant_rows(contents: DataFrame) -> DataFrame:
    """``image, area, copies, differ`` for a report of damaged discs."""
    order = Window.partitionBy("image", "area")
    return contents.select("image", "area", F.count("*").over(order).alias("copies"), (F.size(F.collect_set(F.sha2("data", 256)).over(order)) > 1).alias("differ")).distinct()
