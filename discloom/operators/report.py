"""Text reports and file names from the metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discloom.functions.binary import lossy_field, sanitized
from discloom.functions.timecode import category_name, character_set, clock_text, frame_format_name, genre_name
from discloom.operators.toc import first_general


def _line(label: str, value: Column, indent: int = 4) -> Column:
    """``label: value``, or null where there is no value."""
    return F.concat(F.lit(" " * indent + label + ": "), value.cast("string"))


def _version() -> Column:
    return F.format_string("%2d.%02d", "version_major", "version_minor")


def disc_lines(discs: DataFrame) -> DataFrame:
    """``image, section, line_no, line`` of the disc and album sections."""
    c = F.col
    general = first_general("disc_genre")
    languages = F.transform(
        F.filter("locales", lambda x: F.length(_language(x)) > 0),
        lambda x: F.concat(F.lit("    Locale: "), _language(x), F.lit(", Code character set:["), x["charset"].cast("string"), F.lit("], "), character_set(x["charset"])),
    )
    disc = F.concat(
        F.array(
            F.lit("Disc Information:"),
            _line("Version", _version()),
            _line("Creation date", F.format_string("%04d-%02d-%02d", "year", "month", "day")),
            _line("Hybrid Disc", c("hybrid")),
            _line("Stereo Disc", c("two_channel")),
            _line("Multi-channel Disc", c("multi_channel")),
            _line("Disc Catalog Number", F.nullif(c("disc_catalog"), F.lit(""))),
            _line("Disc Category", category_name(general["category"])),
            _line("Disc Genre", genre_name(general["category"], general["genre"])),
        ),
        languages,
        F.array(*(_line(name.capitalize(), c(f"disc_{name}")) for name in ("title", "artist", "publisher", "copyright"))),
    )
    album = F.array(
        F.lit(""),
        F.lit("Album Information:"),
        _line("Album Catalog Number", c("album_catalog")),
        _line("Sequence Number", c("album_seq")),
        _line("Set Size", c("album_set_size")),
        *(_line(name.capitalize(), c(f"album_{name}")) for name in ("title", "artist", "publisher", "copyright")),
    )
    return _numbered(discs.select("image", F.lit(0).alias("section"), F.concat(disc, album).alias("lines")))


def _language(x: Column) -> Column:
    return F.regexp_replace(F.make_valid_utf8(x["lang"].cast("string")), "\\x00+$", "")


def _numbered(rows: DataFrame) -> DataFrame:
    kept = F.filter("lines", lambda x: x.isNotNull())
    return rows.select("image", "section", F.posexplode(kept).alias("line_no", "line"))


def area_lines(areas: DataFrame, tracks: DataFrame) -> DataFrame:
    """``image, section, line_no, line``: the number of areas, and each area with its tracks."""
    c = F.col
    time = lambda x: F.concat(clock_text(x["m"], x["s"], x["f"]), F.lit(" [mins:secs:frames]"))
    # Areas are counted as they are there, stereo first.
    index = F.row_number().over(Window.partitionBy("image").orderBy(F.when(c("area") == "stereo", 0).otherwise(1))) - 1
    place = (c("track_no") - 1).cast("string")
    numbered = lambda label, value, indent=8: F.concat(F.lit(" " * indent + label + "["), place, F.lit("]: "), value)
    timed = c("start").isNotNull() & c("duration").isNotNull()
    titles = F.array(
        numbered("Title", c("title")),
        numbered("Performer", c("performer")),
        numbered("Composer", c("composer")),
        F.when(timed, _line("Track_Start_Time_Code", time(c("start")), 8)),
        F.when(timed, _line("Duration", time(c("duration")), 8)),
        F.lit(""),
    )
    part = lambda n: F.make_valid_utf8(c("isrc")[n].cast("string"))
    valid = F.substring(c("isrc")["country"], 1, 1) != F.lit(b"\x00")
    codes = F.when(
        valid,
        F.array(
            F.concat(F.lit("    ISRC Track ["), place, F.lit("]:")),
            F.concat(F.lit("      Country: "), part("country"), F.lit(", Owner: "), part("owner"), F.lit(", Year: "), part("year"), F.lit(", Designation: "), part("designation")),
        ),
    )
    of_track = tracks.select("image", "area", "track_no", titles.alias("titles"), codes.alias("codes"))
    gathered = of_track.groupBy("image", "area").agg(F.array_sort(F.collect_list(F.struct("track_no", "titles", "codes"))).alias("t"))  # 255 at most
    head = F.array(
        F.concat(F.lit("    Area Information ["), c("_index").cast("string"), F.lit("]:")),
        F.lit(""),
        _line("Version", _version()),
        _line("Area ID", c("area_id")),
        _line("Area Description", c("description")),
        _line("Track Count", c("track_count")),
        _line("Total Play Time", time(c("play_time"))),
        _line("Speaker Config", F.concat(c("channel_count").cast("string"), F.lit(" Channel"))),
        _line("Frame Format", frame_format_name(c("frame_format"))),
        F.concat(F.lit("    Track List ["), c("_index").cast("string"), F.lit("]:")),
    )
    lists = lambda name: F.flatten(F.filter(F.transform(F.coalesce(c("t"), F.array()), lambda x: x[name]), lambda x: x.isNotNull()))
    placed = areas.join(gathered, ["image", "area"], "left").withColumn("_index", index)
    rows = placed.select("image", (c("_index") + 2).alias("section"), F.concat(head, lists("titles"), lists("codes")).alias("lines"))
    count = areas.groupBy("image").agg(F.count("*").alias("n"))
    count = count.select("image", F.lit(1).alias("section"), F.array(F.lit(""), F.concat(F.lit("Area Count: "), c("n").cast("string"))).alias("lines"))
    return _numbered(count).unionByName(_numbered(rows))


def size_lines(sizes: DataFrame) -> DataFrame:
    """The closing line of each image; ``sizes`` has ``image, sectors``."""
    size = F.col("sectors") * 2048
    line = F.format_string("The size of sacd is ok (sectors=%d). Size is: %d bytes, %.3f GB (gigabyte)", "sectors", size, size / 1e9)
    return _numbered(sizes.select("image", F.lit(9).alias("section"), F.array(F.lit(""), line).alias("lines")))


def report(discs: DataFrame, areas: DataFrame, tracks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """All lines of each image's report; order by ``image, section, line_no`` to read them."""
    out = disc_lines(discs).unionByName(area_lines(areas, tracks))
    return out if sizes is None else out.unionByName(size_lines(sizes))


def image_name(title: Column, artist: Column, catalog: Column) -> Column:
    """Name of a dumped image."""
    return F.concat(
        sanitized(F.coalesce(title, F.lit("Unknown_Title"))), F.lit("-"), sanitized(F.coalesce(artist, F.lit("Unknown_Artist"))),
        F.lit("-["), sanitized(F.coalesce(F.nullif(catalog, F.lit("")), F.lit("Unknown_Catalog"))), F.lit("].iso"),
    )


def audio_name(title: Column, artist: Column, area: Column, track_no: Column, track_title: Column) -> Column:
    """Name of a track's audio file; artist before title."""
    disc = F.coalesce(F.nullif(F.concat_ws("-", sanitized(artist), sanitized(title)), F.lit("")), F.lit("Unknown_Disc"))
    number = F.format_string("%02d", track_no)
    return F.concat(
        disc, F.when(area == "stereo", "-stereo-").otherwise("-mch-"), number, F.lit("-"), F.coalesce(sanitized(track_title), F.concat(F.lit("Track_"), number)), F.lit(".dsf")
    )


def disc_size(sizes: DataFrame) -> DataFrame:
    """``image, sectors, bytes, gb``."""
    return sizes.select("image", "sectors", (F.col("sectors") * 2048).alias("bytes"), F.round(F.col("sectors") * 2048 / 1e9, 3).alias("gb"))


def catalog_text(data: Column) -> Column:
    """A catalog number as the report shows it."""
    return lossy_field(data)
