"""Whole jobs: an image's tables, its tracks' samples, and its audio files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from discloom import layouts as L
from discloom.functions.binary import sanitized
from discloom.operators import demux, lossless, pcm, report, tag, toc, tracks
from discloom.operators.pcm import DecoderFactory
from discloom.shared import cut, sent, shared_folder, written
from discloom.sources import dsf
from discloom.sources.sectors import FileImages, Images

KEYS = ["image", "area"]


@dataclass
class Tables:
    """The metadata of any number of images."""

    discs: DataFrame
    areas: DataFrame
    tracks: DataFrame


@dataclass
class Times:
    """What :func:`audio_files` and :func:`write_audio` note when they are given it, for :func:`track_times`."""

    tracks: DataFrame | None = None
    files: DataFrame | None = None


def read_tables(images: DataFrame | Images, strict: bool = True, permissive: bool = False, charsets: bool = False) -> Tables:
    """Metadata of all images, given as ``(image, lsn, data)`` or by :func:`images_at`.

    The few sectors that hold it are read once, and what they say is written to
    the shared folder.  ``permissive`` keeps areas whose track texts are spoilt;
    ``charsets`` reads track texts in the encodings that their areas name.
    """
    discs = cut(toc.discs(images, strict))
    contents = cut(toc.resolve_copies(toc.area_contents(images, discs, permissive)))
    return Tables(discs, toc.areas(contents), cut(toc.tracks(contents, charsets)))


def wanted_areas(areas: DataFrame, stereo: bool = False, multichannel: bool = False) -> DataFrame:
    """The areas asked for; both if neither is."""
    names = [n for n, on in (("stereo", stereo), ("multichannel", multichannel)) if on] or ["stereo", "multichannel"]
    return areas.filter(F.col("area").isin(names))


def track_plan(tables: Tables, selection: str | None = None, **areas: bool) -> DataFrame:
    """Sectors and times of the selected tracks: ``image, area, track_no, frame_format, channels, tc_start, tc_end, low, high``.

    A track without times, or of an unknown frame format, is an error, as is an
    area of another sampling rate than 2 822 400 bits a second.
    """
    own = wanted_areas(tables.areas, **areas)
    chosen = tracks.select_tracks(tables.tracks.join(own.select(*KEYS), KEYS), selection, KEYS)
    plan = tracks.track_ranges(tables.tracks, own, KEYS).join(chosen.select(*KEYS, "track_no"), [*KEYS, "track_no"])
    # Written, so that no filter moves the error before the selection: tracks that aren't asked for may lack what they like.
    plan = cut(plan.join(own.select(*KEYS, "frame_format", "fs_code", F.col("channel_count").cast("int").alias("channels")), KEYS))
    bad = F.col("tc_start").isNull() | F.col("tc_end").isNull() | F.col("lsn_start").isNull() | F.col("lsn_end").isNull()
    other_rate = F.coalesce(F.col("fs_code"), F.lit(0)) != L.RATE_CODE
    problem = F.when(other_rate, "unknown sampling rate: track ").otherwise("no times or unknown format: track ")
    message = F.concat(problem, F.col("track_no").cast("string"), F.lit(" of "), F.col("image"))
    high = F.when(bad | other_rate, F.raise_error(message).cast("long")).otherwise(F.col("lsn_end"))
    return plan.select(*KEYS, "track_no", "frame_format", "channels", "tc_start", "tc_end", F.col("lsn_start").alias("low"), high.alias("high"))


def track_frames(images: DataFrame | Images, tables: Tables, selection: str | None = None, seen: Observation | None = None, timed: bool = False, **areas: bool) -> DataFrame:
    """Raw frames of the selected tracks: ``image, area, track_no, channels, compressed, order_no, raw``.

    Only the sectors of these tracks are used.  ``seen`` gets the numbers of
    frames (``frames``), of those outside their track's times (``filtered``) and
    of those that were begun but never done (``dropped``), and ``bytes``.
    ``timed`` adds ``read_ns`` and ``parse_ns``, the time that a frame took.
    """
    plan = track_plan(tables, selection, **areas)
    parts = toc.as_images(images).within(plan, timed)
    keys, spent = [*KEYS, "track_no"], demux.SPENT if timed else []
    packs = demux.packets(parts.filter("frame_format = 0"), [*keys, "channels", "tc_start", "tc_end"], timed=timed)
    frames = demux.assemble(packs, [*keys, "channels", "tc_start", "tc_end"], lost=True, span=demux.SPAN, timed=timed)
    inside = demux.in_range(F.col("tc"), F.col("tc_start"), F.col("tc_end"))
    frames = frames.select(*keys, "channels", F.lit(True).alias("compressed"), F.col("fid").alias("order_no"), "raw", F.col("lost").alias("_lost"), (inside & ~F.col("lost")).alias("_own"), *spent)
    plain = demux.plain_sectors(parts.filter("frame_format <> 0"), [*keys, "channels"], timed=timed)
    plain = plain.select(*keys, "channels", F.lit(False).alias("compressed"), F.col("lsn").alias("order_no"), "raw", F.lit(False).alias("_lost"), F.lit(True).alias("_own"), *spent)
    out = frames.unionByName(plain)
    if seen is not None:
        counted = [F.count_if("_own").alias("frames"), F.count_if(~F.col("_own") & ~F.col("_lost")).alias("filtered"), F.count_if("_lost").alias("dropped")]
        out = out.observe(seen, *counted, F.coalesce(F.sum(F.when(F.col("_own"), F.length("raw"))), F.lit(0)).alias("bytes"))
    return out.filter("_own").drop("_own", "_lost")


def image_folder(image: Column) -> Column:
    """Name of the folder of an image's files: the last part of its path, without its ending."""
    return sanitized(F.regexp_replace(F.regexp_extract(image.cast("string"), "([^/]*)/*$", 1), "(?i)\\.iso$", ""))


def _one_of_each(names: DataFrame, name: str) -> DataFrame:
    """An error where two images would be written under one name."""
    several = F.count("*").over(Window.partitionBy(name)) > 1
    message = F.concat(F.lit("several images have the name "), F.col(name))
    return names.withColumn(name, F.when(several, F.raise_error(message).cast("string")).otherwise(F.col(name)))


def audio_files(
    images: DataFrame | Images, tables: Tables, decoder: DecoderFactory | None = lossless.Decoder, selection: str | None = None, carry: bool = False, seen: Observation | None = None, times: Times | None = None, **areas: bool
) -> DataFrame:
    """Rows for the ``dsf_files`` sink: all selected tracks' headers, blocks and tags.

    Each image's files are in a folder of their own; two images of one name are
    an error.  Compressed frames need a ``decoder``; with None they are an error,
    as malformed frames are.  ``times`` has this job's times noted.
    """
    keys, timed = [*KEYS, "track_no"], times is not None
    frames = track_frames(images, tables, selection, seen, timed, **areas)
    plain, packed = frames.filter("NOT compressed"), frames.filter("compressed")
    plain = plain.withColumn("decode_ns", F.lit(0.0)) if timed else plain
    samples = plain.unionByName(pcm.decode(packed, decoder or pcm.no_decoder, spent="decode_ns" if timed else None)).drop("compressed")
    # Written, so that frames are decoded once.  A track's decoded size is known before any byte is placed, from lengths alone.
    samples = written(samples.withColumn("size", F.length("raw").cast("long")))
    sizes = samples.groupBy(*keys).agg(F.first("channels").alias("channels"), F.sum("size").alias("bytes"))
    counts = tables.areas.select(*KEYS, F.col("track_count").cast("int").alias("track_count"))
    sizes = sizes.join(counts, KEYS).withColumn("len", F.expr("(bytes + channels - 1) div channels"))
    sizes = tracks.gapless(sizes, KEYS, carry=carry)
    # What an earlier track hands on begins this one's first block.
    start = sizes.select(*keys, "carries", "blocks", "start_byte", F.expr("start_byte div 4096").alias("first_block"), F.expr("end_byte div 4096").alias("last_block"))
    placed = pcm.blocks(samples.join(sent(start.select(*keys, "start_byte")), keys), keys, "order_no", start="start_byte")
    placed = _handed_on(placed, start, keys) if carry else placed
    tagged = tag.with_tags(tables.tracks, tables.discs).select(*keys, "title", "id3")
    names = _one_of_each(tables.discs.select("image", "disc_title", "disc_artist", image_folder(F.col("image")).alias("folder")), "folder")
    files = sizes.join(tagged, keys).join(names, "image")
    file = report.audio_name(F.col("disc_title"), F.col("disc_artist"), F.col("area"), F.col("track_no"), F.col("title"))
    files = files.select(*keys, "folder", file.alias("file"), "channels", "blocks", "bytes", "carries", "id3")
    if timed:
        parts = [F.sum(f"{c}_ns").alias(f"{c}_ns") for c in ("read", "parse", "decode")]
        spent = samples.groupBy(*keys).agg(F.count("*").alias("frames"), *parts)
        times.tracks = cut(spent.join(files.select(*keys, "folder", "file", "bytes"), keys))
    return dsf.file_rows(pcm.padded(placed), files, keys)


def _handed_on(blocks: DataFrame, start: DataFrame, keys: list[str]) -> DataFrame:
    """Move each track's unfinished last block to the track that finishes it, where it is handed on.

    That is the next track, or a later one if tracks in between end in the same
    block and hand it on too.
    """
    run = F.col("track_no") - F.row_number().over(Window.partitionBy(*KEYS).orderBy("track_no"))
    same = F.max(F.when(F.col("carries"), F.col("track_no"))).over(Window.partitionBy(*KEYS, "_run", "last_block"))
    ends = start.withColumn("_run", run).withColumn("_to", same + 1)
    own = blocks.join(ends.select(*keys, "carries", "last_block", "_to"), keys)
    moves = F.col("carries") & (F.col("block_no") == F.col("last_block"))
    # Bytes after a block that is already begun sort behind those that begin it.
    pieces = own.select(*KEYS, F.when(moves, F.col("_to")).otherwise(F.col("track_no")).alias("track_no"), F.col("track_no").alias("from"), "block_no", "channel", "bytes")
    there = pieces.join(start.select(*keys), keys, "left_semi")
    return there.groupBy(*keys, "block_no", "channel").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY `from`)").alias("bytes"))


def write_audio(rows: DataFrame, folder: str, times: Times | None = None) -> None:
    spark = rows.sparkSession
    dsf.register(spark)
    writer = rows.write.format("dsf_files").mode("append")
    if times is None:
        writer.save(folder)
    else:
        path = f"{shared_folder(spark)}/times-{uuid.uuid4().hex}"
        writer.option("times", path).save(folder)
        times.files = spark.read.schema("folder string, file string, write_ns long, file_bytes long").parquet(path)


def track_times(times: Times) -> DataFrame:
    """What each written track took: ``image, area, track_no, folder, file, frames, bytes, file_bytes, read_s, parse_s, decode_s, write_s, mb_per_s, frames_per_s``.

    ``times`` was given to :func:`audio_files` and then to :func:`write_audio`.
    Seconds are those that tasks spent, added up, whatever ran side by side: in
    reading the track's sectors (0 where Spark's own scan reads them), in
    decoding packets and assembling frames, in decoding samples, and in writing
    the file.  ``frames`` are sectors where the track isn't compressed, ``bytes``
    those of its samples; the two rates are of ``file_bytes`` and ``frames`` by
    the sum of the four times, and null where that is 0.  Time that led to no
    frame of the track, as of packets between frames, isn't counted.
    """
    names = ("read", "parse", "decode", "write")
    both = times.tracks.join(times.files, ["folder", "file"])
    total = sum(F.col(f"{c}_s") for c in names)
    rows = both.select(*KEYS, "track_no", "folder", "file", "frames", "bytes", "file_bytes", *((F.col(f"{c}_ns") / 1e9).alias(f"{c}_s") for c in names))
    return rows.withColumns({"mb_per_s": F.try_divide(F.col("file_bytes") / 1e6, total), "frames_per_s": F.try_divide(F.col("frames"), total)})


def dump_image(images: DataFrame | Images, tables: Tables, folder: str) -> DataFrame:
    """Write whole images under names made from their texts; returns ``image, file, sectors``.

    An image with missing or repeated sectors is an error, as are two images of
    one name; nothing is left of them.
    """
    sectors = toc.as_images(images).sectors
    dsf.register(sectors.sparkSession)
    name = report.image_name(F.col("disc_title"), F.col("disc_artist"), F.col("disc_catalog"))
    named = cut(_one_of_each(tables.discs.select("image", name.alias("file")), "file"))
    sectors.join(named, "image").select("file", "lsn", "data").write.format("image_files").mode("append").save(folder)
    return named.withColumn("sectors", dsf.written_sectors(folder)(F.col("file")))


def images_at(spark: SparkSession, path: str) -> Images:
    """Image files, of which only the sectors that are asked for are read."""
    return FileImages(spark, path)


def from_files(spark: SparkSession, path: str, lsn_from: int | None = None, lsn_to: int | None = None) -> DataFrame:
    """Sectors of image files, ``lsn_from`` to ``lsn_to`` - 1 only if these are given."""
    return FileImages(spark, path).between(lsn_from, lsn_to)
