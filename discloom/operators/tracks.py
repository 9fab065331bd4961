"""Track planning: sector ranges, timecode ranges, selection, range joins, gapless carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from discloom.functions.timecode import FRAMES_A_MINUTE, sectors_of_three_frames
from discloom.shared import cut, sent

#: Width of the buckets that turn range joins into equi-joins.
LSN_BUCKET = 4096


def track_ranges(tracks: DataFrame, areas: DataFrame, keys: list[str]) -> DataFrame:
    """Timecode range and sector range of each track.

    ``tracks`` has ``keys, track_no, start_fc, duration_fc, start_lsn,
    length_lsn``; ``areas`` has ``keys, frame_format, track_start, track_end``.
    Returns ``keys, track_no, tc_start, tc_end, lsn_start, lsn_end``.  Where the
    sector list has no entry (null or zero), a range is estimated from the
    timecodes; the first track then begins at the area's start and the last
    ends at its end.
    """
    order = Window.partitionBy(*keys).orderBy("track_no")
    a = areas.select(*keys, "track_start", "track_end", sectors_of_three_frames(F.col("frame_format")).alias("spf3"))
    t = tracks.withColumn("next_fc", F.lead("start_fc").over(order)).join(a, keys)
    listed = (F.coalesce("start_lsn", F.lit(0)) != 0) & (F.coalesce("length_lsn", F.lit(0)) != 0)
    guess = lambda fc: F.col("track_start") + F.expr(f"{fc} * spf3 div 3")
    first = F.when(F.col("track_no") == 1, F.col("track_start")).otherwise(guess("start_fc"))
    last = F.when(F.col("next_fc").isNull(), F.col("track_end")).otherwise(guess("next_fc"))
    return t.select(
        *keys,
        "track_no",
        F.col("start_fc").alias("tc_start"),
        (F.col("start_fc") + F.col("duration_fc")).alias("tc_end"),
        F.when(listed, F.col("start_lsn")).otherwise(first).cast("long").alias("lsn_start"),
        F.when(listed, F.col("start_lsn") + F.col("length_lsn")).otherwise(last).cast("long").alias("lsn_end"),
    )


def in_track_sectors(sectors: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Sectors joined with each track whose range holds them; a border sector may be in two."""
    bucket = F.explode(F.expr(f"sequence(lsn_start div {LSN_BUCKET}, (lsn_end - 1) div {LSN_BUCKET})"))
    r = ranges.filter("lsn_end > lsn_start").withColumn("_b", bucket)
    s = sectors.withColumn("_b", F.expr(f"lsn div {LSN_BUCKET}"))
    return s.join(r, [*keys, "_b"]).filter("lsn >= lsn_start AND lsn < lsn_end").drop("_b")


def counted_sectors(sectors: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks with the number and the first of the sectors in their range: adds ``sectors, first_lsn``.

    The same as counting the rows of :func:`in_track_sectors` for each track,
    tracks without sectors left out, but the work is that of the two tables, not
    of their pairs: sectors are counted from each bucket's beginning, and what was
    counted at a range's start is taken from what was counted at its end.
    """
    ends = ranges.filter("lsn_end > lsn_start")
    places = sectors.select(*keys, "lsn", F.lit(1).alias("n"), F.lit(0).alias("is_end"))
    places = places.unionByName(ends.select(*keys, F.explode(F.array("lsn_start", "lsn_end")).alias("lsn"), F.lit(0).alias("n"), F.lit(1).alias("is_end")))
    places = places.filter("lsn IS NOT NULL").groupBy(*keys, "lsn").agg(F.sum("n").alias("n"), F.max("is_end").alias("is_end"))
    places = cut(places.withColumns({"_b": F.expr(f"(lsn - pmod(lsn, {LSN_BUCKET})) div {LSN_BUCKET}"), "own": F.expr("CASE WHEN n > 0 THEN lsn END")}))
    # A bucket has as many places as numbers at most; then buckets are added up, of which an image has few.
    buckets = places.groupBy(*keys, "_b").agg(F.sum("n").alias("n"), F.min("own").alias("own"))
    up, down = (Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow) for x in (F.col("_b"), F.desc("_b")))
    buckets = buckets.select(*keys, "_b", (F.sum("n").over(up) - F.col("n")).alias("earlier"), F.min("own").over(down).alias("own"))
    buckets = buckets.withColumn("later", F.lead("own").over(Window.partitionBy(*keys).orderBy("_b"))).drop("own")
    up, down = (Window.partitionBy(*keys, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow) for x in (F.col("lsn"), F.desc("lsn")))
    found = places.select(*keys, "_b", "lsn", "is_end", (F.sum("n").over(up) - F.col("n")).alias("before"), F.min("own").over(down).alias("next")).filter("is_end = 1")
    found = cut(found.join(buckets, [*keys, "_b"]).select(*keys, "lsn", (F.col("before") + F.col("earlier")).alias("before"), F.coalesce("next", "later").alias("first_lsn")))
    starts = found.select(*keys, F.col("lsn").alias("lsn_start"), F.col("before").alias("_before"), "first_lsn")
    stops = found.select(*keys, F.col("lsn").alias("lsn_end"), F.col("before").alias("_until"))
    counted = ends.join(starts, [*keys, "lsn_start"]).join(stops, [*keys, "lsn_end"]).withColumn("sectors", F.col("_until") - F.col("_before"))
    return counted.filter("sectors > 0").select(*ranges.columns, "sectors", "first_lsn")


def in_track_times(frames: DataFrame, ranges: DataFrame, keys: list[str], tc: str = "tc") -> DataFrame:
    """Frames joined with each track whose half-open timecode range holds them."""
    bucket = F.explode(F.expr(f"sequence(tc_start div {FRAMES_A_MINUTE}, (tc_end - 1) div {FRAMES_A_MINUTE})"))
    r = ranges.filter("tc_end > tc_start").withColumn("_b", bucket)
    f = frames.withColumn("_b", F.expr(f"{tc} div {FRAMES_A_MINUTE}"))
    return f.join(r, [*keys, "_b"]).filter((F.col(tc) >= F.col("tc_start")) & (F.col(tc) < F.col("tc_end"))).drop("_b")


def selected_numbers(selection: str) -> list[int]:
    """Sorted track numbers of a selection such as ``1-3,5``.

    Zero, reversed or non-numeric parts are errors.
    """
    found: set[int] = set()
    for field in selection.split(","):
        ends = [x.strip() if i == 0 and "-" not in field else x for i, x in enumerate(field.strip().split("-"))]
        if len(ends) > 2 or not all(x.isascii() and x.isdigit() for x in ends):
            raise ValueError(f"not a track or range of tracks: {field.strip()!r}")
        low, high = int(ends[0]), int(ends[-1])
        if low < 1 or high < low:
            raise ValueError(f"tracks count from 1 and ranges go up: {field.strip()!r}")
        found.update(range(low, high + 1))
    return sorted(found)


def select_tracks(tracks: DataFrame, selection: str | None, keys: list[str]) -> DataFrame:
    """The selected tracks, all without a selection; a number that an area lacks is an error in its rows.

    The greatest numbers are found beforehand and joined, so that rows of one area, however many, stay where they are.
    """
    if not selection:
        return tracks
    numbers = F.array(*map(F.lit, selected_numbers(selection)))
    own = [f"_key{i}" for i in range(len(keys))]
    greatest = sent(tracks.groupBy(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True))).agg(F.max("track_no").alias("_most")))
    most, same = F.col("_most"), [tracks[k].eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    checked = F.when(F.array_max(numbers) > most, F.raise_error(F.concat(F.lit("no track "), F.array_max(numbers).cast("string"))).cast("boolean")).otherwise(
        F.array_contains(numbers, F.col("track_no"))
    )
    return tracks.join(greatest, same).withColumn("_own", checked).filter("_own").select(*(tracks[c] for c in tracks.columns))


def gapless(lengths: DataFrame, keys: list[str], last: str = "track_count", block: int = 4096, carry: bool = True) -> DataFrame:
    """Whole blocks that each track's file takes: adds ``start_byte, end_byte, carries, blocks``.

    ``lengths`` has ``keys, track_no, len`` (bytes of one channel) and the
    area's number of tracks.  With ``carry``, a track hands what its last block
    lacks on to the next one, if that is extracted too; the area's last track
    and tracks without ``carry`` are padded.
    """
    if carry:
        island = F.col("track_no") - F.row_number().over(Window.partitionBy(*keys).orderBy("track_no"))
        out = lengths.withColumn("_i", island)
        run = Window.partitionBy(*keys, "_i").orderBy("track_no")
        out = out.withColumn("end_byte", F.sum("len").over(run)).withColumn("start_byte", F.col("end_byte") - F.col("len")).drop("_i")
    else:
        out = lengths.withColumns({"start_byte": F.lit(0).cast("long"), "end_byte": F.col("len").cast("long")})
    carries = F.lit(carry) & (F.col("track_no") < F.col(last)) & (F.col("end_byte") % block > 0)
    out = out.withColumn("carries", carries)
    ends = F.when(F.col("carries"), F.expr(f"end_byte div {block}")).otherwise(F.expr(f"(end_byte + {block - 1}) div {block}"))
    return out.withColumn("blocks", (ends - F.expr(f"start_byte div {block}")).cast("long"))
