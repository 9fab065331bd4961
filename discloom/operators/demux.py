"""Audio sectors to packets, and packets to timecoded frames.

All packets of a batch of sectors are decoded at once from their own rows,
without a shuffle.  Frames are assembled after one shuffle of the packets by
stream, in which they are sorted: batch after batch, by rules on whole columns.
A task holds a batch and the one frame that it leaves unfinished, however long
the stream is.  A stream may be cut into segments, which are assembled apart
once the small states of all of them are known.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloom.functions.timecode import FRAMES_A_MINUTE, FRAMES_A_SECOND, in_range
from discloom.shared import sent

SECTOR_BYTES = 2048
AUDIO, SUPPLEMENTARY, PADDING = 2, 3, 7
#: Packets, and frame infos, that a sector's header has room for.
MOST = 7
#: Most sectors that a frame info can say a frame has.
MOST_SECTORS = 31
#: Sectors of a segment (2 MB).
SPAN = 1024
#: Columns of the time that reading and parsing took.
SPENT = ["read_ns", "parse_ns"]
INFO = "struct<tc: int, sector_count: int, bits: int>"


def _decoded(data: pa.Array) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Header fields of each sector, and fields of each packet by sector and place.

    A packet's ``k`` is the number of audio frame starts up to it in its sector;
    ``info`` is the place of the frame info that this number points at, or -1.
    A sector that is too short, or whose parts reach over its end, is corrupt
    and has no packets.
    """
    n, sizes = len(data), pc.fill_null(pc.binary_length(data), 0).to_numpy()
    whole = sizes >= SECTOR_BYTES
    grid = np.zeros((n, SECTOR_BYTES), np.uint8)
    if n:
        buffer, offsets = np.frombuffer(data.buffers()[2] or b"", np.uint8), np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + n + 1]
        if whole.all() and (sizes == SECTOR_BYTES).all():
            grid = buffer[offsets[0] : offsets[-1]].reshape(n, SECTOR_BYTES)
        else:
            for i in np.flatnonzero(whole).tolist():
                grid[i] = buffer[offsets[i] : offsets[i] + SECTOR_BYTES]
    head = grid[:, 0].astype(np.int32)
    packs, infos, dst = head >> 5, head >> 2 & 7, head & 1
    first, second = grid[:, 1 : 2 * MOST : 2].astype(np.int32), grid[:, 2 : 2 * MOST + 1 : 2].astype(np.int32)
    there = np.arange(MOST) < packs[:, None]
    start, kind, length = (first >> 7 == 1) & there, first >> 3 & 7, ((first & 7) << 8 | second) * there
    body = 1 + 2 * packs + infos * (3 + dst)
    ends = body[:, None] + np.cumsum(length, 1)
    corrupt = ~whole | (ends[:, -1] > sizes)
    there &= ~corrupt[:, None]
    audio = start & (kind == AUDIO)
    k = np.cumsum(audio, 1)
    row, place = np.nonzero(there)
    own = audio[row, place] & (k[row, place] <= infos[row])
    at = np.where(own, 1 + 2 * packs[row] + (k[row, place] - 1) * (3 + dst[row]), 0)
    m, s, f, last = (grid[row, at + i].astype(np.int32) for i in range(4))
    sectors = {"corrupt": corrupt, "dst_encoded": dst == 1, "n_packets": packs, "n_infos": infos}
    return sectors, {
        "row": row, "pno": place, "frame_start": start[row, place], "data_type": kind[row, place], "length": length[row, place], "k": k[row, place], "offset": ends[row, place] - length[row, place],
        "has_info": own, "tc": m * FRAMES_A_MINUTE + s * FRAMES_A_SECOND + f, "bits": last, "timed": own & (dst[row] == 1),
    }


def _int(values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    return pa.array(values.astype(np.int32), mask=None if valid is None else ~valid)


def decode_headers(sectors: DataFrame, data: str = "data") -> DataFrame:
    """Sectors with ``corrupt, dst_encoded, n_packets, n_infos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields, _ = _decoded(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fields["corrupt"]), pa.array(fields["dst_encoded"]), _int(fields["n_packets"]), _int(fields["n_infos"])], names)

    names, at = [*sectors.columns, "corrupt", "dst_encoded", "n_packets", "n_infos"], sectors.columns.index(data)
    return sectors.mapInArrow(run, _schema(sectors.schema, "corrupt boolean, dst_encoded boolean, n_packets int, n_infos int"))


def _schema(fields, more: str) -> T.StructType:
    return T.StructType([*fields, *T.StructType.fromDDL(more)])


def packets(sectors: DataFrame, keys: list[str], data: str = "data", strict: bool = True, timed: bool = False) -> DataFrame:
    """One row for each packet: ``keys, lsn, dst_encoded, pno, frame_start, data_type, length, k, info, payload``.

    ``info`` is null where a packet has none; its ``sector_count`` and ``bits``
    are null in sectors that aren't encoded.  A corrupt sector is an error, or
    with ``strict`` off has no rows.

    ``timed`` adds ``read_ns`` and ``parse_ns``: the sector's ``read_ns`` and the
    time of decoding it, shared by its audio packets, with 0 for all others.
    """
    plain = [*keys, "lsn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            began = time.perf_counter_ns()
            fields, p = _decoded(b.column(len(plain)))
            if strict and fields["corrupt"].any():
                raise ValueError(f"malformed audio sector {b.column(len(plain) - 1)[int(fields['corrupt'].argmax())]}")
            row = pa.array(p["row"])
            held = b.column(len(plain))
            offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset :] if len(held) else np.zeros(1, np.int32)
            begins, sizes = offsets[p["row"]] + p["offset"], p["length"]
            info = pa.StructArray.from_arrays(
                [_int(p["tc"]), _int(p["bits"] >> 2 & 31, p["timed"]), _int(p["bits"], p["timed"])], ["tc", "sector_count", "bits"], mask=pa.array(~p["has_info"])
            )
            payload, spent = _cut(held.buffers()[2], begins, sizes), []
            if timed:
                audio = p["data_type"] == AUDIO
                share = audio / np.maximum(np.bincount(p["row"][audio], minlength=b.num_rows), 1)[p["row"]]
                read = b.column(len(plain) + 1).to_numpy()[p["row"]] * share
                spent = [pa.array(read), pa.array(audio * ((time.perf_counter_ns() - began) / max(1, audio.sum())))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(i).take(row) for i in range(len(plain))), pa.array(fields["dst_encoded"][p["row"]]), _int(p["pno"]), pa.array(p["frame_start"]), _int(p["data_type"]),
                    _int(sizes), _int(p["k"]), info, payload, *spent,
                ],
                names,
            )

    names = [*plain, "dst_encoded", "pno", "frame_start", "data_type", "length", "k", "info", "payload", *(SPENT if timed else [])]
    more = f"dst_encoded boolean, pno int, frame_start boolean, data_type int, length int, k int, info {INFO}, payload binary" + ", read_ns double, parse_ns double" * timed
    return sectors.select(*plain, data, *(["read_ns"] if timed else [])).mapInArrow(run, _schema([sectors.schema[c] for c in plain], more))


def _cut(buffer: pa.Buffer | None, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parts of a buffer, one after another."""
    source = np.frombuffer(buffer or b"", np.uint8)
    ends = np.cumsum(sizes, dtype=np.int64)
    from_where = np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(source[from_where])])


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; null equals null."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def _frames(n_keys: int, n_extra: int, lost: bool, timed: bool = False):
    """Frames of packets sorted by stream and place: columns keys, lsn, frame_start, length, info, payload, extra.

    With ``timed``, the last two of ``extra`` are times, which are added up, the
    last one with the time of assembling the frame.
    """

    def rows_of(table: pa.Table, before: int, ended: bool) -> tuple[pa.RecordBatch | None, pa.Table, int]:
        """Frames that surely end, packets that must wait, and the number of frames of their stream before them."""
        began, n = time.perf_counter_ns(), table.num_rows
        new = np.zeros(n, bool)
        new[:1] = True
        for i in range(n_keys):
            new[1:] |= changes(table.column(i).combine_chunks())
        column = lambda i: table.column(n_keys + i).combine_chunks()
        info = column(3)
        lsn, start, length = column(0).to_numpy(), column(1).to_numpy(zero_copy_only=False), column(2).to_numpy()
        count = pc.fill_null(pc.struct_field(info, "sector_count"), 0).to_numpy()
        begins = start & info.is_valid().to_numpy(zero_copy_only=False)
        stream = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        # Number of the frame in its stream; what is carried over adds to the first one.
        total = np.cumsum(begins)
        fid = total - (total - begins)[first][stream] + np.where(stream == 0, before, 0)
        edge = new | begins
        group = np.cumsum(edge) - 1
        at = np.flatnonzero(edge)
        # The last group waits for more, unless all has come.
        wait = n if ended else int(at[-1])
        passed = int(fid[at[-1]]) - int(begins[at[-1]])
        # A start without an info counts as a packet, but its bytes belong to no frame.
        member = begins | ~start
        place = np.arange(n) - at[group] + 1
        held = np.cumsum(length * member)
        held = held - (held - length * member)[at][group]
        is_done = (place >= count[at][group]) & (held > 0)
        done_at = np.full(len(at), n)
        done_rows = np.flatnonzero(is_done)
        np.minimum.at(done_at, group[done_rows], done_rows)
        done = done_at < n
        done_lsn = np.where(done, lsn[np.minimum(done_at, n - 1)], np.iinfo(np.int64).max)
        counts = (fid > 0) & (lsn <= done_lsn[group])
        own = member & counts & (np.arange(n) < wait)
        # What comes after a done frame is no use but for the stream's name, which one row tells.
        kept = counts & (np.arange(n) >= wait)
        kept[-1:] |= not ended
        waiting = table.filter(pa.array(kept))
        last = np.ones(len(at), bool)
        last[:-1] = stream[at[1:]] != stream[at[:-1]]
        size = np.bincount(group[own], length[own], minlength=len(at)).astype(np.int64)
        ended_well = (done | last) & (size > 0)
        found = np.flatnonzero((fid[at] > 0) & (ended_well | lost) & (at < wait))
        if not len(found):
            return None, waiting, passed
        size[~ended_well] = 0
        own &= np.isin(group, found[ended_well[found]])
        payload = column(4)
        offsets = np.frombuffer(payload.buffers()[1], np.int32)[payload.offset : payload.offset + n]
        raw = _cut(payload.buffers()[2], offsets[own].astype(np.int64), length[own])
        bounds = np.concatenate([[0], np.cumsum(size[found])]).astype(np.int32)
        valid = np.packbits(ended_well[found], bitorder="little")
        raw = pa.Array.from_buffers(pa.binary(), len(found), [pa.py_buffer(valid), pa.py_buffer(bounds), raw.buffers()[2]])
        rows = pa.array(at[found])
        tc, sector_count = (pc.struct_field(info, f).take(rows) for f in ("tc", "sector_count"))
        extra = [column(5 + i).take(rows) for i in range(n_extra - 2 * timed)]
        for i in range(n_extra - 2 * timed, n_extra):
            total = np.bincount(group[:wait], column(5 + i).to_numpy()[:wait], minlength=len(at))[found]
            own_time = (time.perf_counter_ns() - began) / len(found) if i == n_extra - 1 else 0
            extra.append(pa.array(total + own_time))
        columns = [*(table.column(i).combine_chunks().take(rows) for i in range(n_keys)), pa.array(fid[at[found]]), tc, sector_count, pa.array(done[found]), raw, *extra]
        return pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))]), waiting, passed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, before = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = table if waiting is None else pa.concat_tables([waiting, table])
            out, waiting, before = rows_of(table, before, False)
            if out is not None:
                yield out
        if waiting is not None:
            out, _, _ = rows_of(waiting, before, True)
            if out is not None:
                yield out

    return run


def _dealt(audio: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Packets with the segment of ``span`` sectors that their frame begins in (``_home``).

    ``_base`` is the number of frames that begin in earlier segments, and
    ``_more`` whether any begin in later ones.  What a segment does to an open
    frame follows from a few numbers, which are merged over the segments of a
    stream without payload: where its first frame begins, how many do, and
    whether a segment in which none begins is sure to end the open one.
    """
    audio = audio.withColumn("_segment", F.expr(f"lsn div {span}"))
    opens, place = F.col("frame_start") & F.col("info").isNotNull(), F.struct("lsn", "_pno")
    states = audio.groupBy(*keys, "_segment").agg(
        F.count_if(opens).alias("_begins"),
        F.min(F.when(opens, place)).alias("_first"),
        ((F.count("*") >= MOST_SECTORS) & (F.sum(F.when(F.col("frame_start"), 0).otherwise(F.col("length"))) > 0)).alias("_ends"),
    )
    order = Window.partitionBy(*keys).orderBy("_segment")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    states = states.select(
        *keys, "_segment", "_first", "_ends",
        F.coalesce(F.sum("_begins").over(earlier), F.lit(0)).alias("_before"),
        F.last(F.when(F.col("_begins") > 0, F.struct("_segment", "_begins")), True).over(earlier).alias("_open"),
        F.sum("_begins").over(Window.partitionBy(*keys)).alias("_all"), "_begins",
    )
    # Segments that share an open frame have the same number of frames before them.
    between = Window.partitionBy(*keys, "_before").orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    names = {k: f"_of_{k}" for k in [*keys, "_segment"]}
    there = sent(states.withColumn("_ended", F.count_if("_ends").over(between) > 0).withColumnsRenamed(names))
    same = F.lit(True)
    for k, name in names.items():
        same &= F.col(k).eqNullSafe(F.col(name))
    own = F.coalesce(place >= F.col("_first"), F.lit(False))
    packs = audio.join(there, same).filter(own | (F.col("_open").isNotNull() & ~F.col("_ended")))
    base = F.when(own, F.col("_before")).otherwise(F.col("_before") - F.col("_open._begins"))
    more = F.when(own, F.col("_all") > F.col("_before") + F.col("_begins")).otherwise(F.col("_all") > F.col("_before"))
    return packs.select(*audio.drop("_segment").columns, F.when(own, F.col("_segment")).otherwise(F.col("_open._segment")).alias("_home"), base.alias("_base"), more.alias("_more"))


def assemble(packs: DataFrame, keys: list[str], start: str | None = None, end: str | None = None, lost: bool = False, span: int | None = None, timed: bool = False) -> DataFrame:
    """Frames of each stream: ``keys, fid, tc, sector_count, done, raw, kept``.

    A stream is what shares ``keys``, ordered by ``lsn, pno``.  A frame begins
    at a start packet that has a frame info; packets before the first are
    dropped.  It is done in the first sector by whose end it holds as many
    packets as its info says and any bytes, and takes no packets of later
    sectors.  A frame that isn't done is lost unless it is the stream's last.
    ``kept`` tells whether the timecode is in ``[start, end)``, columns of
    ``packs``; all are kept without these.  Data types other than audio are
    passed over.  With ``lost``, lost frames have rows too, with null ``raw`` and
    ``lost`` true, which is a column then.  With ``timed``, packets' times are
    added up for each frame, ``parse_ns`` with the time of assembling it.

    Without ``span``, packets are shuffled once and a stream, which a disc's
    size bounds, is one task's work, as a sorted sequence of batches.  With it,
    a stream is cut into segments of ``span`` sectors, which are worked on
    apart, with the same frames: ``packs`` is read a second time, without
    payload, for the state of each segment.  Packets are still shuffled once
    while there are up to ``SENT_ROWS`` segments (0.5 TB), and twice above.
    """
    extra, times = [c for c in (start, end) if c], SPENT if timed else []
    audio = packs.filter(F.col("data_type") == AUDIO).select(*keys, "lsn", "frame_start", "length", "info", "payload", *(F.col(c).alias(f"_{c}") for c in extra), *times, F.col("pno").alias("_pno"))
    more = [F.col("raw").isNull().alias("lost")] if lost else []
    held, fields = [*keys], [packs.schema[k] for k in keys]
    along = [(f"_{c}", packs.schema[c].dataType) for c in extra]
    if span:
        audio = _dealt(audio, keys, span)
        held, fields = [*keys, "_home"], [*fields, T.StructField("_home", T.LongType())]
        along += [("_base", T.LongType()), ("_more", T.BooleanType())]
    along += [(c, T.DoubleType()) for c in times]
    audio = audio.select(*held, "lsn", "frame_start", "length", "info", "payload", *(c for c, _ in along), "_pno")
    audio = audio.repartition(*held).sortWithinPartitions(*held, "lsn", "_pno").drop("_pno")
    schema = _schema(fields, "fid long, tc int, sector_count int, done boolean, raw binary")
    for c, kind in along:
        schema = schema.add(c, kind)
    frames = audio.mapInArrow(_frames(len(held), len(along), lost, timed), schema)
    if span:
        # The last frame of a segment is the stream's last only if none begins later.
        whole = F.col("done") | ~F.col("_more")
        frames = frames.withColumn("fid", F.col("fid") + F.col("_base")).withColumn("raw", F.when(whole, F.col("raw")))
        frames = frames if lost else frames.filter(whole)
    kept = in_range(F.col("tc"), F.col(f"_{start}"), F.col(f"_{end}")) if start and end else F.lit(True)
    return frames.select(*keys, "fid", "tc", "sector_count", "done", "raw", kept.alias("kept"), *more, *times)


def plain_audio(packs: DataFrame, keys: list[str]) -> DataFrame:
    """Uncompressed streams: the audio bytes of each sector, in order, as ``keys, lsn, raw``.

    There is no timecode filter; the order of rows is that of ``lsn``.
    """
    audio = packs.filter((F.col("data_type") == AUDIO) & (F.col("length") > 0))
    return audio.groupBy(*keys, "lsn").agg(F.expr("listagg(payload) WITHIN GROUP (ORDER BY pno)").alias("raw"))


def plain_sectors(sectors: DataFrame, keys: list[str], data: str = "data", timed: bool = False) -> DataFrame:
    """The same rows as :func:`plain_audio` of the sectors' packets, straight from the sectors: nothing is shuffled.

    ``timed`` keeps the sectors' ``read_ns`` and adds ``parse_ns``.
    """
    plain = [*keys, "lsn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            began = time.perf_counter_ns()
            held = b.column(len(plain))
            fields, p = _decoded(held)
            if fields["corrupt"].any():
                raise ValueError(f"malformed audio sector {b.column(len(plain) - 1)[int(fields['corrupt'].argmax())]}")
            own = (p["data_type"] == AUDIO) & (p["length"] > 0)
            offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset :] if len(held) else np.zeros(1, np.int32)
            row, length = p["row"][own], p["length"][own]
            parts = _cut(held.buffers()[2], offsets[row] + p["offset"][own], length)
            some, sizes = np.unique(row), np.bincount(row, length).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(sizes[some])]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(bounds), parts.buffers()[2]])
            columns, names = [*(b.column(i).take(pa.array(some)) for i in range(len(plain))), raw], [*plain, "raw"]
            if timed:
                columns.append(b.column(len(plain) + 1).take(pa.array(some)))
                columns.append(pa.array(np.full(len(some), (time.perf_counter_ns() - began) / max(1, len(some)))))
                names += SPENT
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = _schema([sectors.schema[c] for c in plain], "raw binary" + ", read_ns double, parse_ns double" * timed)
    return sectors.select(*plain, data, *(["read_ns"] if timed else [])).mapInArrow(run, fields)


def frame_counters(frames: DataFrame, keys: list[str]) -> DataFrame:
    """``decoded, filtered, bytes`` of each stream; an unfinished last frame isn't counted as filtered."""
    return frames.groupBy(*keys).agg(
        F.count_if("kept").alias("decoded"),
        F.count_if(~F.col("kept") & F.col("done")).alias("filtered"),
        F.sum(F.when(F.col("kept"), F.length("raw")).otherwise(0)).cast("long").alias("bytes"),
    )
