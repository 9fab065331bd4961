"""Disc images made from tables, for round trips through the engine.

Written from the layouts alone and apart from the readers, so that a round
trip tests both.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SECTOR = 2048


def audio_sectors(frames: list[tuple[int, bytes]], first: int = 0) -> Iterator[tuple[int, bytes]]:
    """``(lsn, data)`` of compressed-style audio sectors that hold ``(timecode, bytes)`` frames.

    Frames are cut into packets where sectors end; a frame may have 31 at most.
    """
    packs: list[tuple[int, int, int, bytes]] = []  # sector, frame, is start, bytes
    sector, used, count, starts = 0, 1, 0, 0
    for n, (_, data) in enumerate(frames):
        at, begun = 0, False
        while at < len(data) or not begun:
            need = 2 + (0 if begun else 4)
            room = SECTOR - used - need
            if room < 1 or count == 7 or (not begun and starts == 7):
                sector, used, count, starts = sector + 1, 1, 0, 0
                continue
            piece = data[at : at + room]
            packs.append((sector, n, 0 if begun else 1, piece))
            used, count, starts = used + need + len(piece), count + 1, starts + (0 if begun else 1)
            at, begun = at + len(piece), True
    sizes: dict[int, int] = {}
    for _, n, _, _ in packs:
        sizes[n] = sizes.get(n, 0) + 1
    for s in range(sector + 1 if packs else 0):
        own = [p for p in packs if p[0] == s]
        infos = [n for _, n, start, _ in own if start]
        head = bytes([1 | len(infos) << 2 | len(own) << 5])
        for _, _, start, piece in own:
            head += bytes([start << 7 | 2 << 3 | len(piece) >> 8, len(piece) & 0xFF])
        for n in infos:
            tc = frames[n][0]
            head += bytes([tc // 4500, tc // 75 % 60, tc % 75, sizes[n] << 2])
        yield first + s, (head + b"".join(piece for *_, piece in own)).ljust(SECTOR, b"\x00")


def text_images(texts: DataFrame, id_col: str, text: str, frame_bytes: int = 30_000) -> DataFrame:
    """``image long, lsn, data``: one image for each text, cut into frames of at most ``frame_bytes``.

    Null and empty texts have no sectors.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (t or "").encode()
                cuts = range(0, len(data), frame_bytes)
                rows = list(audio_sectors([(n, data[at : at + frame_bytes]) for n, at in enumerate(cuts)]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([image] * len(rows), pa.int64()), pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows])], ["image", "lsn", "data"]
                    )

    return texts.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(build, "image long, lsn long, data binary")


def plain_sectors(data: bytes, first: int = 0) -> dict[int, bytes]:
    """Sectors of uncompressed audio: one packet of audio in each, after one of other data."""
    out = {}
    for n, at in enumerate(range(0, len(data), 1990)):
        piece = data[at : at + 1990]
        head = bytes([2 << 5, 3 << 3, 6, 2 << 3 | len(piece) >> 8, len(piece) & 255])
        out[first + n] = (head + b"others" + piece).ljust(SECTOR, b"\x00")
    return out


def plain_images(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """``image long, lsn, data``: each text as the uncompressed audio of an image."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = plain_sectors((t or "").encode())
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(own), pa.int64()), pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], ["image", "lsn", "data"])

    return texts.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(build, "image long, lsn long, data binary")


def nation_discs(nations: DataFrame) -> DataFrame:
    """``image string, lsn, data``: a disc for each region, with its nations as the tracks of both areas.

    A track's samples are its name, filled up to 12 bytes, again and again.
    """

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows = key[0].as_py(), sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["n_nationkey"])
        audio: dict[int, bytes] = {}
        lsn, contents = 700, {}
        for area, channels, kind in (("stereo", 2, b"TWOCHTOC"), ("multichannel", 6, b"MULCHTOC")):
            own, first = [], lsn
            for i, r in enumerate(rows):
                made = plain_sectors(r["n_name"][:12].ljust(12, ".").encode() * (400 + 37 * r["n_nationkey"]) * (channels // 2), lsn)
                own.append({"start": 75 * i, "duration": 75, "lsn": lsn, "sectors": len(made), "texts": [(1, f"{r['n_name']} {channels}")]})
                audio |= made
                lsn += len(made)
            contents[area] = area_toc(kind, own, {"format": 2, "start": first, "end": lsn, "channels": channels})
        size = len(contents["stereo"]) // SECTOR
        disc = {"area_starts": (544, 0, 600, 0), "area_sizes": (size, size), "date": (2001 + n, 1 + n, 2 + n), "texts": {16: f"Album {n}", 32: f"Region {n}", 34: f"Artist {n}"}}
        sectors = master_sectors(disc) | audio
        for at, area in ((544, "stereo"), (600, "multichannel")):
            sectors |= {at + i: contents[area][i * SECTOR : (i + 1) * SECTOR] for i in range(size)}
        at = sorted(sectors)
        yield pa.RecordBatch.from_arrays([pa.array([f"region-{n}.iso"] * len(at)), pa.array(at, pa.int64()), pa.array([sectors[x] for x in at])], ["image", "lsn", "data"])

    return nations.select("n_regionkey", "n_nationkey", "n_name").groupBy("n_regionkey").applyInArrow(build, "image string, lsn long, data binary")


def master_sectors(disc: dict) -> dict[int, bytes]:
    """The master table of contents and the master texts of a disc."""
    m = bytearray(SECTOR)
    m[0:8], m[8:10] = b"SACDMTOC", bytes([1, 20])
    struct.pack_into(">HH", m, 16, disc.get("set_size", 1), disc.get("seq", 1))
    m[24:40] = disc.get("album_catalog", b"").ljust(16, b"\x00")
    struct.pack_into(">IIII", m, 64, *disc.get("area_starts", (0, 0, 0, 0)))
    m[80] = disc.get("flags", 0)
    struct.pack_into(">HH", m, 84, *disc.get("area_sizes", (0, 0)))
    m[88:104] = disc.get("disc_catalog", b"").ljust(16, b"\x00")
    for base, genres in ((40, disc.get("album_genre", [])), (104, disc.get("disc_genre", []))):
        for i, (category, genre) in enumerate(genres[:4]):
            struct.pack_into(">BBH", m, base + 4 * i, category, 0, genre)
    struct.pack_into(">HBB", m, 120, *disc.get("date", (2000, 1, 1)))
    m[128] = 1
    m[136:139] = b"en\x02"
    out = {510: bytes(m)}
    texts = disc.get("texts", {})
    if texts:
        t, at = bytearray(SECTOR), 64
        t[0:8] = b"SACDText"
        for pointer, value in texts.items():
            raw = value.encode() + b"\x00"
            struct.pack_into(">H", t, pointer, at)
            t[at : at + len(raw)] = raw
            at += len(raw)
        out[511] = bytes(t)
    return out


def area_toc(kind: bytes, tracks: list[dict], area: dict) -> bytes:
    """An area's table of contents: one header sector, three lists and the texts."""
    n = len(tracks)
    texts = bytearray(b"SACDTTxt" + bytes(2 * n))
    for i, t in enumerate(tracks):
        if t.get("texts"):
            struct.pack_into(">H", texts, 8 + 2 * i, len(texts))
            texts += bytes([len(t["texts"]), 0, 0, 0])
            for code, value in t["texts"]:
                texts += bytes([code, 0x20]) + value.encode() + b"\x00" * (1 + len(value) % 3)
    if len(texts) > 0xFFFF:
        raise ValueError("texts of an area may take 65535 bytes")
    text_sectors = -(-len(texts) // SECTOR)
    h = bytearray(SECTOR)
    h[0:8], h[8:10] = kind, bytes([1, 20])
    struct.pack_into(">H", h, 10, 5 + text_sectors)
    struct.pack_into(">I", h, 16, area.get("rate", 1000))
    h[20], h[21] = 4, area.get("format", 0)
    h[32], h[33] = area.get("channels", 2), area.get("setting", 0) << 5
    h[64:67] = bytes(area.get("play", (0, 0, 0)))
    h[69] = n
    struct.pack_into(">II", h, 72, area.get("start", 600), area.get("end", 700))
    h[80] = 1
    h[88:91] = b"en\x02"
    struct.pack_into(">H", h, 128, 5)
    if area.get("description"):
        raw = area["description"].encode() + b"\x00"
        struct.pack_into(">H", h, 144, 152)
        h[152 : 152 + len(raw)] = raw
    times, sectors, codes = bytearray(SECTOR), bytearray(SECTOR), bytearray(2 * SECTOR)
    times[0:8], sectors[0:8], codes[0:8] = b"SACDTRL2", b"SACDTRL1", b"SACD_IGL"
    for i, t in enumerate(tracks):
        for base, fc in ((8, t["start"]), (8 + 1020, t["duration"])):
            times[base + 4 * i : base + 4 * i + 4] = bytes([fc // 4500, fc // 75 % 60, fc % 75, 0])
        struct.pack_into(">I", sectors, 8 + 4 * i, t.get("lsn", 0))
        struct.pack_into(">I", sectors, 8 + 1020 + 4 * i, t.get("sectors", 0))
        codes[8 + 12 * i : 20 + 12 * i] = t.get("isrc", b"").ljust(12, b"\x00")
        struct.pack_into(">BBH", codes, 8 + 255 * 12 + 4 * i, t.get("category", 0), 0, t.get("genre", 0))
    return bytes(h + times + sectors + codes + texts.ljust(text_sectors * SECTOR, b"\x00"))


def part_discs(parts: DataFrame, tracks: int = 100) -> DataFrame:
    """``image string, lsn, data``: parts as tracks, ``tracks`` to a disc, by key.

    The disc of keys 0 to 99 is ``disc-0`` and so on; the keys' remainders are
    the track numbers, counted from 1 in key order without gaps.
    """

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["p_partkey"])
        n = key[0].as_py()
        own, at = [], 0
        for r in rows:
            k = r["p_partkey"]
            texts = [(1, f"old {r['p_name']}"), (1, r["p_name"])] + ([(2, r["p_brand"])] if k % 3 else []) + ([(4, r["p_type"])] if k % 2 else [])
            own.append(
                {
                    "start": at, "duration": 75 + k % 400, "lsn": 1000 + k if k % 5 else 0, "sectors": 10 + k % 7, "texts": texts,
                    "isrc": f"US{'ABC' if k % 4 else 'XYZ'}{k % 100:02d}{k % 100000:05d}".encode() if k % 6 else b"", "category": k % 3, "genre": k % 40,
                }
            )
            at += 75 + k % 400
        toc = area_toc(b"TWOCHTOC", own, {"start": 600, "end": 90_000, "channels": 2, "description": f"area {n}"})
        other = area_toc(b"TWOCHTOC", own, {"start": 600, "end": 80_000, "channels": 2}) if n % 2 else toc
        size = len(toc) // SECTOR
        disc = {
            "set_size": 1 + n % 3, "seq": 1, "flags": 0x80 if n % 2 else 0, "area_starts": (544, 544 + size if n % 3 else 0, 0, 0), "area_sizes": (size, 0),
            "disc_catalog": b"CAT-%d" % n if n % 2 else b"", "album_catalog": b"ALB-%d" % n, "disc_genre": [(n % 2, 5)], "album_genre": [(1, 1 + n % 30)], "date": (1999 + n % 20, 1 + n % 12, 1 + n % 28),
            "texts": {16: f"Album {n}", 34: f" Artist {n} "} | ({32: f"Disc {n}"} if n % 2 else {}),
        }
        sectors = master_sectors(disc) | {544 + i: toc[i * SECTOR : (i + 1) * SECTOR] for i in range(size)}
        # The backup copy is the one to trust where both are there and differ.
        if n % 3:
            sectors |= {544 + size + i: other[i * SECTOR : (i + 1) * SECTOR] for i in range(size)}
        lsn = sorted(sectors)
        yield pa.RecordBatch.from_arrays([pa.array([f"disc-{n}"] * len(lsn)), pa.array(lsn, pa.int64()), pa.array([sectors[x] for x in lsn])], ["image", "lsn", "data"])

    own = parts.select("p_partkey", "p_name", "p_brand", "p_type", F.expr(f"p_partkey div {tracks}").alias("n"))
    return own.groupBy("n").applyInArrow(build, "image string, lsn long, data binary")
