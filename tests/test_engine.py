import socket
import threading

import pytest
from pyspark.sql import functions as F

from discloom.operators import pcm, report, tag, toc, tracks
from discloom.plans import extract, synthesis
from discloom.plans.extract import Tables
from discloom.plans.synthesis import SECTOR, area_toc, audio_sectors, master_sectors
from discloom.sources import remote, sectors

SCHEMA = "image string, lsn long, data binary"
TITLES = ["Été / one", "two", "three", "four", "five"]


def image(frame_format=2, per_track=(40_001, 25_000, 9_999), texts=True):
    """A stereo disc of three tracks and its samples."""
    own, at, lsn, start = [], [], 600, 0
    audio = {}
    for i, n in enumerate(per_track):
        data = bytes((i * 7 + j * 31 + j // 251) & 255 for j in range(2 * n))
        tc = list(range(start, start + 6))
        size = -(-len(data) // 6)
        if frame_format == 0:
            made = dict(audio_sectors([(t, data[k * size : (k + 1) * size]) for k, t in enumerate(tc)], lsn))
        else:
            made = {}
            for k in range(0, len(data), 2000):
                piece = data[k : k + 2000]
                made[lsn + k // 2000] = (bytes([1 << 5, 2 << 3 | len(piece) >> 8, len(piece) & 255]) + piece).ljust(SECTOR, b"\0")
        audio |= made
        own.append(
            {"start": start, "duration": 6, "lsn": lsn, "sectors": len(made), "texts": [(1, TITLES[i]), (2, f"P{i}")] if texts else [], "isrc": b"USABC9900001" if i else b"", "category": 1, "genre": i}
        )
        at.append(data)
        start, lsn = start + 6, lsn + len(made)
    contents = area_toc(b"TWOCHTOC", own, {"format": frame_format, "start": 600, "end": lsn, "channels": 2, "description": "An area", "play": (0, 0, 18)})
    size = len(contents) // SECTOR
    disc = {
        "area_starts": (544, 0, 0, 0), "area_sizes": (size, 0), "disc_catalog": b" C-1 ", "album_catalog": b"A-1", "texts": {16: "Album", 32: "Disc:1", 34: "Artist"}, "set_size": 2, "seq": 1,
        "disc_genre": [(1, 5)], "date": (2004, 5, 6),
    }
    out = master_sectors(disc) | {544 + i: contents[i * SECTOR : (i + 1) * SECTOR] for i in range(size)} | audio
    return out, at


def frame(spark, own, name="disc"):
    return spark.createDataFrame([(name, k, v) for k, v in own.items()], SCHEMA)


def written(spark, tmp_path, own, **options):
    s = frame(spark, own)
    extract.write_audio(extract.audio_files(s, extract.read_tables(s), **options), str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["disc"]
    return {p.name: p.read_bytes() for p in (tmp_path / "disc").iterdir()}


def channel_bytes(data):
    """Both channels' file bytes of a stream of samples."""
    back = lambda x: bytes(int(f"{b:08b}"[::-1], 2) for b in x)
    return back(data[0::2]), back(data[1::2])


def blocks_of(file):
    size = int.from_bytes(file[84:92], "little") - 12
    audio = file[92 : 92 + size]
    return audio, file[92 + size :]


def test_uncompressed_tracks_become_files(spark, tmp_path):
    own, samples = image()
    files = written(spark, tmp_path, own)
    assert sorted(files) == ["Artist-Disc_1-stereo-01-Été _ one.dsf", "Artist-Disc_1-stereo-02-two.dsf", "Artist-Disc_1-stereo-03-three.dsf"]
    for name, data in zip(sorted(files), samples, strict=True):
        f = files[name]
        audio, id3 = blocks_of(f)
        left, right = channel_bytes(data)
        n = -(-len(left) // 4096)
        expected = b"".join(x[i * 4096 : (i + 1) * 4096].ljust(4096, b"\0") for i in range(n) for x in (left, right))
        assert audio == expected
        number = lambda a, b: int.from_bytes(f[a:b], "little")  # noqa: E731, B023
        assert (f[:4], number(4, 12), number(12, 20), number(20, 28)) == (b"DSD ", 28, len(f), 92 + len(audio))
        assert (f[28:32], number(32, 40), number(40, 44), number(44, 48)) == (b"fmt ", 52, 1, 0)
        assert [number(a, a + 4) for a in (48, 52, 56, 60)] == [2, 2, 2_822_400, 1]
        assert (number(64, 72), number(72, 76), f[80:84]) == (len(left) * 8, 4096, b"data")
        assert id3[:6] == b"ID3\x03\0\0" and b"TPOS\0\0\0\x05\0\0\x001/2\0" in id3


def test_gapless_tails_are_handed_on(spark, tmp_path):
    own, samples = image()
    files = written(spark, tmp_path, own, carry=True)
    whole = [b"".join(channel_bytes(x)[c] for x in samples) for c in (0, 1)]
    got = b"".join(blocks_of(files[n])[0] for n in sorted(files))
    n = -(-len(whole[0]) // 4096)
    assert got == b"".join(x[i * 4096 : (i + 1) * 4096].ljust(4096, b"\0") for i in range(n) for x in whole)


def test_sample_counts_are_those_of_what_is_written(spark, tmp_path):
    own, samples = image()
    files = written(spark, tmp_path, own, carry=True)
    count, before = [int.from_bytes(files[n][64:72], "little") for n in sorted(files)], 0
    for n, x in zip(count[:2], samples, strict=False):
        before += len(x) // 2
        assert n == before // 4096 * 4096 * 8  # whole blocks; the tail is handed on
        before %= 4096
    assert count[2] == len(samples[2]) // 2 * 8  # the last track counts its own bytes


def test_short_tracks_hand_on_what_they_were_handed(spark, tmp_path):
    own, samples = image(per_track=(1000, 500, 700, 5000, 30))
    files = written(spark, tmp_path, own, carry=True)
    audio = [blocks_of(files[n])[0] for n in sorted(files)]
    whole = [b"".join(channel_bytes(x)[c] for x in samples) for c in (0, 1)]
    assert [len(x) for x in audio] == [0, 0, 0, 8192, 8192]
    assert b"".join(audio) == b"".join(x[i * 4096 : (i + 1) * 4096].ljust(4096, b"\0") for i in range(2) for x in whole)
    assert [int.from_bytes(files[n][64:72], "little") // 8 for n in sorted(files)] == [0, 0, 0, 4096, 30]


def two_images(spark, names=("a", "b")):
    own, samples = image()
    return spark.createDataFrame([(n, k, v) for n in names for k, v in own.items()], SCHEMA), own, samples


def test_each_image_has_its_folder(spark, tmp_path):
    s, own, _ = two_images(spark, ("/x/a.iso", "/x/b.ISO", "c"))
    extract.write_audio(extract.audio_files(s, extract.read_tables(s)), str(tmp_path))
    found = {p.name: {f.name: f.read_bytes() for f in p.iterdir()} for p in tmp_path.iterdir()}
    assert sorted(found) == ["a", "b", "c"] and found["a"] == found["b"] == found["c"] and len(found["a"]) == 3
    alone = written(spark, tmp_path / "alone", own) if (tmp_path / "alone").mkdir() is None else None
    assert found["a"] == alone


def test_images_of_one_name_are_an_error(spark, tmp_path):
    s, _, _ = two_images(spark, ("/x/a.iso", "/y/a.iso"))
    with pytest.raises(Exception, match="several images have the name a"):
        extract.write_audio(extract.audio_files(s, extract.read_tables(s)), str(tmp_path))
    with pytest.raises(Exception, match="several images have the name Disc_1-Artist"):
        extract.dump_image(s, extract.read_tables(s), str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_failed_jobs_leave_no_files(spark, tmp_path):
    own, _ = image(0)
    s = frame(spark, own)

    def failing(channels):
        def decode(raw):
            raise ValueError("broken frame")

        return decode

    with pytest.raises(Exception, match="broken frame"):
        extract.write_audio(extract.audio_files(s, extract.read_tables(s), decoder=failing), str(tmp_path))
    full = {i: own.get(i, bytes(2048)) for i in range(max(own) + 1) if i != 3}
    with pytest.raises(Exception, match="not each of 0 to"):
        extract.dump_image(frame(spark, full), extract.read_tables(frame(spark, full)), str(tmp_path))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_only_the_sectors_asked_for_are_read(spark, tmp_path):
    own, samples = image()
    last = max(own)
    for name in ("a", "b", "c"):
        # Files but the second end right after the contents: reading on would be an error.
        full = b"".join(own.get(i, bytes(2048)) for i in range(last + 1))
        (tmp_path / f"{name}.iso").write_bytes(full if name == "b" else full[: 600 * 2048])
    images = extract.images_at(spark, str(tmp_path))
    tables = extract.read_tables(images)
    assert tables.discs.count() == 3 and tables.tracks.count() == 9
    one = Tables(tables.discs, tables.areas.filter("image LIKE '%b.iso'"), tables.tracks)
    plan = extract.track_plan(one, "2")
    want = plan.select((F.col("high") - F.col("low")).alias("n")).first().n
    assert plan.count() == 1 and images.within(plan).count() == want
    assert toc.area_sectors(images, tables.discs).count() == 3 * tables.discs.select("area1_size").first()[0]
    got = extract.track_frames(images, one, "2").orderBy("order_no").collect()
    assert b"".join(bytes(r.raw) for r in got) == samples[1]
    # A table of sectors gives the same.
    table = spark.createDataFrame([(r.image, k, v) for r in one.areas.collect() for k, v in own.items()], SCHEMA)
    same = extract.track_frames(table, one, "2").orderBy("order_no").collect()
    assert [bytes(r.raw) for r in same] == [bytes(r.raw) for r in got]


def both_areas(stereo=True):
    """A disc with a multichannel area of two tracks, and maybe a stereo one of one track."""
    audio, lsn, parts = {}, 900, {}
    for area, channels, n in (("stereo", 2, 1), ("multichannel", 6, 2)):
        own = []
        for i in range(n):
            data = bytes((i * 5 + j * 17 + channels) & 255 for j in range(channels * 5000))
            made = {lsn + k // 1998: (bytes([1 << 5, 2 << 3 | len(data[k : k + 1998]) >> 8, len(data[k : k + 1998]) & 255]) + data[k : k + 1998]).ljust(SECTOR, b"\0") for k in range(0, len(data), 1998)}
            own.append({"start": 10 * i, "duration": 10, "lsn": lsn, "sectors": len(made), "texts": [(1, f"{area} {i + 1}")], "data": data})
            audio |= made
            lsn += len(made)
        kind = b"TWOCHTOC" if area == "stereo" else b"MULCHTOC"
        parts[area] = own, area_toc(kind, own, {"format": 2, "start": 900, "end": lsn, "channels": channels})
    size = len(parts["stereo"][1]) // SECTOR
    assert size == len(parts["multichannel"][1]) // SECTOR
    disc = {"area_starts": (544 if stereo else 0, 0, 600, 0), "area_sizes": (size if stereo else 0, size), "texts": {32: "Both"}}
    out = master_sectors(disc) | audio
    for at, area in ((544, "stereo"), (600, "multichannel")):
        out |= {at + i: parts[area][1][i * SECTOR : (i + 1) * SECTOR] for i in range(size)}
    return out, {area: [t["data"] for t in own] for area, (own, _) in parts.items()}


@pytest.mark.parametrize(("flags", "want"), [({}, 3), ({"stereo": True}, 1), ({"multichannel": True}, 2), ({"stereo": True, "multichannel": True}, 3)])
def test_areas_are_extracted_as_asked_for(spark, tmp_path, flags, want):
    own, samples = both_areas()
    files = written(spark, tmp_path, own, **flags)
    assert len(files) == want
    for name, data in files.items():
        area, n = ("stereo", 1) if "-stereo-" in name else ("multichannel", int(name.split("-mch-")[1][:2]))
        channels, sample = (2, samples["stereo"][0]) if area == "stereo" else (6, samples["multichannel"][n - 1])
        assert [int.from_bytes(data[a : a + 4], "little") for a in (48, 52)] == [{2: 2, 6: 7}[channels], channels]
        back = [bytes(int(f"{b:08b}"[::-1], 2) for b in sample[c::channels]) for c in range(channels)]
        blocks = -(-len(back[0]) // 4096)
        assert blocks_of(data)[0] == b"".join(x[i * 4096 : (i + 1) * 4096].ljust(4096, b"\0") for i in range(blocks) for x in back)


def test_areas_are_numbered_as_they_are_there(spark):
    for stereo, want in ((True, ["[0]", "[1]"]), (False, ["[0]"])):
        own, _ = both_areas(stereo)
        tables = extract.read_tables(frame(spark, own))
        lines = [r.line for r in report.report(tables.discs, tables.areas, tables.tracks).orderBy("section", "line_no").collect()]
        assert [x.split()[-1][:-1] for x in lines if x.startswith("    Area Information")] == want
        assert [x.split()[-1][:-1] for x in lines if x.startswith("    Track List")] == want
        assert f"Area Count: {len(want)}" in lines


def test_counts_of_frames_are_observed(spark):
    from pyspark.sql import Observation

    own, _ = image(0)
    s, seen = frame(spark, own), Observation("frames")
    tables = extract.read_tables(s)
    got = extract.track_frames(s, tables, "1", seen).collect()
    assert seen.get == {"frames": 6, "filtered": 0, "dropped": 0, "bytes": sum(len(r.raw) for r in got)} and len(got) == 6
    # A frame outside the track's times, and one whose packets are missing.
    cut = {k: v for k, v in own.items() if k != 607}
    seen = Observation("cut")
    shorter = Tables(tables.discs, tables.areas, tables.tracks.withColumn("duration_fc", F.lit(5)))
    got = extract.track_frames(frame(spark, cut), shorter, "1", seen).collect()
    assert seen.get["filtered"] == 1 and seen.get["frames"] == len(got) and seen.get["frames"] + seen.get["dropped"] == 5


def test_texts_that_do_not_end_or_lead_nowhere(spark):
    own, _ = image()
    size = max(k for k in own if k < 600) - 544 + 1
    contents = b"".join(own[544 + i] for i in range(size))
    base = int.from_bytes(contents[128:130], "big") * 2048
    unended = contents[:base] + contents[base:].rstrip(b"\0").ljust(size * 2048 - base, b"x")
    tables = extract.read_tables(frame(spark, own | {544 + i: unended[i * 2048 : (i + 1) * 2048] for i in range(size)}))
    rows = tables.tracks.orderBy("track_no").collect()
    assert [r.title for r in rows] == TITLES[:3] and rows[2].performer is None and rows[1].performer == "P1"
    spoilt = own | {544 + base // 2048: bytes(2048)}
    assert extract.read_tables(frame(spark, spoilt)).areas.count() == 0
    tables = extract.read_tables(frame(spark, spoilt), permissive=True)
    assert tables.areas.count() == 1 and [r.title for r in tables.tracks.collect()] == [None] * 3


def test_texts_in_the_encoding_that_is_named(spark):
    own, _ = image()
    size = max(k for k in own if k < 600) - 544 + 1
    contents = b"".join(own[544 + i] for i in range(size)).replace("Été".encode(), b"\xc9t\xe9 ")
    own |= {544 + i: contents[i * 2048 : (i + 1) * 2048] for i in range(size)}
    title = lambda **o: extract.read_tables(frame(spark, own), **o).tracks.filter("track_no = 1").first().title
    assert title(charsets=True) == "Été  / one" and title() == "\ufffdt\ufffd  / one"


def test_compressed_frames_need_a_decoder(spark, tmp_path):
    own, samples = image(0)
    s = frame(spark, own)
    tables = extract.read_tables(s)
    with pytest.raises(Exception, match="decoder not available"):
        extract.audio_files(s, tables, decoder=None).collect()
    files = written(spark, tmp_path, own, decoder=lambda channels: lambda raw: raw, selection="2-3")
    assert len(files) == 2
    left, _ = channel_bytes(samples[1])
    assert blocks_of(files["Artist-Disc_1-stereo-02-two.dsf"])[0][:4096] == left[:4096]


def test_frames_are_decoded_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(pcm, "BATCH_FRAMES", 7)
    made = spark.sparkContext.accumulator(0)

    def factory(channels):
        made.add(1)
        return lambda raw: raw * channels

    df = spark.createDataFrame([(i, 2 + i % 2, b"ab" if i % 5 else None) for i in range(100)], "n int, channels int, raw binary").coalesce(1)
    got = pcm.decode(df, factory).collect()
    assert [(r.n, None if r.raw is None else bytes(r.raw)) for r in got] == [(i, b"ab" * (2 + i % 2) if i % 5 else None) for i in range(100)]
    assert made.value == 2


def test_report_and_tables(spark):
    own, _ = image()
    tables = extract.read_tables(frame(spark, own))
    sizes = spark.createDataFrame([("disc", 1_000_000)], "image string, sectors long")
    lines = [r.line for r in report.report(tables.discs, tables.areas, tables.tracks, sizes).orderBy("section", "line_no").collect()]
    for expected in (
        "    Version:  1.20", "    Creation date: 2004-05-06", "    Hybrid Disc: false", "    Disc Catalog Number: C-1", "    Disc Category: General", "    Disc Genre: Classical",
        "    Locale: en, Code character set:[2], ISO-8859-1", "    Title: Disc:1", "    Title: Album", "Area Count: 1", "    Area ID: TWOCHTOC", "    Area Description: An area",
        "    Total Play Time: 00:00:18 [mins:secs:frames]", "    Speaker Config: 2 Channel", "    Frame Format: DSD 3-in-14 (uncompressed)", "        Title[0]: Été / one",
        "        Performer[2]: P2", "        Duration: 00:00:06 [mins:secs:frames]", "    ISRC Track [1]:", "      Country: US, Owner: ABC, Year: 99, Designation: 00001",
        "The size of sacd is ok (sectors=1000000). Size is: 2048000000 bytes, 2.048 GB (gigabyte)",
    ):
        assert expected in lines, expected
    assert lines.index("Disc Information:") == 0


def test_whole_tag(spark):
    own, _ = image()
    tables = extract.read_tables(frame(spark, own))
    got = {r.track_no: bytes(r.id3) for r in tag.with_tags(tables.tracks, tables.discs).collect()}

    def text(name, value):
        raw = b"\0" + value.encode("latin-1") + b"\0"
        return name + len(raw).to_bytes(4, "big") + b"\0\0" + raw

    frames = text(b"TIT2", "two") + text(b"TALB", "Album") + text(b"TXXX", "DISCSUBTITLE\0Disc:1") + text(b"TPE1", "P1") + text(b"TXXX", "PERFORMER\0P1")
    frames += text(b"TXXX", "Catalog Number\0C-1") + text(b"TXXX", "Album Catalog Number\0A-1") + text(b"TSRC", "USABC9900001") + text(b"TPOS", "1/2")
    frames += text(b"TCON", "Not defined") + text(b"TYER", "2004") + text(b"TDAT", "0605") + text(b"TRCK", "2/3")
    n = len(frames)
    assert got[2] == b"ID3\3\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frames
    assert b"TCON" not in got[1]  # the first track's genre, though general, has no name


def test_missing_master_table_is_an_error(spark):
    bad = spark.createDataFrame([("disc", 510, b"x" * 2048)], SCHEMA)
    with pytest.raises(Exception, match="no master table"):
        toc.discs(bad).collect()
    assert toc.discs(bad, strict=False).count() == 0
    short = spark.createDataFrame([("disc", 3, b"x" * 2048)], SCHEMA)  # the sector itself is missing
    with pytest.raises(Exception, match="no master table"):
        toc.discs(short).collect()


def test_missing_lists_are_null(spark):
    own, _ = image(texts=False)
    own = {k: (v if v[:8] != b"SACD_IGL" else bytes(2048)) for k, v in own.items()}
    rows = extract.read_tables(frame(spark, own)).tracks.orderBy("track_no").collect()
    assert [r.title for r in rows] == [None] * 3 and rows[0].isrc is None and rows[2].start_fc == 12


def test_tracks_without_times_cannot_be_extracted(spark):
    own, _ = image()
    spoilt = {k: (v if v[:8] != b"SACDTRL2" else bytes(2048)) for k, v in own.items()}
    s = frame(spark, spoilt)
    tables = extract.read_tables(s)
    assert [r.start_fc for r in tables.tracks.collect()] == [None] * 3
    with pytest.raises(Exception, match="no times or unknown format: track 2"):
        extract.track_frames(s, tables, "2").collect()


def test_codes_without_a_country_are_in_tags_but_not_in_reports(spark):
    own, _ = image()
    own = {k: v.replace(b"USABC9900001", b"\0\0ABC9900001") if v[:8] == b"SACD_IGL" else v for k, v in own.items()}
    tables = extract.read_tables(frame(spark, own))
    tags = {r.track_no: bytes(r.id3) for r in tag.with_tags(tables.tracks, tables.discs).collect()}
    assert b"TSRC" not in tags[1] and b"ABC9900001" in tags[2]
    lines = [r.line for r in report.report(tables.discs, tables.areas, tables.tracks).collect()]
    assert not [x for x in lines if "ISRC" in x]


def test_copies(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 2, "y"), ("d", 1, "z"), ("d", 2, "z")], "image string, toc int, value string")
    got = {r.image: (r.value, r.differ) for r in toc.resolve_copies(df, "value", ("image",)).collect()}
    assert got == {"a": ("y", True), "b": ("x", False), "c": ("y", False), "d": ("z", False)}


def test_selection():
    assert tracks.selected_numbers("1-3,5, 2,9-11") == [1, 2, 3, 5, 9, 10, 11]
    for bad in ("0", "3-1", "x", "1-2-3", "", "1,,2", "0-2"):
        with pytest.raises(ValueError):
            tracks.selected_numbers(bad)


def test_selected_track_must_exist(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "image string, track_no int")
    assert [r.track_no for r in tracks.select_tracks(df, "2", ["image"]).collect()] == [2]
    assert tracks.select_tracks(df, None, ["image"]).count() == 2
    with pytest.raises(Exception, match="no track 3"):
        tracks.select_tracks(df, "1,3", ["image"]).collect()


def test_blocks_follow_a_sequential_writer(spark):
    parts = [bytes((i * j) & 255 for j in range(n)) for i, n in enumerate((5, 8191, 1, 0, 20_000, 7), 1)]
    df = spark.createDataFrame([("k", i, x, 3) for i, x in enumerate(parts)], "k string, n int, raw binary, channels int").repartition(3)
    got = {(r.block_no, r.channel): bytes(r.bytes) for r in pcm.padded(pcm.blocks(df, ["k"], "n")).collect()}
    flat = b"".join(parts)
    for c in range(3):
        line = bytes(int(f"{b:08b}"[::-1], 2) for b in flat[c::3])
        for i in range(-(-len(line) // 4096)):
            assert got.pop((i, c)) == line[i * 4096 : (i + 1) * 4096].ljust(4096, b"\0")
    assert not got


@pytest.mark.parametrize("rows", ["1", "7", "10000"])
def test_blocks_of_many_streams(spark, rows):
    lengths = [0, 1, 5, 4095, 4096, 4097, 9000]
    streams = {(k, n): [(i, bytes((k * 7 + i + j) & 255 for j in range(lengths[(k + i * i) % 7])), n, k * 1000) for i in range(k)] for k in range(1, 9) for n in (1, 2, 6)}
    df = spark.createDataFrame([(*key, *x) for key, own in streams.items() for x in own], "k int, c int, n int, raw binary, channels int, begin int").repartition(5)
    want = {}
    for key, own in streams.items():
        flat, n, before = b"".join(x[1] for x in own), own[0][2], own[0][3]
        for c in range(n):
            for i, byte in enumerate(flat[c::n]):
                want.setdefault((*key, (before + i) // 4096, c), bytearray()).append(int(f"{byte:08b}"[::-1], 2))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = pcm.blocks(df, ["k", "c"], "n", start="begin").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == len(want) and {(r.k, r.c, r.block_no, r.channel): bytes(r.bytes) for r in got} == want


def test_file_source_reads_ranges(spark, tmp_path):
    path = tmp_path / "a.iso"
    path.write_bytes(b"".join(i.to_bytes(2, "big") * 1024 for i in range(1000)) + b"rest")
    sectors.register(spark)
    df = spark.read.format("disc_sectors").option("partitionSectors", 256).load(str(path))
    assert df.count() == 1000 and df.rdd.getNumPartitions() == 4
    some = extract.from_files(spark, str(path), 510, 1000)
    assert some.rdd.getNumPartitions() == 1 and some.count() == 490 and some.agg(F.min("lsn")).first()[0] == 510
    some = spark.read.format("disc_sectors").options(**{"partitionSectors": 256, "from": 510, "to": 1000}).load(str(path))
    assert some.rdd.getNumPartitions() == 2 and some.count() == 490
    # Filters of one use of a table don't reach its other uses.
    a, b = (df.filter(F.col("lsn") == n).select("image", F.col("lsn").alias(f"lsn_{n}")) for n in (3, 700))
    assert tuple(a.join(b, "image").first())[1:] == (3, 700) and df.filter("lsn = 5").count() == 1 and df.count() == 1000
    assert bytes(df.filter("lsn = 700").first().data[:2]) == (700).to_bytes(2, "big")
    assert sectors.sector_counts(spark, str(path)).first().sectors == 1000
    assert sectors.server_address("10.0.0.1:2002") == ("10.0.0.1", 2002)
    for bad in ("host", "a:b:c", "a:b", ":1"):
        with pytest.raises(ValueError):
            sectors.server_address(bad)


def test_dump_gives_the_same_bytes(spark, tmp_path):
    own, _ = image()
    last = max(own)
    full = {i: own.get(i, bytes(2048)) for i in range(last + 1)}
    s = frame(spark, full).repartition(4)
    got = extract.dump_image(s, extract.read_tables(s), str(tmp_path)).collect()
    assert [(r.file, r.sectors) for r in got] == [("Disc_1-Artist-[C-1].iso", last + 1)]
    assert (tmp_path / "Disc_1-Artist-[C-1].iso").read_bytes() == b"".join(full[i] for i in range(last + 1))


class Server(threading.Thread):
    """Shares sectors; each answer comes in two parts, the first of which may end with a zero."""

    def __init__(self, count):
        super().__init__(daemon=True)
        self.listener = socket.create_server(("127.0.0.1", 0))
        self.count, self.closed = count, 0

    def run(self):
        while True:
            try:
                s, _ = self.listener.accept()
            except OSError:
                return
            threading.Thread(target=self.serve, args=(s,), daemon=True).start()

    def serve(self, s):
        got = b""
        while more := s.recv(4096):
            got += more
            if got[-1:] != b"\0":
                continue
            kind, offset, count = got[1], 0, 0
            fields = remote.response(b"\x10" + got[3:-1]) if len(got) > 3 else None
            if kind == remote.READ:
                at, values = 2, []
                while at < len(got) - 1:
                    value, shift, at = 0, 0, at + 1
                    while True:
                        value |= (got[at] & 127) << shift
                        at, shift = at + 1, shift + 7
                        if got[at - 1] < 128:
                            break
                    values.append(value)
                offset, count = values
            del fields
            got, result, data = b"", 0, b""
            if kind == remote.SIZE:
                result = self.count
            if kind == remote.READ:
                result = min(count, 100)  # fewer than asked for
                data = b"".join((offset + i).to_bytes(4, "big") + bytes(2044) for i in range(result))
            self.closed += kind == remote.CLOSE
            out = b"\x08" + remote.varint(kind) + b"\x10" + remote.varint(result)
            out += (b"\x1a" + remote.varint(len(data)) + data if data else b"") + b"\0"
            s.sendall(out[: len(out) // 2])
            s.sendall(out[len(out) // 2 :])


def test_remote_source(spark):
    server = Server(700)
    server.start()
    sectors.register(spark)
    df = spark.read.format("remote_sectors").option("server", f"127.0.0.1:{server.listener.getsockname()[1]}").load()
    assert df.rdd.getNumPartitions() == 1
    rows = df.select("lsn", F.substring("data", 1, 4).alias("d")).collect()
    assert [r.lsn for r in rows] == list(range(700)) and all(int.from_bytes(r.d, "big") == r.lsn for r in rows)
    ranged = spark.read.format("remote_sectors").options(**{"server": f"127.0.0.1:{server.listener.getsockname()[1]}", "from": 650}).load()
    assert ranged.count() == 50 == df.filter("lsn >= 650").count() and server.closed
    server.listener.close()


def test_messages():
    assert remote.request(remote.READ, 0, 300) == b"\x08\x03\x10\x00\x18\xac\x02\x00"
    assert remote.response(b"\x08\x03\x10" + remote.varint(-1)) == (3, -1, b"")
    assert remote.response(b"\x08\x03\x10\x01\x1a\x05ab") is None and remote.response(b"\x08") is None


def test_texts_as_images(spark):
    df = spark.createDataFrame([(1, "a" * 100_000), (2, ""), (3, None), (4, "é")], "id long, t string")
    got = synthesis.text_images(df, "id", "t").groupBy("image").count().collect()
    assert {r.image for r in got} == {1, 4}



def slowly():
    """A decoder of frames that takes 5 ms for each."""

    def slow(channels):
        import time

        def one(raw):
            time.sleep(0.005)
            return raw

        return one

    return slow


@pytest.mark.parametrize("from_files", [False, True])
def test_times_of_each_track(spark, tmp_path, from_files):
    own, samples = image()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "disc.iso").write_bytes(b"".join(own.get(i, b"\0" * SECTOR) for i in range(max(own) + 1)))
    s = extract.images_at(spark, str(tmp_path / "in")) if from_files else frame(spark, own)
    tables, times = extract.read_tables(s), extract.Times()
    extract.write_audio(extract.audio_files(s, tables, times=times), str(tmp_path / "out"), times)
    extract.write_audio(extract.audio_files(s, tables), str(tmp_path / "plain"))
    files = {p.name: p.read_bytes() for p in (tmp_path / "out" / "disc").iterdir()}
    assert files == {p.name: p.read_bytes() for p in (tmp_path / "plain" / "disc").iterdir()}
    got = sorted(extract.track_times(times).collect(), key=lambda r: r.track_no)
    assert [r.track_no for r in got] == [1, 2, 3] and [r.bytes for r in got] == [len(x) for x in samples]
    for r in got:
        assert r.file_bytes == len(files[r.file]) and r.frames > 0 and r.parse_s > 0 and r.write_s > 0 and r.decode_s == 0
        assert (r.read_s > 0) == from_files
        total = r.read_s + r.parse_s + r.decode_s + r.write_s
        assert r.frames_per_s == pytest.approx(r.frames / total) and r.mb_per_s == pytest.approx(r.file_bytes / 1e6 / total)


def test_times_are_shared_by_the_frames_that_took_them(spark):
    frames = spark.createDataFrame([(i, 2, bytes([i])) for i in range(20)], "n long, channels int, raw binary").coalesce(1)
    got = pcm.decode(frames, slowly(), spent="took").collect()
    assert [r.raw for r in got] == [bytes([i]) for i in range(20)] and all(5e6 <= r.took < 1e8 for r in got)


def test_times_of_compressed_tracks(spark, tmp_path):
    own, samples = image(frame_format=0)
    s, times = frame(spark, own), extract.Times()
    extract.write_audio(extract.audio_files(s, extract.read_tables(s), decoder=slowly(), times=times), str(tmp_path), times)
    got = sorted(extract.track_times(times).collect(), key=lambda r: r.track_no)
    assert [(r.frames, r.bytes) for r in got] == [(6, len(x)) for x in samples]
    assert all(r.decode_s >= 0.03 and r.parse_s > 0 and r.write_s > 0 and r.read_s == 0 for r in got)
