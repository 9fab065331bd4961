import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from discloom.operators import demux
from discloom.plans.synthesis import audio_sectors

SCHEMA = "image string, lsn long, data binary"


def sector(packs, infos):
    head = bytes([1 | len(infos) << 2 | len(packs) << 5])
    for start, kind, data in packs:
        head += bytes([start << 7 | kind << 3 | len(data) >> 8, len(data) & 255])
    for m, s, f, n in infos:
        head += bytes([m, s, f, (n & 31) << 2])
    return (head + b"".join(x for *_, x in packs)).ljust(2048, b"\0")


def frames(spark, rows, span=None):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = demux.assemble(demux.packets(df, ["image"]), ["image"], span=span).collect()
    return {image: [(r.tc, bytes(r.raw)) for r in sorted(got, key=lambda r: r.fid) if r.image == image] for image in {r[0] for r in rows}}


def machine(sectors):
    """A sequential model of the assembly of one stream."""
    out, buffer, left, tc = [], None, 0, None
    for packs, infos in sectors:
        nth = 0
        for start, kind, data in packs:
            if kind != 2:
                continue
            if start:
                nth += 1
                if nth <= len(infos):
                    m, s, f, n = infos[nth - 1]
                    if buffer and left <= 0:
                        out.append((tc, buffer))
                    buffer, left, tc = data, (n & 31) - 1, m * 4500 + s * 75 + f
                elif buffer is not None:
                    left -= 1
                continue
            if buffer is not None:
                buffer, left = buffer + data, left - 1
        if buffer and left <= 0:
            out.append((tc, buffer))
            buffer = None
    if buffer:
        out.append((tc, buffer))
    return out


def test_three_frames_in_one_sector(spark):
    data = bytes.fromhex("ff06008038101060014980") + b"\0"
    got = frames(spark, [("x", 0, sector([(1, 2, data)] * 3, [(0, 0, i, 1) for i in range(3)]))])
    assert got["x"] == [(i, data) for i in range(3)]


def test_three_frames_over_five_sectors(spark):
    a, b, c = (bytes([i]) * n for i, n in ((1, 3098), (2, 2783), (3, 2956)))
    own = [
        sector([(1, 2, a[:2041])], [(0, 0, 0, 2)]),
        sector([(0, 2, a[2041:]), (1, 2, b[:982])], [(0, 0, 1, 2)]),
        sector([(0, 2, b[982:]), (1, 2, c[:238])], [(0, 0, 2, 3)]),
        sector([(0, 2, c[238:2283])], []),
        sector([(0, 2, c[2283:])], []),
    ]
    assert frames(spark, [("y", i, x) for i, x in enumerate(own)])["y"] == [(0, a), (1, b), (2, c)]


def test_other_data_types_and_lost_frames(spark):
    own = [
        ([(0, 2, b"lost"), (1, 2, b"aa"), (0, 3, b"text"), (0, 7, b"pad")], [(0, 0, 9, 3)]),
        ([(1, 2, b"bb"), (0, 2, b"cc"), (1, 2, b"no info")], [(0, 1, 0, 2)]),
        ([(0, 2, b"after")], []),
    ]
    got = frames(spark, [("z", i, sector(*x)) for i, x in enumerate(own)])["z"]
    assert got == machine(own) == [(75, b"bbcc")]


packet = st.tuples(st.integers(0, 1), st.sampled_from([2, 2, 2, 3, 7]), st.binary(max_size=5))
info = st.tuples(st.just(0), st.integers(0, 3), st.integers(0, 74), st.integers(0, 4))
stream = st.lists(st.tuples(st.lists(packet, max_size=7), st.lists(info, max_size=7)), max_size=6)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(stream, min_size=20, max_size=40))
def test_assembly_is_that_of_a_state_machine(spark, streams):
    rows = [(str(n), i, sector(*x)) for n, s in enumerate(streams) for i, x in enumerate(s)]
    if rows:
        got = frames(spark, rows)
        for n, s in enumerate(streams):
            assert got.get(str(n), []) == machine(s), s


@pytest.mark.parametrize("rows", ["1", "3", "10000"])
def test_batches_of_a_stream_join_up(spark, rows):
    rng = random.Random(4)
    streams = {}
    for name in ("a", "b", None):
        own = []
        for _ in range(60):
            packs = [(rng.randrange(2), rng.choice([2, 2, 3]), bytes(rng.randrange(1, 30))) for _ in range(rng.randrange(8))]
            own.append((packs, [(0, rng.randrange(4), rng.randrange(75), rng.randrange(5)) for _ in range(rng.randrange(5))]))
        streams[name] = own
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = frames(spark, [(name, i, sector(*x)) for name, own in streams.items() for i, x in enumerate(own)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == {name: machine(own) for name, own in streams.items()}


@pytest.mark.parametrize("span", [1, 3, 8, 1000])
def test_segments_give_the_frames_of_whole_streams(spark, span):
    rng = random.Random(span)
    streams = {}
    for name in ("often", "seldom", "never", "empty", "long", None):
        begins = {"often": 0.6, "seldom": 0.05, "never": 0, "long": 0.02}.get(name, 0.3)
        own = []
        for _ in range(80):
            size = 0 if name == "empty" else 20
            packs = [(int(rng.random() < begins), rng.choice([2, 2, 2, 3]), bytes(rng.randrange(1 + size))) for _ in range(rng.randrange(8))]
            starts = sum(a for a, kind, _ in packs if kind == 2)
            own.append((packs, [(0, rng.randrange(4), rng.randrange(75), rng.choice([1, 2, 9, 31])) for _ in range(starts - (rng.random() < 0.2 and starts > 0))]))
        streams[name] = own
    rows = [(name, i + 7, sector(*x)) for name, own in streams.items() for i, x in enumerate(own)]
    got = frames(spark, rows, span)
    assert {k: got.get(k, []) for k in streams} == {name: machine(own) for name, own in streams.items()}
    packs = demux.packets(spark.createDataFrame(rows, SCHEMA), ["image"])
    columns = ["image", "fid", "tc", "sector_count", "done", "raw", "lost"]
    whole, apart = (demux.assemble(packs, ["image"], lost=True, span=x).select(columns) for x in (None, span))
    assert sorted(map(str, apart.collect())) == sorted(map(str, whole.collect()))


def test_a_stream_in_segments_is_many_tasks(spark):
    rows = [("x", lsn, data) for lsn, data in audio_sectors([(t, bytes([t % 251]) * 1500) for t in range(400)])]
    packs = demux.packets(spark.createDataFrame(rows, SCHEMA), ["image"])
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = demux.assemble(packs, ["image"], span=32).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert len(got) == 400 and len({r.task for r in got}) > 3
    assert max(sum(r.task == t for r in got) for t in {r.task for r in got}) < 300


def test_timecode_filter_and_counters(spark):
    rows = [("x", lsn, data) for lsn, data in audio_sectors([(t, bytes([t]) * 900) for t in range(10)])]
    packs = demux.packets(spark.createDataFrame(rows, SCHEMA), ["image"]).selectExpr("*", "3 AS a", "6 AS b")
    got = demux.assemble(packs, ["image"], "a", "b")
    assert sorted(r.tc for r in got.filter("kept").collect()) == [3, 4, 5]
    assert demux.frame_counters(got, ["image"]).first()[1:] == (3, 7, 2700)


def test_malformed_sectors(spark):
    short = spark.createDataFrame([("x", 0, b"\x21"), ("x", 1, bytes([1 | 1 << 5, 0x97, 0xF0]).ljust(2048, b"\0")), ("x", 2, None)], SCHEMA)
    with pytest.raises(Exception, match="malformed audio sector"):
        demux.packets(short, ["image"]).collect()
    assert [r.lsn for r in demux.packets(short, ["image"], strict=False).collect()] == [1]
    assert [r.corrupt for r in demux.decode_headers(short).orderBy("lsn").collect()] == [True, False, True]
    long = spark.createDataFrame([("x", 0, bytes([1 | 7 << 5] + [0x97, 0xFF] * 7).ljust(2048, b"\0"))], SCHEMA)
    assert demux.decode_headers(long).first().corrupt


def test_plain_audio(spark):
    own = [([(1, 2, b"ab"), (0, 3, b"no"), (0, 2, b"cd")], []), ([(0, 2, b"ef")], [])]
    df = spark.createDataFrame([("x", i, sector(*s)) for i, s in enumerate(own)], SCHEMA)
    got = demux.plain_audio(demux.packets(df, ["image"]), ["image"]).orderBy("lsn").collect()
    assert b"".join(bytes(r.raw) for r in got) == b"abcdef"
