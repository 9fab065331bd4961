import random

import pytest
from pyspark.sql import functions as F
from test_engine import SCHEMA, Server, frame, image

from discloom.operators import toc
from discloom.plans import extract
from discloom.sources import remote, sectors


def scanned(df):
    """Rows that leave the plan's file scans."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan]
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            rows += p.metrics().get("numOutputRows").get().value()
        children = p.children()
        stack += [children.apply(i) for i in range(children.size())]
        if name.endswith("QueryStageExec"):
            stack.append(p.plan())
    return rows


@pytest.fixture
def tables(spark, tmp_path):
    """Two images as a Parquet table of small row groups, sorted, with much between what is asked for."""
    own, _ = image()
    rows = [(n, i, own.get(i, bytes(2048))) for n in ("a", "b") for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange(8, "image", "lsn").sortWithinPartitions("image", "lsn")
    df.write.option("parquet.block.size", 65536).option("parquet.page.size", 4096).option("parquet.page.row.count.limit", 100).parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t")), own


def test_scans_of_sector_tables_are_given_ranges(spark, tables):
    table, own = tables
    discs = toc.discs(table)
    areas = toc.area_sectors(table, discs)
    plan = areas._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line and "GreaterThanOrEqual(lsn" in line and "LessThan(lsn" in line]
    assert pushed and "data#" in plan
    assert scanned(areas) < 2000
    whole = extract.read_tables(table)
    frames = extract.track_frames(table, whole, selection="2")
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lsn" in plan and "In(image, [a,b])" in plan
    # Spans are sent to the sectors, never the other way round.
    assert "BuildLeft" not in plan
    expected = extract.track_frames(frame(spark, own, "a"), extract.read_tables(frame(spark, own, "a")), selection="2")
    rows = lambda df: sorted((r.track_no, r.order_no, bytes(r.raw)) for r in df.collect())
    assert rows(frames.filter("image = 'a'")) == rows(expected) == rows(frames.filter("image = 'b'"))


def test_spans_too_many_to_be_sent_are_joined(spark, tables, monkeypatch):
    table, _ = tables
    spans = spark.createDataFrame([("a", 10, 30), ("b", 20, 21), ("b", 5000, 5005), ("c", 1, 9), ("a", 7, 7)], "image string, low long, high long").withColumn("x", F.lit(1))
    want = sorted([("a", i) for i in range(10, 30)] + [("b", 20)] + [("b", i) for i in range(5000, 5005)])
    for most in (sectors.BROADCAST_SPANS, 1):
        monkeypatch.setattr(sectors, "BROADCAST_SPANS", most)
        found = sectors.Images(table).within(spans)
        assert found.columns == ["image", "x", "lsn", "data"] and sorted((r.image, r.lsn) for r in found.collect()) == want
    assert sectors.Images(table).within(spans.filter("low < 0")).collect() == []


def test_ranges_cover_what_they_are_made_of():
    rng = random.Random(1)
    for _ in range(200):
        ranges = [(a, a + rng.randint(1, 30)) for a in (rng.randrange(1000) for _ in range(rng.randint(0, 40)))]
        most = rng.randint(1, 8)
        found = sectors.merged_ranges(ranges, most)
        assert len(found) <= most and all(any(a <= low and high <= b for a, b in found) for low, high in ranges)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
        if len(ranges) <= most:
            assert {i for a, b in found for i in range(a, b)} == {i for a, b in ranges for i in range(a, b)}


def test_filters_come_before_bytes_are_read(spark, tmp_path):
    """Bytes of sectors that filters leave out don't exist: reading one of them would be an error."""
    whole = tmp_path / "x.iso"
    whole.write_bytes(b"".join(bytes([i % 251]) * 2048 for i in range(3000)))
    table = sectors.FileImages(spark, str(tmp_path), partition_sectors=100).sectors
    assert table.count() == 3000 and table.rdd.getNumPartitions() == 30
    with open(whole, "r+b") as f:
        f.truncate(2500 * 2048)
    low, high = table.filter("lsn between 40 and 260"), table.filter("lsn >= 2400 and lsn < 2500")
    # Two uses of one table in one query, each with a filter of its own.
    both = low.withColumn("use", F.lit(1)).union(high.withColumn("use", F.lit(2)))
    assert sorted((r.use, r.lsn, bytes(r.data)) for r in both.collect()) == [(1, i, bytes([i % 251]) * 2048) for i in range(40, 261)] + [(2, i, bytes([i % 251]) * 2048) for i in range(2400, 2500)]
    pairs = low.alias("l").join(high.alias("h"), F.expr("l.lsn + 2200 = h.lsn"))
    assert pairs.count() == 61
    assert table.select("image", "lsn").count() == 3000
    with pytest.raises(Exception, match="ends in sector 2500"):
        table.collect()


class Flaky(Server):
    """A drive whose connections break after some answers, so many times."""

    def __init__(self, count, breaks):
        super().__init__(count)
        self.breaks = breaks

    def serve(self, s):
        whole = s.sendall

        class Cut:
            recv = s.recv
            sent = 0

            def sendall(_, data):
                _.sent += 1
                if self.breaks and _.sent > 8:  # in the midst of an answer
                    self.breaks -= 1
                    whole(data[: len(data) // 3])
                    s.shutdown(2)
                    raise OSError
                whole(data)

        try:
            super().serve(Cut())
        except OSError:
            pass


def test_broken_sessions_are_gone_on_with(spark, tmp_path):
    server = Flaky(930, breaks=2)
    server.start()
    address = f"127.0.0.1:{server.listener.getsockname()[1]}"
    sectors.register(spark)
    df = spark.read.format("remote_sectors").option("server", address).load()
    got = sorted((r.lsn, int.from_bytes(r.data[:4], "big")) for r in df.collect())
    assert got == [(i, i) for i in range(930)] and server.breaks == 0


def test_a_dump_goes_on_where_it_ended(spark, tmp_path):
    server = Flaky(930, breaks=0)
    server.start()
    address = f"127.0.0.1:{server.listener.getsockname()[1]}"
    done = sectors.dump_remote(spark, address, str(tmp_path), partition_sectors=300)
    assert sorted((r.lsn, int.from_bytes(r.data[:4], "big")) for r in done.collect()) == [(i, i) for i in range(930)]
    files = len(done.inputFiles())
    # Nothing is left to read, and then only what the drive has more.
    assert sectors.dump_remote(spark, address, str(tmp_path), partition_sectors=300).count() == 930
    server.count = 1200
    done = sectors.dump_remote(spark, address, str(tmp_path), partition_sectors=300)
    assert sorted(r.lsn for r in done.select("lsn").collect()) == list(range(1200)) and len(done.inputFiles()) > files


def test_unknown_fields_are_passed_over():
    known = b"\x08\x03" + b"\x10\x01" + b"\x1a\x02ab"
    more = b"\x20\x05" + b"\x2a\x03xyz" + b"\x31" + bytes(8) + b"\x3d" + bytes(4)
    assert remote.response(known) == remote.response(more + known) == remote.response(known[:4] + more + known[4:]) == (3, 1, b"ab")
    assert remote.response(known + b"\x2a\x09xyz") is None and remote.response(known + b"\x31\x00") is None and remote.response(known[:-1]) is None


def test_other_sampling_rates_are_an_error(spark):
    own, _ = image()
    for i, data in own.items():
        if data[:8] == b"TWOCHTOC":
            own[i] = data[:20] + b"\x08" + data[21:]
    s = frame(spark, own)
    with pytest.raises(Exception, match="unknown sampling rate: track"):
        extract.audio_files(s, extract.read_tables(s)).collect()
