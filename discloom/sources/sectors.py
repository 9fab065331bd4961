"""Spark data sources of 2048-byte sectors: image files and remote drives.

``spark.read.format("disc_sectors").load("image.iso")`` gives ``image, lsn,
data``.  Options ``from`` and ``to`` bound ``lsn`` before any byte is read.
Filters are not taken over: a session shares a source's reader among all uses of a
table, so what one use filters would be missing in the others.  :class:`FileImages`
reads the bytes of a sector only after filters, whatever they are.
``path`` is read on executors and so must be on storage that all of them mount;
several paths are separated by commas, and a folder stands for its ``*.iso``
files.  ``spark.read.format("remote_sectors").option("server",
"host:port")`` reads a drive over the network in one partition, since the
drive serves one session; a session that breaks is opened anew where it ended.
As a stream, ``spark.readStream.format("remote_sectors")``, it is read span by
span (see :func:`dump_remote`), and a query that is started again goes on after
the last span that it has written.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from discloom.sources.remote import Session

SECTOR = 2048
SCHEMA = "image string, lsn long, data binary"
#: Sectors of one partition (16 MiB), and of one batch handed to Spark.
PARTITION_SECTORS, BATCH_SECTORS = 8192, 512
#: Sessions in a row that may break without a sector.
RETRIES = 5
#: Spans that are broadcast at most (some 10 MB), ranges that a scan is given, images that it is told by name, and tasks of a table of files.
BROADCAST_SPANS, MOST_RANGES, MOST_NAMES, MOST_TASKS = 100_000, 32, 100, 20_000


@dataclass
class Span(InputPartition):
    """Sectors ``low`` to ``high`` - 1 of one image."""

    image: str
    low: int
    high: int


def _batch(image: str, low: int, data: bytes) -> pa.RecordBatch:
    n = len(data) // SECTOR
    values = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * SECTOR), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array([image] * n, pa.string()), pa.array(np.arange(low, low + n)), values], ["image", "lsn", "data"])


class _Ranged(DataSourceReader):
    """Reads sectors ``from`` to ``to`` - 1, options of the source; all without these."""

    def __init__(self, options: dict) -> None:
        self.options, self.low = options, int(options.get("from", 0))
        self.high = int(options["to"]) if "to" in options else None

    def spans(self, image: str, count: int, step: int) -> list[Span]:
        high = count if self.high is None else min(count, self.high)
        return [Span(image, a, min(a + step, high)) for a in range(max(self.low, 0), high, step)]


def _image_files(options: dict) -> dict[str, int]:
    """Whole sectors of each image file that ``path`` names."""
    out = []
    for p in (options.get("path") or "").split(","):
        p = p.strip().removeprefix("file://")
        out += sorted(os.path.join(p, x) for x in os.listdir(p) if x.endswith(".iso")) if os.path.isdir(p) else [p]
    return {p: os.stat(p).st_size // SECTOR for p in out}


def _read_file(partition: Span) -> Iterator[pa.RecordBatch]:
    if partition.high <= partition.low:
        return
    with open(partition.image, "rb") as f:
        f.seek(partition.low * SECTOR)
        for low in range(partition.low, partition.high, BATCH_SECTORS):
            want = (min(low + BATCH_SECTORS, partition.high) - low) * SECTOR
            data = f.read(want)
            if len(data) < want:
                raise OSError(f"{partition.image} ends in sector {os.fstat(f.fileno()).st_size // SECTOR}")
            yield _batch(partition.image, low, data)


class FileReader(_Ranged):
    def partitions(self) -> list[Span]:
        step = int(self.options.get("partitionSectors", PARTITION_SECTORS))
        return [s for p, n in _image_files(self.options).items() for s in self.spans(p, n, step)] or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _read_file(partition)


class GrowingReader(DataSourceStreamReader):
    """Follows files that grow and folders that get more; an offset is the number of sectors of each file."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _image_files(self.options)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        step = int(self.options.get("partitionSectors", PARTITION_SECTORS))
        return [Span(p, a, min(a + step, n)) for p, n in end.items() for a in range(start.get(p, 0), n, step)] or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _read_file(partition)


class DiscSectors(DataSource):
    """Sectors of image files."""

    @classmethod
    def name(cls) -> str:
        return "disc_sectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def server_address(text: str) -> tuple[str, int]:
    """``host:port``, of exactly two parts."""
    fields = text.split(":")
    if len(fields) != 2 or not fields[0] or not fields[1].isdigit() or int(fields[1]) > 65535:
        raise ValueError(f"not host:port: {text!r}")
    return fields[0], int(fields[1])


def _read_drive(span: Span) -> Iterator[pa.RecordBatch]:
    """Each sector of a span once, over one session at a time.

    A session that breaks is followed by another, which begins with the sector
    that is due; ``RETRIES`` sessions in a row without a sector are an error.
    """
    at, failed = span.low, 0
    while at < span.high:
        try:
            with Session(server_address(span.image)) as session:
                while at < span.high:
                    data = session.read(at, min(BATCH_SECTORS, span.high - at))
                    if not data:
                        raise OSError(f"{span.image} sent nothing for sector {at}")
                    yield _batch(span.image, at, data)
                    at, failed = at + len(data) // SECTOR, 0
        except OSError:
            failed += 1
            if failed > RETRIES:
                raise
            time.sleep(0.1 * 2**failed)


class RemoteReader(_Ranged):
    def partitions(self) -> list[Span]:
        with Session(server_address(self.options["server"])) as session:
            return self.spans(self.options["server"], session.sectors(), 1 << 62) or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _read_drive(partition)


class RemoteStream(DataSourceStreamReader):
    """A drive read in spans, one a micro-batch; an offset is the number of sectors read."""

    def __init__(self, options: dict) -> None:
        self.server, self.step = options["server"], int(options.get("partitionSectors", PARTITION_SECTORS))
        self.at, self.count = 0, None

    def initialOffset(self) -> dict:
        return {"sectors": 0}

    def latestOffset(self) -> dict:
        if self.count is None:
            with Session(server_address(self.server)) as session:
                self.count = session.sectors()
        return {"sectors": min(self.count, self.at + self.step)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = end["sectors"]
        return [Span(self.server, start["sectors"], end["sectors"])]

    def commit(self, end: dict) -> None:
        self.at = end["sectors"]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from _read_drive(partition)


class RemoteSectors(DataSource):
    """Sectors of a drive that a server shares."""

    @classmethod
    def name(cls) -> str:
        return "remote_sectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RemoteReader:
        return RemoteReader(self.options)

    def streamReader(self, schema) -> RemoteStream:
        return RemoteStream(self.options)


class Images:
    """Images whose sectors are rows ``image, lsn, data`` of a table."""

    def __init__(self, sectors: DataFrame) -> None:
        self.sectors = sectors

    def names(self, lsn: int) -> DataFrame:
        """``image`` of each image that has a sector up to ``lsn``."""
        return self.sectors.filter(F.col("lsn") <= lsn).select("image").distinct()

    def between(self, low: int, high: int) -> DataFrame:
        """Sectors ``low`` to ``high`` - 1 of each image."""
        return self.sectors.filter((F.col("lsn") >= low) & (F.col("lsn") < high))

    def within(self, spans: DataFrame, timed: bool = False) -> DataFrame:
        """Rows of ``spans`` with each sector of theirs: its columns but ``low`` and ``high``, ``lsn`` and ``data``.

        ``spans`` has ``image``, and sectors ``low`` to ``high`` - 1.  The scan is
        given the ranges that spans lie in, which reach files whose statistics say
        what sectors they hold.  Up to ``BROADCAST_SPANS`` spans go to the sectors,
        which then stay where they are; more are joined by image and bucket.  The
        exact condition follows.  ``timed`` adds ``read_ns``, the time of reading a
        sector, which is 0 where Spark's own scan reads.
        """
        spans = spans.filter("high > low")
        # At most one row for each bucket of a disc's sectors, however many images there are.
        held = spans.groupBy(F.expr(f"low div {PARTITION_SECTORS}").alias("b")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).collect()
        own = self.sectors.select("image", "lsn", "data").filter(in_ranges(merged_ranges([(r.low, r.high) for r in held])))
        few = sum(r.n for r in held) <= BROADCAST_SPANS
        names = [r.image for r in spans.select("image").distinct().limit(MOST_NAMES + 1).collect()] if few else []
        if 0 < len(names) <= MOST_NAMES and None not in names:
            own = own.filter(F.col("image").isin(names))
        bucket = F.explode(F.expr(f"sequence(low div {PARTITION_SECTORS}, (high - 1) div {PARTITION_SECTORS})"))
        wanted, own = spans.withColumn("_b", bucket), own.withColumn("_b", F.expr(f"lsn div {PARTITION_SECTORS}"))
        return own.join(F.broadcast(wanted) if few else wanted, ["image", "_b"]).filter("lsn >= low AND lsn < high").select(
            *[c for c in spans.columns if c not in ("low", "high")], "lsn", "data", *([F.lit(0.0).alias("read_ns")] if timed else [])
        )


def merged_ranges(ranges: list[tuple[int, int]], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that cover ``ranges`` (low, end), with the least in between."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1], reverse=True)
    cuts = [0, *sorted(gaps[: most - 1]), len(out)]
    return [(out[a][0], out[b - 1][1]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def in_ranges(ranges: list[tuple[int, int]]) -> Column:
    """Whether ``lsn`` is in one of the ranges; never, if there are none."""
    inside = F.lit(False)
    for i, (low, high) in enumerate(ranges):
        this = (F.col("lsn") >= low) & (F.col("lsn") < high)
        inside = this if i == 0 else inside | this
    return inside


def _sector_data(images: pa.Array, lsns: pa.Array) -> pa.Array:
    """Bytes of sectors; neighbours in a file are read at once."""
    lsn, names = lsns.to_numpy(zero_copy_only=False), images.to_pylist()
    out, low = [], 0
    while low < len(lsn):
        high = low + 1
        while high < len(lsn) and lsn[high] == lsn[high - 1] + 1 and names[high] == names[low]:
            high += 1
        out += [part.column(2) for part in _read_file(Span(names[low], int(lsn[low]), int(lsn[high - 1]) + 1))]
        low = high
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


class FileImages(Images):
    """Image files, of which only the sectors asked for are read."""

    def __init__(self, spark: SparkSession, path: str, partition_sectors: int = PARTITION_SECTORS) -> None:
        register(spark)
        self.spark, self.path, self.step = spark, path, partition_sectors
        super().__init__(self.table())

    def table(self) -> DataFrame:
        """All sectors; the bytes of one are read after filters on image and number, and only if they are asked for."""
        counts = _image_files({"path": self.path})
        tasks = min(MOST_TASKS, sum(-(-n // self.step) for n in counts.values()))
        files = self.spark.createDataFrame([(p, n) for p, n in counts.items() if n], "image string, n long")
        spans = files.select("image", "n", F.explode(F.expr(f"sequence(0L, n - 1, {self.step}L)")).alias("low")).repartition(max(1, tasks), "image", "low")
        rows = spans.select("image", F.explode(F.expr(f"sequence(low, least(low + {self.step}, n) - 1)")).alias("lsn"))
        return rows.select("image", "lsn", F.arrow_udf(_sector_data, "binary")("image", "lsn").alias("data"))

    def names(self, lsn: int) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in sorted(_image_files({"path": self.path}))], "image string")

    def between(self, low: int | None = None, high: int | None = None) -> DataFrame:
        bounds = {k: v for k, v in (("from", low), ("to", high)) if v is not None}
        return self.spark.read.format("disc_sectors").options(partitionSectors=self.step, **bounds).load(self.path)

    def within(self, spans: DataFrame, timed: bool = False) -> DataFrame:
        """As of any images; each task reads spans of bounded length at their places in the files."""
        others = [c for c in spans.columns if c not in ("image", "low", "high")]
        begin = F.explode(F.expr(f"sequence(low, high - 1, {self.step}L)"))
        pieces = spans.filter("high > low").select(*others, "image", "high", begin.alias("low"))
        pieces = pieces.withColumn("high", F.least(F.col("high"), F.col("low") + self.step)).repartition("image", "low")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, (image, low, high) in enumerate(zip(*(b.column(c).to_pylist() for c in ("image", "low", "high")), strict=True)):
                    began = time.perf_counter_ns()
                    for part in _read_file(Span(image, low, high)):
                        took = (time.perf_counter_ns() - began) / max(1, part.num_rows)
                        row = pa.array(np.full(part.num_rows, i))
                        more = [pa.array(np.full(part.num_rows, took))] if timed else []
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in others), *part.columns, *more], [*others, "image", "lsn", "data", *(["read_ns"] if timed else [])])
                        began = time.perf_counter_ns()

        fields = [spans.schema[c] for c in others]
        return pieces.mapInArrow(read, T.StructType([*fields, *T.StructType.fromDDL(SCHEMA + ", read_ns double" * timed)]))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    for source in (DiscSectors, RemoteSectors):
        spark.dataSource.register(source)


def dump_remote(spark: SparkSession, server: str, folder: str, partition_sectors: int = PARTITION_SECTORS) -> DataFrame:
    """Write a drive's sectors to ``folder`` as a Parquet table ``image, lsn, data``, and return it.

    The drive is read span by span, each in one session.  What is written is
    noted in ``folder``, so that a call after one that was broken off, by a lost
    executor or driver, goes on with the span that is due and reads no other again.
    """
    register(spark)
    rows = spark.readStream.format("remote_sectors").options(server=server, partitionSectors=partition_sectors).load()
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/_progress").start(f"{folder}/sectors")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(f"{folder}/sectors")


def sector_counts(spark: SparkSession, path: str) -> DataFrame:
    """``image, sectors`` of files anywhere that Spark reads; a part of a sector at the end doesn't count."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("image"), F.expr("length div 2048").alias("sectors"))

