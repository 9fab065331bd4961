"""Audio files and images: sinks that write each file once and show all of a job's files or none.

``files.write.format("dsf_files").mode("append").save(folder)`` takes rows
``folder, file, block_no, channel, bytes, header, id3``, dealt by file and
sorted in it (see :func:`file_rows`); each image has a folder of its own.  The
first row of a file has its header and tag.  The header's sizes are aggregates known before writing, so nothing is patched
afterwards.

Both sinks commit in two phases.  The driver makes a staging folder for the job;
each attempt of a task writes into a folder of its own there, which it can't make
once the job's is gone.  Only when all tasks are done does the driver move the
files that they reported to their places, and then it takes the staging folder
away, as it does when the job fails or is cancelled.  A driver that is killed
leaves a hidden staging folder but no file under its name.

The option ``times`` of ``dsf_files`` names a folder on any such storage, where
the driver writes a table ``folder, file, write_ns, file_bytes`` after the files are in their places.

``folder`` of audio files is a path or URI on any storage that pyarrow's file
systems open: mounted folders, HDFS, object stores.  Images are written at their
sectors' places by many tasks, and need mounted storage.
"""

from __future__ import annotations

import contextlib
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from discloom.functions.binary import le_bytes
from discloom.functions.timecode import SAMPLE_RATE, channel_type
from discloom.shared import sent

HEADER = 92


def header(channels: Column, block_bytes: Column, samples: Column) -> Column:
    """The 92 bytes before the audio; ``block_bytes`` are all channels' whole blocks."""
    word = lambda value, size: le_bytes(value if isinstance(value, Column) else F.lit(value), size)
    tag_at = block_bytes + HEADER
    text = lambda value: F.lit(bytearray(value))
    return F.concat(
        text(b"DSD "), word(28, 8), word(tag_at + F.coalesce(F.col("_tag_bytes"), F.lit(0)), 8), word(tag_at, 8),
        text(b"fmt "), word(52, 8), word(1, 4), word(0, 4), word(channel_type(channels), 4), word(channels, 4), word(SAMPLE_RATE, 4), word(1, 4),
        word(samples, 8), word(4096, 4), word(0, 4),
        text(b"data"), word(block_bytes + 12, 8),
    )


def file_rows(blocks: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Each file's header and tag, in a row before its blocks, dealt and sorted for the sink.

    ``tracks`` has ``keys, folder, file, channels, blocks, bytes`` (sample bytes
    of all channels), ``carries`` and ``id3``.  A track that hands its tail on
    counts the samples of its whole blocks, any other those of its own bytes.
    """
    size = (F.col("blocks") * F.col("channels") * 4096).cast("long")
    samples = F.when(F.col("carries"), F.col("blocks") * (4096 * 8)).otherwise(F.expr("bytes div channels * 8")).cast("long")
    t = tracks.withColumn("_tag_bytes", F.length("id3").cast("long"))
    t = t.withColumn("header", header(F.col("channels").cast("long"), size, samples))
    # A file's first row has no block: a track whose few bytes are all handed on has no other.
    files = t.select("folder", "file", F.lit(-1).cast("long").alias("block_no"), F.lit(None).cast("int").alias("channel"), F.lit(None).cast("binary").alias("bytes"), "header", "id3")
    body = blocks.join(sent(tracks.select(*keys, "folder", "file")), keys).select("folder", "file", "block_no", "channel", "bytes")
    rows = files.unionByName(body, allowMissingColumns=True)
    return rows.repartition("folder", "file").sortWithinPartitions("folder", "file", "block_no", "channel")


@dataclass
class Written(WriterCommitMessage):
    """What an attempt has written to its folder; of images, number, sum and greatest of the sectors.

    Of files also the nanoseconds spent in writing each, and its bytes.
    """

    attempt: str = ""
    files: list[tuple[str, str]] = field(default_factory=list)
    sectors: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    spent: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)


def storage(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder, given as a path or a URI."""
    if "://" in folder and not folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    path = folder.removeprefix("file:")
    return fs.LocalFileSystem(), "/" + path.lstrip("/") if path.startswith("//") else path


class StagedWriter(DataSourceWriter):
    """A job's staging folder, made on the driver with the writer."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        files, path = storage(self.folder)
        self.staging = f"{path}/.staging-{uuid.uuid4().hex}"
        files.create_dir(self.staging)

    def clear(self) -> None:
        files, _ = storage(self.folder)
        with contextlib.suppress(FileNotFoundError):
            files.delete_dir(self.staging)

    def abort(self, messages: list) -> None:
        """Take away whatever tasks of a failed job have written."""
        self.clear()


class FilesWriter(StagedWriter):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.times = options.get("times")

    def write(self, iterator: Iterator) -> Written:
        files, _ = storage(self.folder)
        done, out, tag = Written(uuid.uuid4().hex), None, b""
        own = f"{self.staging}/{done.attempt}"
        files.create_dir(own, recursive=False)  # an error once the job is over

        def put(data: bytes) -> None:
            began = time.perf_counter_ns()
            out.write(data)
            done.spent[-1] += time.perf_counter_ns() - began
            done.sizes[-1] += len(data)

        def finish() -> None:
            if out is not None:
                put(tag)
                began = time.perf_counter_ns()
                out.close()
                done.spent[-1] += time.perf_counter_ns() - began

        try:
            for row in iterator:
                if not done.files or (row["folder"], row["file"]) != done.files[-1]:
                    finish()
                    done.files.append((row["folder"], row["file"]))
                    tag = bytes(row["id3"] or b"")
                    began = time.perf_counter_ns()
                    out = files.open_output_stream(f"{own}/{len(done.files)}")
                    done.spent.append(time.perf_counter_ns() - began)
                    done.sizes.append(0)
                    put(bytes(row["header"]))
                put(bytes(row["bytes"] or b""))
            finish()
        except BaseException:
            with contextlib.suppress(Exception):
                if out is not None:
                    out.close()
                files.delete_dir(own)
            raise
        return done

    def commit(self, messages: list) -> None:
        files, path = storage(self.folder)
        moves = [(f"{self.staging}/{m.attempt}/{i}", f"{path}/{folder}", name) for m in messages if m is not None for i, (folder, name) in enumerate(m.files, 1)]
        try:
            for folder in {folder for _, folder, _ in moves}:
                files.create_dir(folder)
            for source, folder, name in moves:
                files.move(source, f"{folder}/{name}")
            if self.times:
                self._report([m for m in messages if m is not None])
        finally:
            self.clear()

    def _report(self, messages: list[Written]) -> None:
        """One row for each file, in a Parquet file of the folder that the option ``times`` names."""
        files, path = storage(self.times)
        files.create_dir(path)
        folder, file = ([f[i] for m in messages for f in m.files] for i in (0, 1))
        spent, sizes = [x for m in messages for x in m.spent], [x for m in messages for x in m.sizes]
        rows = pa.table([pa.array(folder, pa.string()), pa.array(file, pa.string()), pa.array(spent, pa.int64()), pa.array(sizes, pa.int64())], names=["folder", "file", "write_ns", "file_bytes"])
        pq.write_table(rows, f"{path}/{uuid.uuid4().hex}.parquet", filesystem=files)


class DsfFiles(DataSource):
    """Sink of audio files."""

    @classmethod
    def name(cls) -> str:
        return "dsf_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options)


class ImageWriter(StagedWriter):
    """Writes each sector at its place of the image's file, which appears once no sector is missing."""

    def __init__(self, options: dict) -> None:
        if not isinstance(storage(options["path"])[0], fs.LocalFileSystem):
            raise ValueError("images are written to mounted storage")
        super().__init__(options)

    def write(self, iterator: Iterator) -> Written:
        opened: dict[str, int] = {}
        held: dict[str, tuple[int, int, int]] = {}
        try:
            for row in iterator:
                name, lsn = row["file"], row["lsn"]
                if len(row["data"]) != 2048:
                    raise ValueError(f"sector {lsn} of {name} has {len(row['data'])} bytes")
                if name not in opened:
                    opened[name] = os.open(f"{self.staging}/{name}", os.O_CREAT | os.O_WRONLY, 0o644)
                os.pwrite(opened[name], row["data"], lsn * 2048)  # the same bytes at the same place, however often a task runs
                n, total, most = held.get(name, (0, 0, -1))
                held[name] = n + 1, total + lsn, max(most, lsn)
        finally:
            for handle in opened.values():
                os.close(handle)
        return Written(sectors=held)

    def commit(self, messages: list) -> None:
        held: dict[str, tuple[int, int, int]] = {}
        for m in messages:
            for name, (n, total, most) in m.sectors.items() if m is not None else ():
                a, b, c = held.get(name, (0, 0, -1))
                held[name] = a + n, b + total, max(c, most)
        _, path = storage(self.folder)
        try:
            for name, (n, total, most) in held.items():
                if n != most + 1 or total * 2 != most * (most + 1):
                    raise ValueError(f"{name} has {n} sectors, not each of 0 to {most} once")
            for name in held:
                os.replace(f"{self.staging}/{name}", f"{path}/{name}")
        finally:
            self.clear()


class ImageFiles(DataSource):
    """Sink of disc images: ``file, lsn, data``, in any order and partitioning."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        return ImageWriter(self.options)


def written_sectors(folder: str):
    """Sectors of files in a folder, by their sizes."""

    def sizes(names: pa.Array) -> pa.Array:
        files, path = storage(folder)
        return pa.array([files.get_file_info(f"{path}/{x.as_py()}").size // 2048 for x in names], pa.int64())

    return F.arrow_udf(sizes, "long")


def register(spark) -> None:
    """Make the sinks known to a session."""
    for sink in (DsfFiles, ImageFiles):
        spark.dataSource.register(sink)
