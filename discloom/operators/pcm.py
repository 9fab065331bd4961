"""Decoded samples: de-interleaving, bit order, 4096-byte blocks, and the decoder's interface."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discloom.functions.binary import REVERSED_BYTES, nul_padded
from discloom.operators.demux import changes

BLOCK = 4096
#: Frames that are decoded at once, by decoders of one frame and of many.
BATCH_FRAMES, MANY_FRAMES = 256, 1024
#: Makes a decoder for a number of channels: from one raw frame to samples.  If it has
#: ``many``, from a list of frames to a list of samples, that is called instead.
DecoderFactory = Callable[[int], Callable[[bytes], bytes]]


def no_decoder(channels: int) -> Callable[[bytes], bytes]:
    """Stands for a decoder where compressed frames are to be an error."""
    raise NotImplementedError("decoder not available: pass one for compressed frames")


def decode(frames: DataFrame, decoder: DecoderFactory | None = None, raw: str = "raw", channels: str = "channels", spent: str | None = None) -> DataFrame:
    """Frames with ``raw`` decoded, frame by frame and in place.

    ``frames`` has a column of channel numbers.  None leaves uncompressed frames
    as they are.  A decoder is made once for each task and number of channels;
    ``BATCH_FRAMES`` decoded frames, or ``MANY_FRAMES``, are in memory at once.
    ``spent`` names a column that is added, with the nanoseconds that a frame's
    decoding took, of those decoded together an equal share.
    """
    if decoder is None:
        return frames
    at, of = frames.columns.index(raw), frames.columns.index(channels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Callable[[bytes], bytes]] = {}
        for whole in batches:
            for n in set(whole.column(of).to_pylist()):
                if n not in made:
                    made[n] = decoder(n)
            step = MANY_FRAMES if made and all(hasattr(d, "many") for d in made.values()) else BATCH_FRAMES
            for low in range(0, whole.num_rows, step):
                b = whole.slice(low, step)
                raws, counts = b.column(at).to_pylist(), b.column(of).to_pylist()
                out: list[bytes | None] = [None] * b.num_rows
                took = np.zeros(b.num_rows)
                for n, d in made.items():
                    own = [i for i, (x, m) in enumerate(zip(raws, counts, strict=True)) if m == n and x is not None]
                    many = getattr(d, "many", lambda frames, one=d: [one(x) for x in frames])
                    began = time.perf_counter_ns()
                    for i, samples in zip(own, many([raws[i] for i in own]), strict=True):
                        out[i] = samples
                    took[own] = (time.perf_counter_ns() - began) / max(1, len(own))
                done = b.set_column(at, raw, pa.array(out, pa.binary()))
                yield done.append_column(spent, pa.array(took)) if spent else done

    return frames.mapInArrow(run, T.StructType([*frames.schema, *([T.StructField(spent, T.DoubleType())] if spent else [])]))


class _Stream:
    """A stream's channels: the block that each has come to, where in it its bytes begin, and the bytes themselves."""

    def __init__(self, channels: int, before: int) -> None:
        self.channels, self.at = channels, 0
        self.block, self.inside = [before // BLOCK] * channels, [before % BLOCK] * channels
        self.held = [np.zeros(0, np.uint8)] * channels

    def add(self, data: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Blocks that ``data``, the stream's next bytes, fills."""
        own = REVERSED_BYTES[data]
        for c in range(self.channels):
            line = np.concatenate([self.held[c], own[(c - self.at) % self.channels :: self.channels]])
            low, high = 0, BLOCK - self.inside[c]
            while high <= len(line):
                yield self.block[c], c, line[low:high].tobytes()
                self.block[c], self.inside[c], low, high = self.block[c] + 1, 0, high, high + BLOCK
            self.held[c] = line[low:].copy()
        self.at += len(data)

    def rest(self) -> Iterator[tuple[int, int, bytes]]:
        for c, line in enumerate(self.held):
            if len(line):
                yield self.block[c], c, line.tobytes()


def _laid(n_keys: int, names: list[str]):
    """Blocks of rows sorted by stream and place: columns keys, bytes before, channels, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, key = None, None
        for b in batches:
            if not b.num_rows:
                continue
            # The open stream's keys come before those of the batch.
            before = int(stream is not None)
            keys = [b.column(i) if key is None else pa.concat_arrays([key[i], b.column(i)]) for i in range(n_keys)]
            new = np.zeros(b.num_rows + before, bool)
            new[0] = True
            for k in keys:
                new[1:] |= changes(k)
            edges = [*np.flatnonzero(new).tolist(), len(new)]
            base, count, raws = (b.column(n_keys + i) for i in range(3))
            offsets = np.frombuffer(raws.buffers()[1], np.int32)[raws.offset :]
            data = np.frombuffer(raws.buffers()[2] or b"", np.uint8)
            rows, found = [], []

            def take(row: int, parts: Iterator[tuple[int, int, bytes]], rows=rows, found=found) -> None:
                for x in parts:
                    rows.append(row)
                    found.append(x)

            for low, high in zip(edges, edges[1:], strict=False):
                first = max(low - before, 0)
                if low or not before:
                    if stream is not None:
                        take(low - 1, stream.rest())
                    stream = _Stream(count[first].as_py(), base[first].as_py())
                take(low, stream.add(data[offsets[first] : offsets[high - before]]))
            yield _block_rows([k.take(pa.array(rows, pa.int32())) for k in keys], found, names)
            key = [k.slice(len(k) - 1) for k in keys]
        if stream is not None:
            found = list(stream.rest())
            yield _block_rows([k.take(pa.array([0] * len(found), pa.int32())) for k in key], found, names)

    return run


def _block_rows(keys: list[pa.Array], found: list[tuple[int, int, bytes]], names: list[str]) -> pa.RecordBatch:
    block, channel, data = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([*keys, pa.array(block, pa.int64()), pa.array(channel, pa.int32()), pa.array(data, pa.binary())], [*names, "block_no", "channel", "bytes"])


def blocks(samples: DataFrame, keys: list[str], order: str, raw: str = "raw", channels: str = "channels", start: str | None = None) -> DataFrame:
    """Blocks of one channel's bytes, in file bit order: ``keys, block_no, channel, bytes``.

    The bytes of a stream (what shares ``keys``, by ``order``) go round the
    channels.  ``start`` names a column with the bytes of each channel that come
    before the stream, which is where a gapless album's track begins; the first
    and last block may then be parts.  Null bytes are none.

    Bytes are shuffled once, to their stream, and go through as a sorted
    sequence of batches; a task holds a batch and what is left of one block of
    each channel.  A stream is a track, whose file one task writes anyway.
    """
    base = F.coalesce(F.col(start), F.lit(0)).cast("long") if start else F.lit(0).cast("long")
    data = F.coalesce(F.col(raw), F.lit(bytearray()))
    placed = samples.select(*keys, base.alias("_base"), F.col(channels).cast("int").alias("_n"), data.alias("_raw"), F.col(order).alias("_order"))
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, "_order").drop("_order")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.select(*keys).schema)
    return placed.mapInArrow(_laid(len(keys), keys), f"{fields}, block_no long, channel int, bytes binary")


def padded(blocks: DataFrame) -> DataFrame:
    """Blocks filled up with NULs."""
    return blocks.withColumn("bytes", nul_padded(F.col("bytes"), BLOCK))
