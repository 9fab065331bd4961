"""Frame assembly over a stream of arriving sectors.

``spark.readStream.format("disc_sectors").load(path)`` follows growing image
files; any other stream of ``image, lsn, data`` does as well.  A frame that is
not done when a micro-batch ends waits in the state of its stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from discloom.operators import demux

STATE = "tc int, need int, raw binary, frames long, lsn long"


def _frames(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Frames that end in this micro-batch; the last one's beginning is kept."""
    tc, need, raw, frames, last = state.get if state.exists else (None, 0, None, 0, -1)
    raw = None if raw is None else bytearray(raw)
    rows = pd.concat(list(batches))
    rows = rows[rows["lsn"] > last].sort_values(["lsn", "pno"], kind="stable")
    out: list[tuple] = []
    for lsn, sector in rows.groupby("lsn", sort=True):
        for start, has_info, own_tc, count, payload in zip(sector["frame_start"], sector["has_info"], sector["tc"], sector["sector_count"], sector["payload"], strict=True):
            begins = start and has_info
            if begins and raw and need <= 0:
                out.append((*key, frames, tc, bytes(raw)))
            if begins:
                tc, need, raw, frames = int(own_tc), int(count) - 1, bytearray(payload), frames + 1
            elif raw is not None:
                need -= 1
                if not start:
                    raw += payload
        if raw and need <= 0:
            out.append((*key, frames, tc, bytes(raw)))
            raw = None
        last = int(lsn)
    state.update((tc, need, None if raw is None else bytes(raw), frames, last))
    yield pd.DataFrame(out, columns=[*(f"k{i}" for i in range(len(key))), "fid", "tc", "raw"])


def assemble_stream(packs: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of each stream as they end: ``keys, fid, tc, raw``, for a streaming ``packs``.

    They are those of ``demux.assemble`` but for an unfinished last frame, which
    waits for more.  A stream's sectors must arrive in order between
    micro-batches, in any order within one; a sector up to one that has been
    seen is passed over, so a repeated sector does no harm.
    """
    own = packs.filter(F.col("data_type") == demux.AUDIO).select(
        *keys, "lsn", "pno", "frame_start", F.col("info").isNotNull().alias("has_info"),
        F.coalesce("info.tc", F.lit(0)).cast("int").alias("tc"), F.coalesce("info.sector_count", F.lit(0)).cast("int").alias("sector_count"), "payload",
    )
    schema = T.StructType([packs.schema[k] for k in keys]).add("fid", T.LongType()).add("tc", T.IntegerType()).add("raw", T.BinaryType())

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        for pdf in _frames(key, batches, state):
            yield pdf.set_axis(schema.names, axis=1)

    return own.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.NoTimeout)
