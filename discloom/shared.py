"""Written intermediate tables, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of tracks or segments that are sent to every task: some tens of MB.
SENT_ROWS = 1 << 18

#: Rows of a task that sorts a table's rows by group.
DEALT_ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, also for checkpoints.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and
    everything runs in one machine, a temporary folder is used; on a cluster it
    is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder, of which later uses read the columns that they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """``df`` with its lineage cut, marked for broadcast if it has up to ``most`` rows."""
    held = cut(df)
    return F.broadcast(held) if held.count() <= most else held


def dealt(table: DataFrame, *keys: str, rows: int = DEALT_ROWS) -> DataFrame:
    """``table`` dealt by ``keys``, to as many partitions as hold about ``rows`` rows each, but no fewer than the session's.

    Where the session's number of partitions is fixed, tasks that sort groups would grow with the table.  Rows are counted, which reads no column of Parquet.
    """
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(least, -(-table.count() // rows)), *keys)
