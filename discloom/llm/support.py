"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from discloom.shared import cut, shared_folder

__all__ = ["bit_of", "cut", "filter_bits", "fresh", "has_bit", "held_out", "id_remainder", "shared_folder", "table"]
#: Bits of a filter of ids.
FILTER_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; the path may be anything Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """True for rows whose id is kept out of training (false for a null id)."""
    return F.coalesce(id_remainder(doc_id, n) == remainder, F.lit(False))


def bit_of(*columns: str) -> Column:
    """Where the filter has the bit of a row, counted from 0."""
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def filter_bits(rows: DataFrame, *columns: str) -> bytes:
    """Bitmap of hashed ``columns``; its size is fixed, whatever the number of rows."""
    at = bit_of(*columns) + 1  # Spark numbers buckets and bits from position 1
    maps = rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = bytearray(FILTER_BITS // 8 + 4096)
    for r in maps.collect():  # at most FILTER_BITS / 32768 + 1 rows of 4 KB
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["bits"]
    return bytes(out)


def has_bit(bits: bytes, at: np.ndarray) -> np.ndarray:
    """Which of the bits of :func:`bit_of` the filter has."""
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
