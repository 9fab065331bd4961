import random

import pytest

from discloom.operators import demux
from discloom.plans.synthesis import SECTOR, audio_sectors
from discloom.sources import sectors
from discloom.streaming.frames import assemble_stream

SCHEMA = "image string, lsn long, data binary"


def streamed(df, tmp_path, name):
    return df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").start()


@pytest.fixture
def streams():
    rng = random.Random(2)
    return {n: list(audio_sectors([(t, bytes(rng.randrange(256) for _ in range(rng.randrange(1, 9000)))) for t in range(25)])) for n in ("a", "b")}


def test_frames_of_arriving_sectors_are_those_of_all_at_once(spark, tmp_path, streams):
    rows = [(n, lsn, data) for n, own in streams.items() for lsn, data in own]
    whole = demux.assemble(demux.packets(spark.createDataFrame(rows, SCHEMA), ["image"]), ["image"])
    expected = {(r.image, r.fid, r.tc, bytes(r.raw)) for r in whole.collect()}
    folder = str(tmp_path / "in")
    last = max(lsn for _, lsn, _ in rows)
    cuts = [0, 7, 8, last // 2, last + 1]
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    query = streamed(assemble_stream(demux.packets(stream, ["image"]), ["image"]), tmp_path, "arriving")
    try:
        for low, high in zip(cuts, cuts[1:], strict=False):
            part = [r for r in rows if low <= r[1] < high]
            part += [r for r in rows if r[1] == low - 1]  # seen before
            random.Random(low).shuffle(part)
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            query.processAllAvailable()
        got = [(r.image, r.fid, r.tc, bytes(r.raw)) for r in spark.table("arriving").collect()]
    finally:
        query.stop()
    assert len(got) == len(set(got)) and set(got) == expected


def test_growing_images_are_followed(spark, tmp_path, streams):
    sectors.register(spark)
    folder = tmp_path / "images"
    folder.mkdir()
    data = {n: b"".join(x for _, x in own) for n, own in streams.items()}
    (folder / "a.iso").write_bytes(data["a"][: 10 * SECTOR + 100])  # a part of a sector waits
    query = streamed(spark.readStream.format("disc_sectors").option("partitionSectors", 4).load(str(folder)), tmp_path, "growing")
    try:
        query.processAllAvailable()
        assert spark.table("growing").count() == 10
        (folder / "a.iso").write_bytes(data["a"])
        (folder / "b.iso").write_bytes(data["b"])
        query.processAllAvailable()
        got = {n: b"".join(bytes(r.data) for r in spark.table("growing").filter(f"image LIKE '%{n}.iso'").orderBy("lsn").collect()) for n in data}
    finally:
        query.stop()
    assert got == data
