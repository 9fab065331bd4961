import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from discloom.sources import dsf

ROWS = "folder string, file string, block_no long, channel int, bytes binary, header binary, id3 binary"


def rows(spark, files=4, partitions=1):
    data = [("a", f"{i}.dsf", b, c, bytes([b, c]) * 3, b"head", b"tag" if i % 2 else None) for i in range(files) for b in range(3) for c in range(2)]
    df = spark.createDataFrame(data, ROWS)
    return df.repartition(partitions, "file").sortWithinPartitions("folder", "file", "block_no", "channel")


def broken(df, condition, column="bytes"):
    """``df`` with a row whose making fails."""
    return df.withColumn(column, F.when(F.expr(condition), F.raise_error("it broke").cast("binary")).otherwise(F.col(column)))


def left(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def save(df, sink, folder):
    dsf.register(df.sparkSession)
    df.write.format(sink).mode("append").save(str(folder))


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_files_appear_whole(spark, tmp_path, prefix):
    save(rows(spark, partitions=3), "dsf_files", f"{prefix}{tmp_path}/x")
    assert left(tmp_path) == [f"x/a/{i}.dsf" for i in range(4)]
    body = b"".join(bytes([b, c]) * 3 for b in range(3) for c in range(2))
    assert (tmp_path / "x/a/1.dsf").read_bytes() == b"head" + body + b"tag" and (tmp_path / "x/a/2.dsf").read_bytes() == b"head" + body
    assert not [p for p in (tmp_path / "x").iterdir() if p.name.startswith(".")]


def test_a_task_that_fails_at_its_second_file_leaves_nothing(spark, tmp_path):
    save(rows(spark, files=1), "dsf_files", tmp_path)
    before = (tmp_path / "a/0.dsf").read_bytes()
    for partitions in (1, 3):  # also beside tasks that are done
        with pytest.raises(Exception, match="it broke"):
            save(broken(rows(spark, partitions=partitions), "file = '1.dsf' and block_no = 1"), "dsf_files", tmp_path)
        assert left(tmp_path) == ["a/0.dsf"] and (tmp_path / "a/0.dsf").read_bytes() == before
        assert [p.name for p in tmp_path.iterdir()] == ["a"]


def test_a_failing_image_leaves_nothing(spark, tmp_path):
    sectors = spark.range(40).select(F.lit("x.iso").alias("file"), F.col("id").alias("lsn"), F.expr("cast(repeat('s', 2048) as binary)").alias("data")).repartition(4)
    for bad, why in ((broken(sectors, "lsn = 30", "data"), "it broke"), (sectors.filter("lsn <> 7"), "not each of"), (sectors.withColumn("data", F.expr("substring(data, 1, 5)")), "has 5 bytes")):
        with pytest.raises(Exception, match=why):
            save(bad, "image_files", tmp_path)
        assert not list(tmp_path.iterdir())
    save(sectors, "image_files", tmp_path)
    assert left(tmp_path) == ["x.iso"] and (tmp_path / "x.iso").stat().st_size == 40 * 2048
    with pytest.raises(ValueError, match="mounted"):
        dsf.ImageWriter({"path": "mock://somewhere"})


@pytest.mark.parametrize("sink", ["dsf_files", "image_files"])
def test_a_cancelled_job_leaves_nothing(spark, tmp_path, sink):
    @F.udf("binary")
    def slow(data):
        time.sleep(0.5)
        return data

    if sink == "dsf_files":
        df = rows(spark, files=8, partitions=2).withColumn("bytes", slow("bytes"))
    else:
        df = spark.range(200).repartition(4).select(F.lit("x.iso").alias("file"), F.col("id").alias("lsn"), slow(F.expr("cast(repeat('s', 2048) as binary)")).alias("data"))
    failed = []

    def run():
        spark.sparkContext.setJobGroup(sink, "to be cancelled", interruptOnCancel=True)
        try:
            save(df, sink, tmp_path)
        except Exception as e:
            failed.append(e)

    job = InheritableThread(target=run)
    job.start()
    until = time.time() + 30
    while time.time() < until and not list(tmp_path.glob(".staging-*")):
        time.sleep(0.05)
    time.sleep(2)
    spark.sparkContext.cancelJobGroup(sink)
    job.join(60)
    assert failed and not job.is_alive()
    until = time.time() + 20
    while time.time() < until and list(tmp_path.iterdir()):
        time.sleep(0.1)
    assert not list(tmp_path.iterdir())
