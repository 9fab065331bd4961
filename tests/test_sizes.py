"""Steps whose work or memory must follow the size of their tables."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from discloom.operators import toc, tracks
from discloom.plans import synthesis
from discloom.shared import dealt


def test_dealt_rows_grow_in_number_of_partitions(spark):
    for n in (0, 100, 1000):
        assert dealt(spark.range(n), "id", rows=50).rdd.getNumPartitions() == max(4, n // 50)


def test_few_contents_are_rows_at_once(spark, monkeypatch):
    one = synthesis.area_toc(b"TWOCHTOC", [{"start": 75 * i, "duration": 75} for i in range(200)], {})
    contents = spark.createDataFrame([(f"i{n:02d}", "stereo", one) for n in range(40)], "image string, area string, data binary").coalesce(1)
    kept = []
    fake = SimpleNamespace(schema=contents.schema, select=lambda *_: SimpleNamespace(mapInArrow=lambda f, _: kept.append(f)))
    toc.tracks(fake)
    batch = pa.RecordBatch.from_pydict({"image": [f"i{n:02d}" for n in range(40)], "area": ["stereo"] * 40, "data": [one] * 40})
    found = list(kept[0]([batch]))
    assert len(found) > 1 and max(b.num_rows for b in found) <= 200 * toc.HELD_CONTENTS
    assert [x for b in found for x in b.column("image").to_pylist()] == [f"i{n:02d}" for n in range(40) for _ in range(200)]


def test_counted_sectors_are_those_of_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, None]), rng.choice([None, rng.randrange(-9000, 20000)])) for _ in range(600)]
    sectors = spark.createDataFrame(rows, "image int, lsn long")
    spans = [(i, rng.choice([0, 1, 3, None]), a := rng.randrange(-9000, 20000), a + rng.choice([-5, 0, 1, 900, 9000, 20000])) for i in range(80)]
    ranges = spark.createDataFrame(spans, "t int, image int, lsn_start long, lsn_end long")
    found = {r.t: (r.sectors, r.first_lsn) for r in tracks.counted_sectors(sectors, ranges, ["image"]).collect()}
    held = {t: [x for i, x in rows if i == k and x is not None and a <= x < b] for t, k, a, b in spans if k is not None}
    assert found == {t: (len(x), min(x)) for t, x in held.items() if x}


def test_selection_moves_no_rows(spark):
    df = spark.createDataFrame([(k, i, "x") for k in ("a", None) for i in (1, 2, 3)], "image string, track_no int, title string")
    chosen = tracks.select_tracks(df, "1,3", ["image"])
    assert chosen.columns == df.columns and sorted((r.image or "", r.track_no) for r in chosen.collect()) == [("", 1), ("", 3), ("a", 1), ("a", 3)]
    assert "Window" not in chosen._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="no track 4"):
        tracks.select_tracks(df.union(spark.createDataFrame([("b", 4, "x")], df.schema)), "4", ["image"]).collect()
