import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from discloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k, asks):
    """Distances in double precision to every candidate of another id and equal length."""
    own = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and usable(v)]
    out = {}
    for i in {i for i, _ in own if asks(i)}:
        q = min((v for j, v in own if j == i), key=lambda v: v.tolist())
        found = sorted((math.sqrt(sum(((v - q) ** 2).tolist())), j) for j, v in own if j != i and len(v) == len(q))
        out[i] = found[:k]
    return {(i, r): x for i, f in out.items() for r, x in enumerate(f, 1)}


def check(spark, rows, k=10, divisor=100, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(5)
    got = neighbours.nearest(df, F.col("vec_id") % divisor == 0, k).collect()
    expected = brute(rows, k, lambda i: i % divisor == 0)
    assert len(got) == len(expected)
    for r in got:
        score, other = expected[r.query_id, r.rank]
        assert r.vec_id == other and r.score == pytest.approx(score, rel=1e-12, abs=1e-12)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[i % 12] + 0.05 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("blocks", [None, (37, 5)])
def test_all_neighbours_are_found(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", blocks[0])
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", blocks[1])
    check(spark, vectors(900, 24, 1))


def test_ties_copies_and_bad_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 40)] + [(100 + i, [float(i % 3), 1.0]) for i in range(30)]
    rows += [(200, None), (201, [0.0, 0.0]), (202, [1.0, None]), (203, [float("nan"), 1.0]), (204, [float("inf"), 1.0]), (205, []), (None, [1.0, 2.0])]
    rows += [(300, [1.0, 2.0, 3.0]), (301, [1.0, 2.0, 4.0]), (400, [5.0]), (100, [9.0, 9.0]), (7, [1.0, 2.0]), (500, [1e-30, 0.0]), (501, [3e38, -3e38])]
    check(spark, rows, 4)
    check(spark, rows, 1000, 10)


def test_components_of_very_different_size(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e-6, 1.0, 1e6]) * rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    check(spark, rows, 5, 20)


def test_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 2, "x"), (1, [2.0], 1, 2, "x")], "vec_id int, embedding array<double>, dim int, rank int, c string")
    assert [(r.query_id, r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df, F.col("vec_id") == 9).count() == 0


def test_the_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(20, 16)) * rng.uniform(0.01, 100, (20, 1)), rng.normal(size=(50, 16))
    own = np.zeros((20, 50), bool)
    own[3, 4] = True
    for i, at, distance in neighbours.tile(a, b, own, 3):
        exact = np.sqrt(((b - a[i]) ** 2).sum(1))
        exact[own[i]] = np.inf
        assert set(np.argsort(exact)[:3]) <= set(at.tolist()) and np.allclose(distance, np.sqrt(((b[at] - a[i]) ** 2).sum(1)))


@pytest.mark.parametrize("size", [1e-150, 1.0, 1e155, 1e307])
def test_very_large_and_small_components(spark, size):
    rng = random.Random(7)
    rows = [(i, [rng.uniform(-1, 1) * size for _ in range(4)]) for i in range(60)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 3).collect()
    for q in (0, 20, 40):
        far = {i: math.dist([a / size for a in rows[q][1]], [b / size for b in v]) for i, v in rows if i != q}
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in own] == sorted(far, key=far.get)[:3]
        assert all(math.isclose(r.score / size, far[r.vec_id], rel_tol=1e-9) for r in own)


def test_blocks_and_turns_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i // 3, [rng.gauss(0, 1) for _ in range(5)]) for i in range(400)] + [(5, [1.0] * 5)] * 200
    monkeypatch.setattr(neighbours, "TURN", 3)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    check(spark, rows, 4, 5)
