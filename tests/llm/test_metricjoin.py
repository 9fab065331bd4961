import random

import numpy as np
import pytest
from test_neardup import brute, corpus

from discloom.llm import metricjoin
from discloom.llm.wordcode import U64


@pytest.mark.parametrize(("width", "percent", "seed", "rounds"), [(5, 80, 2, 3), (2, 60, 3, 1), (1, 80, 4, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, width, percent, seed, rounds):
    """Blocks and rounds are small, so that regions, windows, tiles and leaves all have work."""
    monkeypatch.setattr(metricjoin, "BLOCK", 3)
    rows = corpus(seed, groups=20, copies=10)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = metricjoin.jaccard_join(df, width=width, percent=percent, rounds=rounds)
    expected = {i: (n, root) for i, (n, root, _) in brute(rows, width, percent).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected


def test_links_across_regions(spark):
    """Chains: each text is near its neighbours only, so that groups hang together at the borders of regions."""
    rng = random.Random(7)
    rows = []
    for c in range(6):
        words = [f"c{c}w{i}" for i in range(100)]
        for i in range(12):
            rows.append((100 * c + i, " ".join(words)))
            words = words[:]
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = f"new{rng.random()}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for rounds in (1, 3):
        found = metricjoin.jaccard_join(df, width=2, percent=80, rounds=rounds)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == {i: x[:2] for i, x in brute(rows, 2, 80).items()}


def test_first_codes_meet_all_that_overlap():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 60, 30).astype(U64))
        b = np.unique(np.concatenate([rng.choice(a, 22), rng.integers(0, 60, rng.integers(0, 9)).astype(U64)]))
        levels = rng.integers(0, 4, (1 << 8, 4)).astype(np.uint8)
        for x in np.intersect1d(a, b):  # what both have is never counted once
            cell = int(metricjoin._cells(np.array([x]), 1 << 10)[0])
            levels[cell // 4, cell % 4] = max(1, levels[cell // 4, cell % 4])
        order = metricjoin.Order((levels << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes())
        both = len(np.intersect1d(a, b))
        for percent in (60, 80):
            codes, bounds, _ = order.first(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(codes[: bounds[1]], codes[bounds[1] :]))


def test_parities_pass_all_links_and_stop_what_is_far_apart():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 63, 64, 65, 200, 1000, 3000):
        base, sets = rng.integers(0, 1 << 62, n), []
        for lost in (0, 1, n // 20, n // 12, n // 10, n // 9, n // 5):  # several are at the very limit
            for more in (0, n // 9, n // 4):
                sets.append(np.unique(np.concatenate([base[lost:], rng.integers(0, 1 << 62, more)])))
        far = [np.unique(rng.integers(0, 1 << 62, m)) for m in (n, n + n // 5)]
        every = [x.astype(U64) for x in sets + far if len(x)]
        size = np.array(list(map(len, every)))
        marks = metricjoin._marks(np.concatenate(every), np.concatenate([[0], np.cumsum(size)]))
        marks = [np.array(x.as_py(), np.int64).view(U64) for x in marks]
        assert [int(x[0]) for x in marks] == size.tolist() and all(max(64, m) <= 64 * (len(x) - 1) < max(65, 2 * m) for m, x in zip(size.tolist(), marks, strict=True))
        shared = np.array([[len(np.intersect1d(a, b)) for b in every] for a in every])
        for percent in (60, 80, 100):
            linked = (100 * shared >= percent * (size[:, None] + size - shared)) & ~np.eye(len(every), dtype=bool)
            for i in range(len(every)):  # each with each alone, then all at once
                for j in range(i):
                    may = metricjoin.may_link(size[[i, j]], [marks[i][1:], marks[j][1:]], np.array([[False, True], [True, False]]), percent) >= 0
                    assert may.all() or not (may.any() or linked[i, j])
                    assert not may.any() or n < 200 or i < len(every) - 2 or percent < 80
            may = metricjoin.may_link(size, [x[1:] for x in marks], np.ones((len(every),) * 2, bool), percent)
            assert all(may[i] == may[j] >= 0 for i, j in zip(*np.nonzero(linked), strict=True))


def test_leaves_move_no_sets_of_rows_that_cannot_link(spark, monkeypatch):
    """Texts of a few phrases that many others have too: their sets met in tiles, though all but two are far apart."""
    rng = random.Random(11)
    phrases = [[f"p{i}w{j}" for j in range(40)] for i in range(80)]
    rows = [(i, " ".join(w for p in rng.sample(phrases, 6) for w in p)) for i in range(120)]
    near = rows[7][1].split()
    near[80] = "changed"
    rows.append((900, " ".join(near)))
    read = spark.sparkContext.accumulator(0)
    plain = metricjoin.tile_links

    def counting(percent):
        run = plain(percent)

        def counted(batches):
            def seen():
                for b in batches:
                    read.add(b.num_rows)
                    yield b

            return run(seen())

        return counted

    monkeypatch.setattr(metricjoin, "tile_links", counting)
    found = metricjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rounds=1)
    expected = {i: x[:2] for i, x in brute(rows, 5, 80).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected
    assert expected[900][1] == 7 and read.value <= 4


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text.upper()), (3, text + " eleven"), (3, "other words"), (3, "other words"), (4, None), (4, ""), (None, "alone here"), (5, "a b c d e f g h i j " * 20_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, pivot int").repartition(3)
    found = metricjoin.jaccard_join(df)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in found.collect()) == [
        (0, 1, 0), (0, 6, 3), (0, 6, 3), (3, 1, 3), (3, 1, 3), (3, 7, 3), (4, 0, 4), (4, 0, 4), (5, 10, 5)
    ]
    assert metricjoin.jaccard_join(df.filter("doc_id < 0")).collect() == []
    with pytest.raises(ValueError, match="percent"):
        metricjoin.jaccard_join(df, percent=50)


def test_gaps_are_packed_and_unpacked():
    gaps = np.array([0, 1, 127, 128, 0, 16383, 16384, 65535, 5], np.int64)
    data, end = metricjoin.packed(gaps)
    assert len(data) == end[-1] == 3 * 1 + 2 + 1 + 2 + 3 + 3 + 1 and metricjoin.unpacked(data).tolist() == gaps.tolist()
    assert metricjoin.unpacked(data[end[3] : end[6]]).tolist() == gaps[4:7].tolist()
    assert metricjoin.unpacked(data[:0]).tolist() == []


def test_partners_are_those_of_all_pairs():
    rng = np.random.default_rng(9)
    for percent in (60, 80, 100):
        group = np.sort(rng.integers(0, 60, 300))
        n = rng.integers(1, 60, 300)
        n = n[np.lexsort((n, group))]
        rest = n - (n * rng.random(300) * (100 - percent) / 100).astype(np.int64)
        pair = (100 + percent) * np.minimum(rest[:, None], rest) >= percent * (n[:, None] + n)
        pair &= (group[:, None] == group) & ~np.eye(300, dtype=bool)
        found = metricjoin.partnered(group, n, rest, percent)
        assert found.tolist() == pair.any(1).tolist() and found.any() and not found.all()
    assert metricjoin.partnered(group[:0], n[:0], rest[:0], 80).tolist() == []


@pytest.mark.parametrize("met", [1 << 12, 5])
def test_sets_are_made_of_rows_with_a_partner_only(spark, monkeypatch, met):
    """Long texts that begin like short ones, in groups of ten, share first codes; of 121 only two can be linked by size."""
    monkeypatch.setattr(metricjoin, "MET", met)  # larger buckets than that keep all their rows
    rng, rows = random.Random(12), []
    for g in range(12):
        base = [f"g{g}w{j}" for j in range(800)]
        rows += [(10 * g + i, " ".join(base[: int(20 * 1.45**i)])) for i in range(10)]
    near = rows[57][1].split()
    near[rng.randrange(20, 60)] = "changed"
    rows.append((900, " ".join(near)))
    made, plain = [], metricjoin.cut

    def cut(df):
        df = plain(df)
        if "codes" in df.columns:
            made.append(df.count())
        return df

    monkeypatch.setattr(metricjoin, "cut", cut)
    found = metricjoin.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    expected = {i: x[:2] for i, x in brute(rows, 5, 80).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected
    assert expected[900][1] == 57 and len(made) == 1 and (made[0] == 2 or met == 5)
