import random
import re

import numpy as np
import pyarrow as pa
import pytest

from discloom.llm import components, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    """Component of each id of ``rows (id, text)`` with distinct ids, all pairs compared."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed, groups=25, copies=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "ÀB", "x,"]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in own))
    texts += ["one two three four five six seven"] * copies
    texts += [None, "", " \n\t", "solo", "SOLO", "solo  ", "a b", "a b c", "É", "é", "a b c", "a b c"]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent", "seed"), [(2, 80, 1), (5, 80, 2), (2, 60, 3)])
def test_components_are_those_of_all_pairs(spark, width, percent, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.near_duplicates(df, width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, width, percent)


def test_a_large_group_of_variants_meets_in_tiles(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(2 * neardup.BLOCK + 50):  # more than two blocks of one bucket
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(60)] = f"n{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 2, 80)


def test_clashing_columns_null_and_repeated_ids(spark):
    names = "id long, doc_id int, text string, rep long, bands string, key string, codes int, n int"
    rows = [(9, 1, "a b c d", 1, "", "", 1, 1), (9, 1, "a b c d", 1, "", "", 1, 1), (9, None, "a b c d", 1, "", "", 1, 1), (9, 5, "A b c d", 1, "", "", 1, 1), (9, 7, None, 1, "", "", 1, 1)]
    df = spark.createDataFrame(rows, names)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, 2).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (5, 3, 1, False), (7, 0, 7, True)], key=str)
    kept = neardup.keep_one(df, 2)
    assert kept.schema.names == df.schema.names
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 7]


def test_rows_of_one_id_are_told_apart_by_their_texts(spark):
    texts = ["a b c d e f g h", "x y z u v w", "a b c d e f g h", None, "", "p q r s", "a b c d e f g h i"]
    rows = [(4, t) for t in texts] + [(2, "x y z u v w"), (None, "p q r s"), (None, "k l m n o"), (None, "k l m n o"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([(2, "x y z u v w"), (4, None), (4, ""), (4, "p q r s"), (None, "k l m n o"), (None, None)], key=str)
    for _ in range(2):
        kept = sorted(map(tuple, neardup.keep_one(df, 2).collect()), key=str)
        assert [x for x in kept if not (x[1] or "").startswith("a b")] == want
        assert len([x for x in kept if (x[1] or "").startswith("a b")]) == 1 and len(kept) == len(want) + 1
    got = neardup.near_duplicates(df, 2).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id, r.kept) for r in got if r.n_shingles == 5} == {(4, 2, False), (2, 2, True)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df, 2).count() == 0 and neardup.keep_one(df).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(4)
    words = [f"v{rng.randrange(50_000)}" for _ in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, " ".join(words[:100_000]))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    own = rng.integers(0, 1 << 62, (2, 50)).astype(np.uint64)
    code = np.concatenate([shared, own[0], shared, own[1]])
    sig = neardup.super_minhash(code, np.array([0, 950, 1900]))
    assert abs((sig[0] == sig[1]).mean() - 0.9) < 0.08
    # A slot's values come from distinct steps: every element takes each slot once.
    alone = neardup.super_minhash(code[:1], np.array([0, 1]))
    assert sorted((alone[0] >> np.uint64(48)).tolist()) == list(range(neardup.SLOTS))


@pytest.mark.parametrize(("codes", "columns"), [(neardup.RANGE_CODES, neardup.MATRIX_COLUMNS), (300, 7)])
def test_overlaps_of_all_pairs(monkeypatch, codes, columns):
    monkeypatch.setattr(neardup, "RANGE_CODES", codes)
    monkeypatch.setattr(neardup, "MATRIX_COLUMNS", columns)
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 64, 500, np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (200, 200, 1, 3, 400, 0, 50)]
    got = neardup.overlaps(sets)
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) if i != j else got[i, j] for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    assert neardup.overlaps([np.empty(0, np.uint64)] * 2).tolist() == [[0, 0], [0, 0]]


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1400)] + [(3, 3)]
    sets = components.UnionFind()
    for u, v in edges:
        sets.union(u, v)
    nodes = {x for u, v in edges if u != v for x in (u, v)}
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    got = components.components(df).collect()
    assert len(got) == len(nodes) and {r.node: r.root for r in got} == {x: sets.find(x) for x in nodes}
    assert components.components(df.limit(0)).count() == 0


def test_words_of_the_known_collision_stay_apart(spark):
    """Words of letters in Thue-Morse order have the polynomial codes of their complements."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    rows = [(i, " ".join("".join("xy"[b ^ i] for b in bits) + str(j) for j in range(40))) for i in (0, 1)]
    rows += [(2 + i, "".join("xy"[b ^ i] for b in bits)) for i in (0, 1)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert sorted(r.component_id for r in found.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("last", [0, 1 << 18])
def test_small_graphs_take_few_jobs(spark, monkeypatch, last):
    """One more task joins small forests; rounds, which larger ones take, give the same components."""
    monkeypatch.setattr(components, "LAST_EDGES", last)
    tracker, group = spark.sparkContext.statusTracker(), f"components-{last}"
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i % 50] + [(7, 7), (900, 3), (900, 3)], "u long, v long").repartition(4)
    spark.sparkContext.setJobGroup(group, "test")
    found = sorted((r.node, r.root) for r in components.components(edges).collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == sorted([(i, 50 * ((i - 1) // 50) + 1) for i in range(1, 301)] + [(900, 1)])
    assert (len(tracker.getJobIdsForGroup(group)) <= 12) == (last > 0)


def test_sets_know_their_classes():
    """Sets carry the prints that rows of signatures have, so they find their class without a join."""
    texts = pa.array(["a b c d", None, "a b", "", "x", "B b c a"])
    rows = pa.RecordBatch.from_arrays([pa.array(range(6), pa.int64()), pa.array(range(6), pa.int64()), texts], ["id", "t", "text"])
    (signed,) = neardup._signatures(2, 20, 5)([rows])
    (sets,) = neardup._sets(2, bytes([0b111101]))([pa.RecordBatch.from_arrays([texts, pa.array(range(6), pa.int64())], ["text", "bit"])])
    assert [sets.column(c).to_pylist() for c in ("n", "p1", "p2")] == [[x for i, x in enumerate(signed.column(c).to_pylist()) if i != 1] for c in ("n", "p1", "p2")]
    assert [len(x) for x in sets.column("codes").to_pylist()] == [3, 1, 0, 1, 3]
