import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from discloom.llm import substrings, wordcode

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """Sorted results of ``rows (id, text)`` by counting every window."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (name, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((name, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def results(df, width, cells):
    return sorted(map(tuple, substrings.remove_repeats(df, width, cells=cells).collect()), key=str)


def corpus(seed, width):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "x.", " ", "漢字"]
    passages = [[rng.choice(vocabulary) for _ in range(width + rng.randrange(-1, 12))] for _ in range(5)]
    rows = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3 * width))]
        for _ in range(rng.randrange(3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t\t", "  "]) for x in w)))
    rows += [(90, None), (91, ""), (92, " \n"), (93, "a " * (3 * width)), (94, "a " * width), (95, rows[3][1]), (95, rows[3][1]), (None, rows[4][1])]
    return rows


@pytest.mark.parametrize(("width", "cells", "seed"), [(5, 1 << 20, 1), (35, 1 << 20, 2), (5, 64, 3), (16, 1024, 4)])
def test_every_repeated_window_goes_and_no_other(spark, width, cells, seed):
    """Few cells make most windows suspects: the result stays exact."""
    rows = corpus(seed, width)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert results(df, width, cells) == brute(rows, width)


def test_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([("k", "a b c", 1, "x", [1], 2)], "doc_id string, text string, print int, slice string, alarms array<int>, id int")
    assert substrings.remove_repeats(df.limit(0), 3).count() == 0
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeats(df, 3).collect()] == [("k", 3, 0, "a b c")]
    assert substrings.remove_repeats(df, 3, with_text=False).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_a_very_long_text(spark):
    rng = random.Random(8)
    w = [f"u{i}" for i in range(300_000)]
    w[200_000:200_040] = w[10:50]
    rows = [(1, " ".join(w)), (2, " ".join(rng.sample(w[60:1000], 100)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert results(df, 35, 1 << 20) == brute(rows, 35)


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB \t\n\x0b\x1f\u0085é漢")), st.text()), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    got = []
    for low, high, data, bounds in wordcode.pieces(pa.array(texts, pa.string()), 7):
        w = wordcode.split_words(data, bounds)
        for d in range(high - low):
            got.append([bytes(data[a:b]).decode() for a, b in zip(w.start[w.first[d] : w.first[d + 1]], w.end[w.first[d] : w.first[d + 1]], strict=True)])
    assert got == [WORD.findall(t or "") for t in texts]


def thue_morse(n):
    """Letters or words whose polynomial codes modulo 2 ** 64 are those of their complement."""
    return [bin(i).count("1") % 2 for i in range(n)]


def test_equal_words_and_runs_have_equal_codes():
    a, b = ("".join("xy"[i ^ flip] for i in thue_morse(2048)) for flip in (0, 1))
    texts = pa.array([f"one two three two {a}", f"xx two three {b}", "one"])
    found = {}
    for _, _, data, bounds in wordcode.pieces(texts):
        w = wordcode.split_words(data, bounds)
        for codes in wordcode.word_prints(data, w.start, w.end, 1):
            for x, y, c in zip(w.start, w.end, codes.tolist(), strict=True):
                found.setdefault(bytes(data[x:y]), set()).add(c)
            two, three, seven = wordcode.run_prints(codes, 2, 3, 7)
            assert two[1] == two[6] and len(set(two.tolist())) == 8 and len(set(three.tolist())) == 8 and len(seven) == 4
    assert all(len(x) == 2 for x in found.values()) and len(set.union(*found.values())) == 2 * len(found)
    for n in (64, 1024):
        run = np.array([7, 11], wordcode.U64)[[*thue_morse(n), *(1 - i for i in thue_morse(n))]]
        codes = wordcode.run_prints(run, n)[0]
        assert codes[0] != codes[n]
    assert np.array_equal(substrings._least_places(np.array([3, 1, 2, 1, 5], np.uint64), 3), [1, 1, 3])


def test_words_of_the_known_collision_stay_apart(spark):
    a, b = ("".join("xy"[i ^ flip] for i in thue_morse(1024)) for flip in (0, 1))
    rows = [(i, " ".join(f"w{j}" for j in range(17)) + f" {x} " + " ".join(f"v{j}" for j in range(17))) for i, x in enumerate((a, b))]
    rows += [(2 + i, " ".join("xy"[j ^ i] for j in thue_morse(64))) for i in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (35, 64):
        assert results(df, width, 1 << 20) == brute(rows, width)
