import random
import time

import numpy as np
import pytest

from discloom.llm import periods


def brute(words):
    """Runs as (start, length, period), by comparing all words that are q apart, for every q."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(rng, most):
    letters, n = rng.randint(1, 4), rng.randint(0, most)
    words = [rng.randrange(letters) for _ in range(n)]
    if n > 4 and rng.random() < 0.6:
        start, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        words = [words[min(n - 1, i if i < start else start + (i - start) % p)] for i in range(n)]
    return words


@pytest.mark.parametrize("few", [0, 12])
def test_runs_are_those_of_all_periods(monkeypatch, few):
    monkeypatch.setattr(periods, "FEW", few)
    rng = random.Random(few)
    for _ in range(700):
        docs = [some_words(rng, 80) for _ in range(rng.randint(1, 4))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        found = periods.find_runs(np.array([x for d in docs for x in d], np.int32), first)
        expected = sorted((s + int(first[k]), length, q) for k, d in enumerate(docs) for s, length, q in brute(d))
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == expected


def test_time_grows_with_n_log_n():
    """Periodic texts are refined up to a quarter of their length; each step must touch few positions."""
    for make in (lambda i: 0, lambda i: i % 20_000, lambda i: i // 1000 % 2 if i % 7 else 5):
        ids = np.array([make(i) for i in range(80_000)], np.int32)
        began = time.time()
        periods.find_runs(ids, np.array([0, len(ids)]))
        assert time.time() - began < 20


def test_table(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{x}" for x in some_words(rng, 60)) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "a " * 7, "a a a a a a", "a a a a a", "\tÀ b\nÀ  b À\x0bb À b c ", "a\x1fb a\x1fb a\x1fb a\x1fb a\x1fb a\x1fb"]
    texts += ["x y " * 40_000 + "end", "  lead a b c a b c a b c a b c tail  "]
    rows = [(i if i % 9 else None, t, "id", 1.0) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id int, text string, ID2 string, runs double").repartition(3)
    found = periods.collapse_runs(df)
    assert found.dtypes == [("doc_id", "int"), ("n_words", "bigint"), ("runs", "array<struct<start:bigint,length:bigint,period:bigint>>"), ("collapsed", "string")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=repr)
    expected = []
    for i, t, *_ in rows:
        words = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ")
        words = [w for w in words if w]
        runs = brute(words) if len(words) < 1000 else [(0, 80_000, 2)]
        expected.append((i is None, i or 0, len(words), runs, collapsed(words, runs)))
    assert got == sorted(expected, key=repr)
    assert periods.collapse_runs(df.filter("doc_id < 0")).collect() == []
