import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from discloom.llm import decontaminate
from discloom.llm.decontaminate import normal


def least_edits(item, text):
    """Least edit distance of ``item`` to any part of ``text``, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] * (len(text) + 1)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return min(row)


@given(st.text("abc", max_size=12), st.text("abc ", max_size=40))
def test_bit_parallel_distance(item, text):
    distance, end = decontaminate.edits(item, text)
    assert distance == least_edits(item, text)
    if item:
        assert least_edits(item, text[:end]) == distance


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 0)] = [] if kind == 1 else ["q"]
    return "".join(out)


def fixture():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(n)).capitalize()) for i, n in enumerate([12, 14, 9, 16, 5])]
    items += [(10, items[0][1].upper() + "\n"), (11, None), (12, "  "), (13, "zz")]
    docs = []
    for i in range(40):
        text = " ".join(word() for _ in range(rng.randint(0, 20)))
        if i % 3:
            item = items[i % 5][1]
            text += " " + edited(rng, item, rng.randint(0, int(len(item) * 0.05) + 2)) + "\n " + " ".join(word() for _ in range(8))
        docs.append((i, text))
    docs += [(50, None), (51, ""), (52, items[1][1]), (52, items[1][1]), (53, "jazz"), (None, items[2][1])]
    return items, docs


@pytest.mark.parametrize(("rate", "item_bytes"), [(0.05, 1 << 20), (0.1, 60)])
def test_all_items_within_the_budget_are_found(spark, rate, item_bytes):
    items, docs = fixture()
    expected = []
    for name, text in docs:
        for item, wanted in items:
            if text is not None and wanted and (w := normal(wanted)):
                d = least_edits(w, normal(text))
                if d <= int(len(w) * rate):
                    expected.append((name, item, d, int(len(w) * rate)))
    assert any(e[2] for e in expected) and any(not e[2] for e in expected)
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, benchmark, rate, item_bytes=item_bytes).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance, r.budget) for r in got), key=str) == sorted(expected, key=str)
    for r in got:
        if r.distance == 0:
            text = next(normal(t) for n, t in docs if n == r.doc_id)
            assert text.startswith(normal(dict(items)[r.item_id]), r.start)
    held = {e[0] for e in expected}
    kept = decontaminate.drop_contaminated(df, benchmark, rate, item_bytes=item_bytes).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((n for n, _ in docs if n not in held), key=str)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "some words here", 1, 2)], "doc_id string, text string, item_id int, id int")
    items = spark.createDataFrame([(1, "some words here", 5)], "item_id int, text string, doc_id int")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(df, items).collect()] == [("a", 1, 0)]
    assert decontaminate.contaminated(df, items.limit(0)).count() == 0 == decontaminate.contaminated(df.limit(0), items).count()
    assert decontaminate.drop_contaminated(df, items.limit(0)).collect() == df.collect()
    assert decontaminate.drop_contaminated(df, items).columns == df.columns


def test_a_very_long_text(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefg ") for _ in range(2_000_000))
    item = text[1_500_000:1_500_200].strip()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontaminate.contaminated(df, spark.createDataFrame([(7, edited(rng, item, 4))], "item_id long, text string")).collect()
    assert len(got) == 1 and got[0].distance <= 4


def test_items_without_an_id_are_found(spark):
    docs = spark.createDataFrame([(1, "before the quick brown fox jumps after"), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "the quick brown fox jumps"), (7, "other words here")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, items).collect()] == [(1, None, 0)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]


def test_short_items_cut_no_words(spark):
    docs = spark.createDataFrame([(1, "which one"), (2, "nothing"), (3, "he said: Hi!"), (4, "hi"), (5, "hip hi5 _hi_ high"), (6, "\u4f60\u597d\u5417")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "hi"), (2, "\u597d")], "item_id long, text string")
    got = decontaminate.contaminated(docs, items, whole_words=True).collect()
    assert sorted((r.doc_id, r.item_id, r.start) for r in got) == [(3, 1, 9), (4, 1, 0), (5, 1, 9), (6, 2, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items, whole_words=True).collect()) == [1, 2]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()) == []


def test_documents_are_not_written_for_slices(spark, monkeypatch):
    words = [f"item {i} is a sentence of its own with number {i * 7919}" for i in range(64)]
    docs = spark.createDataFrame([(i, f"before {words[i % 70]} after" if i % 70 < 64 else "clean text") for i in range(140)] + [(None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, words[0])], "item_id long, text string")
    cuts, cut = [], decontaminate.cut
    monkeypatch.setattr(decontaminate, "cut", lambda df: cuts.append(df.columns) or cut(df))
    kept = decontaminate.drop_contaminated(docs, items, rate=0.0, item_bytes=500)
    assert len(cuts) > 8 and all(c == ["h"] for c in cuts)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*(i for i in range(140) if i % 70 >= 64), None], key=str)
    got = decontaminate.contaminated(docs, items, rate=0.0, item_bytes=500).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([*((i, i % 70) for i in range(140) if i % 70 < 64), (0, 99), (70, 99)])
