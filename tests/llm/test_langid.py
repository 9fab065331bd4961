import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from discloom.llm import langid

WORDS = {
    "en": "the and of to that with this there which have from they were when".split(),
    "de": "der die und nicht auch eine schön über ist mit dem auf sich wäre".split(),
    "fr": "le les des et où pas était une dans pour que vous être à".split(),
}


def text_of(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def corpus(n=300):
    rng = random.Random(3)
    return [(i, text_of(rng, lang := sorted(WORDS)[i % 3], rng.randint(3, 60)), lang) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string"


def test_held_out_texts_and_inserted_passages(spark):
    rows = corpus()
    rng = random.Random(4)
    mixed = [(1000, text_of(rng, "de", 60) + " " + text_of(rng, "en", 25), None), (1001, text_of(rng, "fr", 20) + " 123 " + text_of(rng, "de", 50), None)]
    odd = [(1002, None, "en"), (1003, "", "en"), (1004, "123 !? --", "de"), (1005, "×÷ ‒ §", None), (1006, "LES DES ÉTAIT OÙ", None), (5, rows[5][1], rows[5][2]), (None, rows[7][1], None)]
    odd += [(1007, text_of(rng, "fr", 150_000), None)]
    got = langid.identify(spark.createDataFrame(rows + mixed + odd, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows) + len(mixed) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    own = [(i, lang) for i, _, lang in rows if by[i].held_out]
    assert len(own) > 50 and all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert sum(by[i].lang_pred == lang for i, lang in own) >= 0.98 * len(own)
    assert (by[1000].lang_pred, by[1001].lang_pred) == ("de", "de") and 0.5 < by[1000].score < 0.9
    assert [by[i].lang_pred for i in (1002, 1003, 1004, 1005, 1006, 1007)] == ["und"] * 4 + ["fr"] * 2
    assert by[1002].score == 0 and by[None].lang_pred == rows[7][2]


def test_few_languages_no_rows_and_clashing_columns(spark):
    one = spark.createDataFrame([(i, "some words", "en", "x", 1) for i in range(20)], f"{SCHEMA}, lang_pred string, p int")
    got = langid.identify(one)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and {(r.lang_pred, r.score) for r in got.collect()} == {("en", 1.0)}
    assert {r.lang_pred for r in langid.identify(one.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(one.limit(0)).count() == 0


def test_many_rows_of_one_id_are_drawn_like_others(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(langid, "fit_field", lambda texts, langs: drawn.append((texts, langs)) or langid.Field.empty(sorted(set(langs)), np.empty(0, np.uint64)))
    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(hot, f"hot words {i % 2000}", "en") for i in range(4000)] + [(1000 + i, f"viele andere {i}", "de") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs, sample=200)
    texts, langs = drawn[0]
    assert len(texts) <= 200 and len(set(texts)) == len(texts) and 40 <= langs.count("en") <= 100


@pytest.mark.parametrize("segment", [2, 64])
def test_forward_backward_is_a_sum_over_all_labellings(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = np.random.default_rng(1)
    k, sizes = 3, [5, 0, 1, 4, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    potentials, moves = rng.normal(size=(first[-1], k)) * 3, rng.normal(size=(k, k)).astype(np.float32)
    got, pairs = langid.marginals(potentials, first, moves, pairs=True)
    expected, moved = np.zeros_like(got), np.zeros((k, k))
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = list(product(range(k), repeat=b - a))
        weight = np.exp([sum(potentials[a + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:], strict=False)) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for i, y in enumerate(p):
                expected[a + i, y] += w
            for x, y in zip(p, p[1:], strict=False):
                moved[x, y] += w
    assert np.allclose(got, expected) and np.allclose(pairs, moved)


def test_features_do_not_cross_texts():
    alone = langid.observe(*_flat(["über uns"]), np.empty(0, np.uint64))
    both = langid.observe(*_flat(["Vor", "Über uns", "nach"]), np.empty(0, np.uint64))
    assert np.array_equal(both.affixes[1:3], alone.affixes)
    assert np.array_equal(both.grams[both.gram_first[1] : both.gram_first[3]], alone.grams)


def _flat(texts):
    _, _, data, bounds = next(langid.pieces(pa.array(texts)))
    return data, bounds


def test_the_ends_of_long_texts_are_fitted_on(spark):
    same = "lorem ipsum " * 5000
    docs = [(i, same + " ".join(["quando sempre vita"] * 4000 if i % 2 else ["warum immer leben"] * 4000), "it" if i % 2 else "de") for i in range(24)]
    short = [(100, "quando sempre", None), (101, "warum immer leben", None)]
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(docs + short, "doc_id long, text string, lang string")).collect()}
    assert got[100] == "it" and got[101] == "de" and all(got[n] == lang for n, _, lang in docs)
