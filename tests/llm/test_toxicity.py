import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from discloom.llm import toxicity
from discloom.llm.support import cut

RUDE = ["grumbolt", "snarkfish", "blightmaw"]


def clean_word(rng):
    return "".join(rng.choice(["ba", "ne", "ti", "mo", "sur", "len", "ka", "ost"]) for _ in range(rng.randint(1, 3)))


def hidden(rng, word):
    kind = rng.randrange(4)
    if kind == 0:
        return word.translate(str.maketrans("oaeilst", "0@31|$7"))
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return "".join(c * rng.choice([1, 1, 4]) for c in word)
    return ".".join(word)


def corpus(n=800):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [clean_word(rng) for _ in range(rng.randint(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w = rng.choice(RUDE)
                words.insert(rng.randrange(len(words)), hidden(rng, w) if rng.random() < 0.5 else w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    assert len(got) == len(rows)
    own = [i for i in got if got[i].held_out]
    assert len(own) > 150 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    right = [got[i].predicted == int(i % 5 == 0) for i in own]
    assert sum(right) / len(right) > 0.96
    # Words that appear only disguised are found too.
    rng = random.Random(8)
    disguised = [(5000 + i, " ".join([clean_word(rng) for _ in range(20)] + [hidden(rng, w) for w in RUDE])) for i in range(40)]
    more = toxicity.score_toxicity(docs.union(spark.createDataFrame(disguised, "doc_id long, text string")), known).filter("doc_id >= 5000")
    assert more.agg(F.avg("predicted")).first()[0] > 0.9


@pytest.mark.parametrize("word", ["gr0mb0lt", "grrrrombolttt", "g.r.o.m.b.o.l.t", "gr*mbolt", "9rombolt", "grombo|t", "gromb0l7"])
def test_words_are_restored(spark, word):
    rng = random.Random(1)
    texts = [(i, " ".join(["grombolt", *(clean_word(rng) for _ in range(30))])) for i in range(50)]
    decoder = _decoder(spark, texts)
    assert decoder.read(word) == "grombolt"


def plain_readings(decoder, word, most):
    """All ways through the lattice, one by one."""
    ways, before, run = {"": 0.0}, "", 0
    for c in word:
        run, after = run + 1 if c == before else 1, {}
        before, stands = c, toxicity.LOOKALIKES.get(c, "")
        if c.isalpha():
            options = [(c, 0.0)] * (run < 3) + [("", toxicity.REPEATED if run == 2 else 0.0)] * (run > 1)
        else:
            options = [(x, toxicity.SUBSTITUTED) for x in stands] + [("", toxicity.LOOKALIKE_DROPPED if stands else toxicity.MARK_DROPPED)]
            options += [(x, toxicity.WILD_READ) for x in toxicity.LETTERS if c in toxicity.WILD and x not in stands]
        for done, t in ways.items():
            for x, price in options:
                after[done + x] = min(after.get(done + x, 1e9), t + price)
        ways = after

    def total(done):
        s = [0, 0, *(int(toxicity.SYMBOL[x.encode()[-1]]) for x in done), 0]
        return sum(float(decoder.cost[a, b, c]) for a, b, c in zip(s, s[1:], s[2:], strict=False))

    return sorted((t + total(done), done) for done, t in ways.items() if done)[:most]


def test_readings_are_the_best_of_all():
    rng = np.random.default_rng(4)
    decoder = toxicity.Decoder(rng.integers(0, 40, toxicity.SYMBOLS**3) * (rng.random(toxicity.SYMBOLS**3) < 0.05) * 1.0)
    draw = random.Random(3)
    words = ["s**pid", "m*r*n", "*1*o0l", "b**kk1", "66**", "aa1ll", "x.y-z", "é8*e", "6*1*8", "ab1cd2ef", "abba1", "..", ""]
    words += ["".join(draw.choice("aabbll1o0.é") for _ in range(draw.randint(1, 9))) for _ in range(150)]
    for word in words:
        want = plain_readings(decoder, word, 1)
        assert decoder.read(word) == (want[0][1] if want else ""), word


def test_blocks_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    counts, draw = rng.integers(0, 40, toxicity.SYMBOLS**3) * 1.0, random.Random(5)
    words = ["".join(draw.choice("a10b5*") for _ in range(n)) for n in (1, 2, 15, 16, 17, 200)]
    want = [toxicity.Decoder(counts).read(x) for x in words]
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    assert [toxicity.Decoder(counts).read(x) for x in words] == want
    assert len(toxicity.Decoder(counts).read("1a0b5" * 2000)) >= 4000


def test_time_is_linear_in_long_words():
    decoder = toxicity.Decoder(np.ones(toxicity.SYMBOLS**3))
    texts = pa.array(["s t u p 1 d " * 40_000, "st1pidwor" * 60_000, "x" * 500_000, "ab " * 100_000])
    began = time.time()
    doc, codes = toxicity.text_codes(*toxicity.flat(texts), decoder)
    assert set(doc.tolist()) == {0, 1, 2, 3} and time.time() - began < 60


@pytest.mark.parametrize("word", ["57up1d", "$7upid", "5tup1d", "stupi*", "stup**", "st00pid"[:2] + "up1d", "stuupid", "sstupid", "stu pid", "st up id", "s tu pid", "s t u p i d", "57 up 1d", "(stupid", "stupid!", "455", "@$$", "a s 5", "4 5 5"])
def test_disguises_give_the_features_of_the_word(spark, word):
    rng = random.Random(1)
    texts = [" ".join(["stupid ass", *(clean_word(rng) for _ in range(30))]) for _ in range(50)]
    decoder = toxicity.Decoder(toxicity.character_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text"))
    codes = lambda *texts: toxicity.text_codes(*toxicity.flat(pa.array(texts)), decoder)
    want = codes("ass" if len(word.replace(" ", "")) == 3 else "stupid")[1][0, 0]
    doc, found = codes("mo len", f"ba {word}", "ne ti")
    assert want in found[doc == 1, 0] and want not in found[doc != 1, 0]


def test_wildcards_alone_tell_nothing(spark):
    decoder = toxicity.Decoder(np.ones(toxicity.SYMBOLS**3))
    doc, _ = toxicity.text_codes(*toxicity.flat(pa.array(["*****", "", "## ** ?", "a1", "--- ..."])), decoder)
    assert set(doc.tolist()) == {3}


_KEPT = {}


def _decoder(spark, texts):
    if "decoder" not in _KEPT:
        _KEPT["decoder"] = toxicity.Decoder(toxicity.character_counts(spark.createDataFrame(texts, "doc_id long, text string"), "text"))
    return _KEPT["decoder"]


def test_character_counts_are_of_all_texts(spark):
    counts = toxicity.character_counts(spark.createDataFrame([(1, "ab a"), (2, None), (3, "AB a")], "doc_id long, text string").repartition(2), "text")
    s, n = toxicity.SYMBOLS, toxicity.SYMBOL
    at = lambda a, b, c: counts[(n[ord(a)] * s + n[ord(b)]) * s + n[ord(c)]]
    assert at("a", "b", " ") == 2 and at("b", " ", "a") == 2


def test_nulls_empty_long_texts_and_repeated_rows(spark):
    rows, labels = corpus(300)
    odd = [(None, "grumbolt here"), (1001, None), (1002, ""), (1003, "\n"), (5, rows[5][1]), (5, rows[5][1]), (1004, "sur len " * 200_000 + "grumbolt snarkfish"), (1005, "!!! ((( ### 000"), (1006, "�é" * 50)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS score", "1 AS y", "2 AS toxic", "3 AS id")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (6, 9), (5, 1), (1001, 1), (1002, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, known).collect()
    assert len(got) == len(rows) + len(odd) and all(np.isfinite(r.score) and 0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1001] == scores[1002] and scores[1001] < 0.3 and not next(r.held_out for r in got if r.doc_id is None)


def test_without_labels_or_rows(spark):
    rows, labels = corpus(40)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    for own in (known.limit(0), known.filter("toxic = 0"), known.filter("toxic = 1")):
        assert toxicity.score_toxicity(docs, own).agg(F.max("score")).first()[0] < 0.3
    assert toxicity.score_toxicity(docs.limit(0), known).count() == 0


def test_codes_of_long_overlapping_spans(monkeypatch):
    from discloom.llm import wordcode

    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4900, 400)
    ends = np.minimum(starts + rng.integers(0, 3000, 400), 5000)
    want = wordcode.Coder(7).words(data, starts, ends)
    assert want.tolist() == [int(wordcode.Coder(7).words(data[a:b], np.array([0]), np.array([b - a]))[0]) for a, b in zip(starts, ends, strict=True)]
    monkeypatch.setattr(wordcode, "CHUNK_BYTES", 64)
    assert (wordcode.Coder(7).words(data, starts, ends) == want).all() and len(wordcode.Coder(7).words(data, starts[:0], ends[:0])) == 0


def test_many_rows_of_one_id_do_not_fill_the_sample(spark, monkeypatch):
    rows, labels = corpus(300)
    hot = next(i for i, _ in rows if i % 5 == 0 and zlib.crc32(str(i).encode()) % 4 != 2)
    docs = spark.createDataFrame(rows + [(hot, f"{rows[hot][1]} more {i % 700}") for i in range(3000)], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    toxicity.fit(docs, known, sample=400)
    assert len(seen) == 2 and seen[-1].count() < 800 and seen[0].count() <= 300 + 700
