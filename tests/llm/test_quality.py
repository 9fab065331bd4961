import random
import zlib

import numpy as np
import pyarrow as pa

from discloom.llm import quality


def good(rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(40, 200)))


def bad(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join([rng.choice(["BUY", "NOW"])] * rng.randint(30, 100)) + "!!!"
    if kind == 1:
        return " | ".join(good(rng).split()[:60])
    return "".join(rng.choice("$%&#*0123456789 ") for _ in range(600))


def tables(spark, n=900):
    rng = random.Random(1)
    rows = [(i, good(rng) if i % 4 else bad(rng)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n) if i % 3 or i % 4 == 0], "doc_id long, quality int")
    return rows, docs, labels


def test_held_out_documents_are_told_apart(spark):
    rows, docs, labels = tables(spark)
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    own = [i for i, r in got.items() if r.held_out]
    assert len(own) > 100 and sum(got[i].predicted == int(i % 4 > 0) for i in own) / len(own) > 0.97
    kept = quality.keep_good(docs, labels).collect()
    assert {r.doc_id for r in kept} == {i for i, r in got.items() if r.predicted}


def test_scores_are_those_of_two_gaussians():
    rng = np.random.default_rng(2)
    xs = [rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(90, 4)) + 1]
    n = np.array([60.0, 90.0])
    model = quality.discriminant(n, np.stack([x.sum(0) for x in xs]), np.stack([x.T @ x for x in xs]))
    pooled = sum(np.cov(x.T, bias=True) * len(x) for x in xs) / 150
    logs = []
    at = rng.normal(size=(7, 4))
    for x in xs:
        shrink = quality.SHRINK_POOLED + 4 / len(x)
        cov = (1 - shrink) * (1 - quality.SHRINK_DIAGONAL) * np.cov(x.T, bias=True)
        cov += shrink * pooled + quality.SHRINK_DIAGONAL * (np.diag(np.diag(pooled)) + 1e-3 * np.eye(4)) + 1e-3 * np.eye(4)
        d = at - x.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((len(x) + 1) / 152))
    assert np.allclose(model.score(at), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_nulls_empty_and_long_texts_and_repeated_rows(spark):
    rows, docs, labels = tables(spark, 400)
    odd = [(None, "some text"), (1001, None), (1002, ""), (1003, " \n"), (5, rows[5][1]), (5, rows[5][1]), (1004, "word " * 400_000)]
    more = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    own = labels.union(spark.createDataFrame([(None, 1), (5, None), (6, 7), (1002, 0), (5, 1)], "doc_id long, quality int"))
    got = quality.score_quality(more, own).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1001] == scores[1002] and not next(r.held_out for r in got if r.doc_id is None)
    # The score is a matter of the text alone.
    again = quality.score_quality(more.selectExpr("doc_id", "text", "7 AS score", "'x' AS quality", "true AS held_out"), own)
    assert {r.doc_id: r.score for r in again.collect()} == scores and again.columns == ["doc_id", "held_out", "score", "predicted"]


def test_without_labels_or_rows(spark):
    _, docs, labels = tables(spark, 40)
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0 == quality.keep_good(docs.limit(0), labels).count()
    only = labels.filter("quality = 1")
    assert all(r.score > 0.5 for r in quality.score_quality(docs, only).collect())


def test_statistics_of_plain_texts():
    x = quality.features(pa.array(["ab ab cd", None, "A1!\n|"]))
    at = {n: i for i, n in enumerate(quality.FEATURES)}
    assert np.allclose(x[0, at["n_words"]], np.log1p(3)) and np.allclose(x[0, at["distinct"]], 2 / 3)
    assert np.allclose(x[0, at["stutter"]], np.log1p(100 / 3)) and np.allclose(x[2, at["upper"]], np.log1p(300 / 5))
    assert not x[1].any() and np.isfinite(x).all()


def test_ids_of_another_type_are_the_same_ids(spark):
    _, docs, labels = tables(spark, 300)
    want = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    other = quality.score_quality(docs, labels.selectExpr("cast(doc_id AS int) AS doc_id", "quality")).collect()
    assert {r.doc_id: r.score for r in other} == want and len(set(want.values())) > 10
