"""Quality classifier: regularised quadratic discriminant on document statistics.

Each whole text becomes a short vector of transformed rates (case, symbols,
repetition, line and word lengths).  Each class has a Gaussian whose covariance
is shrunk towards the pooled one and its diagonal; a score is the logistic of
the difference of the two log densities, with Mahalanobis terms from cached
Cholesky factors.  Fitting adds up counts, sums and outer products of all
training rows in Spark; the driver sees one small matrix for each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discloom.llm.support import bit_of, filter_bits, fresh, has_bit, held_out
from discloom.llm.wordcode import U64, Coder, pieces, split_words

CODER = Coder(11)
#: The byte classes whose rates are taken.
BYTE_CLASSES = {
    "upper": range(ord("A"), ord("Z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "bang": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*+/<=>@[\\]^_`{}~",
    "mark": b"\"'(),-.:;?",
    "line": b"\n",
    "space": b" \t\r\v\f",
    "wide": range(128, 256),
}
CLASS_OF = np.zeros(256, np.int64)
for _i, _bytes in enumerate(BYTE_CLASSES.values(), 1):
    CLASS_OF[list(_bytes)] = _i
FEATURES = ["n_words", "word_len", "word_len_sd", *BYTE_CLASSES, "distinct", "stutter", "top_word", "marked_words"]
SHRINK_POOLED, SHRINK_DIAGONAL = 0.15, 0.05
#: Statistics are summed in units of one by this.
FRACTION = float(1 << 20)


def features(texts: pa.Array) -> np.ndarray:
    """One row of finite statistics for each text; null counts as empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    for low, high, data, bounds in pieces(texts):
        n = high - low
        w = split_words(data, bounds)
        words = np.diff(w.first).astype(float)
        some = np.maximum(words, 1)
        size = np.maximum(np.diff(bounds), 1).astype(float)
        length = (w.end - w.start).astype(float)
        mean = np.bincount(w.doc, length, n) / some
        square = np.bincount(w.doc, length * length, n) / some
        kinds = len(BYTE_CLASSES) + 1
        of_doc = np.repeat(np.arange(n) * kinds, np.diff(bounds))
        rates = np.bincount(of_doc + CLASS_OF[data], minlength=n * kinds).reshape(n, kinds)[:, 1:] / size[:, None]
        codes = CODER.words(data, w.start, w.end)
        bits = U64(max(1, n.bit_length()))
        key = np.sort((w.doc.astype(U64) << (U64(64) - bits)) | (codes >> bits))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        doc_of_key = (key[at] >> (U64(64) - bits)).astype(np.int64)
        distinct = np.bincount(doc_of_key, minlength=n) / some
        runs = np.diff(np.append(at, len(key)))
        top = np.zeros(n)
        np.maximum.at(top, doc_of_key, runs)
        again = (codes[1:] == codes[:-1]) & (w.doc[1:] == w.doc[:-1])
        stutter = np.bincount(w.doc[1:][again], minlength=n) / some
        last = CLASS_OF[data[w.end - 1]]
        marked = np.bincount(w.doc[(last == 3) | (last == 4) | (last == 5)], minlength=n) / some
        out[low:high, 0] = np.log1p(words)
        out[low:high, 1] = np.log1p(mean)
        out[low:high, 2] = np.log1p(np.sqrt(np.maximum(square - mean * mean, 0)))
        out[low:high, 3 : 3 + kinds - 1] = np.log1p(300 * rates)
        out[low:high, 3 + kinds - 1 :] = np.stack([distinct, np.log1p(100 * stutter), np.log1p(20 * top / some), np.log1p(100 * marked)], 1)
    return out


@dataclass
class Discriminant:
    """Means, whitening factors and log normalisers of classes 0 and 1."""

    means: np.ndarray
    roots: np.ndarray  # inverse Cholesky factors
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        log = np.stack([o - 0.5 * (((x - m) @ r.T) ** 2).sum(1) for m, r, o in zip(self.means, self.roots, self.offsets, strict=True)])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def discriminant(n: np.ndarray, total: np.ndarray, outer: np.ndarray) -> Discriminant:
    """From the counts, sums and sums of outer products of both classes.

    A class without rows takes the pooled moments, so that its density is the
    pooled one; with no rows at all, every score is one half.
    """
    d = total.shape[1]
    all_n = max(n.sum(), 1.0)
    pooled_mean = total.sum(0) / all_n
    means = np.stack([t / c if c else pooled_mean for t, c in zip(total, n, strict=True)])
    around = [o / c - np.outer(m, m) if c else np.zeros((d, d)) for o, m, c in zip(outer, means, n, strict=True)]
    pooled = sum(a * c for a, c in zip(around, n, strict=True)) / all_n
    diagonal = np.diag(np.diag(pooled)) + 1e-3 * np.eye(d)
    roots, offsets = [], []
    for a, c in zip(around, n, strict=True):
        shrink = min(1.0, SHRINK_POOLED + d / max(c, d))
        cov = (1 - shrink - SHRINK_DIAGONAL * (1 - shrink)) * a + shrink * pooled + SHRINK_DIAGONAL * diagonal
        cov = (cov + cov.T) / 2 + 1e-3 * np.eye(d)
        root = np.linalg.inv(np.linalg.cholesky(cov))
        roots.append(root)
        offsets.append(np.log(np.diag(root)).sum() + np.log((c + 1) / (n.sum() + 2)))
    return Discriminant(means, np.stack(roots), np.array(offsets))


def fit(docs: DataFrame, labels: DataFrame, training: Column, text: str = "text", id_col: str = "doc_id", label: str = "quality") -> Discriminant:
    """Fit on all labelled rows of ``docs`` that ``training`` (on the id) allows."""
    d = len(FEATURES)

    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter(training & F.col("y").isin(0, 1))
    # Ids of other types that are equal must have equal bits.
    bits = filter_bits(known.select(F.col("id").cast("string").alias("key")), "key")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A filter of fixed size keeps most texts without a label from being looked at.
        for b in batches:
            b = b.filter(pa.array(has_bit(bits, b.column(2).to_numpy())))
            flat_values = features(b.column(1))
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat_values.ravel()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    train = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(id_col).cast("string").alias("key")).filter(training)
    train = train.select("id", "text", bit_of("key").alias("bit"))
    rows = train.mapInArrow(vectors, f"id {kind}, x array<double>").join(known, "id").select("y", "x")
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    # Sums of entries and of products of two, in Spark: no second Python worker beside the one that makes the vectors.
    # Whole numbers add up to the same whatever the order in which tasks end.
    whole = lambda v: F.sum(F.round(v * FRACTION).cast("long"))
    sums = rows.groupBy("y").agg(F.count("*"), *(whole(v) for v in x), *(whole(x[i] * x[j]) for i, j in pairs))
    n, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for y, count, *values in sums.collect():  # one row for each class
        values = np.array(values, float) / FRACTION
        n[y], total[y] = count, values[:d]
        for (i, j), value in zip(pairs, values[d:], strict=True):
            outer[y, i, j] = outer[y, j, i] = value
    return discriminant(n, total, outer)


def scorer(model: Discriminant):
    """Arrow UDF from a text column to its score."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    return F.arrow_udf(score, "double")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``.

    Rows whose crc32 of the id is 0 modulo 5 are held out of the fit, as are
    rows without an id, without a label or with another label than 0 or 1.
    Null and empty texts are scored as texts without words, texts of any length
    as a whole.  Repeated rows and repeated labels each count.  Without any
    training row all scores are 0.5.  Other columns of ``docs`` and ``labels``
    are ignored, whatever their names.
    """
    model = fit(docs, labels, _training(), text, id_col)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col), 5, 0).alias("held_out"), scorer(model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their columns, that score ``threshold`` or more.

    Rows with null, empty or very long texts, without an id, or repeated are
    scored like any other.  Without any training row all stay.
    """
    model = fit(docs, labels, _training(), text, id_col)
    name = fresh(docs, "quality_score")
    return docs.withColumn(name, scorer(model)(F.col(text))).filter(F.col(name) >= threshold).drop(name)


def _training() -> Column:
    return F.col("id").isNotNull() & ~held_out(F.col("id"), 5, 0)
