"""Language of texts from a linear-chain conditional random field over words.

Each word has a potential for each language: the sum of learned weights of its
byte trigrams (with its edges), of its prefixes and suffixes, and of its entry
in a lexicon of frequent words.  Learned transitions join the words of a text,
and forward-backward gives every word's distribution over languages, so that
inserted passages in another language are told apart; a text is in the language
that most of its letters' words are in.

The weights are fitted by gradient steps on a bounded sample of labelled passages
(``SAMPLE`` of them, spread evenly over the languages; a long text is several
passages, each as likely to be drawn as any other), strung together in
random order so that language changes are seen.  Everything else works on whole
columns: n-gram weights are gathered for all bytes of a batch at once, and the
recursions run over fixed-length segments of all texts side by side, joined by
their products of transition matrices, which is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloom.llm.support import held_out
from discloom.llm.wordcode import LOWER_ASCII, U64, Coder, pieces, split_words

CODER = Coder(41)
#: Labelled passages fitted on, passes over them, and passages in one gradient step.
SAMPLE, PASSES, STEP_TEXTS = 1200, 6, 60
#: Characters of the passages that labelled texts are cut into.
PASSAGE = 50_000
GRAM_BITS, AFFIX_BITS, LEXICON = 16, 15, 4096
#: Bytes of the prefixes and suffixes.
AFFIXES = (3, 4, 5)
#: Words of one segment of the recursions.
SEGMENT = 64
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, all other bytes as they are."""
    out = LOWER_ASCII[data]
    after = np.flatnonzero(out[:-1] == 0xC3) + 1 if len(out) else np.empty(0, np.int64)
    upper = after[(out[after] >= 0x80) & (out[after] <= 0x9E) & (out[after] != 0x97)]
    out[upper] += 0x20
    return out


@dataclass
class Observed:
    """Feature numbers of the words of some texts."""

    first: np.ndarray  # number of the first word of each text, one more at the end
    grams: np.ndarray  # trigram of each byte place that counts
    gram_first: np.ndarray  # number of the first such place of each word
    affixes: np.ndarray  # for each word
    lexicon: np.ndarray  # entry of each word; 0 if none
    lettered: np.ndarray


def observe(data: np.ndarray, bounds: np.ndarray, lexicon: np.ndarray) -> Observed:
    data = folded(data)
    w = split_words(data, bounds)
    n = len(w.start)
    # Trigrams centred on the bytes of a word; its neighbours outside count as spaces.
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    left, right = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
    left[1:], right[:-1] = data[:-1], data[1:]
    left[w.start] = 32
    right[w.end - 1] = 32
    key = ((left << 16) | (data.astype(np.uint32) << 8) | right)[inside]
    grams = ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)
    size = w.end - w.start
    gram_first = np.concatenate([[0], np.cumsum(size)])
    affixes = np.empty((n, 2 * len(AFFIXES)), np.int32)
    for i, k in enumerate(AFFIXES):
        near = np.minimum(size, k)
        for j, code in enumerate((CODER.words(data, w.start, w.start + near), CODER.words(data, w.end - near, w.end))):
            affixes[:, 2 * i + j] = ((code ^ U64(2 * i + j)) * U64(0x9E3779B97F4A7C15)) >> U64(64 - AFFIX_BITS)
    codes = CODER.words(data, w.start, w.end)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, codes), len(lexicon) - 1)
        entry = np.where(lexicon[at] == codes, at + 1, 0)
    else:
        entry = np.zeros(n, np.int64)
    letters = np.concatenate([[0], np.cumsum(IS_LETTER[data])])
    return Observed(w.first, grams, gram_first, affixes, entry, letters[w.end] > letters[w.start])


@dataclass
class Field:
    """Weights of the random field."""

    labels: list[str]
    lexicon: np.ndarray
    grams: np.ndarray
    affixes: np.ndarray
    words: np.ndarray
    moves: np.ndarray

    @staticmethod
    def empty(labels: list[str], lexicon: np.ndarray) -> Field:
        k = len(labels)
        return Field(labels, lexicon, *(np.zeros((n, k), np.float32) for n in (1 << GRAM_BITS, 1 << AFFIX_BITS, len(lexicon) + 1, k)))

    def weights(self) -> list[np.ndarray]:
        return [self.grams, self.affixes, self.words, self.moves]

    def potentials(self, x: Observed) -> np.ndarray:
        """Log potentials of all words."""
        out = np.empty((len(x.lexicon), len(self.labels)))
        for k in range(len(self.labels)):
            total = np.concatenate([[0.0], np.cumsum(self.grams[:, k][x.grams], dtype=np.float64)])
            out[:, k] = total[x.gram_first[1:]] - total[x.gram_first[:-1]] + self.affixes[:, k][x.affixes].sum(1) + self.words[:, k][x.lexicon]
        return out


def marginals(potentials: np.ndarray, first: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distributions of all words, and expected moves if ``pairs``.

    ``first`` has the first word of each text and one more at the end.
    """
    n, k = potentials.shape
    moved = np.zeros((k, k))
    if not n:
        return np.empty((0, k)), moved
    psi = np.exp(potentials - potentials.max(1, keepdims=True))
    t = np.exp(moves.astype(np.float64) - moves.max())
    counts = np.diff(first)
    parts = -(-counts // SEGMENT)
    text = np.repeat(np.arange(len(counts)), parts)
    part_first = np.concatenate([[0], np.cumsum(parts)])
    nth = np.arange(len(text)) - part_first[text]
    begin = first[text] + nth * SEGMENT
    size = np.minimum(first[text + 1] - begin, SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    alive = np.searchsorted(-size, -np.arange(SEGMENT), "left")  # segments longer than s
    # Product of each segment's matrices, from its first word to its last.
    product = psi[begin][:, None, :] * np.eye(k)
    for s in range(1, SEGMENT):
        a = alive[s]
        if not a:
            break
        p = (product[:a].reshape(-1, k) @ t).reshape(a, k, k) * psi[begin[:a] + s][:, None, :]
        product[:a] = p / p.max((1, 2), keepdims=True)
    product = product[np.argsort(order)]
    # Messages between the segments of each text, over all texts at once.
    enter = np.ones((len(text), k))
    leave = np.ones((len(text), k))
    longest = np.argsort(-parts, kind="stable")
    depth = parts[longest]
    for d in range(1, int(depth[0])):
        at = part_first[longest[: np.searchsorted(-depth, -d, "left")]] + d
        v = np.einsum("gi,gij->gj", enter[at - 1], product[at - 1]) @ t
        enter[at] = v / v.max(1, keepdims=True)
    for d in range(1, int(depth[0])):
        own = longest[: np.searchsorted(-depth, -d, "left")]
        at = part_first[own + 1] - d
        v = np.einsum("gij,gj->gi", product[at], leave[at]) @ t.T
        leave[at - 1] = v / v.max(1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    v = enter[order] * psi[begin]
    alpha[begin] = v = v / v.max(1, keepdims=True)
    for s in range(1, SEGMENT):
        a = alive[s]
        if not a:
            break
        v = (v[:a] @ t) * psi[begin[:a] + s]
        v /= v.max(1, keepdims=True)
        alpha[begin[:a] + s] = v
    beta[begin + size - 1] = leave[order]
    for s in range(SEGMENT - 1, 0, -1):
        a = alive[s]
        if a:
            at = begin[:a] + s
            v = (psi[at] * beta[at]) @ t.T
            beta[at - 1] = v / v.max(1, keepdims=True)
    out = alpha * beta
    out /= out.sum(1, keepdims=True)
    if pairs:
        inner = np.ones(n, bool)
        inner[first[:-1][counts > 0]] = False
        at = np.flatnonzero(inner)
        right = psi[at] * beta[at]
        norm = ((alpha[at - 1] @ t) * right).sum(1, keepdims=True)
        moved = (alpha[at - 1].T @ (right / norm)) * t
    return out, moved


def fit_field(texts: list[str], langs: list[str], seed: int = 7) -> Field:
    """Fit by Adam on the texts strung together; gold words have their text's language."""
    labels = sorted(set(langs))
    arrow = pa.array(texts, pa.large_string())
    lexicon = np.empty(0, U64)
    if texts:
        seen = []
        for _, _, data, bounds in pieces(arrow):
            data = folded(data)
            w = split_words(data, bounds)
            seen.append(CODER.words(data, w.start, w.end))
        code, count = np.unique(np.concatenate(seen), return_counts=True)
        lexicon = np.sort(code[np.argsort(-count, kind="stable")[:LEXICON]])
    field = Field.empty(labels, lexicon)
    if len(labels) < 2:
        return field
    gold_of = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    mean = [np.zeros(x.shape) for x in field.weights()]
    square = [np.zeros(x.shape) for x in field.weights()]
    step = 0
    for _ in range(PASSES):
        dealt = rng.permutation(len(texts))
        for low in range(0, len(dealt), STEP_TEXTS):
            own = dealt[low : low + STEP_TEXTS]
            grad = [np.zeros(x.shape) for x in field.weights()]
            words = 0
            for a, b, data, bounds in pieces(arrow.take(pa.array(own)), 1 << 19):
                x = observe(data, bounds, lexicon)
                gold = np.repeat(gold_of[own[a:b]], np.diff(x.first))
                if not len(gold):
                    continue
                chain = np.array([0, len(gold)])
                p, moved = marginals(field.potentials(x), chain, field.moves, pairs=True)
                error = p.copy()
                error[np.arange(len(gold)), gold] -= 1
                for k in range(len(labels)):
                    e = error[:, k]
                    grad[0][:, k] += np.bincount(x.grams, np.repeat(e, np.diff(x.gram_first)), 1 << GRAM_BITS)
                    grad[1][:, k] += np.bincount(x.affixes.ravel(), np.repeat(e, x.affixes.shape[1]), 1 << AFFIX_BITS)
                    grad[2][:, k] += np.bincount(x.lexicon, e, len(lexicon) + 1)
                np.add.at(moved, (gold[:-1], gold[1:]), -1)
                grad[3] += moved
                words += len(gold)
            step += 1
            for i, weight in enumerate(field.weights()):
                g = grad[i] / max(words, 1) + 1e-7 * weight
                mean[i] += 0.1 * (g - mean[i])
                square[i] += 0.01 * (g * g - square[i])
                weight -= (0.05 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return field


def labelled(field: Field, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 for one without a letter."""
    names, scores = [], np.zeros(len(texts))
    for low, high, data, bounds in pieces(texts, 2 << 20):
        x = observe(data, bounds, field.lexicon)
        n = high - low
        if len(field.labels):
            p, _ = marginals(field.potentials(x), x.first, field.moves)
            p[~x.lettered] = 0
            total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, 0)])
            share = total[x.first[1:]] - total[x.first[:-1]]
        else:
            share = np.zeros((n, 1))
        some = share.sum(1)
        ascii_letters = np.concatenate([[0], np.cumsum(IS_LETTER[data] & (data < 128))])
        plain = ascii_letters[bounds[1:]] > ascii_letters[bounds[:-1]]
        for i in range(n):
            # Bytes of other scripts may be marks only; these few texts are looked at closely.
            letter = plain[i] or (some[i] > 0 and any(c.isalpha() for c in texts[low + i].as_py()))
            if letter and some[i] > 0:
                k = int(share[i].argmax())
                names.append(field.labels[k])
                scores[low + i] = min(1.0, max(0.0, share[i, k] / some[i]))
            else:
                names.append("und")
    return names, scores


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "lang", sample: int = SAMPLE) -> Field:
    """Fit on a bounded sample of the passages of the rows that are not held out."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    own = own.filter(F.col("id").isNotNull() & ~held_out(F.col("id"), 4, 2) & F.col("label").isNotNull() & F.col("text").isNotNull())
    parts = F.expr(f"(char_length(text) - 1) div {PASSAGE}")
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.sum(parts + 1).alias("n")).collect()}  # one row for each language
    if not counts:
        return Field.empty([], np.empty(0, U64))
    each = max(1, sample // len(counts))
    # Somewhat more than the share, then cut: a language is short of its part only if it has too few passages.
    rate = F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 1.3 * each / n + 10 / n))))
    # Passages are drawn by id, text and place, and equal ones once, so many rows of one id are no more than others.
    own = own.withColumn("t", F.xxhash64("id", "text", F.lit(5))).select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts)).alias("nth"))
    drawn = own.filter(F.pmod(F.xxhash64("t", "nth"), F.lit(1 << 30)) < rate[F.col("label")] * (1 << 30))
    drawn = drawn.select(F.xxhash64("t", "nth", F.lit(6)).alias("h"), "id", F.expr(f"substring(text, int(nth * {PASSAGE} + 1), {PASSAGE})").alias("text"), "label")
    rows = drawn.dropDuplicates(["h", "label"]).orderBy("h").limit(2 * sample + 20 * len(counts)).collect()
    rows.sort(key=lambda r: (r["h"], r["id"]))
    texts, langs, got = [], [], dict.fromkeys(counts, 0)
    for r in rows:
        if got[r["label"]] < each:
            got[r["label"]] += 1
            texts.append(r["text"])
            langs.append(r["label"])
    return fit_field(texts, langs)


def identify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` for every row of ``docs``.

    Rows whose crc32 of the id is 2 modulo 4 are held out of the fit.  A null
    text and one without a letter get ``und`` and score 0, as all texts do when
    there is no row to learn from; with one language, all others get that one.
    The score is the share of the lettered words' probability that the language
    has.  Repeated rows are each returned and fitted on once; rows with a null id
    are labelled and never fitted on.  Texts of any length are labelled whole.
    ``label``, source and id are never looked at to predict; other columns are
    ignored, whatever their names.
    """
    field = fit(docs, text, id_col, label, sample)

    def predict(texts: pa.Array) -> pa.Array:
        names, scores = labelled(field, texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    out = docs.select(F.col(id_col), held_out(F.col(id_col), 4, 2).alias("held_out"), F.arrow_udf(predict, "struct<lang_pred: string, score: double>")(F.col(text)).alias("p"))
    return out.select(id_col, "held_out", "p.lang_pred", "p.score")
