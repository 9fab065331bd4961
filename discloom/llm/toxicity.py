"""Toxicity by noisy-channel deobfuscation and scoring of the restored text.

The writer's words are taken to have passed a channel that replaces letters by
look-alikes, repeats them, and puts marks or spaces between them.  Words that
show such traces, and short fragments next to each other taken as one, become
lattices of the letters that each character may stand for; exact Viterbi
decoding under a character trigram model, counted over all documents, restores
them.  Words and word beginnings of the restored text are then scored by how
much more often they occur in toxic training texts, and a logistic function of
the strongest ones gives the score of the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discloom.llm.langid import folded
from discloom.llm.support import cut, held_out
from discloom.llm.wordcode import U64, Coder, flat, mix64, pieces, split_words

CODER = Coder(53)
#: Labelled texts fitted on, about.
SAMPLE = 20_000
#: Bytes of word beginnings that are features, besides the whole word.
PREFIXES = (4, 5, 6, 7)
#: Weight of the prior in a feature's toxicity.
PRIOR_TEXTS = 8.0
#: Characters decoded before where states came from is forgotten; characters of a part of a word that is remembered, and how many of them are.
BLOCK, SHORT, PARTS = 1024, 24, 200_000
#: Bytes of a fragment that may be part of a word, and of a word made of such; runs of single characters may be of any length.
FRAGMENT, SPAN = 3, 12

# Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "[": "c", "&": "a", "#": "h",
}
WILD = "*#%?"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SUBSTITUTED, REPEATED, MARK_DROPPED, LOOKALIKE_DROPPED, WILD_READ = 1.0, 2.5, 0.5, 6.0, 3.0

LETTER = re.compile(r"[^\W\d_]")
#: A character that may be read in several ways, or be dropped; and two letters that can only be themselves.
AMBIGUOUS = re.compile(r"[\W\d_]|(?<=(.))\1", re.S)
SETTLED = re.compile(r"(?<=(.))(?!\1)([^\W\d_])(?!\2)[^\W\d_]", re.S)

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(97, 123), *range(128, 256)]] = True
#: Characters that may be letters, and those that may be any letter; words of only these tell nothing.
STANDS, IS_ONLY, ONLY = np.zeros(256, bool), np.zeros(256, bool), b"*#%?"
STANDS[[ord(c) for c in (*LOOKALIKES, *WILD)]] = True
IS_ONLY[list(ONLY)] = True
#: Symbols of the character model: 0 is a word's edge.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:256] = 27 + (np.arange(128, 256) & 31)
SYMBOLS = 64


def character_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Trigram counts of folded characters over all texts, added up in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            for _, _, data, _ in pieces(b.column(0)):
                s = SYMBOL[folded(data)]
                if len(s) > 2:
                    # Trigrams that end in a letter, or end a word.
                    key = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    total += np.bincount(key[(s[2:] > 0) | (s[1:-1] > 0)], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(SYMBOLS**3)
    for r in counted.collect():  # at most SYMBOLS ** 3 rows
        out[r["at"]] = r["n"]
    return out


class Decoder:
    """Restores words under a character trigram model."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two = three.sum(0)
        one = two.sum(0)
        p1 = (one + 0.5) / (one.sum() + 0.5 * SYMBOLS)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).astype(np.float32)
        self.parts: dict[tuple[str, str, bool], str] = {}

    def __reduce__(self):
        return _decoder, (self.cost,)

    def read(self, word: str) -> str:
        """The likeliest reading of a lower-case word; empty if it can be none.

        Two letters in a row that can only be themselves leave one state of the
        model, so the lattice falls apart there, and each part is decoded once.
        """
        out, at = [], 0
        while (m := AMBIGUOUS.search(word, at)) is not None:
            first = m.start()
            settled = SETTLED.search(word, m.end())
            last = len(word) if settled is None else settled.end()
            out += word[at:first], self._part(word[max(0, first - 2) : first], word[first:last], settled is None)
            at = last
        return "".join(out) + word[at:]

    def _part(self, before: str, text: str, ends: bool) -> str:
        """Letters kept of ``text``, which follows ``before`` and may end the word; a part of ``SHORT`` characters is remembered."""
        key = before, text, ends
        found = self.parts.get(key)
        if found is None:
            found = self._viterbi(before, text, ends)
            if len(text) <= SHORT:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[key] = found
        return found

    def _viterbi(self, before: str, text: str, ends: bool) -> str:
        """Exact decoding over states of the last two symbols.

        Where each state came from is kept for one block of characters at a
        time and worked out again from the costs at the block's start, so the
        memory of a very long text is that of its block starts.
        """
        whole = before + text
        at = len(before)
        moves = {m: self._moves(*m) for m in {_move(whole, i) for i in range(at, len(whole))}}
        own = [int(SYMBOL[x.encode()[-1]]) for x in before]
        symbols = sorted({0, *own, *(n for letters, _ in moves.values() for _, n, _ in letters)})
        place = {n: i for i, n in enumerate(symbols)}
        cost = self.cost[np.ix_(symbols, symbols, symbols)]
        steps, letter_of = {}, {}
        for m, (letters, dropped) in moves.items():
            prices = np.full(len(symbols), np.inf, np.float32)
            prices[[place[n] for _, n, _ in letters]] = [price for *_, price in letters]
            steps[m] = cost + prices if letters else None, np.float32(dropped)
            letter_of[m] = {place[n]: x for x, n, _ in letters}
        table = np.full((len(symbols),) * 2, np.inf, np.float32)
        table[tuple(place[n] for n in [0, 0, *own][-2:])] = 0
        starts = [table]
        for low in range(at, len(whole) - BLOCK, BLOCK):
            for i in range(low, low + BLOCK):
                table = _step(table, *steps[_move(whole, i)])
            table = table - table.min()  # so that costs stay small and exact
            starts.append(table)
        out, a, b = [], -1, -1
        for low in reversed(range(at, len(whole), BLOCK)):
            table, origins = starts.pop(), []
            for i in range(low, min(low + BLOCK, len(whole))):
                table = _step(table, *steps[_move(whole, i)], origins)
            if b < 0:
                if ends:
                    table = table + cost[:, :, 0]
                    if not before:
                        table[0, 0] = np.inf  # nothing is no reading
                a, b = divmod(int(table.argmin()), len(symbols))
                if table[a, b] == np.inf:
                    return ""
            for i in reversed(range(len(origins))):
                origin = int(origins[i][a, b])
                if origin >= 0:
                    out.append(letter_of[_move(whole, low + i)][b])
                    a, b = origin, a
        return "".join(reversed(out))

    @staticmethod
    def _moves(c: str, run: int) -> tuple[list[tuple[str, int, float]], float]:
        """Letters, symbols and prices of what a character may stand for, and the price of dropping it."""
        options: dict[str, float] = {}
        if LETTER.match(c):
            if run < 3:
                options[c] = 0.0
            dropped = (math.inf, REPEATED, 0.0)[run - 1]
        else:
            stands = LOOKALIKES.get(c, "")
            options |= dict.fromkeys(stands, SUBSTITUTED)
            dropped = LOOKALIKE_DROPPED if stands else MARK_DROPPED
            if c in WILD:
                options |= {x: WILD_READ for x in LETTERS if x not in stands}
        return [(x, int(SYMBOL[x.encode()[-1]]), price) for x, price in options.items()], dropped


def _move(text: str, i: int) -> tuple[str, int]:
    """A character and its number in a run of equal ones; 3 stands for all later ones."""
    c, run = text[i], 1
    while run < 3 and i >= run and text[i - run] == c:
        run += 1
    return c, run


def _step(table: np.ndarray, price: np.ndarray | None, dropped: np.float32, origins: list[np.ndarray] | None = None) -> np.ndarray:
    """Costs after one character; ``origins`` gets the symbol that left each state, -1 where the character was dropped."""
    after, origin = table + dropped, None
    if price is not None:
        ways = table[:, :, None] + price
        best = ways.min(0)
        if origins is not None:
            origin = np.where(best < after, ways.argmin(0), -1).astype(np.int8)
        np.minimum(after, best, out=after)
    if origins is not None:
        origins.append(np.full(table.shape, -1, np.int8) if origin is None else origin)
    return after


@lru_cache(maxsize=4)
def _built(key: bytes) -> Decoder:
    d = Decoder.__new__(Decoder)
    d.cost, d.parts = np.frombuffer(key, np.float32).reshape(SYMBOLS, SYMBOLS, SYMBOLS), {}
    return d


def _decoder(cost: np.ndarray) -> Decoder:
    return _built(cost.tobytes())


def feature_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Codes of the word and of its beginnings; 0 where it is no longer than these."""
    out = np.zeros((len(start), 1 + len(PREFIXES)), U64)
    out[:, 0] = CODER.words(data, start, end)
    for i, k in enumerate(PREFIXES, 1):
        longer = np.flatnonzero(end - start > k)
        out[longer, i] = mix64(CODER.words(data, start[longer], start[longer] + k) ^ U64(k))
    return out


def text_codes(data: np.ndarray, bounds: np.ndarray, decoder: Decoder, joined: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Documents and feature codes of all words of some texts, restored ones included.

    Of what is ``joined`` from fragments only whole words have codes.  There are
    many such, by chance, so they are found but not learned.
    """
    data = folded(data)
    w = split_words(data, bounds)
    letter, signed = IS_LETTER[data], STANDS[data]
    letters, signs, only = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, signed, IS_ONLY[data]))
    place = np.flatnonzero(letter)
    count = letters[w.end] - letters[w.start]
    own = np.flatnonzero(count > 0)
    first, last = place[letters[w.start[own]]], place[letters[w.end[own]] - 1] + 1
    docs, codes = [w.doc[own]], [feature_codes(data, first, last)]

    # Traces of the channel: look-alikes at any place, marks between letters, equal letters one after another.
    told = count + signs[w.end] - signs[w.start]
    known = told - (only[w.end] - only[w.start])
    noisy = (told > count) & (known > 0)
    noisy[own] |= last - first != count[own]
    twice = np.zeros(len(data) + 1, np.int64)
    twice[2:] = np.cumsum((data[1:] == data[:-1]) & letter[1:])[: max(0, len(data) - 1)] if len(data) > 1 else 0
    noisy[own] |= twice[last] > twice[first + 1]
    view = bytes(np.ascontiguousarray(data))
    restored = [(w.doc[noisy], [view[a:b] for a, b in zip(w.start[noisy].tolist(), w.end[noisy].tolist(), strict=True)], "written")]

    # Adjoining fragments may be one word; those that may be anything are part of none, but single characters are.
    size = w.end - w.start
    short = (size <= FRAGMENT) & ((known > 0) | (size == 1))
    joins = np.zeros(len(size), bool)  # with the fragment before it
    joins[1:] = short[1:] & short[:-1] & (w.doc[1:] == w.doc[:-1])
    reach, total, meant, some = np.flatnonzero(short), size[short], told[short], known[short]
    of, words = [w.doc[:0]], []
    for n in range(1, SPAN if joined else 1):
        more = reach + n < len(size)
        more[more] = joins[reach[more] + n]
        reach, total, meant, some = reach[more], total[more], meant[more], some[more]
        to = reach + n
        total, meant, some = total + size[to], meant + told[to], some + known[to]
        more = total <= SPAN
        reach, total, meant, some, to = reach[more], total[more], meant[more], some[more], to[more]
        if not len(reach):
            break
        own = (meant >= 3) & (some > 0)
        of.append(w.doc[reach[own]])
        words += [b"".join(view[a:b].split()) for a, b in zip(w.start[reach[own]].tolist(), w.end[to[own]].tolist(), strict=True)]

    restored.append((np.concatenate(of), words, "joined"))
    # Single characters one after another spell words of any length.
    single = size == 1
    if single.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        runs, of = [], []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            for d in range(int(w.doc[a]), int(w.doc[b - 1]) + 1):
                lo, hi = max(a, int(w.first[d])), min(b, int(w.first[d + 1]))
                spelt = data[w.start[lo:hi]]
                if np.count_nonzero(IS_LETTER[spelt] | STANDS[spelt]) >= 3 and not IS_ONLY[spelt].all():
                    runs.append(bytes(spelt))
                    of.append(d)
        restored.append((np.array(of, np.int64), runs, "spelt"))
    for of, words, kind in restored:
        if words:
            of_word, found = _restored(words, kind == "spelt", decoder)
            if kind == "joined":
                found[:, 1:] = 0
            docs.append(of[of_word])
            codes.append(found)
    return np.concatenate(docs), np.concatenate(codes)


def _restored(words: list[bytes], spelt: bool, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Number of the word and feature codes of each word's likeliest reading.

    Where words begin in a spelt reading is not known: they are taken to begin
    at each of its letters but the last two.
    """
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(x, len(number)) for x in words])
    data, spans = flat(pa.array([decoder.read(x.decode(errors="replace")).lower() for x in number], pa.large_string()))
    if not spelt:
        full = np.flatnonzero(np.diff(spans))
        codes = np.zeros((len(number), 1 + len(PREFIXES)), U64)
        codes[full] = feature_codes(data, spans[full], spans[full + 1])
        some = np.flatnonzero(np.isin(of, full))
        return some, codes[of[some]]
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    nth, letter_no = np.searchsorted(spans, begins, "right") - 1, np.searchsorted(begins, spans)
    own = np.arange(len(begins)) < np.maximum(letter_no[nth + 1] - 2, letter_no[nth] + 1)
    begins, nth = begins[own], nth[own]
    codes, edges = feature_codes(data, begins, spans[1:][nth]), np.searchsorted(nth, np.arange(len(number) + 1))
    many = np.diff(edges)[of]
    at = np.repeat(edges[of] - np.cumsum(many) + many, many) + np.arange(many.sum())
    return np.repeat(np.arange(len(of)), many), codes[at]


@dataclass
class Model:
    """Evidence of features, and the logistic function of a text's strongest words."""

    decoder: Decoder
    codes: np.ndarray  # sorted
    evidence: np.ndarray
    weights: np.ndarray

    def statistics(self, texts: pa.Array) -> np.ndarray:
        """Strongest word, sum of strong words, and length of each text, after a constant."""
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        known = np.zeros(1 << 20, bool)
        known[(self.codes >> U64(44)).astype(np.int64)] = True
        for low, high, data, bounds in pieces(texts):
            doc, codes = text_codes(data, bounds, self.decoder)
            words = np.bincount(doc, minlength=high - low)
            row, kind = np.nonzero(known[(codes >> U64(44)).astype(np.int64)])
            if len(row) and len(self.codes):
                code = codes[row, kind]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[at] == code
                word = np.zeros(len(doc))
                np.maximum.at(word, row[hit], self.evidence[at[hit]])
                top = np.zeros(high - low)
                np.maximum.at(top, doc, word)
                out[low:high, 1] = top
                out[low:high, 2] = np.log1p(np.bincount(doc, np.maximum(word - 2, 0), high - low))
            out[low:high, 3] = np.log1p(words) / 4
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.statistics(texts) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a logistic regression held near ``start``."""
    w = start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - start)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def _feature_texts(decoder: Decoder):
    """Texts of each label and half that have a feature, for the task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = b.column(1).to_numpy()  # label, and 2 more for the second half
            for low, high, data, bounds in pieces(b.column(0)):
                doc, codes = text_codes(data, bounds, decoder, joined=False)
                doc, codes = np.repeat(doc, codes.shape[1]), codes.ravel()
                order = np.lexsort((codes, doc))
                doc, codes = doc[order], codes[order]
                new = codes != 0
                new[1:] &= (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])
                code, at = np.unique(codes[new], return_inverse=True)
                counts = np.bincount(at * 4 + group[low:high][doc[new]], minlength=4 * len(code)).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts.T)], ["code", *"abcd"])

    return run


def _evidence(counts: pd.DataFrame, toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and evidence of features more usual in toxic texts: a gain in log odds."""
    base = texts[1] / sum(texts)
    part = (toxic + PRIOR_TEXTS * base) / (toxic + clean + PRIOR_TEXTS)
    gain = np.log(part / (1 - part)) - math.log(base / (1 - base))
    code = counts["code"].to_numpy(np.int64).view(U64)
    own = np.flatnonzero((gain > 0.7) & (toxic >= 2))
    own = own[np.argsort(code[own])]
    return code[own], gain[own]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out.

    The logistic function comes from one half of it, scored with the evidence of
    the other; the model has the evidence of both.  Character counts are of all
    rows.
    """
    decoder = Decoder(character_counts(docs, text))
    training = F.col("id").isNotNull() & ~held_out(F.col("id"), 4, 2)
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("long").alias("y")).filter(training & F.col("y").isin(0, 1))
    n = known.count()
    # The labelled ids are drawn before they meet the texts.
    drawn = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(training & drawn & F.col("text").isNotNull())
    half = F.when(F.pmod(F.xxhash64("id", F.lit(10)), F.lit(2)) == 0, 0).otherwise(2)
    found = texts.join(known.filter(drawn), "id").withColumn("print", F.xxhash64("id", "text")).dropDuplicates(["id", "print", "y"])
    rows = cut(found.select("text", "print", (F.col("y") + half).alias("y")))
    total = rows.count()
    if total > 2 * sample:  # many texts of one id
        rows = cut(rows.filter(F.pmod(F.xxhash64("print", F.lit(11)), F.lit(1 << 30)) < sample / total * (1 << 30)))
    start = np.array([-2.0, 0.6, 0.5, 0.0])
    n = np.zeros(4, int)
    for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect():
        n[r["y"]] = r["n"]
    if not (n[1] + n[3]) or not (n[0] + n[2]):
        return Model(decoder, np.empty(0, U64), np.empty(0), start)
    found = rows.select("text", "y").mapInArrow(_feature_texts(decoder), "code long, a long, b long, c long, d long")
    found = found.groupBy("code").agg(*(F.sum(x).alias(x) for x in "abcd"))
    # Features that hold two toxic texts and are not as usual in others, of a bounded sample.
    base = (n[1] + n[3]) / n.sum()
    found = found.filter((F.col("b") + F.col("d") >= 2) & (F.col("b") + F.col("d") >= 1.5 * base * (F.col("a") + F.col("b") + F.col("c") + F.col("d")))).toPandas()
    a, b, c, d = (found[x].to_numpy(float) for x in "abcd")
    model = Model(decoder, *_evidence(found, b, a, (n[0], n[1])), start) if n[0] and n[1] else Model(decoder, np.empty(0, U64), np.empty(0), start)

    def statistics(texts: pa.Array) -> pa.Array:
        x = model.statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    # The second half is scored with evidence that it had no part in, then adds its own.
    other = rows.filter("y >= 2").select("y", F.arrow_udf(statistics, "array<double>")("text").alias("x")).toPandas()
    if n[1] and n[2] and n[3]:
        model.weights = logistic(np.stack(other["x"].to_list()), other["y"].to_numpy(float) - 2, start)
    model.codes, model.evidence = _evidence(found, b + d, a + c, (n[0] + n[2], n[1] + n[3]))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``.

    Rows whose crc32 of the id is 2 modulo 4 are held out of the fit.  Null and
    empty texts are scored as texts without words.  Repeated rows are each
    scored, but count once in the fit, as do repeated labels; a row with a null
    id is scored and never fitted on.  Time and memory are linear in the length
    of a text, also of one long word.  Without training rows of both labels no
    word is evidence and all texts get a low score.  Other columns of ``docs``
    and ``labels`` are ignored, whatever their names.
    """
    model = fit(docs, labels, text, id_col, "toxic", sample)

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(texts))

    out = docs.select(F.col(id_col), held_out(F.col(id_col), 4, 2).alias("held_out"), F.arrow_udf(score, "double")(F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
