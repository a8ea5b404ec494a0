"""Language identification: a linear-chain conditional random field over words.

Words are runs of letters. A word's features are its letters' bigrams and trigrams with
word edges, its affixes (first and last two and three letters) and whether it stands in a
language's lexicon (words learned to belong to one language); all but the last are
hashed. Weights per feature and language, and transitions between languages, are learned
on chains that switch languages, and words of new texts are labelled by forward-backward.
A text's language is the one with the largest summed probability over its words (ties: the
first by name), the score that sum's mean.

The fit uses a bounded sample of the labelled rows: about ``SAMPLE_DOCS`` rows a language,
drawn by a hash of the id, none longer than ``SAMPLE_CHARS``. Prediction is map only and
reads whole texts; a chain is ``CHAIN`` consecutive words. Null texts and texts without a
letter are ``und`` with score 0, and so is every text if no language was learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.llm.common import tidy

SAMPLE_DOCS, SAMPLE_CHARS, CHAIN, BUCKETS = 300, 50_000, 64, 1 << 15
UND = "und"
_CHUNK_CHARS = 1 << 17
_TABLES: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and its lower case where that is one code point."""
    if not _TABLES:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for c in (*range(0xD800), *range(0xE000, 0x110000)):
            if (x := chr(c)).isalpha():
                letter[c] = True
                lower[c] = ord(y) if len(y := x.lower()) == 1 else c
        _TABLES.extend([letter, lower])
    return _TABLES[0], _TABLES[1]


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    h = np.zeros(1, np.uint32)
    for x in parts:
        h = (h ^ np.atleast_1d(x).astype(np.uint32)) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
    return h


class Words:
    """Features of all words of some texts: ``grams`` (two per letter), ``starts`` of the words among the letters,
    ``affixes`` (four per word), ``word`` (a hash) and ``first``, where the texts' words start."""

    def __init__(self, texts: list[str]):
        letter, lower = _letters()
        raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
        ends = np.cumsum([len(r) + 3 for r in raw])
        c = np.zeros(int(ends[-1]) + 3 if len(ends) else 3, np.uint32)  # three blanks between texts
        for r, e in zip(raw, ends.tolist(), strict=True):
            c[e - len(r):e] = r
        is_letter = letter[c]
        c = np.where(is_letter, lower[c], 0).astype(np.uint32)
        at = np.flatnonzero(is_letter)
        opens = at[~is_letter[at - 1]] if len(at) else at
        closes = at[~is_letter[at + 1]] if len(at) else at
        self.starts = np.searchsorted(at, opens)
        self.first = np.searchsorted(opens, np.concatenate([[0], ends]))
        bucket = lambda h: (h & np.uint32(BUCKETS - 1)).astype(np.int32)
        self.grams = np.stack([bucket(_hash(1, c[at], c[at + 1])), bucket(_hash(2, c[at - 1], c[at], c[at + 1]))], axis=1)
        second, third = np.minimum(opens + 1, closes), np.minimum(opens + 2, closes)
        last2, last3 = np.maximum(closes - 1, opens), np.maximum(closes - 2, opens)
        self.affixes = np.stack([bucket(_hash(3, c[opens], c[second])), bucket(_hash(4, c[opens], c[second], c[third])),
                                 bucket(_hash(5, c[last2], c[closes])), bucket(_hash(6, c[last3], c[last2], c[closes]))], axis=1)
        place = (at - np.repeat(opens, closes - opens + 1)).astype(np.uint32) if len(at) else at.astype(np.uint32)
        piece = _hash(7, c[at], place).astype(np.uint64) | (_hash(8, place, c[at]).astype(np.uint64) << np.uint64(32))
        self.word = np.add.reduceat(piece, self.starts) if len(self.starts) else np.zeros(0, np.uint64)


class LanguageField:
    """The fitted field: languages, weights (buckets x languages), lexicon and transitions."""

    def __init__(self, languages: list[str], seed: int = 3):
        self.languages, self.seed, n = languages, seed, len(languages)
        self.weights = np.zeros((BUCKETS, n), np.float32)
        self.lexicon, self.owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.listed = np.zeros((n + 1, n), np.float32)  # weights of the lexicon features; the last row: in no lexicon
        self.change = np.zeros((n, n), np.float32)

    def _lists(self, w: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.full(len(w.word), len(self.languages))
        at = np.minimum(np.searchsorted(self.lexicon, w.word), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == w.word, self.owner[at], len(self.languages))

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        per_letter = self.weights[w.grams[:, 0]] + self.weights[w.grams[:, 1]]
        return np.add.reduceat(per_letter, w.starts, axis=0) + self.weights[w.affixes].sum(axis=1) + self.listed[self._lists(w)]

    def marginals(self, emissions: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over padded chains (chains x words x languages): word marginals, summed pair marginals."""
        chains, steps, n = emissions.shape
        on = np.arange(steps)[None, :] < length[:, None]
        local = np.exp(emissions - emissions.max(axis=2, keepdims=True)) + 1e-30
        step, forward, backward = np.exp(self.change - self.change.max()), np.empty_like(local), np.ones_like(local)
        now = np.full((chains, n), 1.0 / n, local.dtype)
        for t in range(steps):
            nxt = (now @ step if t else now) * local[:, t]
            now = forward[:, t] = np.where(on[:, t, None], nxt / nxt.sum(axis=1, keepdims=True), now)
        now = np.ones((chains, n), local.dtype)
        pairs = np.zeros((n, n), np.float64)
        for t in range(steps - 1, 0, -1):
            seen = local[:, t] * now
            both = forward[:, t - 1, :, None] * step * seen[:, None, :]
            pairs += (both / both.sum(axis=(1, 2), keepdims=True) * on[:, t, None, None]).sum(axis=0)
            nxt = seen @ step.T
            now = np.where(on[:, t, None], nxt / nxt.sum(axis=1, keepdims=True), now)
            backward[:, t - 1] = now
        word = forward * backward
        return word / word.sum(axis=2, keepdims=True) * on[:, :, None], pairs

    def fit(self, texts: list[str], labels: list[int], chains: int = 4000, epochs: int = 5, rate: float = 0.3) -> LanguageField:
        """Adagrad on the log-likelihood of ``chains`` chains; half of them switch from one language to another."""
        rng, n = np.random.default_rng(self.seed), len(self.languages)
        if not texts or not n:
            return self
        w = Words(texts)
        label = np.repeat(np.asarray(labels, np.int64), np.diff(w.first))
        every, number = np.unique(w.word, return_inverse=True)
        votes = np.zeros((len(every), n))
        np.add.at(votes, (number, label), 1)
        sure = (votes.max(axis=1) >= 3) & (votes.max(axis=1) >= 0.9 * votes.sum(axis=1))
        self.lexicon, self.owner = every[sure], votes[sure].argmax(axis=1)
        lists = self._lists(w)
        letters_end = np.append(w.starts[1:], len(w.grams))
        longest = [i for i in range(len(texts)) if w.first[i + 1] > w.first[i]]
        by_label = [[i for i in longest if labels[i] == k] for k in range(n)]
        by_label = [x for x in by_label if x]

        def piece(words: int) -> np.ndarray:
            own = by_label[rng.integers(len(by_label))]
            i = own[rng.integers(len(own))]
            at = rng.integers(w.first[i], max(w.first[i] + 1, w.first[i + 1] - words + 1))
            return np.arange(at, min(at + words, w.first[i + 1]))

        made = [np.concatenate([piece(CHAIN // 2), piece(CHAIN // 2)]) if k % 2 else piece(CHAIN) for k in range(chains)] if by_label else []
        sums = [np.full_like(x, 1e-2) for x in (self.weights, self.listed, self.change)]

        def move(x: np.ndarray, total: np.ndarray, gradient: np.ndarray) -> None:
            total += gradient * gradient
            x += rate * gradient / np.sqrt(total)

        for _ in range(epochs):
            for start in range(0, len(made), 100):
                batch = [made[i] for i in range(start, min(start + 100, len(made)))]
                length = np.array([len(b) for b in batch])
                at, row = np.concatenate(batch), np.repeat(np.arange(len(batch)), length)
                col = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
                size = letters_end[at] - w.starts[at]
                of = np.repeat(np.arange(len(at)), size)
                grams = w.grams[np.repeat(w.starts[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                emission = np.zeros((len(at), n), np.float32)
                np.add.at(emission, of, self.weights[grams].sum(axis=1))
                emission += self.weights[w.affixes[at]].sum(axis=1) + self.listed[lists[at]]
                padded = np.zeros((len(batch), CHAIN, n), np.float32)
                padded[row, col] = emission
                word, pairs = self.marginals(padded, length)
                diff = -word[row, col]
                diff[np.arange(len(at)), label[at]] += 1
                gold, joined = np.zeros((n, n)), np.flatnonzero(col > 0)
                np.add.at(gold, (label[at[joined - 1]], label[at[joined]]), 1)
                gradient, listed = np.zeros_like(self.weights), np.zeros_like(self.listed)
                for g in (grams[:, 0], grams[:, 1]):
                    np.add.at(gradient, g, diff[of])
                for k in range(4):
                    np.add.at(gradient, w.affixes[at, k], diff)
                np.add.at(listed, lists[at], diff)
                move(self.weights, sums[0], gradient / len(batch) - 1e-5 * self.weights)
                move(self.listed, sums[1], listed / len(batch))
                move(self.change, sums[2], ((gold - pairs) / len(batch)).astype(np.float32))
        return self

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        names, scores, at = [], [], 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= _CHUNK_CHARS):
                chars += len(texts[to])
                to += 1
            sums, words = self._sums(texts[at:to])
            for s, n in zip(sums, words.tolist(), strict=True):
                names.append(self.languages[int(s.argmax())] if n and self.languages else UND)
                scores.append(float(min(1.0, max(0.0, s.max() / n))) if n and self.languages else 0.0)
            at = to
        return names, scores

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        w, n = Words(texts), len(self.languages)
        words = np.diff(w.first)
        if not n or not len(w.starts):
            return np.zeros((len(texts), max(1, n))), words
        chains = -(-words // CHAIN)
        of_text, text_of_word = np.repeat(np.arange(len(texts)), chains), np.repeat(np.arange(len(texts)), words)
        place = np.arange(len(text_of_word)) - w.first[text_of_word]
        row, col = (np.cumsum(chains) - chains)[text_of_word] + place // CHAIN, place % CHAIN
        padded = np.zeros((len(of_text), CHAIN, n), np.float32)
        padded[row, col] = self.emissions(w)
        word, _ = self.marginals(padded, np.bincount(row, minlength=len(of_text)))
        out = np.zeros((len(texts), n))
        np.add.at(out, of_text, word.sum(axis=1))
        return out, words


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, seed: int = 3) -> LanguageField:
    """Fit on rows of ``docs`` (doc_id, text, lang) with a language; the sample is about ``sample_docs`` rows a language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for lang, n in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < min(1.0, sample_docs / n)))
    rows = labelled.where(chosen & (F.length("text") <= sample_chars)).orderBy("doc_id", "text").limit(2 * sample_docs * max(1, len(counts))).collect()
    return LanguageField(languages, seed).fit([r.text for r in rows], [languages.index(r.lang) for r in rows])


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, field: LanguageField) -> DataFrame:
    """``docs`` with lang_pred and score added; whole texts, map only."""
    field_of = docs.sparkSession.sparkContext.broadcast(field)
    out = docs.drop("lang_pred", "score")
    at = out.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = field_of.value.label([x or "" for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*b.schema.names, "lang_pred", "score"])

    return out.mapInArrow(tidy(run), T.StructType([*out.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
