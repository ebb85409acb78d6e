"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's probability in a language is the sum over all ways to cut it into
pieces, taken by the forward algorithm; a text's is the product over its words.
The piece probabilities are learned by expectation maximisation (forward and
backward sums over word types), never by choosing one segmentation.

Words are runs of letters, lower-cased, with the vocabulary's word-start mark
in front, of any length: sums are scaled as they go, and only as many of them
are kept as the longest piece has characters. A single character that is no
piece of its own counts as the piece "unknown".
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefield.llm.common import mix, ragged, slices
from tracefield.llm.learn import fold, sample_by_label
from tracefield.session import checkpoint

#: labelled texts that are learned from, at most (about)
MAX_LABELLED = 8_000
#: characters of words that are summed at once, and places after which sums are scaled
CELLS, EVERY = 1 << 20, 16
START = ord("▁")
BASE = np.uint64(0x9E3779B97F4A7C15)


def load_pieces(model_file: str) -> list[str]:
    """Lower-case pieces of letters, with or without the word-start mark, of a sentencepiece vocabulary."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    kept = dict.fromkeys(p.lower() for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if p == "▁" or p.lstrip("▁").isalpha() and p.count("▁") <= 1)
    return list(kept)


class Vocabulary:
    """Pieces looked up by hash, many at a time; number ``len(pieces)`` stands for unknown characters."""

    def __init__(self, pieces: list[str]):
        h = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            x = 0
            for c in p:
                x = (x * int(BASE) + ord(c) + 1) & (2**64 - 1)
            h[i] = x
        h = mix(h)
        order = np.argsort(h, kind="stable")
        self.hashes, self.numbers = h[order], order
        self.first = np.searchsorted(self.hashes >> np.uint64(46), np.arange((1 << 18) + 1))
        self.most = int(np.diff(self.first).max()) if len(h) else 0
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        h = mix(h)
        slot = (h >> np.uint64(46)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1)
        for _ in range(self.most):
            inside = np.flatnonzero(at < end)
            hit = inside[self.hashes[at[inside]] == h[inside]]
            out[hit] = self.numbers[at[hit]]
            at = at + 1
        return out


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Words:
    """Distinct words as one run of code points, the start mark before each."""

    def __init__(self, points: np.ndarray, lengths: np.ndarray):
        self.points, self.lengths = points, lengths
        self.starts = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, words: list[str]) -> Words:
        marked = [chr(START) + w for w in words]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
        return cls(points, np.fromiter(map(len, marked), np.int64, len(marked)))

    def text(self, i: int) -> str:
        return "".join(map(chr, self.points[self.starts[i] + 1 : self.starts[i] + self.lengths[i]]))

    def block(self, rows: np.ndarray) -> np.ndarray:
        """Matrix of code points of some words, as wide as the longest."""
        size = self.lengths[rows]
        out = np.zeros((len(rows), int(size.max())), np.uint32)
        column = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(np.arange(len(rows)), size), column] = self.points[ragged(self.starts[rows], size)]
        return out


def letter_words(texts: list, letters: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts: (words, their lengths, text of each occurrence, word of each occurrence)."""
    lowered = [(t or "").lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))])
    c = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    none = np.zeros(0, np.int64)
    inside = letters[c]
    if not inside.any():
        return Words(np.zeros(0, np.uint32), none), none, none, none
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(c))]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    first, length = np.flatnonzero(begin), np.flatnonzero(end) - np.flatnonzero(begin) + 1
    doc = np.searchsorted(offsets, first, "right") - 1
    at = ragged(first, length)
    lead = np.cumsum(length) - length
    power = np.ones(int(length.max()), np.uint64)
    power[1:] = BASE
    power = np.cumprod(power)
    h = np.add.reduceat((c[at].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(at)) - np.repeat(lead, length)], lead) + length.astype(np.uint64)
    _, where, back = np.unique(h, return_index=True, return_inverse=True)
    first, length = first[where], length[where] + 1
    points = np.full(int(length.sum()), START, np.uint32)
    points[ragged(np.cumsum(length) - length + 1, length - 1)] = c[ragged(first, length - 1)]
    return Words(points, length), length, doc, back


def groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers by growing length, so many at once that a matrix of them has about CELLS cells."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        size = lengths[order[at : at + (1 << 14)]]
        n = max(1, int(np.searchsorted(np.arange(1, len(size) + 1) * size, CELLS, "right")))
        yield order[at : at + n]
        at += n


def spans(matrix: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary):
    """Yield (start, end, words, pieces) of every piece that lies in some word, by start."""
    for i in range(matrix.shape[1]):
        live = np.flatnonzero(lengths > i)
        h = np.zeros(len(live), np.uint64)
        for j in range(i, min(matrix.shape[1], i + vocabulary.longest)):
            longer = lengths[live] > j
            live, h = live[longer], h[longer]
            if not len(live):
                break
            h = h * BASE + matrix[live, j].astype(np.uint64) + np.uint64(1)
            piece = vocabulary.find(h)
            if j == i:
                piece = np.where(piece < 0, vocabulary.unknown, piece)
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                yield i, j + 1, live[hit], piece[hit]


def forward(words: Words, lengths: np.ndarray, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows) in each language (columns), over all segmentations.

    Sums are kept in a ring for the places that a piece can still reach.
    """
    out = np.zeros((len(lengths), prob.shape[1]))
    slots = vocabulary.longest + 1
    for part in groups(lengths):
        size, ring, scale, at = lengths[part], np.zeros((slots, len(part), prob.shape[1])), np.zeros((len(part), prob.shape[1])), 0
        ring[0] = 1.0

        def move(to: int):
            """All sums up to place ``to`` are complete: note those of the words that end there."""
            nonlocal at
            while at < to:
                ring[at % slots] = 0.0
                at += 1
                if at % EVERY == 0:
                    most = ring.max(0)
                    most[most == 0] = 1.0
                    ring[:] /= most
                    scale[:] += np.log(most)
                low, high = np.searchsorted(size, [at, at + 1])
                if low < high:
                    out[part[low:high]] = np.log(ring[at % slots, low:high] + 1e-300) + scale[low:high]

        for i, j, w, p in spans(words.block(part), size, vocabulary):
            move(i)
            ring[j % slots, w] += ring[i % slots, w] * prob[p]
        move(int(size[-1]))
    return out


def expect(words: Words, lengths: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of the word types (one language).

    The backward pass is the derivative of the scaled forward pass.
    """
    total = np.zeros(len(prob))
    for part in groups(lengths):
        size, rows = lengths[part], np.arange(len(part))
        width = int(size[-1])
        steps = list(spans(words.block(part), size, vocabulary))
        alpha, back, marks, at = np.zeros((width + 1, len(part))), np.zeros((width + 1, len(part))), {}, 0
        alpha[0] = 1.0
        reach = lambda b: slice(b, b + vocabulary.longest + 1)
        for i, j, w, p in steps:
            while at < i:
                at += 1
                if at % EVERY == 0:
                    most = alpha[reach(at)].max(0)
                    most[most == 0] = 1.0
                    alpha[reach(at)] /= most
                    marks[at] = most
            alpha[j, w] += alpha[i, w] * prob[p]
        back[size, rows] = counts[part] / np.maximum(alpha[size, rows], 1e-300)
        for i, j, w, p in reversed(steps):
            while at > i:
                if at in marks:
                    back[reach(at)] /= marks[at]
                at -= 1
            share = prob[p] * back[j, w]
            back[i, w] += share
            total += np.bincount(p, alpha[i, w] * share, len(prob))
    return total


def train(docs: DataFrame, pieces: list[str], bound: int = MAX_LABELLED, rounds: int = 4, smoothing: float = 0.02) -> dict:
    """Model {langs, prior, prob} from texts with a language whose crc32 of the id mod 4 is not 2.

    ``bound`` labelled texts at most (about) are learned from, of every language
    some, so word types are bounded too; the prior is that of all. ``smoothing`` is the count that every piece has in every language.
    """
    known = docs.filter(F.col("lang").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id", "lang", "text")
    sample, prior, _ = sample_by_label(known, "doc_id", "lang", bound)
    sample = checkpoint(sample)
    langs = sorted(prior)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for big in batches:
            for b in slices(big, "text"):
                words, length, doc, word = letter_words(b.column("text").to_pylist(), letters)
                lang = b.column("lang").dictionary_encode()
                code = np.asarray(lang.indices)
                key, n = np.unique(code[doc] * max(1, len(length)) + word, return_counts=True)
                w = key % max(1, len(length))
                text = [words.text(i) for i in w.tolist()]
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key // max(1, len(length)))), pa.array(text, pa.string()), pa.array(n)], ["lang", "word", "n"])

    types = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        vocabulary = Vocabulary(pieces)
        words = Words.of(rows["word"].tolist())
        n = rows["n"].to_numpy(float)
        prob = np.full(len(pieces) + 1, 1.0 / (len(pieces) + 1))
        for _ in range(rounds):
            got = expect(words, words.lengths, n, vocabulary, prob) + smoothing
            prob = got / got.sum()
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "prob": [prob.tolist()]})

    prob = np.zeros((len(pieces) + 1, len(langs)))
    for r in types.groupBy("lang").applyInPandas(fit, "lang string, prob array<double>").toLocalIterator():
        prob[:, langs.index(r["lang"])] = r["prob"]
    for k in range(len(langs)):
        if not prob[:, k].any():  # a language whose texts have no letters
            prob[:, k] = 1.0 / len(prob)
    total = sum(prior.values())
    return {"langs": langs, "prior": np.log([prior[x] / total for x in langs]) if langs else np.zeros(0), "prob": prob, "pieces": pieces}


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's share of the probability).

    Whole texts. ``und`` with score 0 for null texts, texts without letters, or
    a model without languages; null ids count as held out, repeated ids give a
    row each; equally likely languages: the first in order.
    """
    langs = model["langs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, vocabulary = letter_table(), Vocabulary(model["pieces"])
        names = np.array([*langs, "und"], object)
        for big in batches:
            for b in slices(big, "text", 4 << 20):
                n = len(b)
                best, score = np.full(n, len(langs)), np.zeros(n)
                words, length, doc, word = letter_words(b.column("text").to_pylist(), letters)
                if langs and len(doc):
                    each = forward(words, length, vocabulary, model["prob"])[word]
                    z = np.stack([np.bincount(doc, each[:, k], n) for k in range(len(langs))], 1) + model["prior"]
                    share = np.exp(z - z.max(1, keepdims=True))
                    share /= share.sum(1, keepdims=True)
                    some = np.bincount(doc, minlength=n) > 0
                    best[some] = share[some].argmax(1)
                    score[some] = share[some].max(1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
