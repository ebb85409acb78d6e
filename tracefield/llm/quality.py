"""Graded quality by ordinal regression with cumulative links.

One weight vector over hashed text features serves all grades; ordered
thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - score). Expected
grade and the tail probabilities P(grade >= k) come out of one model. Features
are shares: of each hashed word among the words, of each hashed n-gram of
character classes (runs collapsed) among such n-grams, and of words that repeat
the word before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefield.llm.common import mix, slices, utf8, words
from tracefield.llm.learn import Rows, lbfgs, sample_by_label, sigmoid, texts_of_ids
from tracefield.session import checkpoint

PLACES = 1 << 17
#: labelled texts that are learned from, at most (about)
MAX_LABELLED = 6_000
SHAPE_SIZES = (1, 2, 3, 4)
#: a share is this many times as strong as the weight's penalty alone would have it
SCALE = 8.0

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 97, 48, 97


def feature_sums(data: np.ndarray, offsets: np.ndarray):
    """Yield (text, place, share) of each feature group, entries not merged."""
    n = len(offsets) - 1
    h, _, _, doc = words(data, offsets)
    size = np.maximum(np.bincount(doc, minlength=n), 1)
    yield doc, (h >> np.uint64(47)).astype(np.int64), 1.0 / size[doc]
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
    yield doc[again], np.zeros(len(again), np.int64), 1.0 / size[doc[again]]
    kind = _CLASS[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    starts = offsets[:-1][offsets[:-1] < len(kind)]
    new[starts] = True
    at = np.flatnonzero(new)
    where = np.searchsorted(offsets, at, "right") - 1
    run = kind[at].astype(np.uint64) + np.uint64(1)
    total = np.maximum(np.bincount(where, minlength=n), 1)
    g = np.zeros(len(run), np.uint64)
    for k in SHAPE_SIZES:
        if len(run) < k:
            break
        g = g[: len(run) - k + 1] * np.uint64(257) + run[k - 1 :]
        same = where[: len(g)] == where[k - 1 :]
        yield where[: len(g)][same], (mix(g[same] + np.uint64(k << 56)) >> np.uint64(47)).astype(np.int64), 1.0 / total[where[: len(g)][same]]


def cumulative_link(x: Rows, grade: np.ndarray, weight: np.ndarray, top: int, penalty: float) -> Callable:
    """Loss of (weights, first threshold, log gaps of the others): P(grade <= k) = sigmoid(threshold_k - score), rows weighted."""

    def loss(p):
        w, theta = p[:PLACES], thresholds(p[PLACES:])
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        z = x.dot(w)
        hi, lo = sigmoid(edges[grade + 1] - z), sigmoid(edges[grade] - z)
        prob = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        value = -(weight * np.log(prob)).sum() + penalty / 2 * (w @ w)
        dhi, dlo = weight * dhi, weight * dlo
        gz = (dhi - dlo) / prob
        gtheta = np.array([(-dhi[grade == k] / prob[grade == k]).sum() + (dlo[grade == k + 1] / prob[grade == k + 1]).sum() for k in range(top)])
        gaps = np.exp(p[PLACES + 1 :])
        gp = np.array([gtheta.sum(), *(gtheta[k + 1 :].sum() * gaps[k] for k in range(top - 1))]) if top else np.zeros(0)
        return value / x.n, np.concatenate([x.back(gz) + penalty * w, gp]) / x.n

    return loss


def train(docs: DataFrame, grades: DataFrame, bound: int = MAX_LABELLED, penalty: float = 0.02) -> dict:
    """Model of ``grades`` (doc_id, grade int from 0): weights, thresholds. ``bound`` labelled texts at most are learned from."""
    known = grades.filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("grade").cast("int")).alias("grade"))
    picked, _, rates = sample_by_label(known, "doc_id", "grade", bound)
    sample = texts_of_ids(docs, picked).select("grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                doc, place, share = (np.concatenate(x) for x in zip(*feature_sums(*utf8(b.column("text"))), strict=True))
                key, back = np.unique(doc * PLACES + place, return_inverse=True)
                value = np.bincount(back, share, len(key)) * SCALE
                cuts = pa.array(np.searchsorted(key, np.arange(len(b) + 1) * PLACES).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((key % PLACES).astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([b.column("grade"), *lists], ["grade", "place", "value"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        grade = rows["grade"].to_numpy(np.int64)
        top = int(grade.max())
        x = Rows(list(rows["place"]), list(rows["value"]), PLACES)
        # back to the shares of the grades among all labelled texts
        weight = np.array([1 / rates[g] for g in grade.tolist()])
        weight /= weight.mean()
        share = np.array([(weight * (grade <= k)).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
        cut = np.log(share / (1 - share))
        start = np.concatenate([np.zeros(PLACES), cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])

        p = lbfgs(cumulative_link(x, grade, weight, top, penalty), start, rounds=100) if top else start[:PLACES]
        keep = np.flatnonzero(p[:PLACES])
        return pd.DataFrame({"place": [keep.tolist()], "weight": [p[keep].tolist()], "theta": [thresholds(p[PLACES:]).tolist()]})

    rows = checkpoint(sample.mapInArrow(features, "grade int, place array<int>, value array<float>"))
    got = rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "place array<int>, weight array<double>, theta array<double>").first()
    weight = np.zeros(PLACES)
    if got:
        weight[np.asarray(got["place"], np.int64)] = got["weight"]
    return {"weight": weight.astype(np.float32), "theta": np.asarray(got["theta"] if got else [], float)}


def thresholds(p: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the gaps."""
    return np.cumsum(np.concatenate([p[:1], np.exp(p[1:])])) if len(p) else np.zeros(0)


def grade_texts(docs: DataFrame, model: dict, at_least: int = 1, share: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tails (P(grade >= k) for k = 1, 2, ...), selected: P(grade >= at_least) >= share.

    Whole texts; null or empty ones have the grade of the thresholds alone.
    Repeated and null ids give a row each; other columns are ignored. A model
    without grades gives 0, no tails, and selects nothing out.
    """
    theta = model["theta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model["weight"].astype(float)
        for big in batches:
            for b in slices(big, "text"):
                z = np.zeros(len(b))
                for doc, place, value in feature_sums(*utf8(b.column("text"))):
                    z += np.bincount(doc, value * weight[place], len(b)) * SCALE
                tail = sigmoid(z[:, None] - theta[None, :])
                chosen = tail[:, at_least - 1] >= share if len(theta) >= at_least else np.ones(len(b), bool)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(b) + 1) * len(theta)).astype(np.int32)), pa.array(tail.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tail.sum(1)), lists, pa.array(chosen)], ["doc_id", "expected_grade", "tails", "selected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tails array<double>, selected boolean")
