"""Helpers of the trained models: sparse rows, L-BFGS, bounded labelled samples and their texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefield.session import checkpoint

#: picked ids that are broadcast to the scan of the texts, at most; more are left to the optimizer
MAX_BROADCAST = 200_000
#: rows of a label that a bounded sample has at least (about), if there are so many
LEAST = 40


class Rows:
    """Sparse rows: feature numbers, values and the row of each entry."""

    def __init__(self, index: list, value: list | None, width: int):
        lengths = np.fromiter(map(len, index), np.int64, len(index))
        self.index = np.concatenate([*index, np.zeros(0, np.int64)]).astype(np.int64)
        self.value = np.ones(len(self.index)) if value is None else np.concatenate([*value, np.zeros(0)]).astype(float)
        self.row = np.repeat(np.arange(len(index)), lengths)
        self.n, self.width = len(index), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.index], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, self.value * r[self.row], self.width)


def lbfgs(loss: Callable, x: np.ndarray, rounds: int = 80, memory: int = 8, tolerance: float = 1e-6) -> np.ndarray:
    """Minimise ``loss`` (value, gradient) by limited-memory BFGS with backtracking."""
    f, g = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = -g, []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            d = d - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        slope, t = g @ d, 1.0 if steps else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        if slope >= 0:
            d, slope, steps = -g, -(g @ g), []
        for _ in range(30):
            new = x + t * d
            nf, ng = loss(new)
            if nf <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = new - x, ng - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = f - nf <= tolerance * max(1.0, abs(f))
        x, f, g = new, nf, ng
        if done:
            break
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` of the rows at most, picked by a hash of ``key``: the same rows in every run.

    Only labelled training rows are sampled so; the bound is a parameter of each model.
    """
    n = rows.count()
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < int((1 << 40) * bound / n))


def sample_by_label(rows: DataFrame, key: str, label: str, bound: int) -> tuple[DataFrame, dict, dict]:
    """(sample, rows of each label, share of them taken): as ``bounded_sample``, but label by label.

    All rows if they are ``bound`` at most. Else the bound is shared out evenly;
    labels with fewer rows are taken whole and leave their rest to the others.
    No label's share is under LEAST rows, so the bound grows with over bound / LEAST labels.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    rates, left, rest = {}, bound, len(counts)
    for value, n in sorted(counts.items(), key=lambda x: x[1]):
        part = max(LEAST, left / rest)
        rates[value] = min(1.0, part / n)
        left, rest = max(0, left - min(n, part)), rest - 1
    if sum(counts.values()) <= bound:
        rates = dict.fromkeys(counts, 1.0)
    cut = [x for v, r in rates.items() if r < 1 for x in (F.lit(v), F.lit(int((1 << 40) * r)))]
    if cut:
        limit = F.coalesce(F.try_element_at(F.create_map(*cut), F.col(label)), F.lit(1 << 40))
        rows = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40)) < limit)
    return rows, counts, rates


def texts_of_ids(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """``picked`` (a bounded sample: doc_id and labels) with the texts of its ids, found in the scan of ``docs``.

    The picked rows are written and counted; only such a counted list is
    broadcast, so texts that were not picked never move. Rows equal in id and
    text are learned from once.
    """
    picked = checkpoint(picked)
    few = picked.count() <= MAX_BROADCAST
    return docs.select("doc_id", "text").join(F.broadcast(picked) if few else picked, "doc_id").dropDuplicates(["doc_id", "text"])


def fold(id_col: str, parts: int):
    """Remainder of crc32 of the id as text; null for a null id, which is never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts))
