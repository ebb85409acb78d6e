"""Occurrences of byte strings out of lists of any length.

Every window of each string length gets a hash, all of them in one numpy pass
over the bytes; a bit table of the list's hashes lets few windows through. So
the cost follows the bytes and the number of different lengths, not the number
of strings. Short lists travel with the scan (``PatternIndex``); long ones stay
a table on Spark, of which only the bit table travels (``listed_windows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.functions.bytesops import arrays_type

#: bits of the table that travels with the scan: 16 a string, 32 MB at most
MAX_BITS = 28
SPOTS = arrays_type(pos=T.IntegerType(), size=T.IntegerType())

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(0, np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept by each worker."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            row = np.full(max(n, 1 << 12), base, np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row)
    return [p[:n] for p in _powers]


def window_hashes(a: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the window at each place) of a byte array: differences of one running sum."""
    n = len(a)
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    for length in lengths:
        if 0 < length <= n:
            h = (total[length:] - total[:-length]) * down[: n - length + 1] + np.uint64(length)
            h ^= h >> np.uint64(32)
            yield length, h * np.uint64(0xD6E8FEB86659FD93)


def string_hashes(strings: list[bytes]) -> np.ndarray:
    """The hash that a window with these bytes has."""
    out = np.zeros(len(strings), np.uint64)
    for i, s in enumerate(strings):
        for _, h in window_hashes(np.frombuffer(s, np.uint8), [len(s)]):
            out[i] = h[0]
    return out


class PatternIndex:
    """Patterns by length and hash; ``find`` gives every occurrence, verified byte by byte."""

    def __init__(self, patterns: list[bytes], bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.sieve = np.zeros(1 << bits, bool)
        self.by_length = {}
        hashes = string_hashes(patterns)
        sizes = np.fromiter(map(len, patterns), np.int64, len(patterns))
        self.sieve[(hashes[sizes > 0] >> self.shift).astype(np.int64)] = True
        for length in sorted(set(sizes.tolist()) - {0}):
            ids = np.flatnonzero(sizes == length)
            ids = ids[np.argsort(hashes[ids], kind="stable")]
            rows = np.frombuffer(b"".join(patterns[i] for i in ids.tolist()), np.uint8).reshape(len(ids), length)
            self.by_length[length] = ids, hashes[ids], rows

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Pattern numbers and positions, overlaps included."""
        a = np.frombuffer(data, np.uint8)
        pids, found = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for length, h in window_hashes(a, list(self.by_length)):
            ids, known, rows = self.by_length[length]
            at = np.flatnonzero(self.sieve[(h >> self.shift).astype(np.int64)])
            low, high = np.searchsorted(known, h[at], "left"), np.searchsorted(known, h[at], "right")
            n = high - low
            at, row = np.repeat(at, n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            for i in range(length):
                same = a[at + i] == rows[row, i]
                at, row = at[same], row[same]
            pids.append(ids[row].astype(np.int32))
            found.append(at)
        return np.concatenate(pids), np.concatenate(found).astype(np.int64)


def listed_windows(strings: DataFrame, column: str):
    """Functions from bytes to the windows that may be in ``strings`` (written, distinct or not): (inside, edge).

    ``inside(data)`` gives the places and sizes of windows of a cell,
    ``edge(left, right)`` those that begin in the left part and end in the right
    one; ``windows`` cuts them, to be joined with the list on the bytes
    themselves. Also returns the longest length.
    """
    lengths = sorted(r[0] for r in strings.select(F.octet_length(column)).distinct().collect() if r[0])
    bits = min(MAX_BITS, max(10, (16 * strings.count()).bit_length()))
    shift = np.uint64(64 - bits)

    @F.pandas_udf("long")
    def slot(s: pd.Series) -> pd.Series:
        return pd.Series((string_hashes(s.tolist()) >> shift).astype(np.int64))

    slots = strings.filter(F.octet_length(column) > 0).select(slot(column).alias("slot"))
    marks = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mark"))
    table = np.zeros((1 << bits) >> 6, np.int64)
    for r in marks.toLocalIterator():
        table[r["word"]] = r["mark"]
    table = table.view(np.uint64)

    def find(data: bytes, edge: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        places, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for length, h in window_hashes(np.frombuffer(data, np.uint8), lengths):
            first = 0
            if edge is not None:  # only those over the edge
                first = max(0, edge - length + 1)
                h = h[first:edge]
            s = h >> shift
            at = np.flatnonzero((table[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1)) + first
            places.append(at.astype(np.int32))
            sizes.append(np.full(len(at), length, np.int32))
        return np.concatenate(places), np.concatenate(sizes)

    @F.pandas_udf(SPOTS)
    def inside(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find(d) for d in data], columns=["pos", "size"])

    @F.pandas_udf(SPOTS)
    def over(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find(a + b, len(a)) for a, b in zip(left, right)], columns=["pos", "size"])

    return inside, over, lengths[-1] if lengths else 1


def windows(data: Column, spots: Column) -> Column:
    """Array of (pos, window): the bytes at each of the ``spots`` of a cell, cut where the cell is."""
    return F.transform(F.arrays_zip(spots["pos"], spots["size"]), lambda x: F.struct(x["pos"].alias("pos"), F.substring(data, x["pos"] + 1, x["size"]).alias("window")))
