"""Helpers shared by the operators of this folder: tables, text batches, words as hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefield.session import checkpoint

U64 = np.uint64
#: bytes of text that one numpy pass works on; longer single texts are one pass of their own
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def continued(local: DataFrame, key: str, part: str, number: str) -> DataFrame:
    """Numbers that count the rows of ``key`` in one range partition go on from the partitions before it.

    ``local`` (written) is ordered by ``key`` over partitions numbered ``part``.
    Only the key that a partition shares with those before needs their count,
    one row per partition at most: a list that may be broadcast.
    """
    sizes = local.groupBy(key, part).agg(F.count(F.lit(1)).alias("_n"))
    # the keys of a partition other than its first begin there
    lasts = checkpoint(sizes.groupBy(part).agg(F.max_by(F.struct(key, "_n"), F.struct(F.col(key).isNotNull(), F.col(key))).alias("_last"), F.min_by(F.struct(key), F.struct(F.col(key).isNotNull(), F.col(key))).alias("_first")))
    ends = sorted((r.asDict(True) for r in lasts.collect()), key=lambda r: r[part])
    base, now, count = [], None, 0
    for r in ends:
        first, last = r["_first"][key], r["_last"][key]
        carry = count if now == (first,) else 0
        if carry:
            base.append((r[part], first, carry))
        count = r["_last"]["_n"] + (carry if last == first else 0)
        now = (last,)
    if not base:
        return local
    kind = local.schema[key].dataType.simpleString()
    table = local.sparkSession.createDataFrame(base, f"_p int, _k {kind}, _base long")
    joined = local.join(F.broadcast(table), (F.col(part) == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn(number, F.col(number) + F.coalesce("_base", F.lit(0))).drop("_p", "_k", "_base")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cut an Arrow batch in row ranges of at most ``limit`` text bytes (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads every input bit over all 64."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_POW = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(64)], U64)


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of texts: (hash, first byte, end byte, text number).

    A word is a run of the bytes that ``word`` marks: ASCII letters, digits,
    underscores and non-ASCII bytes; ASCII letters are lower-cased. Words do not reach across texts.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    inside = word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    begins[bounds] = inside[bounds]
    ends[bounds - 1] = inside[bounds - 1]
    first = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, first, "right") - 1
    length = end - first
    # polynomial in the place within the word; the power repeats every 64 bytes, mixed with the block number
    chars = _LOWER[data[inside]].astype(U64) + U64(1)
    at = np.cumsum(length) - length
    place = np.arange(len(chars)) - np.repeat(at, length)
    value = chars * _POW[place & 63]
    if len(length) and length.max() > 64:
        value = np.where(place < 64, value, mix(value + (place >> 6).astype(U64)))
    total = np.add.reduceat(value, at) if len(at) else np.zeros(0, U64)
    return mix(total + length.astype(U64)), first, end, doc


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as lower-cased words with one blank after each: (bytes, word starts, text offsets)."""
    _, first, end, doc = words(data, offsets)
    length = end - first
    out = np.full(int(length.sum()) + len(first), 32, np.uint8)
    starts = np.cumsum(length + 1) - (length + 1)
    out[ragged(starts, length)] = _LOWER[data[ragged(first, length)]]
    sizes = np.bincount(doc, length + 1, len(offsets) - 1).astype(np.int64)
    return out, starts, np.concatenate([[0], np.cumsum(sizes)])


def word_characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``plain_words`` by characters: (code points, word starts, text offsets) of texts taken as they are."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _WORD[np.minimum(points, 255)]
    # the last character of a word brings a blank along, so words of different texts never touch
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends <= len(points))] - 1
    last[edge] = inside[edge]
    size = inside.astype(np.int64) + last
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(total[-1]), 32, np.uint32)
    at = np.flatnonzero(inside)
    out[total[at]] = points[at]
    starts = np.concatenate([[0], total[np.flatnonzero(last) + 1]])
    return out, starts[starts < len(out)], np.concatenate([[0], total[ends]]) if len(texts) else np.zeros(1, np.int64)
