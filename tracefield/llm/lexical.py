"""Ranked lexical search over bit-sliced Bloom signatures.

Each document has a Bloom signature of its terms; a term that occurs often is
also entered at the higher of the counts LEVELS, so the signature bounds how
often a term occurs, never from below. Signatures of the documents of a block
are stored by slices: slice b holds bit b of every document, a bitmap over rows.
The slices of a term at a level, and-ed, are the rows that may hold it so often.

A query adds, row by row, each term's weight at the largest count its slices
allow: an upper bound of the score. The rows with the highest bounds are scored
exactly and give each query a threshold that its last place cannot fall below;
rows whose bound is under it are provably out, all others are scored exactly
from their texts. Integer arithmetic as documented in ``contribution``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefield.llm.common import U64, mix, slices, utf8, words
from tracefield.llm.minhash import few_rows_a_batch
from tracefield.llm.url_filter import bloom
from tracefield.session import checkpoint

#: counts that a signature tells apart
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096, 16384, 65536, 1 << 20, 1 << 25, 1 << 30])
BITS_A_KEY, HASHES = 12, 4
#: a block holds documents of about equal signature width: at most so many, with at most so many keys in all
BLOCK_ROWS, BLOCK_KEYS = 1024, 1 << 18
#: queries that one pass over the signatures answers; more go in blocks
MAX_ITEMS = 256
#: rows with the highest bounds that are scored to set a query's threshold, as a multiple of the places asked for
SEEDS = 2

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FIND = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text: runs of ASCII letters, digits and all non-ASCII characters; A-Z lower-cased."""
    return _FIND.findall((text or "").encode().lower())


def term_hash(terms: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(terms), np.uint8)
    return words(data, np.cumsum([0, *map(len, terms)]), _TERM)[0]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contribution(tf, m):
    """What one unit of weight adds for a term that occurs ``tf`` times: (10**9 tf) div (1000 tf + 12 m), from 0 up to 10**6."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def norm(n, n_docs: int, length: int):
    """m: 75 for an empty text, 100 for one of mean length."""
    return 75 + 25 * n * n_docs // max(1, length)


def width_of(keys: np.ndarray) -> np.ndarray:
    """Bits of a signature for so many keys, in steps of a quarter."""
    need = np.maximum(keys * BITS_A_KEY, 64) / 64
    return (64 * np.ceil(1.25 ** np.ceil(np.log(need) / np.log(1.25) - 1e-9))).astype(np.int64)


def places(hashes: np.ndarray, level: int | np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """The HASHES slices (rows) of terms at a level in signatures of ``width`` bits."""
    key = mix(hashes + np.asarray(level).astype(U64) * U64(0x9E3779B97F4A7C15))
    a, b = key >> U64(32), (key & U64(0xFFFFFFFF)) | U64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=U64) * b[:, None]) % np.asarray(width).astype(U64).reshape(-1, 1)).astype(np.int64)


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, 44-bit hash, count) of distinct terms, and (hash, text) of every term.

    Terms of one text whose 44 bits are equal count as one: bounds only rise.
    """
    h, _, _, doc = words(data, offsets, _TERM)
    key = np.sort((doc.astype(U64) << U64(44)) | (h >> U64(20)))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    key, n = key[first], np.diff(np.r_[first, len(key)])
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1), n, h, doc


class Blocks:
    """Collects documents by signature width and cuts blocks: (width, ids, sizes, slices)."""

    def __init__(self):
        self.held: dict[int, list] = {}
        self.keys: dict[int, int] = {}
        self.rows: dict[int, int] = {}

    def add(self, ids: list, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[tuple]:
        level = np.searchsorted(LEVELS, tf, "right")  # levels 0 .. level - 1 are entered
        keys = np.bincount(doc, level, len(ids)).astype(np.int64)
        width = width_of(keys)
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        for w in np.unique(width[sizes > 0]).tolist():
            for i in np.flatnonzero((width == w) & (sizes > 0)).tolist():
                a, z = cuts[i], cuts[i + 1]
                self.held.setdefault(w, []).append((ids[i], int(sizes[i]), term[a:z], level[a:z]))
                self.keys[w] = self.keys.get(w, 0) + int(keys[i])
                if len(self.held[w]) == BLOCK_ROWS or self.keys[w] >= BLOCK_KEYS:
                    yield self.cut(w)

    def cut(self, width: int) -> tuple:
        rows = self.held.pop(width)
        self.keys.pop(width)
        ids, sizes, terms, levels = zip(*rows, strict=True)
        doc = np.repeat(np.arange(len(rows)), list(map(len, terms)))
        term, level = np.concatenate(terms), np.concatenate(levels)
        bytes_a_slice = (len(rows) + 7) // 8
        bits = np.zeros(width * bytes_a_slice, np.uint8)
        for j in range(int(level.max())):
            up = level > j
            doc, term, level = doc[up], term[up], level[up]
            at = places(term, j, width) * bytes_a_slice + (doc >> 3)[:, None]
            for lane in range(8):  # within a lane equal places carry the same bit
                bits[at[(doc & 7) == lane].ravel()] |= np.uint8(128 >> lane)
        return width, list(ids), list(sizes), bits.tobytes()

    def rest(self) -> Iterator[tuple]:
        for w in list(self.held):
            yield self.cut(w)


BLOCK_SQL = "width int, ids array<long>, sizes array<int>, slices binary, term array<int>, df array<long>"


def build(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """Signature blocks of ``docs`` (doc_id, text): width, ids, sizes (terms with repeats), slices.

    Documents without a term are in none. If a ``vocabulary`` is given, rows
    with ``term`` (its place there) and ``df`` (documents of the task that hold
    it, all counted) come along: one row per task. Written once.
    """
    asked = term_hash(vocabulary or [])
    order = np.argsort(asked)
    ranked, length = asked[order], len(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, df = Blocks(), np.zeros(length, np.int64)
        sieve = np.zeros(1 << 20, bool)
        sieve[(ranked & U64((1 << 20) - 1)).astype(np.int64)] = True

        def out(rows: list) -> pa.RecordBatch:
            w, ids, sizes, bits = zip(*rows, strict=True)
            none = pa.nulls(len(rows), pa.list_(pa.int32())), pa.nulls(len(rows), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(bits, pa.binary()), *none], ["width", "ids", "sizes", "slices", "term", "df"])

        for big in batches:
            for b in slices(big, "text"):
                doc, term, tf, h, where = counted(*utf8(b.column("text")))
                for block in blocks.add(b.column("doc_id").to_pylist(), np.bincount(where, minlength=len(b)), doc, term, tf):
                    yield out([block])
                if length:
                    maybe = np.flatnonzero(sieve[(h & U64((1 << 20) - 1)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(ranked, h[maybe]), length - 1)
                    hit = ranked[at] == h[maybe]
                    df += np.bincount(np.unique(where[maybe][hit] * length + at[hit]) % length, minlength=length)
        for block in blocks.rest():
            yield out([block])
        if df.any():
            there = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary()), pa.array([order[there].tolist()], pa.list_(pa.int32())), pa.array([df[there].tolist()], pa.list_(pa.int64()))], ["width", "ids", "sizes", "slices", "term", "df"])

    return checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK_SQL))


class Queries:
    """A block of queries: term weights of each, and exact scores of texts."""

    def __init__(self, items: list[list[int]], vocabulary: list[bytes], weights: np.ndarray, n_docs: int, length: int):
        self.used = sorted({t for terms in items for t in terms})
        self.terms = [vocabulary[t] for t in self.used]
        self.n_docs, self.length, self.n = n_docs, length, len(items)
        column = {t: i for i, t in enumerate(self.used)}
        entry = Counter((q, column[t]) for q, terms in enumerate(items) for t in terms)
        self.q, self.t = (np.array(x, np.int64) for x in zip(*entry, strict=True))
        self.w = np.array([n * int(weights[self.used[t]]) for (_, t), n in entry.items()], np.int64)

    def matrix(self, kind) -> np.ndarray:
        """Weight of each term (column) in each query (row), repeats included."""
        out = np.zeros((self.n, len(self.terms)), kind)
        out[self.q, self.t] = self.w
        return out

    def bounds(self, hashes: np.ndarray, matrix: np.ndarray, width: int, sizes: np.ndarray, bits: bytes) -> np.ndarray:
        """Upper bound of every query's score (rows) for every document of a block (columns)."""
        n = len(sizes)
        slice_rows = np.frombuffer(bits, np.uint8).reshape(width, -1)
        alive, may, count = np.arange(len(hashes)), None, None
        there = np.zeros((0, n), np.uint8)
        for level in range(len(LEVELS)):
            at = places(hashes[alive], level, width)
            rows = np.bitwise_and.reduce(slice_rows[at], axis=1)
            if may is not None:
                rows &= may
            some = rows.any(1)
            if level == 0:
                alive = alive[some]
                columns, there = alive, np.zeros((len(alive), n), np.uint8)
                index = np.arange(len(alive))
            else:
                alive, index = alive[some], index[some]
            if not len(alive):
                break
            may = rows[some]
            there[index] += np.unpackbits(may, axis=1, count=n)
        if not len(there):
            return np.zeros((self.n, n))
        # the most that a term can add at each level: its count is below the next level and within the text
        most = np.minimum(np.r_[0, LEVELS[1:] - 1, np.iinfo(np.int32).max][:, None], sizes[None, :].astype(np.int64))
        table = contribution(most, norm(sizes.astype(np.int64), self.n_docs, self.length)[None, :]).astype(float)
        count = table[there, np.arange(n)[None, :]]
        return matrix[:, columns] @ count

    def scores(self, text: str | None, column: dict, matrix: np.ndarray) -> np.ndarray:
        """Exact score of a text for every query, from its terms themselves."""
        terms = terms_of(text)
        found = Counter(t for t in terms if t in column)
        if not found:
            return np.zeros(self.n, np.int64)
        at = np.fromiter((column[t] for t in found), np.int64, len(found))
        tf = np.fromiter(found.values(), np.int64, len(found))
        return matrix[:, at] @ contribution(tf, norm(len(terms), self.n_docs, self.length))


def _highest(blocks: DataFrame, q: Queries, k: int) -> DataFrame:
    """(item, doc_id, bound): each task's ``k`` documents with the highest bounds for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, matrix = term_hash(q.terms) >> U64(20), q.matrix(float)
        best, who = np.zeros((q.n, 0)), np.zeros((q.n, 0), np.int64)
        for b in batches:
            for row in b.to_pylist():
                bound = q.bounds(hashes, matrix, row["width"], np.array(row["sizes"]), row["slices"])
                ids = pd.array(row["ids"], "Int64")
                ok = np.flatnonzero(~ids.isna())  # a null id sets no threshold; it is ranked all the same
                best = np.concatenate([best, bound[:, ok]], 1)
                who = np.concatenate([who, np.broadcast_to(ids[ok].to_numpy(np.int64), (q.n, len(ok)))], 1)
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, who = np.take_along_axis(best, top, 1), np.take_along_axis(who, top, 1)
        item, place = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(who[item, place]), pa.array(best[item, place])], ["item", "doc_id", "bound"])

    rows = blocks.select("width", "ids", "sizes", "slices").mapInArrow(run, "item int, doc_id long, bound double")
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id"))
    return rows.withColumn("n", first).filter(F.col("n") <= k).select("doc_id")


def _possible(blocks: DataFrame, q: Queries, least: np.ndarray) -> DataFrame:
    """(doc_id): documents whose bound reaches the threshold of some query, and how many pairs that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, matrix = term_hash(q.terms) >> U64(20), q.matrix(float)
        for b in batches:
            for row in b.to_pylist():
                bound = q.bounds(hashes, matrix, row["width"], np.array(row["sizes"]), row["slices"])
                n = (bound >= least[:, None]).sum(0)
                some = np.flatnonzero(n)
                ids = row["ids"]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some.tolist()], pa.int64()), pa.array(n[some], pa.int64())], ["doc_id", "pairs"])

    return blocks.select("width", "ids", "sizes", "slices").mapInArrow(run, "doc_id long, pairs long")


def _rescored(docs: DataFrame, wanted: DataFrame, q: Queries, least: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score) at or above the thresholds, exact, the first ``k`` of each query with their rank.

    Texts do not move: a Bloom filter of the wanted ids picks them in the
    scan. What it lets pass wrongly is scored too, which changes nothing.
    """
    keys = lambda c: [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]
    wanted = checkpoint(wanted.select("doc_id").distinct())
    passes = bloom(wanted.select(*keys("doc_id")), max(1, wanted.count()), 0.01, 0)

    @F.pandas_udf("boolean")
    def maybe(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(passes.hits(h1.to_numpy(), h2.to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, matrix = {t: i for i, t in enumerate(q.terms)}, q.matrix(np.int64)
        for big in batches:
            for b in slices(big, "text"):
                item, doc, score = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
                for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    s = q.scores(text, column, matrix)
                    at = np.flatnonzero((s >= least) & (s > 0))
                    item.append(at)
                    score.append(s[at])
                    doc += [i] * len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(item), pa.int32()), pa.array(doc, pa.int64()), pa.array(np.concatenate(score))], ["item", "doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(maybe(*keys("doc_id")))
    rows = rows.mapInArrow(run, "item int, doc_id long, score long")
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return checkpoint(rows.withColumn("rank", first).filter(F.col("rank") <= k))


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id, score, bounded (documents whose bound reached the item block's thresholds): the ``k`` best documents of each item.

    ``items`` (item_id, text) are queries, each row one for itself, held on the
    driver; ``docs`` (doc_id, text) may be any number. Equal scores by doc_id,
    a null id last; repeated rows are documents of their own; null and empty
    texts have no terms and are in no result; items without terms have no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    queries = [(r["item_id"], terms_of(r["text"])) for r in items.select("item_id", "text").collect()]
    queries = sorted(((i, t) for i, t in queries if t), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    vocabulary = sorted({t for _, terms in queries for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    built = build(docs, vocabulary)
    blocks = built.filter("width > 0")
    total = blocks.select(F.size("ids").cast("long").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    n_docs, length = int(total[0]), int(total[1])
    df = np.zeros(len(vocabulary), np.int64)
    for r in built.filter("width = 0").select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]
    weights = np.array([weight(n_docs, int(n)) for n in df], np.int64)
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for at in range(0, len(queries), MAX_ITEMS):
        part = queries[at : at + MAX_ITEMS]
        q = Queries([[number[t] for t in terms] for _, terms in part], vocabulary, weights, n_docs, length)
        with few_rows_a_batch(spark, 16):
            seeds = checkpoint(_highest(blocks, q, SEEDS * k))
        least = np.ones(q.n)
        for r in _rescored(docs, seeds, q, least, k).groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).toLocalIterator():
            least[r["item"]] = r["least"]
        with few_rows_a_batch(spark, 16):
            possible = checkpoint(_possible(blocks, q, least))
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(part)], f"_item int, item_id {kind}")
        ranked = _rescored(docs, possible, q, least, k)
        out = out.unionByName(ranked.join(F.broadcast(names), F.col("item") == F.col("_item")).select("item_id", "rank", "doc_id", "score"))
    return out
