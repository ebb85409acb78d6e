"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit distance.

The CGK embedding walks over a string with shared random bits: at step j it
reads the character under the walk and moves on by the random bit of (j,
character). Strings at edit distance k then differ in few steps (Hamming), since
two walks meet again soon after an edit. Bit sampling hashes the characters
read at some fixed steps; equal hashes make a candidate. Every benchmark item
is indexed from each of its word starts on, every document is asked at each of its
word starts, for several walks and samples, so a leaked item has (words of
the item) x (tables) chances. A candidate fixes where the whole item would lie;
that item-sized window, wider by the allowed edits, is verified exactly.
Items take the long walks if enough of them end inside the item for the wanted
recall, else short ones. Items with too few word starts for these too are cut in
one piece more than edits are allowed: one piece is left as it is, so asking for
all pieces at every place finds them all.

Texts are compared as case-folded words with single blanks between them,
character by character in any script; only walks, pieces and run counts, which
make candidates, see characters beyond ASCII by one of 128 classes.
Documents are scanned once, without a shuffle; the index holds the items only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefield.llm.common import mix, plain_words, ragged, slices, utf8, word_characters

#: edits allowed, as a share of the item's characters
EDITS = 0.12
STEPS, WALKS, TABLES, SAMPLED = 64, 2, 3, 14
#: the same for items in which too few long walks end
SHORT_STEPS, SHORT_SAMPLED = 32, 10
#: share of the items with all allowed edits, evenly spread, that must become candidates
RECALL = 0.995
#: a word start counts as hit with probability (1 - edits) ** REACH at least (tests measure the recall); so many next starts share edits
REACH, OVERLAP = 4, {"long": 4, "short": 1}
#: places asked for pieces at once, and word starts that walk at once (their arrays stay in the processor's cache)
ASKED, WALKING = 1 << 16, 1 << 16
#: items that one scan of the documents looks for; more take more scans
ITEMS_PER_SCAN = 20_000
FILTER_BITS = 22
#: length of the character runs counted before a candidate is verified, and places they are hashed to
GRAM, GRAM_PLACES = 5, 1 << 12


def walk_bits() -> np.ndarray:
    """The shared random bits: (walk, step, character)."""
    return np.random.default_rng(20_240_601).integers(0, 2, (WALKS, STEPS, 256), np.uint8)


def sampled_steps() -> list[tuple[int, np.ndarray]]:
    """(walk, steps) of every table; the last ones are for short items."""
    rng = np.random.default_rng(20_240_602)
    long = [(w, np.sort(rng.choice(STEPS, SAMPLED, replace=False))) for w in range(WALKS) for _ in range(TABLES)]
    return long + [(w, np.sort(rng.choice(SHORT_STEPS, SHORT_SAMPLED, replace=False))) for w in range(WALKS) for _ in range(TABLES)]


def starts_needed(kind: str, edits: float) -> int:
    """Word starts with walks inside the item from which on its recall is RECALL."""
    miss = 1 - (1 - edits) ** REACH
    return OVERLAP[kind] * max(1, int(np.ceil(np.log(1 - RECALL) / np.log(max(miss, 1e-9)))))


def run_hash(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` characters at each place."""
    h = np.full(max(0, len(data) - n + 1), n, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x100000001B3) + data[i : len(data) - n + 1 + i]
    return mix(h)


def embed(data: np.ndarray, starts: np.ndarray, tables: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (table number, hash, last place read) for windows at ``starts`` of letters; STEPS + 1 more follow the last one."""
    bits = walk_bits()
    for walk in sorted({w for w, _ in tables}):
        own = [(t, set(steps.tolist())) for t, (w, steps) in enumerate(tables) if w == walk]
        h = {t: np.full(len(starts), t + 1, np.uint64) for t, _ in own}
        at = starts.astype(np.int64)
        last = max(max(s) for _, s in own)
        ends: dict[int, np.ndarray] = {}
        for j in range(last + 1):
            read = data.take(at)
            for t, steps in own:
                if j in steps:
                    h[t] *= np.uint64(0x100000001B3)
                    h[t] += read
                    if j == max(steps):
                        ends[t] = at.copy()
            at += bits[walk, j].take(read)
        for t, _ in own:
            yield t, mix(h[t]), ends[t]


class Index:
    """Items and their windows, by table and hash."""

    def __init__(self, items: list[tuple[int, np.ndarray | bytes]], edits: float = EDITS):
        """``items``: (id, code points of the normalised text, or its bytes if it is ASCII)."""
        items = [(name, np.frombuffer(t, np.uint8) if isinstance(t, bytes) else t) for name, t in items]
        self.items = [(name, points.tolist()) for name, points in items]
        self.raw = [points.astype("<u4").tobytes() for _, points in items]
        self.tables = sampled_steps()
        self.n_long = WALKS * TABLES
        size = np.fromiter((len(t) for _, t in items), np.int64, len(items))
        begin = np.cumsum(size) - size
        data = letters(np.concatenate([np.zeros(0, np.uint32), *(t for _, t in items)]))
        starts = np.array([b + o for b, (_, t) in zip(begin.tolist(), items, strict=True) for o in word_starts(t)], np.int64)
        owner = np.searchsorted(begin, starts, "right") - 1 if len(items) else starts
        reach = (begin + size)[owner] if len(items) else starts
        keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        walks = [(t, h, last < reach) for t, h, last in embed(np.concatenate([data, np.zeros(STEPS + 1, np.uint8)]), starts, self.tables)]
        # walks of an item that end inside it, a table of each kind
        ended = {"long": np.zeros(len(items)), "short": np.zeros(len(items))}
        for t, _, fits in walks:
            ended["short" if t >= self.n_long else "long"] += np.bincount(owner[fits], minlength=len(items)) / self.n_long
        long = ended["long"] >= starts_needed("long", edits)
        short = ~long & (ended["short"] >= starts_needed("short", edits))
        for t, h, fits in walks:
            fits = fits & (short if t >= self.n_long else long)[owner]
            keys.append(h[fits])
            at.append(np.flatnonzero(fits))
        self.keys, which = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner, self.offset = owner[which[order]], (starts - begin[owner])[which[order]] if len(items) else starts
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.used = self.tables if short.any() else self.tables[: self.n_long]
        rest = np.flatnonzero(~long & ~short)
        most = (edits * size[rest]).astype(np.int64)
        #: too short for an edit: looked for as they are
        self.tiny = rest[most == 0].tolist()
        #: length of pieces -> (sorted hashes, item, place in the item)
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        cut: dict[int, list[tuple[int, int]]] = {}
        for i, k in zip(rest[most > 0].tolist(), most[most > 0].tolist(), strict=True):
            n = int(size[i]) // (k + 1)
            cut.setdefault(n, []).extend((i, j * n) for j in range(k + 1))
        for n, found in cut.items():
            of, place = np.array(found, np.int64).T
            hashes = run_hash(data, n)[begin[of] + place]
            order = np.argsort(hashes, kind="stable")
            self.pieces[n] = hashes[order], of[order], place[order]

        self.grams = np.zeros((len(items), GRAM_PLACES), bool)
        run = gram_places(data)
        for i, (b, n) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
            self.grams[i, run[b : b + max(0, n - GRAM + 1)]] = True
        self.sizes = size

    def possible(self, data: np.ndarray, item: np.ndarray, begin: np.ndarray, edits: float) -> np.ndarray:
        """Which candidates can be leaks: k edits leave at least n - GRAM + 1 - k * GRAM runs of the item in the window."""
        run = gram_places(data)
        ok = np.zeros(len(item), bool)
        for part in np.array_split(np.arange(len(item)), max(1, len(item) >> 12)):
            n = self.sizes[item[part]]
            most = (edits * n).astype(np.int64)
            low, high = np.clip(begin[part] - 2 * most, 0, len(run)), np.clip(begin[part] + n + 2 * most - GRAM + 1, 0, len(run))
            width = np.maximum(high - low, 0)
            owner = np.repeat(np.arange(len(part)), width)
            there = self.grams[item[part][owner], run[ragged(low, width)]]
            ok[part] = np.bincount(owner, there, len(part)) >= n - GRAM + 1 - most * GRAM
        return ok

    def candidates(self, data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item number, place in ``data`` where the item would begin), distinct in each part."""
        out = [np.zeros((0, 2), np.int64)]
        padded = np.concatenate([data, np.zeros(STEPS + 1, np.uint8)])
        for part in np.array_split(starts, max(1, -(-len(starts) // WALKING))):
            for _, h, _ in embed(padded, part, self.used):
                hit = np.flatnonzero(self.seen.take((h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)))
                low, high = np.searchsorted(self.keys, h[hit], "left"), np.searchsorted(self.keys, h[hit], "right")
                n = high - low
                entry = ragged(low, n)
                out.append(np.stack([self.owner[entry], np.repeat(part[hit], n) - self.offset[entry]], 1))
        found = np.unique(np.concatenate(out), axis=0)
        yield found[:, 0], found[:, 1]
        for size, (keys, of, place) in self.pieces.items():
            asked = run_hash(data, size)
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            for first in range(0, len(asked), ASKED):
                h = asked[first : first + ASKED]
                hit = np.flatnonzero(seen.take((h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)))
                low, high = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
                entry = ragged(low, high - low)
                if len(entry):
                    found = np.unique(np.stack([of[entry], np.repeat(first + hit, high - low) - place[entry]], 1), axis=0)
                    yield found[:, 0], found[:, 1]


def gram_places(data: np.ndarray) -> np.ndarray:
    h = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for i in range(GRAM):
        h = h * np.uint32(0x01000193) + data[i : len(data) - GRAM + 1 + i]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(20)


def letters(points: np.ndarray) -> np.ndarray:
    """Code points as bytes: ASCII as it is, others as one of 128 classes."""
    return np.where(points < 128, points, 128 + (points.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(25))).astype(np.uint8)


def word_starts(text: np.ndarray) -> list[int]:
    return [0] * bool(len(text)) + (np.flatnonzero(text[:-1] == 32) + 1).tolist()


def edits_within(item: Sequence[int], text: Sequence[int], most: int) -> tuple[int, int] | None:
    """(least edit distance of the item to a part of ``text``, end of that part) if it is at most ``most``.

    Bit-parallel dynamic programming over whole numbers of len(item) bits.
    """
    m = len(item)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, where = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (full & ~(d | plus))
        hn = plus & d
        if hp & top:
            distance += 1
        elif hn & top:
            distance -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(x | hp)), hp & x
        if distance < best:
            best, where = distance, j + 1
            if not best:
                break
        if distance - (len(text) - 1 - j) > min(most, best):
            break
    return (best, where) if where and best <= most else None


def leaks(index: Index, points: np.ndarray, starts: np.ndarray, offsets: np.ndarray, edits: float) -> list[tuple[int, int, int, int]]:
    """(text number, item number, edit distance, end) of verified leaks, the closest of each text and item."""
    points = points.astype("<u4")
    data, raw = letters(points), points.tobytes()
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tried: set[tuple[int, int]] = set()
    # a window starts in the text of the word it was asked at; its item may begin up to the allowed edits before
    for item, begin in index.candidates(data, starts):
        ok = index.possible(data, item, begin, edits)
        for i, b in zip(item[ok].tolist(), begin[ok].tolist(), strict=True):
            text = index.items[i][1]
            most = int(edits * len(text))
            middle = b + len(text) // 2
            doc = int(np.searchsorted(offsets, min(max(middle, 0), len(points) - 1), "right")) - 1
            first, end = int(offsets[doc]), int(offsets[doc + 1])
            key = (doc, i)
            closest = best[key][0] if key in best else most + 1
            if not closest:
                continue
            if b >= first and b + len(text) <= end and raw[4 * b : 4 * (b + len(text))] == index.raw[i]:
                best[key] = (0, b + len(text) - first)
                continue
            spot = (i, b // max(1, most))
            if spot in tried:
                continue
            tried.add(spot)
            low, high = max(first, b - 2 * most), min(end, b + len(text) + 2 * most)
            got = edits_within(text, points[low:high].tolist(), closest - 1)
            if got:
                best[key] = (got[0], low + got[1] - first)
    for i in index.tiny:
        text = index.raw[i]
        at = raw.find(text) if text else -1
        while at >= 0:
            if at % 4 == 0:
                place, end = at // 4, (at + len(text)) // 4
                doc = int(np.searchsorted(offsets, place, "right")) - 1
                if end <= offsets[doc + 1] and (place == offsets[doc] or points[place - 1] == 32) and (end == offsets[doc + 1] or points[end] == 32):
                    best[doc, i] = (0, end - int(offsets[doc]))
            at = raw.find(text, at + 1)
    return [(doc, i, *found) for (doc, i), found in best.items()]


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, word starts, text offsets) of texts as case-folded words with one blank after each."""
    if not pc.any(pc.not_equal(pc.binary_length(texts), pc.utf8_length(texts))).as_py():
        return plain_words(*utf8(texts))
    return word_characters([(t or "").casefold() for t in texts.to_pylist()])


def item_list(rows: pa.Table) -> list[tuple[object, np.ndarray]]:
    """(item_id or row number, code points of the normalised text) of items that have a word."""
    if not len(rows):
        return []
    names = rows.column("item_id").to_pylist() if "item_id" in rows.column_names else range(len(rows))
    points, _, offsets = normalised(rows.column("text").combine_chunks())
    cut = ((n, points[a : z - 1]) for n, a, z in zip(names, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if z > a)
    return [(n, x) for n, x in cut if len(x)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, distance, n_chars): leaks of whole items, the closest for each document row and item.

    ``distance`` is the edit distance of the item to the closest part of the
    document, at most ``edits`` of the item's characters; ``n_chars`` the
    item's length, both in characters of case-folded text. Null texts and items without words
    match nothing; repeated documents and null ids give rows of their own; an
    empty benchmark gives an empty result.
    """
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    scans = max(1, -(-benchmark.count() // ITEMS_PER_SCAN))
    found = None
    for scan in range(scans):
        part = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
        if scans > 1:
            part = part.filter(F.pmod(F.xxhash64("text"), F.lit(scans)) == scan)
        items = item_list(part.toArrow())

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, edits)
            for big in batches:
                for b in slices(big, "text"):
                    points, starts, offsets = normalised(b.column("text"))
                    hits = leaks(index, points, starts, offsets, edits) if len(starts) else []
                    if hits:
                        doc, item, distance, _ = zip(*hits, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [b.column("doc_id").take(pa.array(doc)), pa.array([items[i][0] for i in item]), pa.array(distance, pa.int64()), pa.array([len(items[i][1]) for i in item], pa.int64())],
                            ["doc_id", "item_id", "distance", "n_chars"],
                        )

        got = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, distance long, n_chars long")
        found = got if found is None else found.unionByName(got)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all other rows and columns stay as they are."""
    rows = benchmark.select("text").filter(F.col("text").isNotNull())
    scans = max(1, -(-rows.count() // ITEMS_PER_SCAN))
    for scan in range(scans):
        part = rows if scans == 1 else rows.filter(F.pmod(F.xxhash64("text"), F.lit(scans)) == scan)
        items = item_list(part.toArrow())
        if not items:
            continue

        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = Index(items, edits)
            for big in batches:
                for b in slices(big, "text"):
                    points, starts, offsets = normalised(b.column("text"))
                    clean = np.ones(len(b), bool)
                    if len(starts):
                        clean[[h[0] for h in leaks(index, points, starts, offsets, edits)]] = False
                    yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
