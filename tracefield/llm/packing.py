"""Best-fit packing of documents into fixed-length sequences by exact-complement hashing.

Tasks cut documents into pieces; only the count of each piece length reaches
the driver, at most ``size`` numbers. There, single lengths, pairs and triples
are looked up by their sum in tables of what is still available, and every
combination that fills a gap exactly is used as often as the counts allow; what
is left is placed best-fit. The plan is a list of patterns (lengths, how
often), whose size depends on the sequence length, not on the corpus. Pieces
of a length are numbered over the cluster and read their place off the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefield.llm.common import partitions, slices
from tracefield.llm.tokens import encoder
from tracefield.session import checkpoint


def plan_sequences(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, number of sequences) that use every piece once.

    Exact fills by one complement never cost a sequence. Exact fills by pairs
    and triples may use up short pieces that long ones need, so the plans that
    fill with up to one, two and three pieces are all made, on counts alone, and
    the shortest is taken (of equal ones, that with the most exact fills).
    """
    plans = [_plan(counts, size, depth) for depth in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _plan(counts: dict[int, int], size: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Exact fills with up to ``depth`` pieces, longest lengths first; the rest goes, longest first, into the fullest sequence with room."""
    have = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        have[length] += n
    plan: list[tuple[tuple[int, ...], int]] = []
    if have[size]:
        plan.append(((size,), int(have[size])))
        have[size] = 0

    def use(lengths: tuple[int, ...]) -> bool:
        need = Counter(lengths)
        k = min(int(have[x]) // n for x, n in need.items())
        if k:
            plan.append((lengths, k))
            for x, n in need.items():
                have[x] -= k * n
        return k > 0

    def enough(lengths: tuple[int, ...]) -> bool:
        return all(have[x] >= n for x, n in Counter(lengths).items())

    for longest in range(size - 1, 0, -1):
        if have[longest]:
            use((longest, size - longest))
    for longest in range(size - 1, 0, -1) if depth > 1 else ():
        gap = size - longest
        while have[longest]:
            a = np.arange(gap - 1, (gap - 1) // 2, -1)
            a = a[(have[a] > 0) & (have[gap - a] > 0)]
            found = next((t for x in a.tolist() if enough(t := (longest, x, gap - x))), None)
            if found is None or not use(found):
                break
    for longest in range(size - 1, 0, -1) if depth > 2 else ():
        gap = size - longest
        while have[longest]:
            there = (have[: gap + 1] > 0).astype(float)
            pairs = np.rint(np.convolve(there, there))[: gap + 1]  # pairs with each sum
            a = np.arange(gap - 2, 0, -1)
            a = a[(have[a] > 0) & (pairs[gap - a] > 0)]
            found = None
            for x in a.tolist():
                rest = gap - x
                b = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
                b = b[(have[b] > 0) & (have[rest - b] > 0)]
                found = next((t for y in b.tolist() if enough(t := (longest, x, y, rest - y))), None)
                if found:
                    break
            if found is None or not use(found):
                break
    # best fit on counts: open sequences by room left
    rooms: dict[int, list[list]] = {}
    for length in range(size - 1, 0, -1):
        left = int(have[length])
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                fit = min(size // length, left)
                per, more = divmod(left, fit)
                rooms.setdefault(size - fit * length, []).append([(length,) * fit, per])
                left = more
                continue
            lengths, n = rooms[room].pop()
            k = min(n, left)
            if n > k:
                rooms[room].append([lengths, n - k])
            if not rooms[room]:
                del rooms[room]
            rooms.setdefault(room - length, []).append([(*lengths, length), k])
            left -= k
    return plan + [(tuple(lengths), n) for group in rooms.values() for lengths, n in group]


def _slots(plan) -> pd.DataFrame:
    """Where the pieces of each length go: ranks from ``rank`` on lie in sequences from ``sequence`` on, at ``offset``."""
    rows, taken, sequence = [], Counter(), 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            rows.append((x, taken[x], sequence, offset))
            taken[x] += n
            offset += x
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of every text, the end id included.

    Only documents over ``size`` ids are cut; their first piece takes the odd length.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, "byte")
        for big in batches:
            for b in slices(big, text_col):
                ids, lengths = encode(b.column(text_col).to_pylist())
                stop, out, raw = 0, [], ids.astype("<u4")
                for row, n in enumerate(lengths.tolist()):
                    tokens = np.append(raw[stop : stop + n], np.uint32(end_id)).astype("<u4")
                    stop += n
                    first = len(tokens) % size or size
                    bounds = [0, *range(first, len(tokens) + 1, size)]
                    out += [(row, i, x, y - x, zlib.crc32(tokens[x:y].tobytes())) for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False))]
                row, piece, start, length, crc = (pa.array(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(id_col).take(row), piece.cast(pa.int32()), start, length, crc], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2) -> DataFrame:
    """Packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone; null and repeated
    ids are packed as rows of their own; other columns are ignored; an empty
    table gives an empty result. A length that most pieces share is numbered in
    buckets, whose counts are added up first.
    """
    spark = docs.sparkSession
    pieces = checkpoint(cut_documents(docs, tokenizer, id_col, text_col, size, end_id))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(plan_sequences(counts, size))
    lengths, ranks, sequences, offsets = (slots[c].to_numpy(np.int64) for c in ("length", "rank", "sequence", "offset"))
    keys = (lengths << 48) + ranks

    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark)))
    dealt = pieces.withColumn("bucket", bucket)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], [*b.schema.names[:-1], "sequence_id", "offset"]
            )

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(names).schema)
    return ranked.select(*names, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")
