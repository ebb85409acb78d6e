"""Signature carving over chunked byte images.

Chunks are (image_id, chunk_no, base_offset, data). One scan of the bytes finds
headers and footers together; from then on only hits (a few numbers each)
travel. Matches across a chunk edge are found on short strips cut from both
sides of the edge, so image bytes are never shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.functions.bytesops import arrays_type, inline_arrays
from tracefield.operators import ordered as od
from tracefield.operators.windows import PatternIndex, listed_windows, windows
from tracefield.session import checkpoint, rows_a_batch, small_table

#: patterns that one scan of the bytes looks for; longer lists take more scans
PATTERNS_PER_SCAN = 65_536
#: lists up to here are searched by first bytes; up to the next they are compiled into the scan, longer ones stay on Spark
FEW, SHORT_LIST = 64, 1024
#: byte strings shorter than this are searched together
JOINED = 1 << 18
HITS = arrays_type(pid=T.IntegerType(), pos=T.LongType())


def find_all(data: bytes, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pattern numbers and positions of every occurrence, overlaps included."""
    return finder(patterns)(data)


def finder(patterns: list[bytes]) -> Callable[[bytes], tuple[np.ndarray, np.ndarray]]:
    """``find_all`` for one pattern list: by hashed windows, or by first bytes where the list is short."""
    return PatternIndex(patterns).find if len(patterns) > FEW else partial(find_few, patterns)


def find_few(patterns: list[bytes], data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A table over byte pairs marks where any pattern can start; its patterns are tried there."""
    a = np.frombuffer(data, np.uint8)
    pair = a[:-1].astype(np.uint16) << 8 | a[1:] if len(a) > 1 else np.empty(0, np.uint16)
    wanted = np.zeros(65536, bool)
    for p in patterns:
        if len(p) > 1:
            wanted[p[0] << 8 | p[1]] = True
    cand = np.flatnonzero(wanted[pair])
    code = pair[cand]
    pids, found = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for n, p in enumerate(patterns):
        at = cand[code == (p[0] << 8 | p[1])] if len(p) > 1 else np.flatnonzero(a == p[0])
        at = at[at + len(p) <= len(a)]
        for i in range(2, len(p)):
            at = at[a[at + i] == p[i]]
        pids.append(np.full(len(at), n, np.int32))
        found.append(at)
    return np.concatenate(pids), np.concatenate(found).astype(np.int64)


def find_each(patterns: list[bytes]) -> Callable[[Iterable[bytes]], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """``find_all`` for each of many byte strings.

    Short ones are searched together, up to ``JOINED`` bytes, as a search has a
    cost of its own; hits that run over the end of their string are dropped.
    """
    find = finder(patterns)
    length = np.array([len(p) for p in patterns] or [0])

    def together(group: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(group) == 1:
            yield find(group[0])
            return
        sizes = np.array([len(g) for g in group])
        stops = np.cumsum(sizes)
        pid, pos = find(b"".join(group))
        row = np.searchsorted(stops, pos, side="right")
        whole = pos + length[pid] <= stops[row]
        pid, pos, row = pid[whole], pos[whole], row[whole]
        order = np.argsort(row, kind="stable")
        pid, pos, row = pid[order], pos[order], row[order]
        ends = np.searchsorted(row, np.arange(1, len(group)))
        yield from zip(np.split(pid, ends), np.split(pos - (stops - sizes)[row], ends), strict=True)

    def search(rows: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group, load = [], 0
        for data in rows:
            if group and load + len(data) > JOINED:
                yield from together(group)
                group, load = [], 0
            group.append(data)
            load += len(data)
        if group:
            yield from together(group)

    return search


def scan_udf(patterns: list[bytes]):
    search = find_each(patterns)

    @F.pandas_udf(HITS)
    def scan(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(search(data)), columns=["pid", "pos"])

    return scan


def edge_udf(patterns: list[bytes]):
    """Hits that start in the left part and end in the right one."""
    search = find_each(patterns)

    @F.pandas_udf(HITS)
    def scan(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        size = np.array([len(p) for p in patterns])
        rows = []
        for a, (pid, pos) in zip(left, search(a + b for a, b in zip(left, right))):
            over = (pos < len(a)) & (pos + size[pid] > len(a))
            rows.append((pid[over], pos[over]))
        return pd.DataFrame(rows, columns=["pid", "pos"])

    return scan


def scan_pass(chunks: DataFrame, packed: Column, reach: int) -> DataFrame:
    """The one read of the image bytes, written as a small table: per chunk the
    packed hits, the size, and ``reach`` bytes from each end."""
    d = F.col("data")
    size = F.octet_length(d)
    passed = chunks.select(
        "image_id", "chunk_no", "base_offset", size.alias("size"), packed.alias("hits"),
        F.substring(d, 1, reach).alias("head"),
        F.substring(d, F.greatest(size - reach + 1, F.lit(1)), F.lit(reach)).alias("tail"),
    )
    with rows_a_batch(chunks.sparkSession, 256):
        return checkpoint(passed)


def strips(passed: DataFrame, reach: int) -> DataFrame:
    """(image_id, left_offset, left, right): the bytes before each chunk end and those after it.

    Chunks are glued only where the next one begins at the very offset where
    this one ends; over a missing chunk nothing is glued. Where chunks are
    shorter than ``reach``, heads of following chunks are joined by doubling.
    """
    parts = passed.filter("size > 0").select(
        "image_id", F.col("base_offset").alias("begin"), (F.col("base_offset") + F.col("size")).alias("stop"), "head", "tail"
    )
    least = parts.agg(F.min(F.col("stop") - F.col("begin"))).first()[0] or reach
    run = parts.select("image_id", "begin", "stop", "head")
    while least < reach:
        # each run grows by the run that begins where it stops
        after = run.select("image_id", F.col("begin").alias("stop"), F.col("stop").alias("_stop"), F.col("head").alias("_head"))
        run = checkpoint(run.join(after, ["image_id", "stop"], "left").select(
            "image_id", "begin", F.coalesce("_stop", "stop").alias("stop"),
            F.substring(F.when(F.col("_head").isNull(), F.col("head")).otherwise(F.concat("head", "_head")), 1, reach).alias("head"),
        ))
        least *= 2
    right = run.select("image_id", F.col("begin").alias("stop"), F.col("head").alias("right"))
    return parts.join(right, ["image_id", "stop"]).select(
        "image_id", (F.col("stop") - F.octet_length("tail")).alias("left_offset"), F.col("tail").alias("left"), "right"
    )


def scan_images(chunks: DataFrame, patterns: list[bytes]) -> tuple[DataFrame, DataFrame]:
    """Every occurrence of every pattern (image_id, pid, offset), and (image_id, image_size)."""
    found = sizes = None
    for start in range(0, max(1, len(patterns)), PATTERNS_PER_SCAN):
        group = patterns[start : start + PATTERNS_PER_SCAN]
        hits, sizes = _scan_group(chunks, group)
        hits = hits.withColumn("pid", F.col("pid") + start)
        found = hits if found is None else found.unionByName(hits)
    return found, sizes


def _scan_group(chunks: DataFrame, patterns: list[bytes]) -> tuple[DataFrame, DataFrame]:
    reach = max([len(p) for p in patterns] + [2]) - 1
    passed = scan_pass(chunks, scan_udf(patterns)(F.col("data")), reach)
    inside = passed.select(
        "image_id", "base_offset", F.inline(F.arrays_zip("hits.pid", "hits.pos"))
    ).select("image_id", "pid", (F.col("base_offset") + F.col("pos")).alias("offset"))
    edge = inline_arrays(strips(passed, reach), ["image_id", "left_offset"], edge_udf(patterns)(F.col("left"), F.col("right")))
    across = edge.select("image_id", "pid", (F.col("left_offset") + F.col("pos")).alias("offset"))
    sizes = passed.groupBy("image_id").agg(F.max(F.col("base_offset") + F.col("size")).alias("image_size"))
    return inside.unionByName(across), sizes


def scan_patterns(chunks: DataFrame, patterns: list[bytes]) -> DataFrame:
    return scan_images(chunks, patterns)[0]


def match_signatures(chunks: DataFrame, signatures: DataFrame) -> DataFrame:
    """Header hits (image_id, name, offset, header_len), over chunk edges too.

    A short list is compiled into the scan. A longer one stays on Spark: the
    scan gives the windows that a bit table of it lets through, and these meet
    the list in a join on their bytes.
    """
    rows = signatures.select("name", "header").limit(SHORT_LIST + 1).collect()
    if len(rows) > SHORT_LIST:
        return match_listed(chunks, signatures)
    patterns = sorted({bytes(r.header) for r in rows})
    number = {p: i for i, p in enumerate(patterns)}
    names = small_table(
        chunks.sparkSession, [(number[bytes(r.header)], r.name, len(r.header)) for r in rows], "pid int, name string, header_len int"
    )
    return scan_patterns(chunks, patterns).join(names, "pid").select("image_id", "name", "offset", "header_len")


def match_listed(chunks: DataFrame, signatures: DataFrame) -> DataFrame:
    """``match_signatures`` for a list of any length, which is never collected."""
    listed = checkpoint(signatures.select("name", "header").filter(F.octet_length("header") > 0))
    inside, over, longest = listed_windows(listed, "header")
    reach = max(longest, 2) - 1
    data = F.col("data")
    with rows_a_batch(chunks.sparkSession, 256):
        passed = scan_pass(chunks, windows(data, inside(data)), reach)
    hits = passed.select("image_id", F.col("base_offset").alias("at"), F.inline("hits"))
    edges = strips(passed, reach).select("image_id", F.col("left_offset").alias("at"), F.concat("left", "right").alias("data"), over(F.col("left"), F.col("right")).alias("_s"))
    edges = edges.select("image_id", "at", F.inline(windows(data, F.col("_s"))))
    both = hits.unionByName(edges).withColumnRenamed("window", "header")
    return both.join(listed, "header").select("image_id", "name", (F.col("at") + F.col("pos")).alias("offset"), F.octet_length("header").alias("header_len"))


def dedup_offsets(hits: DataFrame, priority: Column | None = None) -> DataFrame:
    """One hit per offset: longest header, then highest priority, then name."""
    rank = F.struct(-F.col("header_len"), F.lit(0) if priority is None else -priority, F.col("name"))
    return hits.groupBy("image_id", "offset").agg(
        F.min_by("name", rank).alias("name"), F.max("header_len").alias("header_len")
    )


def pair_footers(headers: DataFrame, footers: DataFrame, mode: str = "first", span: int = 1 << 26) -> DataFrame:
    """Add ``footer_offset`` (null if none) to each header.

    headers: image_id, name, offset, max_size, footer_search_offset, footer_len;
    footers: image_id, name, offset. ``first``: earliest footer at or after
    start + footer_search_offset; ``last``: latest one. Both must end within
    start + max_size. As-of joins, so dense footers make no pairs.
    """
    keys = ["image_id", "name"]
    f = footers.select(*keys, F.col("offset").alias("_f"))
    low = F.col("offset") + F.col("footer_search_offset")
    high = F.col("offset") + F.col("max_size") - F.col("footer_len")
    if mode == "first":
        got = od.next_at_or_after(headers.withColumn("_p", low), f, keys, "_p", "_f", span, "footer_offset")
        ok = F.col("footer_offset") <= high
    else:
        got = od.last_at_or_before(headers.withColumn("_p", high), f, keys, "_p", "_f", span, "footer_offset")
        ok = F.col("footer_offset") >= low
    return got.withColumn("footer_offset", F.when(ok, F.col("footer_offset"))).drop("_p")


def cut_ranges(paired: DataFrame, image_sizes: DataFrame) -> DataFrame:
    """Footer found: cut after it, complete. Otherwise cut at the size bound,
    complete only when no footer was expected. Empty ranges are dropped."""
    end = F.when(F.col("footer_offset").isNotNull(), F.col("footer_offset") + F.col("footer_len")).otherwise(
        F.least(F.col("offset") + F.col("max_size"), F.col("image_size"))
    )
    return (
        paired.join(image_sizes, "image_id")
        .withColumn("end_offset", end)
        .withColumn("is_complete", F.col("footer_offset").isNotNull() | (F.col("footer_len") == 0))
        .withColumn("size", F.col("end_offset") - F.col("offset"))
        .filter("size > 0")
        .select("image_id", "name", F.col("offset").alias("start_offset"), "end_offset", "size", "is_complete")
    )


def roles(spark, signatures: DataFrame) -> tuple[list[bytes], DataFrame, DataFrame]:
    """(patterns, what each is the header of, what each is the footer of) of a signature list."""
    rows = signatures.collect()
    patterns = sorted({bytes(r.header) for r in rows} | {bytes(r.footer) for r in rows if r.footer})
    number = {p: i for i, p in enumerate(patterns)}
    heads = small_table(
        spark,
        [(number[bytes(r.header)], r.name, len(r.header), r.max_size, r.footer_search_offset, len(r.footer or b"")) for r in rows],
        "pid int, name string, header_len int, max_size bigint, footer_search_offset bigint, footer_len int",
    )
    feet = small_table(spark, [(number[bytes(r.footer)], r.name) for r in rows if r.footer], "pid int, name string")
    return patterns, heads, feet


def carve(
    chunks: DataFrame,
    signatures: DataFrame,
    mode: str = "first",
    dedup: bool = False,
    span: int = 1 << 26,
) -> DataFrame:
    """Ranges carved from the images, one row each.

    Headers, footers and image sizes all come from one scan of the bytes.
    """
    patterns, heads, feet = roles(chunks.sparkSession, signatures)
    hits, sizes = scan_images(chunks, patterns)
    hits = checkpoint(hits)
    headers = hits.join(heads, "pid").drop("pid")
    if dedup:
        keep = dedup_offsets(headers).select("image_id", "offset", "name")
        headers = headers.join(keep, ["image_id", "offset", "name"], "left_semi")
    paired = pair_footers(headers, hits.join(feet, "pid").drop("pid"), mode, span)
    return cut_ranges(paired, sizes)


def overlapping_pieces(ranges: DataFrame, chunks: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Bytes of each range as ordered pieces (image_id, name, start_offset, piece_offset, piece).

    Which chunk holds which part of a range is found on chunk places alone, cut
    into ``span`` wide cells. Each chunk then meets the list of parts wanted of
    it once, cuts them, and only the pieces go on; chunks that nothing is
    wanted of are left where they are.
    """
    first = F.floor(F.col("start_offset") / span)
    r = ranges.withColumn("_cell", F.explode(F.sequence(first, F.floor((F.col("end_offset") - 1) / span)))).withColumn("_rc", first)
    places = chunks.select("image_id", "chunk_no", "base_offset", (F.col("base_offset") + F.octet_length("data")).alias("_stop")).filter(F.col("_stop") > F.col("base_offset"))
    c_first = F.floor(F.col("base_offset") / span)
    c = places.withColumn("_cell", F.explode(F.sequence(c_first, F.floor((F.col("_stop") - 1) / span)))).withColumn("_cc", c_first)
    lo = F.greatest("start_offset", "base_offset")
    hi = F.least("end_offset", "_stop")
    # a pair that shares several cells is kept in the first one only
    wanted = (
        r.join(c, ["image_id", "_cell"])
        .filter((lo < hi) & (F.col("_cell") == F.greatest("_rc", "_cc")))
        .select("image_id", "chunk_no", "name", "start_offset", lo.alias("piece_offset"), (hi - lo).cast("int").alias("_n"))
        .groupBy("image_id", "chunk_no").agg(F.collect_list(F.struct("name", "start_offset", "piece_offset", "_n")).alias("_w"))
    )
    cut = chunks.join(checkpoint(wanted), ["image_id", "chunk_no"]).select("image_id", "base_offset", "data", F.explode("_w").alias("w"))
    return cut.select(
        "image_id", "w.name", "w.start_offset", "w.piece_offset",
        F.substring(F.col("data"), (F.col("w.piece_offset") - F.col("base_offset") + 1).cast("int"), F.col("w._n")).alias("piece"),
    )


def carved_bytes(ranges: DataFrame, chunks: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Whole content per range, for ranges that fit a cell; larger ones stay pieces."""
    pieces = overlapping_pieces(ranges, chunks, span)
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("piece_offset", F.hex("piece").alias("h")))), lambda x: x["h"]), ""
    )
    return pieces.groupBy("image_id", "name", "start_offset").agg(F.unhex(joined).alias("content"))


def carve_filters(
    carved: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
    min_confidence: float | None = None,
) -> DataFrame:
    if include:
        carved = carved.filter(F.col("name").isin(*include))
    if exclude:
        carved = carved.filter(~F.col("name").isin(*exclude))
    if min_size is not None:
        carved = carved.filter(F.col("size") >= min_size)
    if max_size is not None:
        carved = carved.filter(F.col("size") <= max_size)
    if min_confidence is not None:
        carved = carved.filter(F.col("confidence") >= min_confidence)
    return carved


def carving_stats(carved: DataFrame) -> DataFrame:
    return carved.groupBy("name").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("is_complete").cast("bigint")).alias("complete"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.floor(F.sum("size") / F.count(F.lit(1))).alias("mean_size"),
        F.sum("size").alias("total_size"),
    )


def fragmented(parts: DataFrame, keys: list[str], max_gap: int, max_fragments: int, span: int = 1 << 26) -> DataFrame:
    """Runs of parts (keys, offset, size) no further than ``max_gap`` apart,
    with more than one and at most ``max_fragments`` members."""
    end = F.col("offset") + F.col("size")
    bucket = F.floor(F.col("offset") / span)
    # each ordered step reads its input twice, so chained steps are written out between
    step = checkpoint(od.lag_value(checkpoint(parts), keys, ["offset"], bucket, end, "_prev"))
    start = (F.col("_prev").isNull() | (F.col("offset") - F.col("_prev") > max_gap)).cast("bigint")
    runs = od.running_sum(step, keys, ["offset"], bucket, start, "_run")
    return (
        runs.groupBy(*keys, "_run")
        .agg(
            F.count(F.lit(1)).alias("fragments"),
            F.min("offset").alias("start_offset"),
            F.max(end).alias("end_offset"),
            F.sum("size").alias("bytes"),
        )
        .filter((F.col("fragments") > 1) & (F.col("fragments") <= max_fragments))
        .drop("_run")
    )


def scan_udtf(patterns: list[bytes], id_type: str = "string"):
    """Table function over rows (image_id, base_offset, edge, data): all header hits, Arrow batches in, Arrow tables out.

    ``edge``: null, or the place in ``data`` that a hit must reach over.
    """
    find = finder(patterns)
    sizes = np.array([len(p) for p in patterns] or [0])

    @F.arrow_udtf(returnType=f"image_id {id_type}, pid int, offset bigint")
    class Scan:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            image = batch.column("image_id")
            for i, (base, edge, data) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("base_offset", "edge", "data")), strict=True)):
                pid, pos = find(data)
                if edge is not None:
                    over = (pos < edge) & (pos + sizes[pid] > edge)
                    pid, pos = pid[over], pos[over]
                if len(pid):
                    yield pa.table([image.take(pa.array(np.full(len(pid), i))), pa.array(pid, pa.int32()), pa.array(pos + base, pa.int64())], names=["image_id", "pid", "offset"])

    return Scan


def scan_by_udtf(chunks: DataFrame, patterns: list[bytes]) -> DataFrame:
    """(image_id, pid, offset) by the table function: over each chunk, and over the bytes around each chunk edge."""
    scan = scan_udtf(patterns, chunks.schema["image_id"].dataType.simpleString())
    reach = max([len(p) for p in patterns] + [2]) - 1
    inside = chunks.select("image_id", "base_offset", F.lit(None).cast("int").alias("edge"), "data")
    edges = strips(scan_pass(chunks, F.lit(None).cast("int"), reach), reach)
    edges = edges.select("image_id", F.col("left_offset").alias("base_offset"), F.octet_length("left").alias("edge"), F.concat("left", "right").alias("data"))
    return scan(inside.asTable()).unionByName(scan(edges.asTable()))
