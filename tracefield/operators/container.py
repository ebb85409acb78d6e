"""Container atoms: walking, scanning, damage flags, scores, plans, matching."""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.operators import ordered as od
from tracefield.functions.bytesops import arrays_type, inline_arrays
from tracefield.operators.carving import carved_bytes, scan_pass, strips
from tracefield.session import checkpoint

# fixed values
CONTAINER_ATOMS = {"moov", "trak", "edts", "mdia", "minf", "dinf", "stbl", "mvex", "moof", "traf"}
CRITICAL_ATOMS = ["ftyp", "moov", "mdat", "mvhd", "tkhd", "mdhd", "hdlr", "stsd", "stts", "stsc", "stsz", "stco"]

ATOM_ROW = "atom_type string, offset bigint, size bigint, header_size int, level int, parent_offset bigint"


def walk_atoms(d: bytes, start: int, end: int, level: int = 0, parent=None):
    """Atom rows in file order, at any depth; a level stops at its first impossible size."""
    open_levels = [(start, end, level, parent)]
    while open_levels:
        at, end, level, parent = open_levels.pop()
        if at + 8 > end:
            continue
        (size,) = struct.unpack_from(">I", d, at)
        kind, head = d[at + 4 : at + 8].decode("ascii", "ignore"), 8
        if size == 1:
            if at + 16 > end:
                continue
            (size,), head = struct.unpack_from(">Q", d, at + 8), 16
        elif size == 0:
            size = end - at
        if not head <= size <= end - at:
            continue
        yield kind, at, size, head, level, parent
        open_levels.append((at + size, end, level, parent))
        if kind in CONTAINER_ATOMS:
            open_levels.append((at + head, at + size, level + 1, at))


def atom_walk(files: DataFrame, key: str = "file_id", data: str = "data") -> DataFrame:
    """One row per atom, nested ones with their parent's offset."""

    def walk(batches):
        for pdf in batches:
            rows = [(k, *a) for k, d in zip(pdf[key], pdf[data]) for a in walk_atoms(d, 0, len(d))]
            out = pd.DataFrame(rows, columns=[key, "atom_type", "offset", "size", "header_size", "level", "parent_offset"])
            yield out.astype({"parent_offset": "Int64"})

    key_type = files.schema[key].dataType.simpleString()
    return files.select(key, data).mapInPandas(walk, f"{key} {key_type}, {ATOM_ROW}")


_HEADERS = arrays_type(pos=T.LongType(), size=T.LongType(), head=T.IntegerType(), kind=T.LongType())


def plausible_headers(d: bytes, stop: int, base: int, limit: int) -> tuple[np.ndarray, ...]:
    """(offset, size, header size, kind as a number) of all places before ``stop`` whose size field could be an atom's.

    The atom must end by ``limit``; sizes of 0 are left out.
    """
    a = np.frombuffer(d + bytes(16), np.uint8).astype(np.int64)
    at = np.arange(max(0, min(stop, len(d) - 7)))
    word = lambda k: a[at + k] << 24 | a[at + k + 1] << 16 | a[at + k + 2] << 8 | a[at + k + 3]
    size = word(0)
    at = at[(size >= 8) & (size <= limit - base - at) | (size == 1) & (at + 16 <= len(d))]
    size, kind = word(0), word(4)
    wide = size == 1
    high = word(8)
    size = np.where(wide, np.where(high < 1 << 30, high << 32 | word(12), limit + 1), size)
    head = np.where(wide, 16, 8)
    ok = (size >= head) & (size <= limit - base - at)
    return base + at[ok], size[ok], head[ok].astype(np.int32), kind[ok]


@F.pandas_udf(T.StringType())
def kind_text(kind: pd.Series) -> pd.Series:
    return kind.map(lambda k: int(k).to_bytes(4, "big").decode("ascii", "ignore"))


def atom_walk_chunks(chunks: DataFrame, span: int = 1 << 20) -> DataFrame:
    """``atom_walk`` over files in chunks (image_id, chunk_no, base_offset, data): image_id and ATOM_ROW, no cell above a chunk.

    One scan lists every place whose size field could be an atom's. Where a walk
    goes from such a place is known from its size alone, so its leaps of 1, 2, 4,
    ... atoms are joins; a level of the walk is then read off in one pass over
    these leaps, for all its containers and files at once. Only the places where
    walks end are looked at again in the bytes, for an atom that reaches to the
    end of its container.
    """
    length = F.col("base_offset") + F.octet_length("data")
    sizes = checkpoint(chunks.groupBy("image_id").agg(F.max(length).alias("file_size")))
    limit = sizes.agg(F.max("file_size")).first()[0] or 0

    @F.pandas_udf(_HEADERS)
    def inside(data: pd.Series, base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([plausible_headers(d, len(d) - 15, b, limit) for d, b in zip(data, base)], columns=["pos", "size", "head", "kind"])

    @F.pandas_udf(_HEADERS)
    def ends(left: pd.Series, right: pd.Series, base: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([plausible_headers(a + b, len(a), o, limit) for a, b, o in zip(left, right, base)], columns=["pos", "size", "head", "kind"])

    passed = scan_pass(chunks, inside(F.col("data"), F.col("base_offset")), 15)
    seams = strips(passed, 15).select("image_id", "left_offset", "left", "right")
    last = passed.join(sizes, "image_id").filter(F.col("base_offset") + F.col("size") == F.col("file_size")).select(
        "image_id", (F.col("file_size") - F.octet_length("tail")).alias("left_offset"), F.col("tail").alias("left"), F.lit(b"").alias("right")
    )
    found = passed.select("image_id", F.inline(F.arrays_zip("hits.pos", "hits.size", "hits.head", "hits.kind")))
    at_ends = inline_arrays(seams.unionByName(last), ["image_id"], ends(F.col("left"), F.col("right"), F.col("left_offset")))
    c = found.unionByName(at_ends).join(sizes, "image_id").filter(F.col("pos") + F.col("size") <= F.col("file_size")).drop("file_size")
    c = checkpoint(c.withColumn("kind", kind_text("kind")))

    leaps = [checkpoint(c.select("image_id", "pos", (F.col("pos") + F.col("size")).alias("to")).join(c.select("image_id", F.col("pos").alias("to")), ["image_id", "to"], "left_semi"))]
    while leaps[-1].head(1):
        far = leaps[-1].select("image_id", F.col("pos").alias("to"), F.col("to").alias("_far"))
        leaps.append(checkpoint(leaps[-1].join(far, ["image_id", "to"]).select("image_id", "pos", F.col("_far").alias("to"))))

    def level_of(open_: DataFrame, level: int) -> DataFrame:
        """Atoms of one level: what the walks from ``open_`` (image_id, start, end, parent) meet."""
        walk = ["image_id", "start", "end", "parent"]
        there = open_.join(c.select("image_id", F.col("pos").alias("start")), ["image_id", "start"], "left_semi").withColumn("pos", F.col("start"))
        for leap in reversed(leaps[:-1]):
            more = there.join(leap, ["image_id", "pos"]).filter(F.col("to") < F.col("end")).drop("pos").withColumnRenamed("to", "pos")
            there = checkpoint(there.select(*walk, "pos").unionByName(more.select(*walk, "pos")))
        atoms = checkpoint(there.join(c, ["image_id", "pos"]).filter(F.col("pos") + F.col("size") <= F.col("end")))
        reached = atoms.groupBy("image_id", "start").agg(F.max(F.col("pos") + F.col("size")).alias("_reached"))
        stop = open_.join(reached, ["image_id", "start"], "left").withColumn("pos", F.coalesce("_reached", "start")).filter(F.col("pos") + 8 <= F.col("end"))
        stop = checkpoint(stop.select(*walk, "pos"))
        look = stop.select("image_id", F.lit("").alias("name"), F.col("pos").alias("start_offset"), (F.col("pos") + 8).alias("end_offset")).distinct()
        header = carved_bytes(look, chunks, span).select("image_id", F.col("start_offset").alias("pos"), "content")
        open_ended = stop.join(header, ["image_id", "pos"]).filter(F.octet_length("content") == 8).filter(F.substring("content", 1, 4) == F.lit(bytes(4)))
        number = F.conv(F.hex(F.substring("content", 5, 4)), 16, 10).cast("bigint")
        open_ended = open_ended.select(*walk, "pos", (F.col("end") - F.col("pos")).alias("size"), F.lit(8).alias("head"), kind_text(number).alias("kind"))
        return checkpoint(atoms.select(*walk, "pos", "size", "head", "kind").unionByName(open_ended).withColumn("level", F.lit(level)))

    open_ = sizes.select("image_id", F.lit(0).cast("bigint").alias("start"), F.col("file_size").alias("end"), F.lit(None).cast("bigint").alias("parent"))
    out, level = None, 0
    while out is None or open_.head(1):
        atoms = level_of(open_, level)
        out = atoms if out is None else out.unionByName(atoms)
        holders = atoms.filter(F.col("kind").isin(*sorted(CONTAINER_ATOMS)))
        open_ = checkpoint(holders.select("image_id", (F.col("pos") + F.col("head")).alias("start"), (F.col("pos") + F.col("size")).alias("end"), F.col("pos").alias("parent")))
        level += 1
    return out.select("image_id", F.col("kind").alias("atom_type"), F.col("pos").alias("offset"), "size", F.col("head").alias("header_size"), "level", F.col("parent").alias("parent_offset"))


RIFF_ROW = "chunk string, offset bigint, size bigint, level int, parent_offset bigint"


def walk_riff(d: bytes):
    """Chunk rows of a RIFF file in file order, at any depth: little-endian sizes, chunks begin at even places.

    Lists go by their form type. A level stops at its first impossible size.
    """
    open_levels = [(0, len(d), 0, None)]
    while open_levels:
        at, end, level, parent = open_levels.pop()
        if at + 8 > end:
            continue
        kind, (size,) = d[at : at + 4], struct.unpack_from("<I", d, at + 4)
        stop = at + 8 + size
        listed = kind in (b"RIFF", b"LIST")
        if stop > end or listed and size < 4:
            continue
        yield (d[at + 8 : at + 12] if listed else kind).decode("ascii", "ignore"), at, size, level, parent
        open_levels.append((stop + size % 2, end, level, parent))
        if listed:
            open_levels.append((at + 12, stop, level + 1, at))


def riff_walk(files: DataFrame, key: str = "file_id", data: str = "data") -> DataFrame:
    """One row per RIFF chunk, nested ones with their parent's offset."""

    def walk(batches):
        for pdf in batches:
            rows = [(k, *c) for k, d in zip(pdf[key], pdf[data]) for c in walk_riff(d)]
            yield pd.DataFrame(rows, columns=[key, "chunk", "offset", "size", "level", "parent_offset"]).astype({"parent_offset": "Int64"})

    key_type = files.schema[key].dataType.simpleString()
    return files.select(key, data).mapInPandas(walk, f"{key} {key_type}, {RIFF_ROW}")


def avi_flags(chunks: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Damage of every file: NOT_AVI, HDRL_MISSING, MOVI_MISSING; an empty list where none is found."""
    has = lambda name, level: F.coalesce(F.bool_or((F.col("chunk") == name) & (F.col("level") == level)), F.lit(False))
    seen = chunks.groupBy(key).agg(has("AVI ", 0).alias("_avi"), has("hdrl", 1).alias("_hdrl"), has("movi", 1).alias("_movi"))
    miss = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    flags = F.array(F.when(miss("_avi"), "NOT_AVI"), F.when(miss("_hdrl"), "HDRL_MISSING"), F.when(miss("_movi"), "MOVI_MISSING"))
    return files.select(key).join(seen, key, "left").select(key, F.filter(flags, lambda x: x.isNotNull()).alias("flags"))


def moov_structure(atoms: DataFrame, key: str = "file_id") -> DataFrame:
    """Per file: whether the movie atom and its header are there, number of tracks, damage found.

    No movie atom or no ``mvhd``: HEADER_DAMAGE; a movie without a track: STRUCTURE_DAMAGE.
    """
    kind = F.col("atom_type")
    g = atoms.groupBy(key).agg(
        F.bool_or((kind == "moov") & (F.col("level") == 0)).alias("has_moov"), F.bool_or((kind == "mvhd") & (F.col("level") == 1)).alias("has_mvhd"),
        F.sum(((kind == "trak") & (F.col("level") == 1)).cast("bigint")).alias("tracks"),
    )
    flags = F.filter(F.array(
        F.when(~F.col("has_moov") | ~F.col("has_mvhd"), "HEADER_DAMAGE"), F.when(F.col("has_moov") & (F.col("tracks") == 0), "STRUCTURE_DAMAGE")
    ), lambda x: x.isNotNull())
    return g.withColumn("damage", flags)


_TIMES = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("time_scale", T.LongType()), T.StructField("seconds", T.DoubleType())])


@F.pandas_udf(_TIMES)
def movie_seconds_udf(moov: pd.Series) -> pd.DataFrame:
    """Version, time scale and length in seconds of a movie header: 32-bit times in version 0, 64-bit in version 1."""
    rows = []
    for d in moov:
        at = d.find(b"mvhd") + 4
        wide = at >= 4 and len(d) > at and d[at] == 1
        if at < 4 or len(d) < at + (32 if wide else 20):
            rows.append((None, None, None))
            continue
        scale, length = struct.unpack_from(">IQ" if wide else ">II", d, at + (20 if wide else 12))
        rows.append((int(wide), scale, length / scale if scale else None))
    return pd.DataFrame(rows, columns=["version", "time_scale", "seconds"]).astype({"version": "Int32", "time_scale": "Int64", "seconds": "Float64"})


_TAGS = T.ArrayType(T.StructType([
    T.StructField("atom_type", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("size", T.LongType()),
]))


def _tag_hits(d: bytes, tags: list[bytes], lo: int, hi: int):
    """Tags with their size field when the field starts in [lo, hi)."""
    out = []
    for t in tags:
        i = d.find(t, 4)
        while i != -1:
            if lo <= i - 4 < hi:
                out.append({"atom_type": t.decode(), "pos": i - 4, "size": struct.unpack_from(">I", d, i - 4)[0]})
            i = d.find(t, i + 1)
    return out


def atom_candidates(chunks: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(image_id, atom_type, offset, size) of every tag and the size field before it, edges
    included; and the image sizes. The bytes are read once."""
    tags = [t.encode() for t in types]

    @F.pandas_udf(_TAGS)
    def inside(data: pd.Series) -> pd.Series:
        return data.map(lambda d: _tag_hits(d, tags, 0, len(d)))

    @F.pandas_udf(_TAGS)
    def across(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([
            [h for h in _tag_hits(a + b, tags, 0, len(a)) if h["pos"] + 8 > len(a)] for a, b in zip(left, right)
        ])

    passed = scan_pass(chunks, inside(F.col("data")), 7)
    a = passed.select("image_id", F.col("base_offset").alias("_b"), F.inline("hits"))
    s = strips(passed, 7)
    b = s.select("image_id", F.col("left_offset").alias("_b"), F.inline(across(F.col("left"), F.col("right"))))
    sizes = passed.groupBy("image_id").agg(F.max(F.col("base_offset") + F.col("size")).alias("image_size"))
    return a.unionByName(b).select("image_id", "atom_type", (F.col("_b") + F.col("pos")).alias("offset"), F.col("size")), sizes


def atom_scan(chunks: DataFrame, types: list[str], span: int = 1 << 26) -> DataFrame:
    """Accepted atoms per type: size from 8 to what is left, the search going on
    behind an accepted atom.

    Which candidates the search meets is a chain (each leads to the next tag
    behind its end). The candidates are dealt in stretches; a task finds where
    the chain would leave its stretch from each of them. Chains soon meet, so
    few places are left where one can enter a stretch: these are followed by
    doubling, and the stretches walked from those that the chain enters.
    """
    keys = ["image_id", "atom_type"]
    c, sizes = atom_candidates(chunks, types)
    c = c.join(sizes, "image_id")
    c = c.filter((F.col("size") >= 8) & (F.col("size") <= F.col("image_size") - F.col("offset")) & (F.col("offset") + 4 < F.col("image_size") - 8))
    c = checkpoint(c.select(*keys, "offset", "size", (F.col("offset") + 4).alias("tag"), (F.col("offset") + F.col("size")).alias("_end")))
    nxt = od.next_at_or_after(c, c.select(*keys, F.col("tag").alias("_t")), keys, "_end", "_t", span, "nxt")
    places = checkpoint(nxt.select(*keys, "tag", F.coalesce("nxt", F.lit(NOWHERE)).alias("nxt")))
    return c.join(chain_reach(places, keys), [*keys, "tag"], "left_semi").select(*keys, "offset", "size")


NOWHERE = -1


def chain_reach(places: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tag) of the places met from the first one of each key on, ``nxt`` leading on from each (further up, or ``NOWHERE``)."""
    dealt = od.dealt(places, keys, ["tag"], "_part")
    leaves = checkpoint(dealt.groupBy(*keys, "_part").applyInPandas(_stretch_exits, T.StructType([*dealt.schema.fields, T.StructField("out", T.LongType())])))
    first = leaves.groupBy(*keys).agg(F.min("tag").alias("tag"))
    doors = checkpoint(leaves.filter(F.col("out") != NOWHERE).select(*keys, F.col("out").alias("tag")).unionByName(first).distinct())
    jump = checkpoint(leaves.join(doors, [*keys, "tag"], "left_semi").select(*keys, "tag", F.nullif("out", F.lit(NOWHERE).cast("bigint")).alias("nxt")).distinct())
    reach = checkpoint(first)
    while True:
        step = reach.join(jump, [*keys, "tag"]).filter("nxt is not null").select(*keys, F.col("nxt").alias("tag"))
        grown = checkpoint(reach.unionByName(step).distinct())
        if grown.count() == reach.count():
            break
        reach = grown
        far = jump.select(*keys, F.col("tag").alias("nxt"), F.col("nxt").alias("_far"))
        jump = checkpoint(jump.join(far, [*keys, "nxt"], "left").select(*keys, "tag", F.col("_far").alias("nxt")))
    entered = leaves.drop("out").join(reach.withColumn("_in", F.lit(True)), [*keys, "tag"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    kept = T.StructType([dealt.schema[k] for k in keys] + [T.StructField("tag", T.LongType())])
    return entered.groupBy(*keys, "_part").applyInPandas(_stretch_walk(keys), kept)


def _stretch(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[int]]:
    """Rows by tag, and the row each leads to: its own number of rows where the stretch is left."""
    rows = rows.sort_values("tag", ignore_index=True)
    tag, nxt = rows["tag"].to_numpy(), rows["nxt"].to_numpy()
    return rows, np.where(nxt == NOWHERE, len(tag), np.searchsorted(tag, nxt)).tolist()


def _stretch_exits(rows: pd.DataFrame) -> pd.DataFrame:
    rows, to = _stretch(rows)
    out = rows["nxt"].tolist()
    for i in range(len(to) - 1, -1, -1):
        if to[i] < len(to):
            out[i] = out[to[i]]
    return rows.assign(out=np.array(out, np.int64))


def _stretch_walk(keys: list[str]):
    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows, to = _stretch(rows)
        met = rows["_in"].tolist()
        for i, t in enumerate(to):
            if met[i] and t < len(to):
                met[t] = True
        return rows.loc[np.array(met, bool), [*keys, "tag"]]

    return walk


_EXPECTED = T.StructType([
    T.StructField("expected_mdat", T.LongType()), T.StructField("duration", T.LongType()),
    T.StructField("created", T.LongType()), T.StructField("tracks", T.IntegerType()),
])


@F.pandas_udf(_EXPECTED)
def expected_mdat_udf(moov: pd.Series) -> pd.DataFrame:
    """Media size a movie header promises (sample table, +10 %), duration, creation time, tracks."""

    def u32(d, at):
        return struct.unpack_from(">I", d, at)[0] if at + 4 <= len(d) else None

    rows = []
    for d in moov:
        total = 0
        at = d.find(b"stsz") - 4
        if at >= 0 and (u32(d, at) or 0) >= 20:
            each, count = u32(d, at + 12), u32(d, at + 16)
            if each and count is not None:
                total = each * count
            elif count:
                listed = min(count, (u32(d, at) - 20) // 4, (len(d) - at - 20) // 4)
                total = sum(struct.unpack_from(f">{listed}I", d, at + 20))
        total = total or 10 * 1024 * 1024
        head = d.find(b"mvhd") - 4
        known = head >= 0
        rows.append((int(total * 1.1), u32(d, head + 24) if known else None, u32(d, head + 16) if known else None, d.count(b"trak") or None))
    out = pd.DataFrame(rows, columns=["expected_mdat", "duration", "created", "tracks"])
    return out.astype({"duration": "Int64", "created": "Int64", "tracks": "Int32"})


class Shelf:
    """Media atoms of one block by rank, and who is still free along two walks.

    ``right`` goes up in size, ``left`` down; both take equal sizes by offset.
    Taken atoms point onwards, paths are shortened as they are walked; a rank
    outside the block ends a walk.
    """

    def __init__(self, first: int):
        self.first = first
        self.want, (self.off, self.right, self.left, self.below) = array("d"), (array("q") for _ in range(4))

    def add(self, off: int, want: float, below: int):
        rank = self.first + len(self.want)
        self.want.append(want)
        self.off.append(off)
        self.right.append(rank)
        self.left.append(rank)
        self.below.append(below)

    def holds(self, rank: int) -> bool:
        return 0 <= rank - self.first < len(self.want)

    def free(self, walk: list[int], rank: int) -> int:
        passed = []
        while self.holds(rank) and walk[rank - self.first] != rank:
            passed.append(rank - self.first)
            rank = walk[rank - self.first]
        for i in passed:
            walk[i] = rank
        return rank

    def take(self, rank: int):
        self.right[rank - self.first] = rank + 1
        self.left[rank - self.first] = self.below[rank - self.first]


MOVIE = "off bigint, want double, lo bigint, lo_gap double, lo_off bigint, hi bigint, hi_gap double, hi_off bigint, at bigint, mdat_offset bigint, size_diff double"


def _propose(block: int, tolerance: float):
    """Rows in order of (image_id, at, media first, off): media fill a shelf, each movie then takes the nearest free atom of it or moves on."""

    def visit(shelf: Shelf, m: dict) -> bool:
        best = None
        for rank, gap, off, walk in (("lo", "lo_gap", "lo_off", shelf.left), ("hi", "hi_gap", "hi_off", shelf.right)):
            if m[rank] >= 0 and m[rank] // block == m["at"]:
                m[rank] = shelf.free(walk, m[rank])
                if shelf.holds(m[rank]):
                    i = m[rank] - shelf.first
                    m[gap], m[off] = abs(shelf.want[i] - m["want"]), shelf.off[i]
                elif m[rank] // block == m["at"]:
                    m[rank] = -1
            if m[gap] >= m["want"] * tolerance:
                m[rank] = -1
            if m[rank] >= 0 and (best is None or (m[gap], m[off]) < best[:2] or ((m[gap], m[off]) == best[:2] and shelf.holds(m[rank]))):
                best = (m[gap], m[off], m[rank])
        if best is None:
            return False
        gap, off, rank = best
        if shelf.holds(rank):
            shelf.take(rank)
            m["mdat_offset"], m["size_diff"] = off, gap
        else:
            m["at"], m["mdat_offset"], m["size_diff"] = rank // block, None, None
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, now = None, None
        for b in batches:
            out = []
            for m in b.to_pylist():
                if (m["image_id"], m["at"]) != now:
                    now = (m["image_id"], m["at"])
                    shelf = Shelf(m["at"] * block)
                if m.pop("media"):
                    shelf.add(m["off"], m["want"], m["lo"])
                elif visit(shelf, m):
                    out.append(m)
            kept = b.schema.remove(b.schema.get_field_index("media"))
            yield pa.RecordBatch.from_pylist(out, schema=kept)

    return run


def match_moov_mdat(moov: DataFrame, mdat: DataFrame, tolerance: float = 0.2, block: int = 1 << 18) -> DataFrame:
    """moov(image_id, offset, expected), mdat(image_id, offset, size): one-to-one,
    in moov order each takes the free mdat nearest in size (of equally near ones
    the first), within the tolerance. Rows with a null take no part.

    The same rows come from proposals in rounds, as all media prefer the earlier
    movie: media are ranked by size and cut in blocks of ``block``; a movie visits
    the block of its nearest candidate, takes it from any later movie, and if
    earlier ones hold all near it there, goes on to the block of its next
    candidate. What has rejected a movie once does so for ever, so it keeps two
    ranks, one each way. Rounds end when no movie moves; only blocks with
    arrivals are worked on, and a task holds the media of one block, 40 bytes
    each. Movies turned away at a block's edge cost the rounds, so blocks are
    as large as a task may well hold.
    """
    own = ["image_id", "want"]
    # both are used twice, and come from bytes
    media = checkpoint(mdat.select("image_id", F.col("offset").alias("off"), (F.col("size") - 8).cast("double").alias("want")).dropna())
    movies = checkpoint(moov.select("image_id", F.col("offset").alias("off"), F.col("expected").cast("double").alias("want")).dropna().filter("want > 0"))
    sizes = media.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(1))
    asked = movies.select(*own).distinct().select(*own, F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("kind"))
    order = ["want", "kind"]
    # rank of the first atom of each size, and of the size below
    u = od.dealt(sizes.unionByName(asked), ["image_id"], order)
    u = checkpoint(od.running_sum(u, ["image_id"], order, F.col("_part"), F.col("n"), "first", include_current=False))
    below = F.when(F.col("kind") == 1, F.col("first"))
    u = od.carry_last(u, ["image_id"], order, F.col("_part"), below, "below")
    u = checkpoint(u.withColumn("below", F.coalesce("below", F.lit(-1).cast("bigint"))))

    ranked = od.dense_index(od.dealt(media, ["image_id"], ["want", "off"]), ["image_id"], ["want", "off"], F.col("_part"), "rank")
    after = F.when(F.col("rank") + 1 < F.col("first") + F.col("n"), F.col("rank") + 1).otherwise(F.col("below"))
    none = F.lit(None)
    shelf = ranked.join(u.filter("kind = 1").drop("_part"), own).select(
        "image_id", "off", "want", after.alias("lo"), none.cast("double").alias("lo_gap"), none.cast("bigint").alias("lo_off"), F.col("rank").alias("hi"),
        none.cast("double").alias("hi_gap"), none.cast("bigint").alias("hi_off"), F.floor(F.col("rank") / block).alias("at"), none.cast("bigint").alias("mdat_offset"), none.cast("double").alias("size_diff"),
    )
    shelf = checkpoint(shelf)
    unseen = [F.lit(-1.0), F.lit(-1).cast("bigint")]
    state = movies.join(u.filter("kind = 0"), own).select(
        "image_id", "off", "want", F.col("below").alias("lo"), unseen[0].alias("lo_gap"), unseen[1].alias("lo_off"), F.col("first").alias("hi"),
        unseen[0].alias("hi_gap"), unseen[1].alias("hi_off"), F.floor(F.col("first") / block).alias("at"), none.cast("bigint").alias("mdat_offset"), none.cast("double").alias("size_diff"),
    )
    state = checkpoint(state)
    place = ["image_id", "at"]
    schema = f"image_id {moov.schema['image_id'].dataType.simpleString()}, {MOVIE}"
    while state.filter("mdat_offset is null").head(1):
        busy = checkpoint(state.filter("mdat_offset is null").select(*place).distinct())
        rows = shelf.join(busy, place, "left_semi").withColumn("media", F.lit(True)).unionByName(state.join(busy, place, "left_semi").withColumn("media", F.lit(False)))
        met = rows.select(*state.columns, "media").repartition(*place).sortWithinPartitions(*place, F.desc("media"), F.when(F.col("media"), F.col("hi")), "off", "want")
        state = checkpoint(state.join(busy, place, "left_anti").select(*state.columns).unionByName(met.mapInArrow(_propose(block, tolerance), schema)))
    return state.select("image_id", F.col("off").alias("moov_offset"), "mdat_offset", "size_diff")


def chunk_offsets_in_mdat(offsets: DataFrame, mdat: DataFrame) -> DataFrame:
    """offsets(file_id, offset), mdat(file_id, mdat_offset, mdat_size): offsets outside the payload."""
    ok = (F.col("offset") >= F.col("mdat_offset") + 8) & (F.col("offset") < F.col("mdat_offset") + F.col("mdat_size"))
    return (
        offsets.join(mdat, "file_id")
        .groupBy("file_id")
        .agg(F.count(F.lit(1)).alias("offsets"), F.sum((~ok).cast("bigint")).alias("invalid"))
        .withColumn("invalid_ratio", F.col("invalid") / F.col("offsets"))
    )


def atom_flags(atoms: DataFrame, files: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Damage flags per file from its atom rows; files(file_id, file_size)."""
    need = required or CRITICAL_ATOMS
    top = F.col("level") == 0
    kind = F.col("atom_type")
    j = atoms.join(files, "file_id", "right")
    odd = ~F.regexp_replace(kind, " ", "").rlike("^[A-Za-z0-9]+$") | (F.col("size") < F.col("header_size")) | (F.col("offset") + F.col("size") > F.col("file_size"))
    g = j.groupBy("file_id").agg(
        F.max("file_size").alias("file_size"),
        F.collect_set(F.when(kind.isin(*need), kind)).alias("present"),  # at most len(need) values
        F.min_by(kind, F.when(top, F.col("offset"))).alias("first"),
        F.coalesce(F.sum(F.when(top, F.col("size"))), F.lit(0)).alias("covered"),
        F.bool_or(top & (kind == "moov")).alias("has_moov"),
        F.bool_or(top & (kind == "mdat")).alias("has_mdat"),
        F.min(F.when(top & (kind == "moov"), F.col("offset"))).alias("_mo"),
        F.min(F.when(top & (kind == "mdat"), F.col("offset"))).alias("_md"),
        F.coalesce(F.sum((top & (kind == "moof")).cast("bigint")), F.lit(0)).alias("fragments"),
        F.coalesce(F.bool_or(odd), F.lit(False)).alias("_odd"),
    )
    no = F.lit(False)
    g = g.withColumn("has_moov", F.coalesce("has_moov", no)).withColumn("has_mdat", F.coalesce("has_mdat", no))
    flags = F.array(
        F.when(F.size("present") < len(need), "MISSING_ATOMS"),
        F.when(F.coalesce(F.col("first") != "ftyp", F.lit(True)), "HEADER_CORRUPTION"),
        F.when(F.abs(F.col("covered") - F.col("file_size")) > 1024, "TRUNCATED_FILE"),
        F.when(~F.col("has_moov"), "METADATA_CORRUPTION"),
        F.when(~F.col("has_mdat"), "STRUCTURE_CORRUPTION"),
        F.when(F.col("_odd"), "ATOM_SIZE_MISMATCH"),
    )
    missing = F.array_except(F.array(*map(F.lit, need)), "present")
    return g.select(
        "file_id", "file_size", "has_moov", "has_mdat", F.coalesce(F.col("_mo") < F.col("_md"), no).alias("moov_first"), "fragments",
        missing.alias("missing"), F.filter(flags, lambda x: x.isNotNull()).alias("flags"),
    )


def missing_atoms(atoms: DataFrame, files: DataFrame, required: list[str]) -> DataFrame:
    """One row per (file, required type) that is absent."""
    want = files.select("file_id", F.explode(F.array(*map(F.lit, required))).alias("atom_type"))
    return want.join(atoms.select("file_id", "atom_type").filter(F.col("atom_type").isin(*required)).distinct(), ["file_id", "atom_type"], "left_anti")


def integrity_scores(flagged: DataFrame) -> DataFrame:
    f = lambda name, w: F.when(F.array_contains("flags", name), w).otherwise(0.0)
    floor0 = lambda x: F.greatest(x, F.lit(0.0))
    s = floor0(1.0 - f("MISSING_ATOMS", 0.4) - f("HEADER_CORRUPTION", 0.3) - f("TRUNCATED_FILE", 0.2))
    m = floor0(1.0 - F.when(~F.col("has_moov"), 0.6).otherwise(0.0) - f("METADATA_CORRUPTION", 0.3))
    p = floor0(1.0 - F.when(~F.col("has_mdat"), 0.5).otherwise(0.0) - f("INDEX_CORRUPTION", 0.3))
    out = flagged.withColumn("structure", s).withColumn("metadata", m).withColumn("playback", p)
    return out.withColumn("overall", F.col("structure") * 0.4 + F.col("metadata") * 0.3 + F.col("playback") * 0.3)


def repair_plan(scored: DataFrame) -> DataFrame:
    """Severity, tools, strategies, success rate, risk and advice from the overall score."""
    o = F.col("overall")

    def arr(*x):
        return F.array(*map(F.lit, x))

    def plan(severity, tools, steps, rate, risk):
        return F.struct(F.lit(severity).alias("severity"), arr(*tools).alias("tools"), arr(*steps).alias("strategies"), F.lit(rate).alias("success_rate"), F.lit(risk).alias("risk"))

    ladder = (
        F.when(o >= 0.8, plan("minimal", ["ffmpeg"], ["container_remux"], 0.9, "low"))
        .when(o >= 0.6, plan("mild", ["untrunc", "ffmpeg"], ["header_reconstruction", "container_remux"], 0.7, "medium"))
        .when(o >= 0.3, plan("moderate", ["mp4recover", "untrunc", "ffmpeg"], ["deep_scan", "fragment_recovery", "ai_enhancement"], 0.5, "high"))
        .otherwise(plan("severe", ["photorec", "mp4recover", "ai_enhancement"], ["fragment_recovery", "deep_scan", "custom_algorithms"], 0.2, "critical"))
    )
    has = lambda n: F.array_contains("flags", n)
    no_moov = has("MISSING_ATOMS") & F.array_contains("missing", "moov")
    late = ~F.col("moov_first") & F.col("has_moov") & F.col("has_mdat")
    advice = F.array(
        F.when(has("HEADER_CORRUPTION"), "Use untrunc with reference file for header reconstruction"),
        F.when(has("HEADER_CORRUPTION"), "Try FFmpeg with -f mp4 to force container format"),
        F.when(no_moov, "Critical: moov atom missing - try mp4recover for deep scan"),
        F.when(no_moov, "Use photorec for fragment recovery if other tools fail"),
        F.when(has("TRUNCATED_FILE"), "File appears truncated - check for additional fragments"),
        F.when(has("TRUNCATED_FILE"), "Use FFmpeg with -avoid_negative_ts make_zero"),
        F.when(late, "moov atom after mdat - use FFmpeg to optimize structure"),
        F.when(F.col("fragments") > 0, "Fragmented MP4 detected - ensure proper fragment handling"),
        F.when(o < 0.5, "Severe corruption detected - try multiple tools in sequence"),
        F.when(o < 0.5, "Consider AI-enhanced repair for best quality recovery"),
    )
    return scored.withColumn("plan", ladder).select(
        "file_id", "overall", "plan.*", F.filter(advice, lambda x: x.isNotNull()).alias("recommendations")
    )


def reorder_atoms(atoms: DataFrame) -> DataFrame:
    """ftyp, moov, mdat in that order with new offsets; only files that have all three. The last of a type wins."""
    order = F.when(F.col("atom_type") == "ftyp", 0).when(F.col("atom_type") == "moov", 1).when(F.col("atom_type") == "mdat", 2)
    last = (
        atoms.filter((F.col("level") == 0) & F.col("atom_type").isin("ftyp", "moov", "mdat"))
        .groupBy("file_id", order.alias("ord")).agg(F.max_by(F.struct("atom_type", "offset", "size"), "offset").alias("a"))
    )
    three = last.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "a"))).alias("l")).filter(F.size("l") == 3)
    upto = lambda i: F.aggregate(F.slice("l", 1, i), F.lit(0).cast("bigint"), lambda s, x: s + x["a"]["size"])
    return three.select("file_id", F.posexplode("l").alias("i", "x"), "l").select(
        "file_id", F.col("x.a.atom_type").alias("atom_type"), F.col("x.a.offset").alias("old_offset"), F.col("x.a.size").alias("size"),
        F.when(F.col("i") == 0, F.lit(0).cast("bigint")).otherwise(upto(F.greatest(F.col("i"), F.lit(1)))).alias("new_offset"),
    )
