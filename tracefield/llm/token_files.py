"""Token files: one zstandard frame per document, a document index and a trailing seek table.

File layout (little-endian): the documents' frames in order; a skippable frame
with the index (for each frame: id present flag, doc_id, number of ids, crc32
of the ids); a skippable frame with the seek table of the public "zstd seekable
format" (for each frame: compressed size, decompressed size, low 32 bits of the
content's XXH64; then number of frames, descriptor 0x80, magic 0x8F92EAB1). A
plain zstd decoder reads the whole file; a reader that wants some documents
reads the tail and then only their frames, each checked against its sum.

Files are written by tasks to a shared folder through ``pyarrow.fs`` under a
name of the attempt; only the files that finished tasks report count, so lost
or repeated attempts leave nothing behind that a reader would take.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefield.llm.common import partitions, slices
from tracefield.llm.tokens import encoder
from tracefield.session import checkpoint, work_dir

# fixed values of the public zstd seekable format
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
INDEX = np.dtype([("there", "<u1"), ("doc_id", "<i8"), ("n_tokens", "<i8"), ("crc32", "<u4")])
SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


def tail(index: np.ndarray, seek: np.ndarray) -> bytes:
    """Index and seek table as they end a file."""
    table = seek.tobytes() + struct.pack("<IBI", len(seek), 0x80, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_INDEX, index.nbytes) + index.tobytes() + struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table


def read_tail(file) -> tuple[np.ndarray, np.ndarray]:
    """(index, seek table) from the end of an open file, read from its last bytes only."""
    end = file.size()
    n, descriptor, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
    if magic != SEEK_MAGIC or descriptor != 0x80:
        raise ValueError("no seek table at the end of the file")
    seek_bytes, index_bytes = n * SEEK.itemsize, n * INDEX.itemsize
    start = end - 9 - seek_bytes - 8 - index_bytes
    raw = file.read_at(end - 9 - start, start)
    index = np.frombuffer(raw, INDEX, n)
    return index, np.frombuffer(raw, SEEK, n, offset=index_bytes + 8)


def open_uri(path: str, mode: str):
    """Open a path of a shared store: a URI that pyarrow knows (file, s3, gs, hdfs), or a plain path."""
    place, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "r":
        return place.open_input_file(name)
    place.create_dir(name.rpartition("/")[0], recursive=True)
    return place.open_output_stream(name, compression=None)


def _frames(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, crc32, sum, frame) of every text: the expensive part, one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, "word")
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
        for big in batches:
            for b in slices(big, text_col):
                ids, lengths = encode(b.column(text_col).to_pylist())
                stop, rows = 0, []
                for n in lengths.tolist():
                    raw = np.append(ids[stop : stop + n], np.uint32(end_id)).astype("<u4").tobytes()
                    stop += n
                    rows.append((n + 1, zlib.crc32(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF, pack.compress(raw)))
                n, crc, total, frame = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(frame, pa.binary())], ["doc_id", "n_tokens", "crc32", "sum", "frame"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "doc_id long, n_tokens long, crc32 long, sum long, frame binary")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, docs_per_file: int = 4096) -> DataFrame:
    """Write token files in ascending id order; the manifest (part, path, docs, tokens) of what counts.

    File number and order follow the ids: the ids' ranges are cut from their
    distribution (ids only), so every file holds about ``docs_per_file``
    documents and its task a stream of them. Null ids come first, equal ids in
    order of their content; other columns are ignored.
    """
    spark = docs.sparkSession
    frames = checkpoint(_frames(docs, tokenizer, id_col, text_col, end_id))
    files = max(1, -(-frames.count() // docs_per_file))
    cuts = sorted({int(x) for x in frames.stat.approxQuantile("doc_id", [i / files for i in range(1, files)], min(0.001, 0.1 / files))}) if files > 1 else []
    cuts = np.asarray(cuts, np.int64)
    target = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for number, doc, n, crc, total, frame in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "crc32", "sum", "frame")), strict=True):
                if out is None or out["part"] != number:
                    if out:
                        yield close(out)
                    path = f"{target}/part-{number:08d}-{uuid.uuid4().hex}.tok.zst"
                    out = {"part": number, "path": path, "file": open_uri(path, "w"), "index": [], "seek": []}
                out["file"].write(frame)
                out["index"].append((doc is not None, doc or 0, n, crc))
                out["seek"].append((len(frame), 4 * n, total))
        if out:
            yield close(out)

    def close(out) -> pa.RecordBatch:
        out["file"].write(tail(np.array(out["index"], INDEX), np.array(out["seek"], SEEK)))
        out["file"].close()
        tokens = sum(x[2] for x in out["index"])
        return pa.RecordBatch.from_pydict({"part": [out["part"]], "path": [out["path"]], "docs": [len(out["index"])], "tokens": [tokens]}, pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        """Number of cuts at or below an id; null ids come first."""
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).astype(np.int64), "right")).astype(np.int32))

    tasks = max(1, min(len(cuts) + 1, 4 * partitions(spark)))
    dealt = frames.withColumn("part", part_of("doc_id")).repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int"))
    return checkpoint(dealt.sortWithinPartitions("part", "doc_id", "crc32", "n_tokens").mapInArrow(write, "part int, path string, docs long, tokens long"))


def read_token_files(manifest: DataFrame, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 and, if asked for, their ids.

    ``start`` counts the ids of all documents before, in file order. With
    ``wanted``, only the frames of those doc_ids are decompressed. A frame that
    does not fit its checksum is an error.
    """
    spark = manifest.sparkSession
    # one row per file: a running sum over the manifest only
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    asked = None if wanted is None else np.unique(np.asarray(wanted, np.int64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                with open_uri(path, "r") as file:
                    index, seek = read_tail(file)
                    at = np.cumsum(np.r_[0, seek["packed"].astype(np.int64)])
                    start = base + np.cumsum(np.r_[0, index["n_tokens"]])
                    pick = np.arange(len(index)) if asked is None else np.flatnonzero(np.isin(index["doc_id"], asked) & (index["there"] == 1))
                    for chunk in np.array_split(pick, max(1, -(-len(pick) // 512))):
                        rows = []
                        for i in chunk.tolist():
                            raw = unpack.decompress(file.read_at(int(seek["packed"][i]), int(at[i])), max_output_size=int(seek["size"][i]))
                            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(seek["sum"][i]):
                                raise ValueError(f"frame {i} of {path} does not fit its checksum")
                            ids = np.frombuffer(raw, "<u4")
                            rows.append((int(index["doc_id"][i]) if index["there"][i] else None, int(start[i]), len(ids), zlib.crc32(raw), ids if with_ids else None))
                        if rows:
                            doc, first, n, crc, ids = zip(*rows, strict=True)
                            cols = [pa.array(doc, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                            if with_ids:
                                cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                                names.append("ids")
                            yield pa.RecordBatch.from_arrays(cols, names)

    spread = files.repartition(max(1, 2 * spark.sparkContext.defaultParallelism), "path")
    return spread.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def token_folder(spark) -> str:
    """A new folder on the shared storage."""
    return f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
