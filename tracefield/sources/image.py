"""Byte images as chunk tables, read in parallel byte ranges."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tracefield.session import checkpoint
from tracefield.sources.filesets import store_of

CHUNK_SCHEMA = "image_id string, chunk_no bigint, base_offset bigint, length int, data binary"
MIB = 1 << 20
OPEN_COST = MIB // 16  # bytes that could be read while a file is opened


class ByteRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ByteRanges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class ByteImageReader(DataSourceReader):
    """Partitions of runs of chunks; each task reads its own ranges of the shared files.

    A large file is dealt over many partitions, many small files share one: a
    partition takes ``chunksperpartition`` chunks, or the 64th part of a small
    input (1 to 128 MiB), opening a file being counted too.

    The path is a file, or a folder whose files are images each; a plain path
    or a URI of a store that pyarrow knows (file, hdfs, s3, gs).
    """

    def __init__(self, options):
        self.path = options["path"]
        self.chunk = int(options.get("chunk", 16 * MIB))
        self.overlap = int(options.get("overlap", 0))
        self.run = int(options.get("chunksperpartition", 8))

    def partitions(self):
        store, name = self.store()
        info = store.get_file_info(name)
        files = store.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
        files = [f for f in files if f.type == fs.FileType.File and f.size]
        total = sum(max(f.size, OPEN_COST) for f in files)
        room = max(self.run * self.chunk, min(128 * MIB, max(MIB, total // 64)))
        out, ranges, load = [], [], 0
        for f in files:
            n = -(-f.size // self.chunk)
            step = room // self.chunk
            for i in range(0, n, step):
                last = min(i + step, n)
                cost = max(min(last * self.chunk, f.size) - i * self.chunk, OPEN_COST)
                if ranges and load + cost > room:
                    out.append(ByteRanges(ranges))
                    ranges, load = [], 0
                ranges.append((f.path, i, last))
                load += cost
        return [*out, ByteRanges(ranges)] if ranges else out

    def store(self):
        return fs.FileSystem.from_uri(self.path) if self.path.startswith("file:") or "://" in self.path else (fs.LocalFileSystem(), self.path)

    def read(self, part):
        store = self.store()[0]
        for path, first, last in part.ranges:
            with store.open_input_file(path) as f:
                for i in range(first, last):
                    f.seek(i * self.chunk)
                    data = f.read(self.chunk + self.overlap)
                    yield path, i, i * self.chunk, min(self.chunk, len(data)), data


class GrowingImageReader(ByteImageReader, DataSourceStreamReader):
    """Files that grow: an offset is the size seen of each; what is new is dealt out in ranges of ``chunk`` bytes.

    A file's bytes are given once, in order; where it ended between two chunk
    borders, the rest follows as a chunk of its own.
    """

    def initialOffset(self):
        return {}

    def latestOffset(self):
        store, name = self.store()
        info = store.get_file_info(name)
        files = store.get_file_info(fs.FileSelector(name, recursive=True)) if info.type == fs.FileType.Directory else [info]
        return {f.path: f.size for f in files if f.type == fs.FileType.File}

    def partitions(self, start, end):
        out, run = [], self.run * self.chunk
        for path, size in sorted(end.items()):
            out += [ByteRange(path, at, min(size, (at // run + 1) * run)) for at in range_starts(start.get(path, 0), size, run)]
        return out

    def read(self, part):
        with self.store()[0].open_input_file(part.path) as f:
            for at in range_starts(part.first, part.last, self.chunk):
                f.seek(at)
                data = f.read(min(part.last, (at // self.chunk + 1) * self.chunk) - at)
                yield part.path, at, at, len(data), data


def range_starts(first: int, last: int, step: int) -> list[int]:
    """``first`` and every multiple of ``step`` after it, below ``last``."""
    return ([first] if first < last else []) + list(range((first // step + 1) * step, last, step))


class ByteImageSource(DataSource):
    @classmethod
    def name(cls):
        return "byteimage"

    def schema(self):
        return CHUNK_SCHEMA

    def reader(self, schema):
        return ByteImageReader(self.options)

    def streamReader(self, schema):
        return GrowingImageReader(self.options)


def read_image(spark: SparkSession, path: str, chunk: int = 16 * MIB, overlap: int = 0) -> DataFrame:
    """Fixed-size chunks of one large file, or of every file of a folder, on storage every executor can open.

    ``length`` is a chunk's own size; with ``overlap`` its data also carries
    that many bytes of the next one.
    """
    spark.dataSource.register(ByteImageSource)
    return spark.read.format("byteimage").option("chunk", chunk).option("overlap", overlap).load(path)


def stream_image(spark: SparkSession, path: str, chunk: int = 16 * MIB) -> DataFrame:
    """``read_image`` as a stream over files that arrive and grow; ``chunk_no`` is the chunk's offset."""
    spark.dataSource.register(ByteImageSource)
    return spark.readStream.format("byteimage").option("chunk", chunk).load(path)


def read_small_images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Many small files, one chunk each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("image_id"), F.lit(0).cast("bigint").alias("chunk_no"), F.lit(0).cast("bigint").alias("base_offset"),
        F.col("length").cast("int").alias("length"), F.col("content").alias("data"),
    )


def scan_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """Files below ``root`` whose name ends, case ignored, in one of the extensions; contents are not read.

    Tasks list the folders, level by level, so neither the driver nor a plan
    holds the files; only one folder's own listing has to fit a task. As in
    Spark's own listings, names that begin with ``_`` or ``.`` are left out.
    """
    store, top = store_of(root)
    kind = store.get_file_info(top).type
    if kind == fs.FileType.NotFound:
        raise FileNotFoundError(root)
    top = top.rstrip("/") or "/"
    uri = root.rstrip("/")
    scheme = "file:" if isinstance(store, fs.LocalFileSystem) else uri.removesuffix(top)

    def look(batches):
        store = store_of(root)[0]
        for b in batches:
            for folder in b.column("folder").to_pylist():
                found = store.get_file_info(fs.FileSelector(folder) if kind == fs.FileType.Directory else [folder])
                for i in range(0, len(found), 10_000):
                    part = [f for f in found[i : i + 10_000] if f.type != fs.FileType.NotFound and not hidden(f.base_name)]
                    times = [f.mtime_ns and f.mtime_ns // 1_000_000 * 1000 for f in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.path for f in part], pa.string()), pa.array(times, pa.int64()).cast(pa.timestamp("us", "UTC")),
                         pa.array([f.size for f in part], pa.int64()), pa.array([f.type == fs.FileType.Directory for f in part], pa.bool_())],
                        names=["path", "modificationTime", "length", "is_folder"],
                    )

    hit = F.lit(False)
    for e in extensions:
        hit = hit | F.endswith(F.lower("path"), F.lit(e.lower()))
    level, found = spark.createDataFrame([(top,)], "folder string"), None
    while True:
        listed = level.mapInArrow(look, "path string, modificationTime timestamp, length bigint, is_folder boolean")
        listed = checkpoint(listed.filter(F.col("is_folder") | hit))
        files = listed.filter(~F.col("is_folder"))
        found = files if found is None else found.unionByName(files)
        folders = listed.filter("is_folder").select(F.col("path").alias("folder"))
        if not folders.head(1):
            break
        level = folders.repartition(spark.sparkContext.defaultParallelism)
    return found.select(F.concat(F.lit(scheme), "path").alias("path"), "modificationTime", (F.col("length") / MIB).alias("size_mb"))


def hidden(name: str) -> bool:
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
