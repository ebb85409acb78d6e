"""Filesystem records: detection, boot sector, superblock, file table."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.functions.bytesops import byte_at, le_uint, magic
from tracefield.session import MAX_SMALL_ROWS, checkpoint

RECORD = 1024
#: bytes of torn records that one task sorts, about
PART_BYTES = 1 << 25


def fs_detect(data: Column) -> Column:
    """NTFS is tried before EXT4. ``data`` is the first 2 KiB or more of a volume."""
    boot = F.substring(data, 1, 512)
    ntfs = magic(data, b"NTFS    ".hex(), 3) | (magic(data, "EB5290") & F.contains(boot, F.unhex(F.lit(b"NTFS".hex()))))
    ext4 = le_uint(data, 1024 + 0x38, 2) == 0xEF53
    return F.when(ntfs, "NTFS").when(F.coalesce(ext4, F.lit(False)), "EXT4").otherwise("UNKNOWN")


def ntfs_boot(volumes: DataFrame, key: str, data: str = "data") -> DataFrame:
    d = F.col(data)
    base = volumes.select(
        key,
        le_uint(d, 0x0B, 2).alias("bytes_per_sector"),
        byte_at(d, 0x0D).alias("sectors_per_cluster"),
        le_uint(d, 0x28, 8).alias("total_sectors"),
        le_uint(d, 0x30, 8).alias("mft_cluster"),
        le_uint(d, 0x38, 8).alias("mirror_cluster"),
        le_uint(d, 0x48, 8).alias("serial"),
    )
    cluster = F.col("bytes_per_sector") * F.col("sectors_per_cluster")
    return base.withColumn("cluster_size", cluster).withColumn(
        "total_size", F.col("total_sectors") * F.col("bytes_per_sector")
    ).withColumn("mft_offset", F.col("mft_cluster") * cluster)


def ext4_super(volumes: DataFrame, key: str, data: str = "data") -> DataFrame:
    s = F.substring(F.col(data), 1025, 1024)
    blocks, log = le_uint(s, 0x04, 4), le_uint(s, 0x18, 4)
    size = F.lit(1024).cast("bigint") * F.pow(F.lit(2.0), log).cast("bigint")
    label = F.rtrim(F.decode(F.substring(s, 0x78 + 1, 16), "UTF-8"), F.lit("\x00"))
    return volumes.select(key, blocks.alias("blocks"), size.alias("block_size"), (blocks * size).alias("total_size"), label.alias("label"))


def mft_records(images: DataFrame, key: str, mft_offset: Column, data: str = "data") -> DataFrame:
    """1024-byte rows from the table's offset to the end of the data."""
    n = F.floor((F.octet_length(data) - mft_offset) / RECORD)
    return images.filter(n > 0).select(
        key,
        F.posexplode(
            F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.substring(F.col(data), (mft_offset + i * RECORD + 1).cast("int"), F.lit(RECORD)))
        ).alias("record_no", "record"),
    )


def mft_slices(chunks: DataFrame, tables: DataFrame) -> DataFrame:
    """(image_id, record_no, record): the 1024-byte rows of file tables in chunked volumes, for chunks of any sizes.

    chunks: image_id, base_offset, data; tables: image_id, mft_offset. Which
    records a chunk holds, or holds parts of, follows from offsets alone. Whole
    ones stay where they are; only parts of a record are brought together, in
    partitions of about PART_BYTES. A record of which bytes are missing is left out.
    """
    tables = checkpoint(tables.select("image_id", "mft_offset"))
    if tables.count() <= MAX_SMALL_ROWS:  # counted: else all chunks of a volume would meet its one row in one task
        tables = F.broadcast(tables)
    low = (F.col("base_offset") - F.col("mft_offset")).cast("bigint")
    high = low + F.octet_length("data")
    held = chunks.join(tables, "image_id").filter((high > 0) & (F.octet_length("data") > 0))

    def part(n):
        begin, end = F.greatest(n * RECORD, low), F.least((n + 1) * RECORD, high)
        return F.struct(n.alias("record_no"), (begin - n * RECORD).cast("int").alias("at"), F.substring(F.col("data"), (begin - low + 1).cast("int"), (end - begin).cast("int")).alias("record"))

    numbers = F.sequence(F.floor(F.greatest(low, F.lit(0)) / RECORD).cast("bigint"), F.floor((high - 1) / RECORD).cast("bigint"))
    parts = held.select("image_id", F.inline(F.transform(numbers, part)))
    whole = parts.filter(F.octet_length("record") == RECORD).select("image_id", "record_no", "record")
    # a chunk holds parts of two records at most, its first and its last
    most = chunks.agg(F.sum(F.least(F.octet_length("data"), F.lit(2 * RECORD)) + 64).cast("bigint")).first()[0] or 0
    torn = parts.filter(F.octet_length("record") < RECORD).repartition(most // PART_BYTES + 1, "image_id", "record_no").groupBy("image_id", "record_no").agg(
        F.array_sort(F.collect_list(F.struct("at", "record"))).alias("p"), F.sum(F.octet_length("record")).alias("n")
    )
    joined = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["record"]))
    glued = torn.filter(F.col("n") == RECORD).select("image_id", "record_no", joined.alias("record"))
    return whole.unionByName(glued)


def _attributes(rec: bytes):
    """(kind, offset, length) of each attribute until the end mark or a zero length."""
    (at,) = struct.unpack_from("<H", rec, 0x14)
    while at < len(rec) - 4:
        (kind,) = struct.unpack_from("<I", rec, at)
        if kind == 0xFFFFFFFF or at + 8 > len(rec):
            return
        (length,) = struct.unpack_from("<I", rec, at + 4)
        yield kind, at, length
        if length == 0:
            return
        at += length


_ENTRY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("is_directory", T.BooleanType()), T.StructField("is_deleted", T.BooleanType()),
])


@F.pandas_udf(_ENTRY)
def mft_entry_udf(record: pd.Series) -> pd.DataFrame:
    rows = []
    for rec in record:
        (flags,) = struct.unpack_from("<H", rec, 0x16)
        name, size = None, 0
        for kind, at, length in _attributes(rec):
            if kind == 0x30 and 0 < length <= len(rec) - at:
                body = rec[at + 24 : at + length]
                chars = body[64] if len(body) > 64 else 0
                if chars and len(body) > 66 + 2 * chars:
                    name = body[66 : 66 + 2 * chars].decode("utf-16le", "ignore")
            elif kind == 0x80 and length >= 16 and at + 16 <= len(rec):
                (size,) = struct.unpack_from("<Q", rec, at + 8)
        rows.append((name, size, bool(flags & 2), not flags & 1))
    return pd.DataFrame(rows, columns=["name", "size", "is_directory", "is_deleted"])


def mft_scan(records: DataFrame, key: str) -> DataFrame:
    """File entries of the records that carry the FILE mark."""
    good = records.filter(magic(F.col("record"), b"FILE".hex()) & (F.octet_length("record") >= 48))
    e = good.select(key, "record_no", mft_entry_udf(F.col("record")).alias("e"))
    name = F.coalesce("e.name", F.concat(F.lit("MFT_Record_"), F.col("record_no").cast("string")))
    return e.select(
        key, F.col("record_no").alias("inode"), name.alias("name"),
        F.concat(F.lit("/MFT_"), F.col("record_no").cast("string"), F.lit("/"), name).alias("path"),
        "e.size", "e.is_directory", "e.is_deleted",
    )
