"""Byte-exact expressions and byte statistics.

Counting bytes is the one thing SQL does badly (a row per byte), so the
histogram is an Arrow UDF over whole batches; everything after it (256 counts
per cell) is ordinary aggregation.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.session import checkpoint, rows_a_batch


def byte_at(data: Column, offset: int) -> Column:
    """Value 0..255 of one byte (0-based offset); null past the end."""
    return F.conv(F.nullif(F.hex(F.substring(data, offset + 1, 1)), F.lit("")), 16, 10).cast("int")


def be_uint(data: Column, offset: int, n: int) -> Column:
    """Big-endian unsigned integer of ``n`` bytes; null past the end."""
    part = F.substring(data, offset + 1, n)
    value = F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(part) == n, value if n > 7 else value.cast("bigint"))


def le_uint(data: Column, offset: int, n: int) -> Column:
    """Little-endian unsigned integer of ``n`` bytes; null past the end."""
    turned = F.concat(*[F.substring(data, offset + i + 1, 1) for i in range(n - 1, -1, -1)])
    value = F.conv(F.hex(turned), 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(turned) == n, value if n > 7 else value.cast("bigint"))


def hex_bytes(text: Column) -> Column:
    """Hex text with any white space in it to bytes; empty text is null."""
    return F.unhex(F.nullif(F.regexp_replace(text, r"\s", ""), F.lit("")))


def magic(data: Column, hex_magic: str, offset: int = 0) -> Column:
    return F.substring(data, offset + 1, len(hex_magic) // 2) == F.unhex(F.lit(hex_magic))


@F.pandas_udf(T.ArrayType(T.LongType()))
def histogram_udf(data: pd.Series) -> pd.Series:
    """256 byte counts per cell."""
    return data.map(lambda d: np.bincount(np.frombuffer(d, np.uint8), minlength=256) if d is not None else None)


def _entropy(d) -> float:
    if not d:
        return 0.0
    n = np.bincount(np.frombuffer(d, np.uint8), minlength=256)
    n = n[n > 0]
    # sum over n log n keeps the value the same whatever the order of bytes
    return float(np.log2(len(d)) - (n * np.log2(n)).sum() / len(d))


@F.pandas_udf(T.DoubleType())
def entropy_udf(data: pd.Series) -> pd.Series:
    """Shannon entropy in bits per byte; empty is 0."""
    return data.map(_entropy)


@F.pandas_udf(T.BinaryType())
def xor_udf(parts: pd.Series) -> pd.Series:
    """XOR of an array of buffers; a short one counts as zero-padded."""

    def one(bufs):
        out = np.zeros(max((len(b) for b in bufs), default=0), np.uint8)
        for b in bufs:
            out[: len(b)] ^= np.frombuffer(b, np.uint8)
        return out.tobytes()

    return parts.map(one)


def arrays_type(**fields) -> T.StructType:
    """One array per field: cheaper to hand over than an array of structs."""
    return T.StructType([T.StructField(k, T.ArrayType(v)) for k, v in fields.items()])


def inline_arrays(df: DataFrame, keep: list[str], packed: Column) -> DataFrame:
    """Rows of a struct of equally long arrays."""
    names = packed_names(df, packed)
    return df.select(*keep, packed.alias("_p")).select(
        *keep, F.inline(F.arrays_zip(*[F.col(f"_p.{n}") for n in names]))
    )


def packed_names(df: DataFrame, packed: Column) -> list[str]:
    return df.select(packed.alias("_p")).schema["_p"].dataType.names


def ngram_udf(n: int):
    @F.pandas_udf(arrays_type(gram=T.LongType(), n=T.LongType()))
    def grams(data: pd.Series) -> pd.DataFrame:
        rows = []
        for d in data:
            a = np.frombuffer(d, np.uint8).astype(np.int64)
            code = np.zeros(max(len(a) - n + 1, 0), np.int64)
            for i in range(n):
                code = code * 256 + a[i : i + len(code)]
            rows.append(np.unique(code, return_counts=True))
        return pd.DataFrame(rows, columns=["gram", "n"])

    return grams



def strings_udf(min_len: int = 4):
    @F.pandas_udf(arrays_type(offset=T.LongType(), value=T.StringType()))
    def runs(data: pd.Series) -> pd.DataFrame:
        find = re.compile(rb"[\x20-\x7e]{%d,}" % min_len).finditer
        rows = []
        for d in data:
            found = list(find(d))
            rows.append(([m.start() for m in found], [m.group().decode("ascii") for m in found]))
        return pd.DataFrame(rows, columns=["offset", "value"])

    return runs


def extract_strings(df: DataFrame, key: str, data: str = "data", min_len: int = 4) -> DataFrame:
    """Runs of printable ASCII, one row each."""
    return inline_arrays(df, [key], strings_udf(min_len)(F.col(data)))


def byte_histogram(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """Sparse histogram rows (keys, b, n); cells of the same keys add up."""
    return (
        df.select(*keys, F.posexplode(histogram_udf(F.col(data))).alias("b", "n"))
        .filter("n > 0")
        .groupBy(*keys, "b")
        .agg(F.sum("n").alias("n"))
    )


def entropy_of(hist: DataFrame, keys: list[str]) -> DataFrame:
    """log2(N) - sum(n log2 n) / N over histogram rows: one pass, no second total."""
    n = F.col("n")
    return hist.groupBy(*keys).agg(
        F.sum("n").alias("size"),
        (F.log2(F.sum("n")) - F.sum(n * F.log2(n)) / F.sum("n")).alias("entropy"),
    )


def byte_profile(hist: DataFrame, keys: list[str]) -> DataFrame:
    b, n = F.col("b"), F.col("n")

    def share(cond):
        return F.sum(F.when(cond, n).otherwise(0)) / F.sum("n")

    return hist.groupBy(*keys).agg(
        share(b == 0).alias("null_ratio"),
        share((b >= 32) & (b <= 126)).alias("printable_ratio"),
        share(b >= 128).alias("high_ratio"),
        F.count(F.lit(1)).alias("distinct_bytes"),
        F.max_by("b", F.struct("n", -b)).alias("top_byte"),
        (F.max("n") / F.sum("n")).alias("top_share"),
    )


def byte_freq_stats(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics over the 256 counts, absent bytes counting as zero."""
    n = F.col("n")
    mean = F.sum("n") / 256
    var = F.sum(n * n) / 256 - mean * mean
    g = hist.groupBy(*keys).agg(
        mean.alias("mean"),
        var.alias("var"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"),
        F.max("n").alias("max"),
        F.when(F.count(F.lit(1)) < 256, F.lit(0)).otherwise(F.min("n")).alias("min"),
        F.count(F.lit(1)).alias("unique"),
        F.sum((n == 1).cast("bigint")).alias("singletons"),
        F.sort_array(F.collect_list("n")).alias("_n"),  # at most 256 values
    )
    # median of 256 values = mean of the 128th and 129th once zeros are in front
    pad = F.lit(256) - F.size("_n")
    at = lambda k: F.when(pad >= k, 0).otherwise(F.try_element_at("_n", k - pad))
    return (
        g.withColumn("median", (at(128) + at(129)) / 2)
        .withColumn("above_mean", F.size(F.filter("_n", lambda x: x > F.col("mean"))))
        .drop("_n")
    )


def blocks(df: DataFrame, keys: list[str], block: int, data: str = "data") -> DataFrame:
    """Cut each cell into ``block``-byte pieces: (keys, block_no, piece)."""
    size = F.octet_length(data)
    return df.filter(size > 0).select(
        *keys,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int")),
                lambda i: F.substring(F.col(data), i * block + 1, F.lit(block)),
            )
        ).alias("block_no", "piece"),
    )


def entropy_blocks(df: DataFrame, keys: list[str], block: int, data: str = "data") -> DataFrame:
    e = F.col("entropy")
    return (
        blocks(df, keys, block, data)
        .select(*keys, "block_no", F.octet_length("piece").alias("size"), entropy_udf(F.col("piece")).alias("entropy"))
        .withColumn("encrypted", e > 7.5)
        .withColumn("compressed", (e > 6.0) & (e <= 7.5))
    )


def entropy_summary(block_rows: DataFrame, keys: list[str], whole: DataFrame) -> DataFrame:
    """Spread of block entropies and a verdict from the whole file's entropy."""
    e = F.col("file_entropy")
    return (
        block_rows.groupBy(*keys)
        .agg(
            F.min("entropy").alias("min_entropy"),
            F.max("entropy").alias("max_entropy"),
            F.avg("entropy").alias("mean_entropy"),
            F.var_pop("entropy").alias("var_entropy"),
            F.stddev_pop("entropy").alias("std_entropy"),
        )
        .join(whole.select(*keys, F.col("entropy").alias("file_entropy")), keys)
        .withColumn(
            "verdict",
            F.when(e > 7.8, "encrypted").when(e > 7.0, "compressed").when(e > 5.0, "mixed").otherwise("plain"),
        )
    )


def section_entropy(df: DataFrame, keys: list[str], sections: int = 10, data: str = "data") -> DataFrame:
    """Entropy of equal sections; the last takes the remainder, empty ones are 0."""
    size = F.octet_length(data)
    sec = F.floor(size / sections).cast("int")
    return df.select(
        *keys,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.lit(sections - 1)),
                lambda i: F.substring(
                    F.col(data), i * sec + 1, F.when(i < sections - 1, sec).otherwise(size)
                ),
            )
        ).alias("section", "piece"),
    ).select(*keys, "section", entropy_udf(F.col("piece")).alias("entropy"))


def ngram_counts(df: DataFrame, keys: list[str], n: int, data: str = "data") -> DataFrame:
    """Counts per cell inside the task, then one sum per (keys, gram)."""
    return (
        inline_arrays(df, keys, ngram_udf(n)(F.col(data)))
        .groupBy(*keys, "gram")
        .agg(F.sum("n").alias("n"))
    )


def binary_type(df: DataFrame, key: str, data: str = "data") -> DataFrame:
    """Coarse class from whole-cell entropy, byte shares and the first 64 bytes."""
    hist = byte_histogram(df, [key], data)
    stats = entropy_of(hist, [key]).join(byte_profile(hist, [key]), key)
    head = df.select(
        key,
        F.octet_length(data).alias("_len"),
        F.size(F.array_distinct(F.regexp_extract_all(F.hex(F.substring(data, 1, 64)), F.lit(".."), F.lit(0)))).alias("_head"),
    )
    return head.join(stats, key, "left").select(
        key,
        F.when(F.col("entropy") > 7.5, "compressed_or_encrypted")
        .when(F.col("null_ratio") > 0.5, "sparse_data")
        .when(F.col("printable_ratio") > 0.7, "text_like_binary")
        .when((F.col("_len") > 64) & (F.col("_head") > 10), "structured_binary")
        .otherwise("unknown_binary")
        .alias("binary_type"),
    )


_RANDOM = T.StructType([
    T.StructField("size", T.LongType()), T.StructField("entropy", T.DoubleType()), T.StructField("chi_square", T.DoubleType()), T.StructField("repeats", T.BooleanType()),
])


@F.pandas_udf(_RANDOM)
def cell_randomness_udf(data: pd.Series) -> pd.DataFrame:
    """Size, entropy and chi-square of the byte counts of one cell (not empty), and whether some whole 16-byte block occurs twice (null: it has none)."""
    rows = []
    for d in data:
        size, n = len(d), np.bincount(np.frombuffer(d, np.uint8), minlength=256)
        n = n[n > 0]
        repeats = len({d[i : i + 16] for i in range(0, size - 15, 16)}) < size // 16 if size >= 16 else None
        rows.append((size, np.log2(size) - (n * np.log2(n)).sum() / size, (n * n).sum() * 256 / size - size, repeats))
    return pd.DataFrame(rows, columns=["size", "entropy", "chi_square", "repeats"])


def randomness(df: DataFrame, key: str, data: str = "data", chi_limit: float = 310.457) -> DataFrame:
    """Stream-cipher or block-cipher look.

    Uniform: chi-square of the 256 counts below ``chi_limit`` (255 degrees, 1 %).
    Block structure: some 16-byte block occurs twice. A cell is judged where it
    lies; counts and blocks are grouped only for keys of several cells.
    """
    n = F.col("n")
    with rows_a_batch(df.sparkSession, 1024):
        cells = df.filter((F.octet_length(data) > 0) & F.col(key).isNotNull()).select(key, cell_randomness_udf(F.col(data)).alias("c")).select(key, "c.*")
        every = checkpoint(cells.groupBy(key).agg(F.count(F.lit(1)).alias("_cells"), *(F.max(c).alias(c) for c in ("size", "entropy", "chi_square", "repeats"))))
    chi = every.filter("_cells = 1").drop("_cells")
    several = every.filter("_cells > 1").select(key)
    if several.head(1):
        parts = df.join(several, key, "left_semi")
        hist = byte_histogram(parts, [key], data)
        shared = entropy_of(hist, [key]).join(hist.groupBy(key).agg((F.sum(n * n) * 256 / F.sum(n) - F.sum(n)).alias("chi_square")), key)
        repeated = (
            blocks(parts, [key], 16, data)
            .filter(F.octet_length("piece") == 16)
            .groupBy(key, "piece").count()
            .groupBy(key).agg((F.max("count") > 1).alias("repeats"))
        )
        chi = chi.unionByName(shared.join(repeated, key, "left"))
    e = F.col("entropy")
    verdict = (
        F.when((e > 7.9) & (F.col("chi_square") < chi_limit), "stream_cipher")
        .when((e > 7.5) & F.coalesce("repeats", F.lit(False)), "block_cipher")
    )
    return (
        chi
        .withColumn("verdict", F.coalesce(verdict, F.lit("none")))
        .withColumn(
            "confidence",
            F.when(F.col("verdict") == "stream_cipher", 0.6).when(F.col("verdict") == "block_cipher", 0.5).otherwise(0.0),
        )
    )
