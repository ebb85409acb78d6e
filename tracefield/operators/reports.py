"""Validation statistics and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recovery_stats(validated: DataFrame) -> DataFrame:
    """Totals over (size, errors); an empty input has success 0."""
    ok = F.size("errors") == 0
    n = F.count(F.lit(1))
    return validated.agg(
        n.alias("total"),
        F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("valid"),
        F.coalesce(F.sum((~ok).cast("bigint")), F.lit(0)).alias("corrupted"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.when(n > 0, F.sum(ok.cast("bigint")) * 100.0 / n).otherwise(0.0).alias("success_pct"),
    )


def type_breakdown(files: DataFrame) -> DataFrame:
    """Major part of the MIME type, else the lower-case suffix, else ``unknown``."""
    kind = F.coalesce(F.split("mime", "/")[0], F.nullif(F.lower("ext"), F.lit("")), F.lit("unknown"))
    return files.groupBy(kind.alias("file_type")).agg(F.count(F.lit(1)).alias("files"))


def failures_head(validated: DataFrame, key: str, n: int = 50) -> DataFrame:
    """First ``n`` failures and how many more there are."""
    bad = validated.filter(F.size("errors") > 0)
    more = bad.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0))).scalar()
    return bad.orderBy(key).limit(n).withColumn("more", more)


def write_report(validated: DataFrame, key: str, out_dir: str, n: int = 50) -> None:
    """JSON and text report: totals, breakdown sorted by type, first failures."""
    stats, kinds, fails = recovery_stats(validated), type_breakdown(validated).orderBy("file_type"), failures_head(validated, key, n)
    stats.write.mode("overwrite").json(f"{out_dir}/totals")
    kinds.coalesce(1).write.mode("overwrite").json(f"{out_dir}/types")
    fails.write.mode("overwrite").json(f"{out_dir}/failures")
    lines = (
        stats.select(F.lit(0).alias("k"), F.lit("").alias("s"), F.format_string("files %d, valid %d (%.1f%%), corrupted %d, %d bytes", "total", "valid", "success_pct", "corrupted", "bytes").alias("line"))
        .unionByName(kinds.select(F.lit(1).alias("k"), F.col("file_type").alias("s"), F.format_string("%s: %d", "file_type", "files").alias("line")))
        .unionByName(fails.select(F.lit(2).alias("k"), F.col(key).cast("string").alias("s"), F.concat_ws(" ", F.col(key).cast("string"), F.array_join("errors", ", ")).alias("line")))
        .unionByName(fails.select(F.lit(3).alias("k"), F.lit("").alias("s"), F.format_string("... and %d more", "more").alias("line")).limit(1))
    )
    lines.orderBy("k", "s").select("line").coalesce(1).write.mode("overwrite").text(f"{out_dir}/text")


def export_results(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Write rows as json, csv, text or parquet, by name or by suffix."""
    kind = (fmt or path.rsplit(".", 1)[-1]).lower()
    writer = df.write.mode("overwrite")
    if kind == "json":
        writer.json(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("txt", "text"):
        df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {kind}")
