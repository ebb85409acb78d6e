"""Exact medians without collecting a group: counts per value, prefix sums, pick the middle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefield.operators import ordered as od
from tracefield.session import checkpoint


CUTS = 256


def exact_median(df: DataFrame, keys: list[str], value: Column, out: str = "median") -> DataFrame:
    """Median per key (keys may be empty).

    The prefix sum runs in buckets whose bounds are approximate quantiles of
    each key's distinct values, so a bucket holds a like share of them whatever
    their range. Bounds decide only where the work is done, not the result.
    """
    counts = df.select(*keys, value.alias("_x")).filter("_x is not null").groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    counts = checkpoint(counts)
    shares = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    bounds = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_x", shares, F.lit(4 * CUTS))).alias("_cuts"))
    if keys:
        cut = counts.join(bounds, keys)
    else:
        first = bounds.first()
        cut = counts.withColumn("_cuts", F.array(*[F.lit(x) for x in first["_cuts"]]) if first and first["_cuts"] else F.lit(None).cast("array<double>"))
    bucket = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_x"))), F.lit(0))
    cut = cut.withColumn("_bucket", bucket).drop("_cuts")
    cum = od.running_sum(cut, keys, ["_x"], F.col("_bucket"), F.col("_n"), "_upto").drop("_bucket")
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        cum = cum.join(total, keys)
        n = F.col("_total")
    else:
        n = total.scalar()
    # 1-based ranks of the two middle rows
    lo, hi = F.floor((n + 1) / 2), F.floor((n + 2) / 2)
    first = F.col("_upto") - F.col("_n") + 1
    return (
        cum.groupBy(*keys)
        .agg(
            F.max(F.when((first <= lo) & (lo <= F.col("_upto")), F.col("_x"))).alias("_lo"),
            F.max(F.when((first <= hi) & (hi <= F.col("_upto")), F.col("_x"))).alias("_hi"),
        )
        .select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(out))
    )
