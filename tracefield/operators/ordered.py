"""Ordered computations that stay parallel when one key holds most rows.

A plain ``Window.partitionBy(key).orderBy(ts)`` puts a whole key on one task.
Every function here takes ``bucket``: a column that never decreases along the
order (an hour, a day, ``floor(offset / span)``). Rows are windowed per
(key, bucket); what must cross a bucket edge travels in a table of one row per
(key, bucket), built with map-side combine, and is joined back. Results are
exact. ``order`` must be a total order inside a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefield.session import checkpoint

_B, _V, _C = "_bucket", "_edge", "_carry"


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "_part") -> DataFrame:
    """``df`` (written) with a bucket column of about equal row counts, whatever the keys and the order.

    Range partitions of (keys, order): their bounds come from a sample of the
    rows, their numbers never decrease along the order of a key. Rows equal in
    all of ``order`` share a bucket.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpoint(df.repartitionByRange(parts, *keys, *order).withColumn(out, F.spark_partition_id()))


def _join_edges(df: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join on keys + bucket; the big side is already hashed on them."""
    return df.join(edges, [*keys, _B], "left")


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    out: str,
    include_current: bool = False,
) -> DataFrame:
    """Last non-null ``value`` before each row (or up to it)."""
    src = df.withColumn(_B, bucket).withColumn(_V, value)
    inner = Window.partitionBy(*keys, _B).orderBy(*order)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    edges = src.groupBy(*keys, _B).agg(
        F.max_by(_V, F.when(F.col(_V).isNotNull(), F.struct(*order))).alias(_C)
    )
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn(_C, F.last(_C, ignorenulls=True).over(before))
    src = src.withColumn(out, F.last(_V, ignorenulls=True).over(inner))
    return (
        _join_edges(src, edges, keys)
        .withColumn(out, F.coalesce(out, _C))
        .drop(_B, _V, _C)
    )


def carry_next(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    out: str,
    include_current: bool = False,
) -> DataFrame:
    """First non-null ``value`` after each row (or from it).

    Written as the last one before it in reverse order: a frame that grows is
    kept up row by row, one that shrinks would be summed anew for every row.
    """
    src = df.withColumn(_B, bucket).withColumn(_V, value)
    inner = Window.partitionBy(*keys, _B).orderBy(*[F.col(c).desc() for c in order])
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    edges = src.groupBy(*keys, _B).agg(
        F.min_by(_V, F.when(F.col(_V).isNotNull(), F.struct(*order))).alias(_C)
    )
    after = Window.partitionBy(*keys).orderBy(F.col(_B).desc()).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn(_C, F.last(_C, ignorenulls=True).over(after))
    src = src.withColumn(out, F.last(_V, ignorenulls=True).over(inner))
    return (
        _join_edges(src, edges, keys)
        .withColumn(out, F.coalesce(out, _C))
        .drop(_B, _V, _C)
    )


def lag_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    out: str,
) -> DataFrame:
    """``lag(value, 1)``, nulls included."""
    boxed = carry_last(df, keys, order, bucket, F.struct(value.alias("v")), out)
    return boxed.withColumn(out, F.col(f"{out}.v"))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    out: str,
    include_current: bool = True,
) -> DataFrame:
    """Prefix sum: in-bucket running sum plus the total of earlier buckets."""
    src = df.withColumn(_B, bucket).withColumn(_V, value)
    inner = Window.partitionBy(*keys, _B).orderBy(*order)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        src.groupBy(*keys, _B)
        .agg(F.sum(_V).alias(_C))
        .withColumn(_C, F.sum(_C).over(before))
    )
    src = src.withColumn(out, F.sum(_V).over(inner))
    zero = F.lit(0)
    return (
        _join_edges(src, edges, keys)
        .withColumn(out, F.coalesce(F.col(out), zero) + F.coalesce(F.col(_C), zero))
        .drop(_B, _V, _C)
    )


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str
) -> DataFrame:
    """Largest ``value`` up to and including each row."""
    src = df.withColumn(_B, bucket).withColumn(_V, value)
    inner = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    edges = src.groupBy(*keys, _B).agg(F.max(_V).alias(_C)).withColumn(_C, F.max(_C).over(before))
    src = src.withColumn(out, F.max(_V).over(inner))
    return _join_edges(src, edges, keys).withColumn(out, F.greatest(out, _C)).drop(_B, _V, _C)


def dense_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str
) -> DataFrame:
    """0-based row number inside each key."""
    return running_sum(
        df, keys, order, bucket, F.lit(1).cast("bigint"), out, include_current=False
    )


def rows_frame_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: Column,
    rows: int,
    out: str,
    block: int = 4096,
) -> DataFrame:
    """``sum(value)`` over the current and the ``rows - 1`` rows before it.

    Rows are numbered, cut into blocks of ``block`` rows (of ``rows``, if the
    frame is longer), and the last ``rows - 1`` rows of a block are also sent
    to the next one.
    """
    halo = rows - 1
    block = max(block, rows)
    numbered = dense_index(df.withColumn("_val", value), keys, order, bucket, "_idx")
    own = F.floor(F.col("_idx") / block)
    spill = F.col("_idx") % block >= block - halo
    both = numbered.withColumn(
        "_blk", F.explode(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    frame = Window.partitionBy(*keys, "_blk").orderBy("_idx").rowsBetween(-halo, 0)
    return (
        both.withColumn(out, F.sum("_val").over(frame))
        .filter(F.col("_blk") == own)
        .drop("_blk", "_idx", "_val")
    )


def range_count(
    df: DataFrame, keys: Sequence[str], ticks: Column, span: int, out: str
) -> DataFrame:
    """Rows of the same key in ``(t - span, t]``; ``ticks`` is an integer time.

    The count up to ``t`` less the count up to ``t - span``: each row asks at
    both places, and growing counts answer, whatever the number of rows inside
    the frame. Only keys, times and a row number go through the two orders.
    """
    rows = checkpoint(df.withColumn("_t", ticks).withColumn("_id", F.monotonically_increasing_id()))
    ask = dealt(rows.select(
        *keys, "_id",
        F.inline(F.array(
            F.struct(F.col("_t").alias("_pos"), F.lit(1).alias("_one")),
            F.struct((F.col("_t") - span).alias("_pos"), F.lit(0).alias("_one")),
        )),
    ), keys, ["_pos"], _B)
    inner = Window.partitionBy(*keys, _B).orderBy("_pos").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    edges = ask.groupBy(*keys, _B).agg(F.sum("_one").alias(_C)).withColumn(_C, F.coalesce(F.sum(_C).over(before), F.lit(0)))
    upto = _join_edges(ask.withColumn(_V, F.sum("_one").over(inner)), edges, keys)
    at = lambda kind: F.max(F.when(F.col("_one") == kind, F.col(_V) + F.col(_C)))
    both = upto.groupBy("_id").agg((at(1) - at(0)).alias(out))
    return rows.join(both, "_id").select(*df.columns, out)


def islands(
    df: DataFrame, keys: Sequence[str], value: str, bucket: Column
) -> DataFrame:
    """Runs of consecutive integers of a distinct column: start, end, length."""
    numbered = dense_index(df, keys, [value], bucket, "_idx")
    return (
        numbered.groupBy(*keys, (F.col(value) - F.col("_idx")).alias("_run"))
        .agg(
            F.min(value).alias("run_start"),
            F.max(value).alias("run_end"),
            F.count(F.lit(1)).alias("run_length"),
        )
        .drop("_run")
    )


def next_at_or_after(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    span: int,
    out: str,
) -> DataFrame:
    """As-of join: smallest ``right_pos >= left_pos`` of the same key.

    Both sides are stacked and ordered once, so no left x right pairs arise.
    """
    probe = left.select(
        *keys,
        F.col(left_pos).alias("_pos"),
        F.lit(0).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    build = right.select(
        *keys, F.col(right_pos).alias("_pos"), F.lit(1).alias("_side")
    ).distinct().withColumn("_row", F.lit(None).cast(probe.schema["_row"].dataType))
    both = probe.unionByName(build)
    hit = F.when(F.col("_side") == 1, F.col("_pos"))
    joined = carry_next(
        both, keys, ["_pos", "_side"], F.floor(F.col("_pos") / span), hit, out
    )
    return joined.filter("_side = 0").select("_row.*", out)


def last_at_or_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    span: int,
    out: str,
) -> DataFrame:
    """As-of join: largest ``right_pos <= left_pos`` of the same key."""
    probe = left.select(
        *keys,
        F.col(left_pos).alias("_pos"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_row"),
    )
    build = right.select(
        *keys, F.col(right_pos).alias("_pos"), F.lit(0).alias("_side")
    ).distinct().withColumn("_row", F.lit(None).cast(probe.schema["_row"].dataType))
    both = probe.unionByName(build)
    hit = F.when(F.col("_side") == 0, F.col("_pos"))
    joined = carry_last(
        both, keys, ["_pos", "_side"], F.floor(F.col("_pos") / span), hit, out
    )
    return joined.filter("_side = 1").select("_row.*", out)
