"""Carving of images whose chunks arrive over many batches, in any order.

Each batch scans its own bytes once. What later batches may need of them is
kept in tables, one sub-folder a batch: the hits, and a few bytes from both
ends of each chunk. A carved range is given out once, by the batch that makes
it certain: when every byte up to its footer, or up to its size bound, has
arrived (``front``: all bytes of the image before it are there).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.functions.bytesops import inline_arrays
from tracefield.operators import carving as cv
from tracefield.operators import ordered as od
from tracefield.session import checkpoint

LAST = 1 << 62


class GrowingImages:
    """State of a carving stream in ``folder``: hits, ends, fronts and the carved ranges, by batch."""

    def __init__(self, spark: SparkSession, signatures: DataFrame, folder: str, mode: str = "first", span: int = 1 << 26):
        self.spark, self.folder, self.mode, self.span = spark, folder, mode, span
        self.patterns, self.heads, self.feet = cv.roles(spark, signatures)
        self.reach = max([len(p) for p in self.patterns] + [2]) - 1
        self.widest = self.heads.agg(F.max(F.greatest("max_size", "header_len"))).first()[0] or 0

    def step(self) -> Callable[[DataFrame, int], None]:
        """Batch writer for a stream of (image_id, chunk_no, base_offset, data); a repeated batch overwrites itself."""
        return self._step

    def _write(self, rows: DataFrame, what: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{what}/batch={batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _before(self, what: str, schema, batch: int) -> DataFrame:
        """Rows of the batches before this one."""
        if not batch:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.folder}/{what}").filter(F.col("batch") < batch).drop("batch")

    def _step(self, chunks: DataFrame, batch: int) -> None:
        passed = cv.scan_pass(chunks, cv.scan_udf(self.patterns)(F.col("data")), self.reach)
        inside = passed.select("image_id", "base_offset", F.inline(F.arrays_zip("hits.pid", "hits.pos")))
        inside = inside.select("image_id", "pid", (F.col("base_offset") + F.col("pos")).alias("offset"))
        new = self._write(passed.drop("hits"), "ends", batch)
        touched = checkpoint(new.select("image_id").distinct())
        old = self._before("ends", passed.drop("hits").schema, batch)
        ends = new.unionByName(self._near(old, new))
        edge = inline_arrays(cv.strips(ends, self.reach), ["image_id", "left_offset"], cv.edge_udf(self.patterns)(F.col("left"), F.col("right")))
        across = edge.select("image_id", "pid", (F.col("left_offset") + F.col("pos")).alias("offset"))
        hits = self._write(inside.unionByName(across), "hits", batch)
        hits = self._before("hits", hits.schema, batch).join(touched, "image_id", "left_semi").unionByName(hits)
        fronts = self._fronts(new, old.join(touched, "image_id", "left_semi"), batch)
        self._write(self._carved(hits, fronts, certain=True), "carved", batch)

    def _near(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """Earlier chunk ends that a match over an edge of a new chunk may touch."""
        widest = new.agg(F.max("size")).first()[0] or 0
        cell = max(self.reach, widest, 1)
        at = lambda c: F.floor(c / cell)
        places = new.select("image_id", F.explode(F.sequence(at(F.col("base_offset") - self.reach), at(F.col("base_offset") + F.col("size") + self.reach))).alias("_cell"))
        # a stored chunk is known by both its ends
        both = old.withColumn("_cell", F.explode(F.array_distinct(F.array(at(F.col("base_offset")), at(F.col("base_offset") + F.col("size"))))))
        return both.join(places.distinct(), ["image_id", "_cell"], "left_semi").drop("_cell").dropDuplicates(["image_id", "chunk_no", "base_offset"])

    def _fronts(self, new: DataFrame, old: DataFrame, batch: int) -> DataFrame:
        """(image_id, front, before, image_size) of the images of this batch: where the bytes from 0 on end now, and ended before it."""
        schema = T.StructType([new.schema["image_id"], *(T.StructField(c, T.LongType()) for c in ("front", "before", "image_size"))])
        known = self._before("fronts", schema, batch).groupBy("image_id").agg(F.max("front").alias("before"), F.max("image_size").alias("_size"))
        stop = (F.col("base_offset") + F.col("size")).alias("stop")
        parts = new.select("image_id", "base_offset", stop).unionByName(old.select("image_id", "base_offset", stop)).filter("stop > base_offset")
        parts = parts.join(known, "image_id", "left").withColumn("before", F.coalesce("before", F.lit(0).cast("bigint")))
        # what lies wholly before the front cannot move it
        open_ = checkpoint(parts.filter(F.col("stop") > F.col("before")))
        bucket, order = F.floor(F.col("base_offset") / self.span), ["base_offset", "stop"]
        reached = checkpoint(od.running_max(open_, ["image_id"], order, bucket, F.col("stop"), "_reach"))
        reached = od.lag_value(reached, ["image_id"], order, bucket, F.col("_reach"), "_prev")
        from_ = F.coalesce("_prev", "before")
        gap = F.min(F.when(F.col("base_offset") > from_, from_))
        now = reached.groupBy("image_id").agg(F.coalesce(gap, F.max("stop")).alias("front"), F.max("before").alias("before"), F.max("stop").alias("image_size"))
        images = new.select("image_id").distinct().join(known, "image_id", "left").join(now.drop("before"), "image_id", "left")
        none = F.lit(0).cast("bigint")
        images = images.select(
            "image_id", F.greatest(F.coalesce("front", "before", none), F.coalesce("before", none)).alias("front"),
            F.coalesce("before", none).alias("before"), F.greatest(F.coalesce("image_size", none), F.coalesce("_size", none)).alias("image_size"),
        )
        return self._write(images, "fronts", batch)

    def _carved(self, hits: DataFrame, fronts: DataFrame, certain: bool) -> DataFrame:
        """Ranges that became certain between ``before`` and ``front``; else all that are still open at ``front``."""
        since = "before" if certain else "front"
        # no range reaches here from further back, and none that uses a byte from the front on is certain
        hits = hits.join(fronts, "image_id").filter(F.col("offset") + self.widest > F.col(since))
        if certain:
            hits = hits.filter("offset < front")
        hits = checkpoint(hits.distinct())
        headers = hits.join(self.heads, "pid").filter(F.col("offset") + F.greatest("max_size", "header_len") > F.col(since)).drop("pid", "front", "before", "image_size")
        footers = hits.join(self.feet, "pid").select("image_id", "name", "offset")
        paired = cv.pair_footers(checkpoint(headers), footers, self.mode, self.span)
        known = (F.col("footer_offset") + F.col("footer_len")) if self.mode == "first" else F.lit(None).cast("bigint")
        # as soon as all bytes up to here are there, no other footer can come
        sure = F.greatest(F.coalesce(known, F.col("offset") + F.col("max_size")), F.col("offset") + F.col("header_len"))
        paired = paired.join(fronts.select("image_id", "front", "before"), "image_id")
        now = (sure > F.col("before")) & (sure <= F.col("front")) if certain else sure > F.col("front")
        sizes = fronts.select("image_id", "image_size")
        return cv.cut_ranges(paired.filter(now).drop("front", "before"), sizes)

    def finish(self) -> DataFrame:
        """No more bytes come: gives out the ranges still open and returns all carved ranges."""
        hits = self.spark.read.parquet(f"{self.folder}/hits").drop("batch")
        fronts = self.spark.read.parquet(f"{self.folder}/fronts").groupBy("image_id").agg(F.max("front").alias("front"), F.max("image_size").alias("image_size"))
        rest = self._carved(hits, fronts.withColumn("before", F.lit(LAST)), certain=False)
        self._write(rest, "carved", LAST)
        return self.spark.read.parquet(f"{self.folder}/carved").drop("batch")
