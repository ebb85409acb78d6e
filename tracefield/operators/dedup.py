"""Equal and alike files, and validators for carved bytes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.operators.graph import connected_components
from tracefield.session import checkpoint


def exact_duplicates(files: DataFrame, key: str, data: str) -> DataFrame:
    """(key, digest, keeper, copies) of every file whose content occurs more than once."""
    d = files.select(key, F.sha2(F.col(data), 256).alias("digest"))
    g = d.groupBy("digest").agg(F.min(key).alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return d.join(g, "digest").select(key, "digest", "keeper", "copies")


def similar_files(hist: DataFrame, ref: DataFrame, key: str, threshold: float = 0.8) -> DataFrame:
    """Files whose byte counts point the way of the reference's: cosine of at least ``threshold``.

    hist(key, b, n); ref(b, n) of one file, so at most 256 rows.
    """
    r = ref.select("b", F.col("n").alias("rn"))
    rn = r.agg(F.sqrt(F.sum(F.col("rn") * F.col("rn")))).scalar()
    n = F.col("n").cast("double")
    return (
        hist.join(r, "b", "left").groupBy(key)
        .agg((F.sum(n * F.coalesce("rn", F.lit(0))) / F.sqrt(F.sum(n * n))).alias("_d"))
        .select(key, (F.col("_d") / rn).alias("similarity"))
        .filter(F.col("similarity") >= threshold)
    )


def shingles(df: DataFrame, key: str, text: str, width: int = 3) -> DataFrame:
    """(key, sh): distinct hashes of every run of ``width`` words of the whole text."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    n = F.size("w")
    runs = F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, width), " ")))).otherwise(
        F.array(F.xxhash64(F.array_join("w", " ")))
    )
    return df.select(key, w.alias("w")).select(key, F.array_distinct(runs).alias("sh"))


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, id): the runs of each set that any set alike to it must share one of.

    Runs are ordered from rare to common; sets of n runs with a Jaccard
    similarity of at least t share one of the first n - ceil(t n) + 1.
    """
    runs = sets.select("id", F.size("sh").alias("n"), F.explode("sh").alias("s"))
    shared = runs.groupBy("s").agg(F.count(F.lit(1)).alias("files")).filter("files > 1")
    # runs of one file come first in its order; only their number matters
    ordered = runs.join(shared, "s").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("files", "s"))).alias("r"))
    first = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int") - (F.col("n") - F.size("r"))
    return ordered.select("id", "n", F.explode(F.slice("r", F.lit(1), F.greatest(first, F.lit(0)))).alias("r")).select(F.col("r.s").alias("bucket"), "id", "n")


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those (u, v) whose sets have at least the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("sh").alias("_a")), "u").join(sets.select(F.col("id").alias("v"), F.col("sh").alias("_b")), "v")
    share = F.size(F.array_intersect("_a", "_b"))
    return checkpoint(both.filter(share >= threshold * (F.size("_a") + F.size("_b") - share)).select("u", "v"))


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.95) -> DataFrame:
    """(key, group): files linked by a Jaccard similarity of at least ``threshold`` over word runs.

    Complete: equal texts are folded; of the others, alike ones share a rare run
    (prefix filter). Each member of a run's bucket is compared with its least
    one; buckets that are not one component by then have their members of
    different components, of fitting sizes, compared too.
    """
    t = df.select(key, F.col(text).alias("_t"), F.sha2(F.col(text), 256).alias("_h"))
    folded = t.groupBy("_h").agg(F.min(key).alias("id"))
    heads = t.join(folded, (t[key] == folded.id) & (t._h == folded._h), "left_semi")
    sets = checkpoint(shingles(heads, key, "_t").withColumnRenamed(key, "id"))
    index = checkpoint(prefixes(sets, threshold))
    low = index.groupBy("bucket").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    index = checkpoint(index.join(low, "bucket"))
    tried = checkpoint(index.filter("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")).distinct())
    links = _alike(tried, sets, threshold)
    component = connected_components(links).withColumnRenamed("node", "id")
    rest = index.filter("m > 2 and id <> low").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
    rest = checkpoint(rest.join(mixed, "bucket", "left_semi").select("bucket", "id", "n", "component"))
    other = rest.select("bucket", F.col("id").alias("v"), F.col("n").alias("_n"), F.col("component").alias("_c"))
    fits = (F.col("v") < F.col("id")) & (F.col("component") != F.col("_c")) & (F.least("n", "_n") >= F.greatest("n", "_n") * threshold - 1e-9)
    pairs = rest.join(other, "bucket").filter(fits).select(F.col("id").alias("u"), "v").distinct().join(tried, ["u", "v"], "left_anti")
    links = links.unionByName(_alike(pairs, sets, threshold))
    copies = t.join(folded, "_h").filter(t[key] != folded.id).select(t[key].alias("u"), folded.id.alias("v"))
    return connected_components(links.unionByName(copies)).select(F.col("node").alias(key), F.col("component").alias("group"))


def validate_carved(carved: DataFrame, validators: dict[str, Callable[[bytes], bool]], content: str = "content") -> DataFrame:
    """Run the validator registered for each signature name; others pass as null."""
    out = carved.filter(~F.col("name").isin(*validators)).withColumn("valid", F.lit(None).cast("boolean"))
    for name, fn in validators.items():
        out = out.unionByName(carved.filter(F.col("name") == name).withColumn("valid", _validator_udf(fn)(F.col(content))))
    return out


def _validator_udf(fn):
    @F.pandas_udf(T.BooleanType())
    def check(data: pd.Series) -> pd.Series:
        return data.map(lambda d: bool(fn(d)))

    return check
