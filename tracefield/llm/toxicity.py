"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a lower-cased text, hashed to
2**20 places. Over the labelled texts the log ratio of the shares of toxic and
other texts that hold a feature is taken; a feature enters as that ratio where
present, else 0. Logistic regression (L2) on the features whose ratio stands
furthest out of its standard error gives the score. Presence, not counts: a long text is not toxic for
being long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefield.llm.common import slices
from tracefield.llm.learn import Rows, fold, lbfgs, sample_by_label, sigmoid, texts_of_ids
from tracefield.session import checkpoint

SIZES = (3, 4, 5, 6)
PLACES = 1 << 20
#: labelled texts that are learned from, at most (about)
MAX_LABELLED = 12_000
MAX_FEATURES = 1 << 14
#: bytes of text taken at once: every character is the start of four n-grams of eight bytes
SLICE = 1 << 17
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of lower-cased texts, each between two blanks."""
    lowered = [f" {(t or '').lower()} " for t in texts]
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)))])
    return np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def gram_places(points: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place) of all n-grams that lie in one text; only the ``wanted`` places if given."""
    found = []
    h = np.zeros(len(points), np.uint64)
    c = points.astype(np.uint64) + np.uint64(1)
    for n in range(1, max(SIZES) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * MULTIPLIER + c[n - 1 :]
        if n not in SIZES:
            continue
        place = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(44)).astype(np.int64)
        at = np.arange(len(place)) if wanted is None else np.flatnonzero(wanted[place])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[doc + 1]
        found.append(np.unique((doc[inside] << 20) | place[at[inside]]))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> 20, keys & (PLACES - 1)


def scaled_logistic(x: Rows, y: np.ndarray, ratio: np.ndarray, penalty: float) -> Callable:
    """Loss of (weights, bias): logistic, over features that enter as their log-count ratio, with an L2 penalty on the weights."""

    def loss(p):
        z = x.dot(ratio * p[:-1]) + p[-1]
        value = np.logaddexp(0, z).sum() - y @ z + penalty / 2 * (p[:-1] @ p[:-1])
        r = sigmoid(z) - y
        return value / len(y), np.append(ratio * x.back(r) + penalty * p[:-1], r.sum()) / len(y)

    return loss


def _labelled(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[DataFrame, dict]:
    """((toxic, text), share taken of each label) of labelled texts that may be learned from: crc32 of the id mod 3 is not 1."""
    known = labels.filter(F.col("toxic").isNotNull() & (fold("doc_id", 3) != 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked, _, rates = sample_by_label(known.withColumn("kind", (F.col("toxic") > 0).cast("int")), "doc_id", "kind", bound)
    return texts_of_ids(docs, picked).select("toxic", "text"), rates


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, penalty: float = 1.0, features: int = MAX_FEATURES, least: int = 3) -> dict:
    """Model: places, weights, bias. ``bound`` labelled texts at most are learned from.

    Places held by ``least`` of these texts or more may be features, the
    ``features`` ones whose ratio stands out most are (README: held-out figures
    for others).
    """
    sample, rates = _labelled(docs, labels, bound)
    sample = checkpoint(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, PLACES), np.int32)
        for big in batches:
            for b in slices(big, "text", SLICE):
                toxic = b.column("toxic").to_numpy(zero_copy_only=False) > 0
                doc, place = gram_places(*codes(b.column("text").to_pylist()))
                for y in (0, 1):
                    np.add.at(total[y], place[toxic[doc] == y], 1)
        there = np.flatnonzero(total.any(0))
        for part in np.array_split(there, max(1, len(there) >> 14)):
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(n[part].astype(np.int64)) for n in total)], ["place", "n0", "n1"])

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    docs1 = sum(n for k, n in sizes.items() if k > 0)
    docs0 = sum(sizes.values()) - docs1
    if not docs0 or not docs1:
        share = (docs1 + 1) / (docs0 + docs1 + 2)
        return {"places": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log(share / (1 - share)))}
    grams = sample.mapInArrow(count, "place long, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= least)
    # the log ratio of the shares of texts with the feature, and how far it stands out of its standard error
    ratio = F.log((F.col("n1") + 1) / (docs1 + 2)) - F.log((F.col("n0") + 1) / (docs0 + 2))
    error = F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1) - 1 / (docs1 + 2) - 1 / (docs0 + 2))
    best = grams.select("place", ratio.alias("ratio"), (F.abs(ratio) / error).alias("z")).orderBy(F.desc("z"), "place").limit(features).collect()
    best.sort(key=lambda r: r["place"])
    places, ratio = np.array([r["place"] for r in best], np.int64), np.array([r["ratio"] for r in best], float)
    number = np.zeros(PLACES, np.int32)
    number[places] = np.arange(len(places))
    wanted = np.zeros(PLACES, bool)
    wanted[places] = True

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text", SLICE):
                doc, place = gram_places(*codes(b.column("text").to_pylist()), wanted)
                cuts = np.searchsorted(doc, np.arange(len(b) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(number[place]))
                yield pa.RecordBatch.from_arrays([b.column("toxic"), lists], ["toxic", "features"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("toxic", kind="stable")
        x = Rows(list(rows["features"]), None, len(places))
        y = (rows["toxic"].to_numpy() > 0).astype(float)

        p = lbfgs(scaled_logistic(x, y, ratio, penalty), np.zeros(len(places) + 1), rounds=120)
        return pd.DataFrame({"weights": [p.tolist()]})

    rows = sample.mapInArrow(present, "toxic int, features array<int>")
    p = np.asarray(rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "weights array<double>").first()["weights"])
    return {"places": places, "weights": ratio * p[:-1], "bias": float(p[-1] + np.log(rates[0] / rates[1]))}  # the odds of all labelled texts, not of the sample


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on).

    Whole texts; null or empty text: the score of the bias alone. Columns of
    these names in ``docs`` are replaced.
    """
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(PLACES)
        weight[model["places"]] = model["weights"]
        wanted = weight != 0
        for big in batches:
            for b in slices(big, "text", SLICE):
                doc, place = gram_places(*codes(b.column("text").to_pylist()), wanted)
                s = sigmoid(np.bincount(doc, weight[place], len(b)) + model["bias"])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*b.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, score double, predicted int")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null ids count as held out; repeated documents are scored each; without
    labels of both kinds every score is the share of toxic labels.
    """
    model = train(docs, labels)
    return score(docs.select("doc_id", "text"), model, threshold).select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", "predicted"
    )
