"""Learned models on spark.ml: file types, malware, repair strategy, clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefield.functions import bytesops as by
from tracefield.functions.filetypes import magic_type
from tracefield.operators.quantiles import exact_median
from tracefield.session import checkpoint

SEED = 42
#: a longer history of outcomes is fitted on its distinct rows
FOLD_ABOVE = 1_000_000


def type_features(files: DataFrame, key: str = "file_id", data: str = "data", extra: list[str] | None = None) -> DataFrame:
    """290 numbers: 32 header bytes, entropy, 256 byte shares, magic code."""
    d = F.col(data)
    hist = by.histogram_udf(d)
    total = F.greatest(F.octet_length(d), F.lit(1))
    header = F.array(*[F.coalesce(by.byte_at(d, i), F.lit(0)).cast("double") / 255 for i in range(32)])
    code = F.when(magic_type(d) == "jpeg", 1.0).when(magic_type(d) == "png", 2.0).when(magic_type(d) == "pdf", 3.0).when(magic_type(d) == "executable", 4.0).otherwise(0.0)
    return files.select(key, *(extra or []), d.alias("_d"), header.alias("_h"), code.alias("_m"), hist.alias("_hist"), total.alias("_n"), by.entropy_udf(d).alias("_e")).select(
        key, *(extra or []),
        array_to_vector(F.concat("_h", F.array("_e"), F.transform("_hist", lambda x: x / F.col("_n")), F.array("_m"))).alias("raw"),
    )


def feature_families() -> list[str]:
    return ["header"] * 32 + ["entropy"] + ["byte_distribution"] * 256 + ["magic"]


def forest(label: str, trees: int, depth: int, weight: str | None = None) -> Pipeline:
    classifier = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        classifier.setWeightCol(weight) if weight else classifier,
    ])


def train_classifier(features: DataFrame, label: str, trees: int = 100, depth: int = 10, folds: int = 5) -> tuple[PipelineModel, dict]:
    """Scaled random forest, 80/20 split; ``folds`` > 1 adds cross-validation. Returns model and accuracies.

    A fit reads its rows many times, so what it needs of them is written once.
    """
    features = checkpoint(features.select("raw", label))
    train, test = features.randomSplit([0.8, 0.2], SEED)
    pipe = forest(label, trees, depth)
    model = pipe.fit(train)
    acc = MulticlassClassificationEvaluator(metricName="accuracy")
    scores = {"train_accuracy": acc.evaluate(model.transform(train)), "test_accuracy": acc.evaluate(model.transform(test))}
    if folds > 1:
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=acc, numFolds=folds, seed=SEED)
        scores["cv_accuracy"] = cv.fit(features).avgMetrics[0]
    return model, scores


def predict(model: PipelineModel, features: DataFrame, key: str) -> DataFrame:
    """Class name and its probability."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = model.transform(features)
    return out.select(
        key, F.coalesce(F.try_element_at(names, (F.col("prediction") + 1).cast("int")), F.lit("unknown")).alias("predicted"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def feature_importance(model: PipelineModel, families: list[str], spark) -> DataFrame:
    """Importance summed per feature family; no rows without a model."""
    if model is None:
        return spark.createDataFrame([], "family string, importance double")
    imp = model.stages[-1].featureImportances.toArray()
    rows = spark.createDataFrame([(f, float(v)) for f, v in zip(families, imp)], "family string, importance double")
    return rows.groupBy("family").agg(F.sum("importance").alias("importance"))


def malware_features(files: DataFrame, key: str = "file_id", data: str = "data") -> DataFrame:
    """33 numbers per file: size 3, section entropy 10, byte frequency 10, byte ratios 5, PE header 5."""
    d = F.col(data)
    size = F.octet_length(d).cast("double")
    hist = by.byte_histogram(files, [key], data)
    sections = by.section_entropy(files, [key], 10, data).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("section", "entropy"))), lambda x: x["entropy"]).alias("_sec")  # ten values
    )
    freq = by.byte_freq_stats(hist, [key])
    prof = by.byte_profile(hist, [key])
    head = F.substring(d, 1, 1024)
    pe = by.magic(d, "4D5A") & (F.octet_length(d) >= 64)
    n = lambda c: F.col(c).cast("double")
    base = files.select(
        key, size.alias("_s"), F.log1p(size).alias("_l"), (size % 512 == 0).cast("double").alias("_a"),
        F.when(pe, 1.0).otherwise(0.0).alias("_pe"), F.when(pe, by.le_uint(d, 60, 4).cast("double")).otherwise(0.0).alias("_po"),
        F.when(pe, F.octet_length(head).cast("double")).otherwise(0.0).alias("_ph"),
        by.histogram_udf(head).alias("_hh"), null_pairs_udf(d).alias("_np"),
    )
    j = base.join(sections, key).join(freq, key, "left").join(prof, key, "left")
    zero = F.lit(0.0)
    vec = F.array(
        F.col("_s"), F.col("_l"), F.col("_a"), *[F.get("_sec", F.lit(i)) for i in range(10)],
        *[F.coalesce(n(c), zero) for c in ("mean", "std", "max", "min", "median", "unique", "unique", "singletons", "above_mean", "var")],
        F.coalesce(n("printable_ratio"), zero), F.coalesce(n("null_ratio"), zero), F.coalesce(n("high_ratio"), zero),
        F.coalesce(n("distinct_bytes") / 256, zero), F.when(F.col("_s") > 1, F.col("_np") / (F.col("_s") - 1)).otherwise(0.0),
        F.col("_pe"), F.col("_po"), F.col("_ph"),
        F.when(F.col("_pe") == 1, F.get("_hh", F.lit(0)).cast("double")).otherwise(0.0),
        F.when(F.col("_pe") == 1, F.size(F.filter("_hh", lambda x: x > 0)).cast("double")).otherwise(0.0),
    )
    return j.select(key, vec.alias("values"), array_to_vector(vec).alias("raw"))


@F.pandas_udf(T.LongType())
def null_pairs_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda d: d.count(b"\x00\x00"))


def robust_outliers(features: DataFrame, benign: DataFrame, key: str, limit: float = 6.0, width: int = 33) -> DataFrame:
    """Largest robust z-score against the benign files' medians and median deviations.

    features/benign(key, values). Medians are exact and taken per feature in
    parallel (no file's or feature's values are gathered in one task).
    """
    long = benign.select(F.posexplode("values").alias("f", "x"))
    med = exact_median(long, ["f"], F.col("x"), "med")
    dev = long.join(med, "f").withColumn("dev", F.abs(F.col("x") - F.col("med")))
    mad = exact_median(dev, ["f"], F.col("dev"), "mad")
    scale = med.join(mad, "f")
    z = features.select(key, F.posexplode("values").alias("f", "x")).join(scale, "f").filter("mad > 0")
    return z.groupBy(key).agg(F.max(F.abs(F.col("x") - F.col("med")) * 0.6745 / F.col("mad")).alias("score")).withColumn(
        "outlier", F.col("score") > limit
    )


def malware_verdict(predicted: DataFrame, outliers: DataFrame, key: str) -> DataFrame:
    """Flagged if the forest or the outlier test says so."""
    return predicted.join(outliers, key, "left").select(
        key, "predicted", "confidence", F.coalesce("outlier", F.lit(False)).alias("outlier"),
        ((F.col("predicted") == "malicious") | F.coalesce("outlier", F.lit(False))).alias("flagged"),
    )


def train_strategy_model(history: DataFrame, trees: int = 100, depth: int = 10, minimum: int = 10, fold_above: int = FOLD_ABOVE) -> PipelineModel | None:
    """history(scenario_id, vec, success, tool): the label is the tool if it worked, else ``failed``.

    A history of more than ``fold_above`` rows is fitted on its distinct rows,
    weighted by how often they occur: of flags and few-valued numbers there are
    far fewer than outcomes. Trees then draw distinct rows, not single outcomes.
    """
    outcome = F.when(F.col("success"), F.col("tool")).otherwise("failed").alias("outcome")
    raw = array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("raw")
    long = history.limit(fold_above + 1).count() > fold_above
    rows = history.select("vec", outcome)
    if long:
        rows = rows.groupBy("vec", "outcome").agg(F.count(F.lit(1)).cast("double").alias("times"))
    rows = checkpoint(rows.select(raw, *rows.columns[1:]))  # a fit reads them many times
    if rows.limit(minimum).count() < minimum and not long:
        return None
    return forest("outcome", trees, depth, "times" if long else None).fit(rows)


class ModelLifeCycle:
    """A strategy model that follows the outcomes of a stream.

    Outcomes of each batch are stored under ``folder``; whenever their number
    passes a multiple of ``every``, the model is fitted to all of them anew. The
    model and the number of outcomes it knows are one version folder, whose name
    holds the number and which counts once the model's own commit mark is there:
    a lost or repeated batch leaves either version whole.
    """

    def __init__(self, spark, folder: str, every: int = 50, trees: int = 100, depth: int = 10):
        self.spark, self.folder, self.every, self.trees, self.depth = spark, folder, every, trees, depth

    def step(self, outcomes: DataFrame, batch: int) -> None:
        """Batch writer for outcomes(scenario_id, vec, success, tool)."""
        outcomes.select("scenario_id", "vec", "success", "tool").write.mode("overwrite").parquet(f"{self.folder}/outcomes/batch={batch}")
        known = self.spark.read.parquet(f"{self.folder}/outcomes").filter(F.col("batch") <= batch)
        total, before = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("batch") < batch, 1))).first()
        if total // self.every > before // self.every:
            model = train_strategy_model(known.drop("batch"), self.trees, self.depth)
            if model is not None:
                model.write().overwrite().save(f"{self.folder}/models/outcomes={total:012d}")

    def versions(self) -> list[int]:
        """Numbers of outcomes at which there is a whole model, oldest first."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/models")
        store = hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not store.exists(hadoop):
            return []
        done = lambda p: store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "metadata/_SUCCESS"))
        return sorted(int(f.getPath().getName().partition("=")[2]) for f in store.listStatus(hadoop) if done(f.getPath()))

    def latest(self) -> PipelineModel | None:
        """The newest model, None before the first fit."""
        found = self.versions()
        return PipelineModel.load(f"{self.folder}/models/outcomes={found[-1]:012d}") if found else None


def predict_strategy(model: PipelineModel, scenarios: DataFrame) -> DataFrame:
    """Tool and probability; a predicted failure gives no row, and so does a history too short for a model.

    Trees are walked once per distinct vector, whose predictions are written before they are filtered.
    """
    if model is None:
        return scenarios.select("scenario_id", F.lit("").alias("predicted"), F.lit(0.0).alias("confidence")).filter("false")
    rows = scenarios.select("vec").distinct().select("vec", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("raw"))
    tools = checkpoint(predict(model, rows, "vec")).filter("predicted not in ('failed', 'unknown')")
    return scenarios.select("scenario_id", "vec").join(tools, "vec").select("scenario_id", "predicted", "confidence")


def dominant_clusters(vectors: DataFrame, k: int = 5) -> DataFrame:
    """k-means centres with their share of the vectors, largest first."""
    data = vectors.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=SEED, maxIter=20).fit(data)
    n = vectors.agg(F.count(F.lit(1))).scalar()
    centres = vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>"
    )
    sizes = model.transform(data).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("members"))
    return sizes.join(centres, "cluster").withColumn("share", F.col("members") / n).orderBy(F.desc("share"), "cluster")
