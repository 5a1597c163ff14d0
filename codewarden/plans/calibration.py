"""Train and apply the confidence calibrator."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codewarden.functions.constants import FEATURE_NAMES, MIN_TRAINING_ROWS
from codewarden.functions.features import feature_columns, finite
from codewarden.operators import metrics
from codewarden.operators.sampling import stratified_holdout
from codewarden.session import cut_lineage


def feature_frame(results: DataFrame, *keep: str, online: bool = False, infinite_to_one: bool = True) -> DataFrame:
    """The kept columns and the 15 features, free of NaN and infinities."""
    rows = results.select(*keep, *feature_columns(online))
    return rows.select(*keep, *[finite(F.col(c), infinite_to_one).alias(c) for c in FEATURE_NAMES])


def guardrail(rows: DataFrame, column: str = "rag_top1_sim", cap: float = 0.8, fit_on: DataFrame | None = None) -> DataFrame:
    """Values above mean + 3 deviations become `cap`; statistics come from `fit_on`, else all rows."""
    limit = (fit_on if fit_on is not None else rows).agg(
        (F.avg(column) + 3 * F.stddev_pop(column)).alias("_limit"))
    return rows.join(F.broadcast(limit), F.lit(True)).withColumn(
        column, F.when(F.col(column) > F.col("_limit"), F.lit(cap)).otherwise(F.col(column))).drop("_limit")


def column_moments(rows: DataFrame) -> DataFrame:
    """One row of means and population deviations of the 15 columns."""
    return rows.agg(*[F.avg(c).alias(f"mean_{c}") for c in FEATURE_NAMES],
                    *[F.stddev_pop(c).alias(f"std_{c}") for c in FEATURE_NAMES])


def standardise(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation; a constant column is only centred."""
    scaled = {c: (F.col(c) - F.col(f"mean_{c}")) / F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0)
              for c in FEATURE_NAMES}
    return rows.join(F.broadcast(moments), F.lit(True)).withColumns(scaled).select(*rows.columns)


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Add `weight` = n / (2 n_class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_total"))
    weights = counts.join(F.broadcast(total), F.lit(True)).select(
        label, (F.col("_total") / (2.0 * F.col("_n"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)  # one row per class


def fit_pca(rows: DataFrame, k: int = 10):
    """Principal directions of standardised features, as a fitted model.

    Each direction has its largest loading positive, so the signs are defined; all-zero data gives
    zero scores.
    """
    assembler = VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="features")
    return assembler, PCA(k=k, inputCol="features", outputCol="pca").fit(assembler.transform(rows))


def principal_scores(rows: DataFrame, fitted, *keep: str) -> DataFrame:
    """Scores on the fitted directions with fixed signs: pc_0 ... pc_{k-1}."""
    assembler, model = fitted
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(loadings.shape[1])]
    scores = model.transform(assembler.transform(rows)).withColumn("_s", vector_to_array("pca"))
    return scores.select(*keep, *[(F.col("_s")[j] * sign).alias(f"pc_{j}") for j, sign in enumerate(signs)])


class Calibrator:
    """Standardise, project, boosted trees; a fitted pipeline with its moments."""

    def __init__(self, moments: DataFrame, model: PipelineModel):
        self.moments, self.model = moments, model

    def score(self, rows: DataFrame) -> DataFrame:
        """Add `score`, the probability of a vulnerability, to rows that hold the 15 features."""
        keyed = rows.withColumn("_raw", F.struct(*[F.col(c) for c in FEATURE_NAMES]))
        clean = keyed.withColumns({c: finite(F.col(c).cast("double")) for c in FEATURE_NAMES})
        out = self.model.transform(standardise(clean, self.moments))
        out = out.withColumn("score", vector_to_array("probability")[1])
        return out.select(*[F.col(f"_raw.{c}").alias(c) if c in FEATURE_NAMES else F.col(c) for c in rows.columns], "score")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.moments.coalesce(1).write.mode("overwrite").json(f"{path}/moments")

    @classmethod
    def load(cls, spark, path: str) -> "Calibrator":
        schema = ", ".join(f"mean_{c} double, std_{c} double" for c in FEATURE_NAMES)
        return cls(spark.read.schema(schema).json(f"{path}/moments"), PipelineModel.load(f"{path}/model"))


def first_rounds(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble of the first n trees."""
    context = SparkContext._active_spark_context
    jvm, whole = context._jvm, model._java_obj
    trees = context._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = context._gateway.new_array(jvm.double, n)
    for i, (tree, weight) in enumerate(zip(whole.trees()[:n], whole.treeWeights()[:n])):
        trees[i], weights[i] = tree, weight
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(whole.uid(), trees, weights)
    return GBTClassificationModel(whole.copyValues(cut, jvm.org.apache.spark.ml.param.ParamMap.empty()))


def round_losses(model: GBTClassificationModel, rows: DataFrame) -> list[float]:
    """Weighted log loss of rows (pca, label, weight) after each round, as `evaluateEachIteration` has it, by one pass.

    A row meets each tree once: the leaves it falls into, by the model's leaf column, give its margin round by round.
    """
    # A tree's description lists its leaves as the leaf column numbers them.
    leaves = [np.array(re.findall(r"Predict: (\S+)", t.toDebugString), dtype=float) for t in model.trees]
    shared = rows.sparkSession.sparkContext.broadcast([w * values for w, values in zip(model.treeWeights, leaves, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        total, mass = np.zeros(len(gains)), 0.0
        for batch in batches:
            sign, weight = 2 * batch.column(1).to_numpy() - 1, batch.column(2).to_numpy()
            margin, leaf = np.zeros(len(sign)), batch.column(0).flatten().to_numpy().reshape(-1, len(gains)).astype(np.int64)
            for n, gain in enumerate(gains):
                margin += gain[leaf[:, n]]
                total[n] += (2 * np.logaddexp(0, -2 * sign * margin) * weight).sum()
            mass += weight.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(gains)), pa.int32()), pa.array(total), pa.array([mass] * len(gains))], names=["n", "loss", "mass"])

    placed = model.copy({model.leafCol: "_leaf"}).transform(rows).select(vector_to_array("_leaf").alias("leaf"), F.col("label").cast("double"), F.col("weight").cast("double"))
    found = placed.mapInArrow(run, "n int, loss double, mass double").groupBy("n").agg((F.sum("loss") / F.sum("mass")).alias("loss"))
    return [r["loss"] for r in found.orderBy("n").collect()]


def boost(rows: DataFrame, rounds: int = 1_000, patience: int = 50, seed: int = 42) -> tuple[GBTClassificationModel, list[float]]:
    """(ensemble up to its best round, hold-out loss by round) of rows (pca, label, weight, is_val).

    The loss of the hold-out is followed round by round; the run ends when `patience` rounds after the best one
    brought nothing, or at `rounds`.  Trees follow the seed, so a longer run repeats the shorter one and goes on.
    `rows` are read several times, so their lineage should be cut.
    """
    train, held = rows.where("NOT is_val"), rows.where("is_val")
    tried = min(rounds, patience + 10)
    while True:
        trees = GBTClassifier(featuresCol="pca", labelCol="label", weightCol="weight", maxIter=tried, stepSize=0.03, maxDepth=6, seed=seed)
        model = trees.fit(train)
        losses = round_losses(model, held)
        best = min(range(len(losses)), key=losses.__getitem__)
        if best + patience < tried or tried == rounds:
            return first_rounds(model, best + 1), losses
        tried = min(rounds, 2 * tried)


def train_calibrator(rows: DataFrame, label: str, row_id: str, rounds: int = 1_000, seed: int = 42, components: int = 10,
                     fit_guardrail_on_train: bool = False, patience: int = 50) -> tuple[Calibrator, DataFrame]:
    """(calibrator, one-row report) from rows with a label, an id and the 15 features.

    80/20 stratified hold-out; the hold-out also ends the boosting and picks its best round (`rounds` in the report).
    """
    rows = cut_lineage(rows)  # quotas, ranks, the guardrail and the split each read all of them
    if rows.limit(MIN_TRAINING_ROWS).count() < MIN_TRAINING_ROWS:
        raise ValueError(f"at least {MIN_TRAINING_ROWS} rows are needed")
    split = stratified_holdout(rows, label, row_id, 0.2, seed)
    split = guardrail(split, fit_on=split.where("NOT is_val") if fit_guardrail_on_train else None)
    split = cut_lineage(split)
    train = split.where("NOT is_val")
    moments = cut_lineage(column_moments(train))
    ready = balanced_weights(standardise(split, moments), label).withColumn("label", F.col(label).cast("double"))
    assembler, pca = fit_pca(ready.where("NOT is_val"), components)
    ready = cut_lineage(pca.transform(assembler.transform(ready)).select("pca", "label", "weight", "is_val"))
    fitted, losses = boost(ready, rounds, patience, seed)
    calibrator = Calibrator(moments, PipelineModel([assembler, pca, fitted]))
    held = cut_lineage(calibrator.score(split.where("is_val")).select(label, "score"))
    curve = metrics.precision_recall(metrics.score_counts(held, label, "score"))
    best = metrics.best_f1(curve, padded=True)
    report = metrics.roc_auc(held, label, "score").join(best, F.lit(True)).select(
        F.col("threshold").alias("best_threshold"), F.col("f1").alias("best_f1"), "auc",
        F.array(*[F.lit(n) for n in FEATURE_NAMES]).alias("features"), "precision", "recall",
        F.lit(fitted.getNumTrees).alias("rounds"), F.lit(len(losses)).alias("rounds_tried"), F.lit(float(min(losses))).alias("best_loss"),
        F.lit(float(losses[0])).alias("first_loss"))
    return calibrator, report


def apply_calibrator(results: DataFrame, calibrator: Calibrator | None, key: str) -> DataFrame:
    """(key, calibrated_confidence) for every result; the native confidence without a calibrator."""
    if calibrator is None:
        return results.select(key, F.coalesce(F.col("native_confidence").cast("double"), F.lit(0.5))
                              .alias("calibrated_confidence"))
    return calibrator.score(feature_frame(results, key)).select(key, F.col("score").alias("calibrated_confidence"))
