"""Gradient-boosted trees over the pair features. Training and scoring share one feature function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entwine.operators.features import MODEL


def split_by_entity(pairs: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, validation) pairs; the records of source 1 in `held` are never trained on."""
    return pairs.join(held.select("s1_id"), "s1_id", "left_anti"), pairs.join(held.select("s1_id"), "s1_id", "left_semi")


def train(labelled: DataFrame, trees: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 42, stop: DataFrame | None = None) -> PipelineModel:
    """A model of column label over the features; rows of `stop` end the boosting early."""
    data = labelled.select(*MODEL, F.col("label").cast("double").alias("label"))
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    if stop is not None:
        data = data.withColumn("stop", F.lit(False)).unionByName(stop.select(*MODEL, F.col("label").cast("double").alias("label"), F.lit(True).alias("stop")))
        gbt = gbt.setValidationIndicatorCol("stop")
    return Pipeline(stages=[VectorAssembler(inputCols=list(MODEL), outputCol="features"), gbt]).fit(data)


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """features with prob."""
    return model.transform(features).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def trees_table(model: PipelineModel) -> DataFrame:
    """(tree, weight, node, feature, threshold, left, right, value): the nodes of a model's trees, to be read by other systems. A leaf
    has no feature; of others rows with feature <= threshold go left. As many rows as the model has nodes."""
    gbt, rows = model.stages[-1], []
    for i, (weight, tree) in enumerate(zip(gbt.treeWeights, gbt.trees, strict=True)):
        nodes = [tree._call_java("rootNode")]
        own = []
        for node in nodes:  # grows while it is walked
            if node.getClass().getSimpleName() == "LeafNode":
                own.append((None, None, None, None, float(node.prediction())))
            else:
                own.append((MODEL[node.split().featureIndex()], float(node.split().threshold()), len(nodes), len(nodes) + 1, float(node.prediction())))
                nodes += [node.leftChild(), node.rightChild()]
        rows += [(i, float(weight), n, *x) for n, x in enumerate(own)]
    return SparkSession.active().createDataFrame(rows, "tree int, weight double, node int, feature string, threshold double, left int, right int, value double")


def predict_by_table(trees: DataFrame, features: DataFrame) -> DataFrame:
    """features with prob, from a table of trees alone. The table, of a model's size, comes to the driver; rows are scored in Arrow batches."""
    forest = []
    for _, t in trees.orderBy("tree", "node").toPandas().groupby("tree"):
        leaf = t["feature"].isna().to_numpy()
        at = t["feature"].map({f: i for i, f in enumerate(MODEL)}).fillna(0).to_numpy(int)
        forest.append((float(t["weight"].iloc[0]), leaf, at, t["threshold"].to_numpy(float), t["left"].fillna(0).to_numpy(int), t["right"].fillna(0).to_numpy(int), t["value"].to_numpy(float)))

    @F.pandas_udf("double")
    def prob(x: pd.DataFrame) -> pd.Series:
        v = x.to_numpy(float)
        margin, rows = np.zeros(len(v)), np.arange(len(v))
        for weight, leaf, at, cut, left, right, value in forest:
            node = np.zeros(len(v), int)
            while not leaf[node].all():
                node = np.where(leaf[node], node, np.where(v[rows, at[node]] <= cut[node], left[node], right[node]))
            margin += weight * value[node]
        return pd.Series(1 / (1 + np.exp(-2 * margin)))

    return features.withColumn("prob", prob(F.struct(*MODEL)))
