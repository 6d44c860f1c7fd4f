"""X3, X4, 2.14: models over the code features.

A model is a function that loads it: called once per Python worker, it returns a function from a matrix of
feature rows to their scores, which then gets whole Arrow batches. A trained forest is one such loader, so
any model takes the same way through a scan. A manifest beside a model names its features and calibration.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskloom.functions.scoring import CALIBRATION, blend

FEATURES = ["comment_density", "mean_line_length", "keyword_score"]
#: Loads a model and returns its function from (rows, features) to a score per row.
Loader = Callable[[], Callable[[np.ndarray], np.ndarray]]
BATCH = 4096


def train_classifier(df: DataFrame, label: str = "label", trees: int = 10, depth: int = 3,
                     seed: int = 42) -> PipelineModel:
    """A forest of ten trees of depth three on labelled feature rows."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, numTrees=trees,
                                    maxDepth=depth, seed=seed, predictionCol="_class",
                                    probabilityCol="_probability", rawPredictionCol="_raw")
    return Pipeline(stages=[assembler, forest]).fit(df)


def model_score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``model_score``, 1 for the generated class and 0 otherwise."""
    scored = model.transform(df)
    return scored.withColumn("model_score", F.when(F.col("_class") == 1, 1.0).otherwise(0.0).cast(
        "float")).drop("_features", "_raw", "_probability", "_class")


def model_probability(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Like ``model_score`` with the forest's class probability, for a finer blend."""
    scored = model.transform(df)
    p = vector_to_array(F.col("_probability"))[1].cast("float")
    return scored.withColumn("model_score", p).drop("_features", "_raw", "_probability", "_class")


# Any model -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Manifest:
    """What a model needs to be used: its features, the profile of its calibration and what it changes
    there."""
    features: Sequence[str] = tuple(FEATURES)
    profile: str = "balanced"
    calibration: dict[str, float] = field(default_factory=dict)


_MANIFEST = ("features array<string>, profile string, calibration struct<model_weight: double, "
             "heuristic_weight: double, scale: double, bias: double, min_probability: double, "
             "max_probability: double>")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest from a JSON file; what is missing takes its default."""
    row = spark.read.schema(_MANIFEST).json(path, multiLine=True).first()
    profile = (row and row["profile"]) or "balanced"
    if profile not in CALIBRATION:
        raise ValueError(f"unknown calibration profile {profile}")
    given = row["calibration"].asDict() if row and row["calibration"] else {}
    return Manifest(tuple((row and row["features"]) or FEATURES), profile,
                    {k: x for k, x in given.items() if x is not None})


def model_column(load: Loader, features: Sequence[str] = tuple(FEATURES), batch: int = BATCH) -> Column:
    """The score of a row by any model. ``load`` runs once per worker; rows come in batches of at most
    ``batch``; a feature that is null is NaN for the model."""
    def make():
        score = load()

        def predict(rows: np.ndarray) -> np.ndarray:
            return np.asarray(score(rows.reshape(len(rows), -1)), dtype=np.float64).reshape(-1)
        return predict

    predict = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch,
                                input_tensor_shapes=[[len(features)]])
    return predict(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan")))
                             for f in features]))


def with_model(df: DataFrame, load: Loader, manifest: Manifest = Manifest()) -> DataFrame:
    """X3 with any model: add ``model_score``, null where the model gives no number."""
    score = model_column(load, manifest.features).cast("float")
    return df.withColumn("model_score", F.when(~F.isnan(score), score))


def blended(df: DataFrame, manifest: Manifest = Manifest(), heuristic: str = "ai_confidence") -> Column:
    """The model's score mixed into the heuristic one as the manifest says."""
    return blend(F.col("model_score"), F.col(heuristic), manifest.profile, **manifest.calibration)


def forest_loader(model: PipelineModel) -> Loader:
    """A trained forest as a loader: its trees as arrays (at most 2 ** depth nodes each), no JVM needed
    where it runs. The score is the probability of the generated class."""
    trees = []
    for tree in model.stages[-1].trees:
        nodes: list[tuple[int, float, int, int, float]] = []

        def add(node) -> int:
            at = len(nodes)
            nodes.append((-1, 0.0, 0, 0, 0.0))
            if node.getClass().getSimpleName() == "LeafNode":
                stats = list(node.impurityStats().stats())
                nodes[at] = (-1, 0.0, 0, 0, stats[1] / sum(stats) if sum(stats) else 0.0)
            else:
                split = node.split()
                nodes[at] = (split.featureIndex(), split.threshold(), add(node.leftChild()),
                             add(node.rightChild()), 0.0)
            return at

        add(tree._java_obj.rootNode())
        trees.append(nodes)

    def load():
        made = [tuple(np.array(c) for c in zip(*nodes)) for nodes in trees]

        def score(rows: np.ndarray) -> np.ndarray:
            total = np.zeros(len(rows))
            for feature, threshold, left, right, value in made:
                at = np.zeros(len(rows), np.int64)
                while (inner := feature[at] >= 0).any():
                    below = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= threshold[at]
                    at = np.where(inner, np.where(below, left[at], right[at]), at)
                total += value[at]
            return total / len(made)
        return score
    return load
