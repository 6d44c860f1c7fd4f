"""The classifier: trained on labelled documents, applied to others and to the hits of a scan."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import views as v
from queries.rulebook import TEXT_RULES, rules
from queries.scanning import SQL as SCANNING
from queries.scanning import score
from riskloom.functions.textsignals import code_features
from riskloom.operators import matching as mt
from riskloom.operators.model import (
    Manifest, blended, forest_loader, model_score, train_classifier, with_model)

QUERIES: dict = {}
SQL: dict = {}

_FEATURES = ("comment_density", "mean_line_length", "keyword_score")


def _labelled(spark, sf) -> DataFrame:
    docs = v.load(spark, sf, "documents").select("doc_id", "text")
    labels = v.load(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return code_features(docs.join(labels, "doc_id"), "text").drop("text")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({f: F.round(F.col(f).cast("double"), 4) for f in _FEATURES})


# The rows a model is trained on: the labelled texts with their features, and the size of each class.
QUERIES["training_rows"] = lambda spark, sf: _rounded(_labelled(spark, sf)).select(
    "doc_id", F.col("label").cast("long").alias("label"), *_FEATURES)
_F = f"({SCANNING['code_features']})"
SQL["training_rows"] = f"""SELECT f.doc_id, quality::BIGINT AS label, comment_density, mean_line_length,
  keyword_score FROM {_F} f JOIN labels l ON f.doc_id = l.doc_id"""
QUERIES["training_classes"] = lambda spark, sf: _labelled(spark, sf).groupBy(
    F.col("label").cast("long").alias("label"), (F.col("doc_id") % 2 == 0).alias("trained")).count()
SQL["training_classes"] = """SELECT quality::BIGINT AS label, doc_id % 2 = 0 AS trained, count(*) AS count
FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"""


def _train(spark, sf) -> DataFrame:
    """Class of the labelled documents that the forest was not trained on."""
    rows = _labelled(spark, sf)
    model = train_classifier(rows.where("doc_id % 2 = 0"))
    scored = model_score(rows.where("doc_id % 2 = 1"), model)
    return scored.select("doc_id", "label", F.col("model_score").cast("double").alias("model_score"))


def _blended(spark, sf) -> DataFrame:
    """Hits of a scan with the forest's probability mixed into the heuristic likelihood."""
    load = forest_loader(train_classifier(_labelled(spark, sf)))
    hits = mt.scored_findings(v.doc_corpus(spark, sf), rules(spark, TEXT_RULES))
    scored = with_model(code_features(hits, "snippet"), load)
    return scored.withColumn("blended", blended(scored)).select(
        F.col("id").alias("rule_id"), "file", "line", score("ai_confidence"), score("blended"))


QUERIES["train_classifier"] = _train
QUERIES["model_blend"] = _blended

# A model of fixed weights, which SQL can follow.
_WEIGHTS, _BIAS = (3.0, -0.04, 0.5), 0.75
_TUNED = Manifest(_FEATURES, "conservative", {"bias": 0.05, "scale": 1.2})


def _linear():
    weights = np.array(_WEIGHTS)
    return lambda rows: 1 / (1 + np.exp(-(rows @ weights + _BIAS)))


def _any_model(spark, sf) -> DataFrame:
    docs = v.load(spark, sf, "documents").select("doc_id", "text")
    rows = _rounded(code_features(docs, "text")).withColumn("ai_confidence", F.lit(40.0))
    scored = with_model(rows, _linear, _TUNED)
    return scored.withColumn("blended", blended(scored, _TUNED)).select(
        "doc_id", F.round(F.col("model_score").cast("double"), 4).alias("model_score"),
        F.abs(F.col("blended").cast("double") - (
            F.least(F.greatest(F.col("model_score").cast("double") * 1.2 + 0.05, F.lit(0.02)), F.lit(0.97))
            * 100 * 0.55 + 40 * 0.45)).alias("off")).select(
        "doc_id", "model_score", (F.col("off") < 0.06).alias("calibrated"))


QUERIES["any_model"] = _any_model
SQL["any_model"] = f"""SELECT doc_id, round((1 / (1 + exp(-({_WEIGHTS[0]} * comment_density
  + {_WEIGHTS[1]} * mean_line_length + {_WEIGHTS[2]} * keyword_score + {_BIAS}))))::REAL::DOUBLE, 4)
  AS model_score, true AS calibrated FROM {_F}"""
