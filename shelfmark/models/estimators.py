"""Classifiers by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)

from shelfmark.models.boosting import SoftmaxBoosting

# Settings of the boosted trees.
BOOSTED = {"maxDepth": 6, "maxBins": 32, "maxIter": 10}


def _mlp(**params) -> Estimator:
    return MultilayerPerceptronClassifier(solver="gd", **params)


def _boosted(**params) -> Estimator:
    """All classes boosted together on the softmax loss."""
    return SoftmaxBoosting(**{**BOOSTED, **params})


def _boosted_apart(labelCol: str, featuresCol: str, parallelism: int = 4, **params) -> Estimator:
    """One boosted model per class, ``parallelism`` of them at a time; MLlib boosts two classes at a time."""
    trees = GBTClassifier(labelCol=labelCol, featuresCol=featuresCol, **{**BOOSTED, **params})
    return OneVsRest(classifier=trees, labelCol=labelCol, featuresCol=featuresCol, parallelism=parallelism)


ESTIMATORS: dict[str, Callable[..., Estimator]] = {
    "logistic": LogisticRegression,
    "mlp": _mlp,
    "naive_bayes": NaiveBayes,
    "tree": DecisionTreeClassifier,
    "forest": RandomForestClassifier,
    "boosted": _boosted,
    "boosted_apart": _boosted_apart,
}


def make_estimator(kind: str, target: str = "target", **params) -> Estimator:
    """An unfitted classifier on ``features``; keyword arguments are its parameters."""
    return ESTIMATORS[kind](labelCol=target, featuresCol="features", **params)
