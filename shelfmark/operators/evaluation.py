"""Reports on predictions: any table with a target and a prediction column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import SEPARATOR
from shelfmark.functions.text import logistic_array, round_array
from shelfmark.operators.sizing import materialise

# Confidence thresholds of the sweep.
THRESHOLDS = (0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99)


def accuracy(df: DataFrame, target: str = "target", prediction: str = "prediction", *by: str) -> DataFrame:
    right = (F.col(target) == F.col(prediction)).cast("int")
    return df.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def confusion(df: DataFrame, target: str = "target", prediction: str = "prediction") -> DataFrame:
    """Rows per (actual, predicted) pair that occurs."""
    return df.groupBy(F.col(target).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("count")
    )


def class_sizes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("actual").agg(F.sum("count").alias("size"))


def _with_sizes(errors: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sizes of both classes; a class without rows of its own has size 0."""
    actual = sizes.select("actual", F.col("size").alias("actual_size"))
    predicted = sizes.select(F.col("actual").alias("predicted"), F.col("size").alias("predicted_size"))
    joined = errors.join(actual, "actual").join(predicted, "predicted", "left")
    return joined.na.fill(0, ["predicted_size"])


def confused_by_count(pairs: DataFrame, k: int = 50, min_count: int = 100) -> DataFrame:
    """The most frequent confusions, with the sizes of both classes."""
    pairs = materialise(pairs)
    errors = (
        pairs.where((F.col("actual") != F.col("predicted")) & (F.col("count") >= min_count))
        .orderBy(F.desc("count"), "actual", "predicted")
        .limit(k)
    )
    return _with_sizes(errors, class_sizes(pairs)).select("actual", "predicted", "count", "actual_size", "predicted_size")


def confused_by_rate(pairs: DataFrame, k: int = 50) -> DataFrame:
    """The confusions that take the largest percentage of their actual class."""
    pairs = materialise(pairs)
    errors = _with_sizes(pairs.where(F.col("actual") != F.col("predicted")), class_sizes(pairs))
    rate = F.round(100 * F.col("count") / F.col("actual_size"), 3)
    return (
        errors.select("actual", "predicted", rate.alias("rate"), "actual_size", "predicted_size")
        .orderBy(F.desc("rate"), "actual", "predicted")
        .limit(k)
    )


def level_accuracy(df: DataFrame, target: str, prediction: str, depth: int) -> DataFrame:
    """Percent of rows whose first i levels all agree (or are all missing), for each i."""
    split = df.select(F.split(target, SEPARATOR).alias("t"), F.split(prediction, SEPARATOR).alias("p"))
    agree = F.lit(True)
    aggs = []
    for i in range(depth):
        agree = agree & F.get("t", i).eqNullSafe(F.get("p", i))
        aggs.append(F.round(100 * F.count_if(agree) / F.count(F.lit(1)), 6).alias(f"l{i + 1}"))
    rows = [F.struct(F.lit(i).alias("level"), F.col(f"l{i}").alias("accuracy")) for i in range(1, depth + 1)]
    return split.agg(*aggs).select(F.inline(F.array(*rows)))


def confidence_sweep(
    df: DataFrame, thresholds: Sequence[float] = THRESHOLDS, smoothing: int = 1,
    target: str = "target", prediction: str = "prediction", confidence: str = "max_probability", by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy and coverage (percent) of the rows at or above each confidence.

    One pass whatever the number of thresholds. ``smoothing`` is added to the covered
    rows when dividing; 0 gives the plain accuracy, NULL where nothing is covered.
    """
    right = F.col(target) == F.col(prediction)
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, t in enumerate(thresholds):
        sure = F.col(confidence) >= t
        aggs += [F.count_if(sure).alias(f"c{i}"), F.count_if(sure & right).alias(f"r{i}")]
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.round(F.try_divide(100.0 * F.col(f"r{i}"), F.col(f"c{i}") + smoothing), 3).alias("accuracy"),
            F.round(100.0 * F.col(f"c{i}") / F.col("total"), 3).alias("coverage"),
        )
        for i, t in enumerate(thresholds)
    ]
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def misclassified(
    df: DataFrame, target: str = "target", prediction: str = "prediction",
    probability: Column | str = "probability", raw: Column | str = "raw", *keep: str,
) -> DataFrame:
    """Wrong rows with rounded probabilities and the logistic form of the raw scores."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.where(F.col(target) != F.col(prediction)).select(
        *keep, target, prediction,
        round_array(as_col(probability)).alias("softmax"),
        logistic_array(as_col(raw)).alias("raw_probability"),
    )


def prediction_sample(df: DataFrame, by: str, *cols: str, rows: int = 100) -> DataFrame:
    """The first rows by name, always the same ones."""
    return df.select(by, *cols).orderBy(by, *cols).limit(rows)


def class_names(classes: DataFrame) -> DataFrame:
    """Class index to name, ready to join; written out so that its size is known."""
    return materialise(classes.select(F.col("target").alias("__index"), F.col("category").alias("__name")))


def index_to_label(df: DataFrame, names: DataFrame, index: str, out: str) -> DataFrame:
    """Add the name of a class index."""
    named = names.select("__index", F.col("__name").alias(out))
    return df.join(named, F.col(index).cast("int") == F.col("__index"), "left").drop("__index")


def join_curated(evaluation: DataFrame, curated: DataFrame, on: str = "id") -> DataFrame:
    """Evaluation rows with what was curated for the same id."""
    left, right = evaluation.alias("e"), curated.alias("c")
    shared = [f"e.{c}" for c in evaluation.columns if c != on]
    extra = [f"c.{c}" for c in curated.columns if c not in evaluation.columns]
    return left.join(right, on).select(on, *shared, *extra)
