"""Prepare labelled rows, fit feature and classifier stages, score and cross-validate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import max_probability
from shelfmark.models.embeddings import fit_word2vec
from shelfmark.models.stages import ProductTokenizer, index_column, one_hot, product_tokenizer
from shelfmark.operators.categories import index_labels
from shelfmark.operators.evaluation import accuracy, index_to_label
from shelfmark.operators.sampling import stratified_folds, stratified_split
from shelfmark.operators.sizing import materialise
from shelfmark.plans.product_table import with_label


def prepare_training(
    products: DataFrame, frequencies: DataFrame, order: str, taxonomy: DataFrame | None = None, depth: int = 7,
    per_label: int | None = 10_000, min_count: int = 1_000, frac: float = 0.75,
) -> tuple[DataFrame, DataFrame]:
    """Labelled train and test rows: rare labels dropped, the others capped (``None``: taken whole) and split."""
    labelled = index_labels(with_label(products, depth), frequencies, min_count, taxonomy)
    return stratified_split(labelled, ["category"], per_label, frac, order)


def feature_stages(categorical: Sequence[str], texts: dict[str, Estimator | Model]) -> list:
    """Index and encode categoricals, tokenise and embed texts, assemble ``features``.

    ``texts`` maps each text column to its embedding stage, fitted or not.
    """
    stages = [index_column(c).setHandleInvalid("keep") for c in categorical]
    stages += [one_hot(c) for c in categorical]
    stages += [product_tokenizer(t) for t in texts] + list(texts.values())
    inputs = [f"{c}Vector" for c in (*categorical, *texts)]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def _inputs(stage) -> list[str]:
    names = [stage.getOrDefault(p) for p in ("inputCol", "inputCols") if stage.hasParam(p) and stage.isDefined(p)]
    return [c for n in names for c in ([n] if isinstance(n, str) else n)]


def _with_tokens(df: DataFrame, features: Sequence) -> DataFrame:
    """The rows, stored with the tokens of their texts in place of the texts: embeddings read them several times."""
    tokenizers = [s for s in features if isinstance(s, ProductTokenizer)]
    for s in tokenizers:
        df = s.transform(df)
    read = {c for s in features if s not in tokenizers for c in _inputs(s)}
    return materialise(df.drop(*[s.getInputCol() for s in tokenizers if s.getInputCol() not in read]))


def _fit_features(stored: DataFrame, features: Sequence) -> tuple[PipelineModel, DataFrame]:
    """The fitted stages, and the rows with their columns; tokens are there already."""
    fitted = []
    for stage in features:
        one = fit_word2vec(stage, stored) if isinstance(stage, Word2Vec) else stage.fit(stored) if isinstance(stage, Estimator) else stage
        fitted.append(one)
        stored = stored if isinstance(stage, ProductTokenizer) else one.transform(stored)
    return PipelineModel(stages=fitted), stored


def fit_classifier(
    train: DataFrame, features: Sequence, classifier: Estimator, target: str = "target"
) -> tuple[PipelineModel, DataFrame]:
    """Fit features, then the classifier on stored features; one pipeline model comes back.

    Embeddings and the classifier pass over their input many times, so tokens and features
    are computed once and written to the scratch folder. Features are returned for training metrics.
    """
    return _fit_stored(_with_tokens(train, features), features, classifier, target)


def _fit_stored(stored: DataFrame, features: Sequence, classifier: Estimator, target: str) -> tuple[PipelineModel, DataFrame]:
    feature_model, featured = _fit_features(stored, features)
    vectors = materialise(featured.select("features", target))
    fitted = classifier.fit(vectors)
    return PipelineModel(stages=[*feature_model.stages, fitted]), vectors


def with_confidence(scored: DataFrame) -> DataFrame:
    """Add the largest class probability."""
    return scored.withColumn("max_probability", max_probability(vector_to_array("probability")))


def score(df: DataFrame, model: PipelineModel, names: DataFrame, *keep: str) -> DataFrame:
    """Predictions with class names for rows outside the training data."""
    scored = model.transform(df).select(*keep, F.col("prediction").alias("predicted_index"))
    return index_to_label(scored, names, "predicted_index", "prediction").drop("predicted_index")


def train_and_test_accuracy(model: PipelineModel, vectors: DataFrame, test: DataFrame) -> DataFrame:
    """Accuracy on the training features and on the test rows."""
    scored = lambda df, part: df.select("target", "prediction", F.lit(part).alias("part"))
    both = scored(model.stages[-1].transform(vectors), "train").unionByName(scored(model.transform(test), "test"))
    return accuracy(both, "target", "prediction", "part")


def cross_validate(
    df: DataFrame, features: Sequence, classifier: Estimator, k: int, order: str, target: str = "target"
) -> DataFrame:
    """Train and test accuracy of every fold; average the column for the summary."""
    folds = _with_tokens(stratified_folds(df, target, k, order), features)  # once for all folds
    parts = None
    for i in range(k):
        model, vectors = _fit_stored(folds.where(F.col("fold") != i), features, classifier, target)
        on_tokens = PipelineModel(stages=[s for s in model.stages if not isinstance(s, ProductTokenizer)])
        result = train_and_test_accuracy(on_tokens, vectors, folds.where(F.col("fold") == i)).withColumn("fold", F.lit(i))
        parts = result if parts is None else parts.unionByName(result)
    return parts


def model_summary(model: PipelineModel) -> DataFrame:
    """What the fitted classifier looks like: sizes, depth, importances, objective."""
    last = model.stages[-1]
    facts: list[tuple[str, float]] = []

    def add(name: str, value) -> None:
        facts.append((name, float(value)))

    if hasattr(last, "coefficientMatrix"):
        matrix = last.coefficientMatrix.toArray()
        add("coefficients", matrix.size)
        add("nonzero_coefficients", (matrix != 0).sum())
    if hasattr(last, "weights") and hasattr(last.weights, "size"):
        add("weights", last.weights.size)
        add("nonzero_weights", (last.weights.toArray() != 0).sum())
    if getattr(last, "hasSummary", False):
        for i, value in enumerate(last.summary.objectiveHistory):
            add(f"objective_{i}", round(value, 3))
    for name in ("depth", "numNodes", "totalNumNodes"):
        if hasattr(last, name):
            add(name, getattr(last, name))
    if hasattr(last, "featureImportances"):
        for i, value in enumerate(last.featureImportances.toArray()):
            add(f"importance_{i}", round(value, 3))
    if hasattr(last, "models"):
        add("binary_models", len(last.models))
    for stage in model.stages:
        if hasattr(stage, "getVectors"):
            add(f"vocabulary_{stage.getInputCol()}", stage.getVectors().count())
    return SparkSession.active().createDataFrame(facts, "name string, value double")
