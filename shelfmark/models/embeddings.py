"""Word embeddings, stored under a key made of their parameters."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.param import Params
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.models.stages import product_tokenizer
from shelfmark.operators.sizing import materialise
from shelfmark.sources.sinks import save_model

# The name and description embeddings; trainer and classifier share them.
NAME = {"vectorSize": 300, "windowSize": 5, "minCount": 200, "maxIter": 1, "numPartitions": 128}
DESCRIPTION = {"vectorSize": 300, "windowSize": 5, "minCount": 700, "maxIter": 1, "numPartitions": 512}

#: Words that a task trains on; what a task does stays the same however long the input is.
TASK_WORDS = 5_000_000


def word2vec(feature: str, **params) -> Word2Vec:
    return Word2Vec(inputCol=f"{feature}Tokens", outputCol=f"{feature}Vector", **params)


def fit_word2vec(spec: Word2Vec, stored: DataFrame) -> Word2VecModel:
    """Fit on a stored table of tokens, in ``numPartitions`` tasks or one for each ``TASK_WORDS`` words, if those are more."""
    words = stored.agg(F.sum(F.size(spec.getInputCol()))).first()[0] or 0
    tasks = max(spec.getNumPartitions(), -(-words // TASK_WORDS))
    return spec.copy({spec.numPartitions: tasks}).fit(stored)


def model_key(spec: Params) -> str:
    """``name=value`` pairs of all parameters but columns, seed and partitions."""
    values = {
        p.name: v for p, v in spec.extractParamMap().items()
        if not any(part in p.name for part in ("Col", "seed", "numPartitions"))
    }
    return "_".join(f"{name}={values[name]}" for name in sorted(values))


def model_path(location: str, spec: Params) -> str:
    return f"{location}/{model_key(spec)}/model"


def train_word2vec(df: DataFrame, feature: str, **params) -> tuple[Word2Vec, Word2VecModel]:
    """Fit an embedding of a text column; parameters default to those of names."""
    spec = word2vec(feature, **(params or NAME))
    tokens = product_tokenizer(feature).transform(df.select(feature)).select(spec.getInputCol())
    return spec, fit_word2vec(spec, materialise(tokens))  # training reads its input several times


def store_word2vec(spec: Word2Vec, model: Word2VecModel, location: str) -> str:
    path = model_path(location, spec)
    save_model(model, path)
    return path


def load_word2vec(spec: Word2Vec, location: str) -> Word2VecModel:
    """The stored model with the parameters of ``spec``."""
    return Word2VecModel.load(model_path(location, spec))


def vocabulary_size(model: Word2VecModel) -> DataFrame:
    return model.getVectors().agg(F.count(F.lit(1)).alias("words"))
