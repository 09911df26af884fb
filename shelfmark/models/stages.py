"""Pipeline stages over the native token expressions, saveable like any other stage."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import CountVectorizer, OneHotEncoder, StringIndexer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from shelfmark.functions.tokens import product_tokens, sorted_ngrams


class ProductTokenizer(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text to normalised product tokens."""

    emit = Param(Params._dummy(), "emit", "published or placeholder", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, emit="published"):
        super().__init__()
        self._setDefault(emit="published")
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        tokens = product_tokens(F.col(self.getInputCol()), self.getOrDefault(self.emit))
        return dataset.withColumn(self.getOutputCol(), tokens)


class SortedNGram(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Tokens to order-free n-grams."""

    n = Param(Params._dummy(), "n", "words per gram", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, n=2):
        super().__init__()
        self._setDefault(n=2)
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        grams = sorted_ngrams(F.col(self.getInputCol()), self.getOrDefault(self.n))
        return dataset.withColumn(self.getOutputCol(), grams)


def product_tokenizer(feature: str) -> ProductTokenizer:
    return ProductTokenizer(inputCol=feature, outputCol=f"{feature}Tokens")


def index_column(feature: str) -> StringIndexer:
    """Category values to indices in alphabetical order."""
    return StringIndexer(inputCol=feature, outputCol=f"{feature}Index", stringOrderType="alphabetAsc")


def one_hot(feature: str) -> OneHotEncoder:
    return OneHotEncoder(inputCol=f"{feature}Index", outputCol=f"{feature}Vector")


def count_vectors(feature: str, vocab_size: int = 20_000) -> CountVectorizer:
    return CountVectorizer(inputCol=f"{feature}Tokens", outputCol=f"{feature}Vector", vocabSize=vocab_size)
