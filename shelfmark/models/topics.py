"""Topic model over normalised descriptions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.stopwords import TOPIC, remove_stop_words
from shelfmark.functions.text import add_term, round_array
from shelfmark.functions.tokens import product_tokens
from shelfmark.models.stages import count_vectors
from shelfmark.operators.sampling import stratified_cap
from shelfmark.operators.sizing import materialise

# Settings of the topic model.
TOPICS = {
    "k": 19, "maxIter": 100, "subsamplingRate": 0.01, "optimizeDocConcentration": True, "learningOffset": 64.0,
}


def topic_tokens(df: DataFrame, text: str, out: str = "topicTokens") -> DataFrame:
    """Normalised tokens without the topic stop words."""
    return df.withColumn(out, remove_stop_words(product_tokens(F.col(text)), TOPIC, case_sensitive=True))


def fit_topics(
    df: DataFrame, text: str, order: str | None = None, category: str = "cat1", cap: int | None = None, vocab_size: int = 20_000,
    keep_counts: bool = False, **params,
) -> PipelineModel:
    """Fit on all documents, or on ``cap`` of each category; each document also carries its category as a term.

    By default a document is the set of its tokens, as published; ``keep_counts``
    trains on repeats as well.
    """
    sample = topic_tokens(df if cap is None else stratified_cap(df, [category], cap, order), text)
    named = sample.withColumn("topicTokens", add_term(F.col("topicTokens"), F.col(category), keep_counts))
    # the optimiser reads its input once per iteration, so tokens and vectors are stored
    tokens = materialise(named.select("topicTokens"))
    vectorizer = count_vectors("topic", vocab_size).fit(tokens)
    vectors = materialise(vectorizer.transform(tokens).select("topicVector"))
    lda = LDA(featuresCol="topicVector", optimizer="online", **{**TOPICS, **params})
    return PipelineModel(stages=[vectorizer, lda.fit(vectors)])


def describe_topics(model: PipelineModel, terms: int = 25) -> DataFrame:
    """The heaviest terms of each topic, as words."""
    vectorizer, lda = model.stages
    topics = lda.describeTopics(terms)
    vocabulary = SparkSession.active().createDataFrame(list(enumerate(vectorizer.vocabulary)), "term int, word string")
    pairs = F.arrays_zip("termIndices", "termWeights")
    ranked = topics.select("topic", F.posexplode(pairs).alias("rank", "pair"))
    named = ranked.join(vocabulary, ranked["pair.termIndices"] == vocabulary["term"])
    entry = F.struct("rank", "word", F.col("pair.termWeights").alias("weight"))
    listed = named.groupBy("topic").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return listed.select("topic", F.col("e.word").alias("terms"), F.col("e.weight").alias("weights"))


def topic_distribution(model: PipelineModel, df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Topic shares of each document, two places."""
    scored = model.transform(topic_tokens(df, text))
    shares = round_array(vector_to_array("topicDistribution"), 2)
    return scored.select(*keep, shares.alias("topics"))


def topic_summary(model: PipelineModel) -> DataFrame:
    """Vocabulary size and the learned weight of each topic."""
    _, lda = model.stages
    weights = [float(x) for x in lda.estimatedDocConcentration()]
    rows = [(topic, weight, lda.vocabSize()) for topic, weight in enumerate(weights)]
    return SparkSession.active().createDataFrame(rows, "topic int, concentration double, vocabulary int")
