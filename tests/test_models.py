"""Learned models: better than the majority class, and they survive saving."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from shelfmark.models import embeddings, stages, training
from shelfmark.models.estimators import ESTIMATORS, make_estimator
from shelfmark.session import scratch_path
from workload.learning import CLASSIFIERS, _features, _fit, _scores, _split, _topic_shares, _topic_terms
from workload.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_logistic_beats_the_majority_class(spark):
    rows = {r.part: r for r in QUERIES["classifier_logistic"](spark, SF).collect()}
    assert rows["test"].above_majority and rows["train"].above_majority


def test_every_document_of_a_large_language_is_split(spark, tmp_path):
    n = 130_000
    rows = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") < 20, "de").otherwise("en").alias("lang"), F.lit("web").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    train, test = _split(spark, str(tmp_path))
    sizes = [{r.cat1: r["count"] for r in part.groupBy("cat1").count().collect()} for part in (train, test)]
    assert sizes == [{"de": 14, "en": 97_484}, {"de": 6, "en": 32_496}]


def test_scores_carry_class_names(spark):
    got = _scores(spark, SF)
    assert got.where("prediction is null").isEmpty()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("kind", sorted(ESTIMATORS))
def test_every_estimator_takes_parameters(spark, kind):
    params = {"layers": [2, 2]} if kind == "mlp" else {}
    assert make_estimator(kind, "label", **params).getLabelCol() == "label"


def test_pipeline_reloads_with_its_own_stages(spark):
    model, _, test = _fit(spark, SF, "tree")
    path = scratch_path(spark)
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    pick = lambda m: sorted(r.prediction for r in m.transform(test).select("prediction").collect())
    assert pick(model) == pick(again)
    assert any(isinstance(s, stages.ProductTokenizer) for s in again.stages)


def test_model_key_leaves_out_columns_seed_and_partitions(spark):
    key = embeddings.model_key(embeddings.word2vec("name", **embeddings.NAME))
    assert "vectorSize=300" in key and "minCount=200" in key and key.startswith("maxIter=1")
    assert "Col" not in key and "seed" not in key and "numPartitions" not in key


def test_topics(spark):
    terms = _topic_terms(spark, SF).collect()
    assert len(terms) == 4 and all(len(r.terms.split()) == 25 for r in terms)
    shares = _topic_shares(spark, SF).select(F.split("topics", " ").cast("array<double>").alias("t"))
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x)
    # a document without any word of the vocabulary has no topics at all
    assert shares.where((F.abs(total - 1) > 0.03) & (total != 0)).isEmpty()


def test_embeddings_get_a_task_for_so_many_words(spark, monkeypatch):
    rows = spark.range(400).select(F.array(*[F.lit(w) for w in "abcde"]).alias("textTokens"))
    asked, fit = [], embeddings.Word2Vec._fit
    monkeypatch.setattr(embeddings.Word2Vec, "_fit", lambda self, df: asked.append(self.getNumPartitions()) or fit(self, df))
    spec = embeddings.word2vec("text", vectorSize=2, minCount=1, numPartitions=4)
    for task_words in (100, 10_000):
        monkeypatch.setattr(embeddings, "TASK_WORDS", task_words)
        embeddings.fit_word2vec(spec, rows)
    assert asked == [20, 4] and spec.getNumPartitions() == 4


def test_folds_share_their_tokens(spark, monkeypatch):
    train, test = _split(spark, SF)
    calls, transform = [], stages.ProductTokenizer._transform
    monkeypatch.setattr(stages.ProductTokenizer, "_transform", lambda self, df: calls.append(1) or transform(self, df))
    found = training.cross_validate(train.unionByName(test), _features(), make_estimator("tree", **CLASSIFIERS["tree"]), 2, "key")
    total = train.count() + test.count()
    assert sum(r["rows"] for r in found.collect()) == 2 * total and len(calls) == 1


def test_vectoriser_reads_stored_tokens(spark, monkeypatch):
    read, fit = [], stages.CountVectorizer._fit
    monkeypatch.setattr(stages.CountVectorizer, "_fit", lambda self, df: read.extend(df.inputFiles()) or fit(self, df))
    assert not QUERIES["count_vector_vocabulary"](spark, SF).isEmpty()
    assert read and not any("documents.parquet" in f for f in read)


def test_topics_are_checked_in_one_pass(spark, capsys):
    checked = QUERIES["topics_checked"](spark, SF)
    checked.explain()
    assert "documents.parquet" not in capsys.readouterr().out
    assert checked.first().shares_sum
