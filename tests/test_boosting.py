"""Boosted trees against a plain version, and against one model a class."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from shelfmark.models.boosting import SoftmaxBoosting, quantile_bins
from shelfmark.models.estimators import make_estimator
from shelfmark.session import scratch_path


def plain_boosting(x, y, classes, rounds, depth, step=0.3, ridge=1.0, least=1.0):
    """Exact greedy trees over distinct values; returns splits and margins."""
    margins, splits = np.zeros((len(x), classes)), []
    for r in range(rounds):
        p = np.exp(margins - margins.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g, h = p - np.eye(classes)[y], np.maximum(2 * p * (1 - p), 1e-6)
        added = np.zeros_like(margins)
        for k in range(classes):
            todo = [(0, np.arange(len(x)), 0)]
            while todo:
                node, rows, level = todo.pop(0)
                gt, ht = g[rows, k].sum(), h[rows, k].sum()
                best = None
                for f in range(x.shape[1]):
                    for t in np.unique(x[rows, f])[:-1]:
                        left = x[rows, f] <= t
                        gl, hl = g[rows[left], k].sum(), h[rows[left], k].sum()
                        if hl < least or ht - hl < least:
                            continue
                        gain = round(gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge), 6)
                        if gain > 0 and (best is None or (gain, -f, -t) > best[:3]):
                            best = (gain, -f, -t, left)
                if level == depth or best is None:
                    added[rows, k] = step * -gt / (ht + ridge)
                    continue
                splits.append((r, k, node, -best[1], -best[2], best[0], len(rows)))
                todo += [(2 * node + 1, rows[best[3]], level + 1), (2 * node + 2, rows[~best[3]], level + 1)]
        margins += added
    return splits, margins


@pytest.fixture(scope="module")
def integers(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, [6, 9, 4], size=(700, 3))
    y = np.where(x[:, 0] + rng.integers(0, 3, 700) > 4, 2, np.where(x[:, 1] * x[:, 2] > 8, 1, 0))
    rows = [(*map(int, a), int(b)) for a, b in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "a int, b int, c int, label int").repartition(5)
    return x, y, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def test_trees_equal_the_plain_version(integers):
    x, y, df = integers
    model = SoftmaxBoosting(maxIter=3, maxDepth=3, maxBins=64).fit(df)
    splits, margins = plain_boosting(x, y, 3, 3, 3)
    got = sorted(model.splits())
    assert [s[:5] + s[6:] for s in got] == [tuple(map(float, s[:5])) + s[6:] for s in sorted(splits)]
    assert np.allclose([s[5] for s in got], [s[5] for s in sorted(splits)], atol=1e-4)
    scored = {(r.a, r.b, r.c): r.rawPrediction.toArray() for r in model.transform(df).collect()}
    assert np.allclose([scored[tuple(row)] for row in x.tolist()], margins, atol=1e-5)


def test_trees_do_not_depend_on_partitions(integers):
    _, _, df = integers
    fit = lambda rows: SoftmaxBoosting(maxIter=2, maxDepth=3).fit(rows).getOrDefault("trees")
    assert fit(df) == fit(df.repartition(13, "b").sortWithinPartitions("a"))


def test_saved_with_its_pipeline(integers, spark):
    _, y, df = integers
    model = Pipeline(stages=[make_estimator("boosted", "label", maxIter=2)]).fit(df)
    path = scratch_path(spark)
    model.write().overwrite().save(path)
    pick = lambda m: sorted((r.a, r.b, r.c, r.prediction, tuple(r.probability)) for r in m.transform(df).collect())
    assert pick(model) == pick(PipelineModel.load(path))
    assert all(abs(sum(r[4]) - 1) < 1e-9 for r in pick(model))
    assert np.mean([r[3] in (0, 1, 2) for r in pick(model)]) == 1


def test_better_than_one_model_a_class(spark):
    """Classes in rings: trees that share a softmax are at least as accurate as separate ones of the same size."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 2))
    y = np.minimum((np.hypot(x[:, 0], x[:, 1]) * 3).astype(int), 4)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, label int")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).selectExpr("*", "abs(hash(a)) % 4 part")
    train, test = df.where("part < 3"), df.where("part = 3")
    accuracy = lambda kind: make_estimator(kind, "label", maxIter=5, maxDepth=4).fit(train).transform(test).where("label = prediction").count()
    assert accuracy("boosted") >= accuracy("boosted_apart")


def test_constant_features_single_class_and_few_bins(spark):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame([(1.0, float(i % 7), 0) for i in range(50)], "a double, b double, label int"))
    model = SoftmaxBoosting(maxIter=2).fit(df)
    assert model.splits() == [] and {r.prediction for r in model.transform(df).collect()} == {0.0}
    arrays = df.selectExpr("array(a, b) values")
    assert quantile_bins(arrays, "values", 3)[0] == [] and len(quantile_bins(arrays, "values", 3)[1]) <= 2
