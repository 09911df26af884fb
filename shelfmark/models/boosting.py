"""Gradient boosted trees for many classes at once: histogram trees on softmax gradients.

MLlib boosts two classes at a time; here every round grows one tree a class, all classes in
the same jobs. Feature values become bin numbers by quantiles once. A level of a round is
one aggregate: gradient and curvature sums by (class, node, feature, bin), combined
map-side, so what is shuffled does not depend on the number of rows. Prefix sums over bins
give the gain of every split, the best of each node goes into the split table, and rows find
their node by walking the splits made so far; no row is moved.

Sums are fixed-point integers: trees do not depend on how rows are partitioned or on tasks
that run twice. Ties go to the lower feature, then the lower threshold. The driver holds the
split tables, at most classes x 2^depth rows a round, which is the model.
"""

from __future__ import annotations

import json
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.sizing import materialise

#: One over the unit of the fixed-point sums.
UNIT = 1 << 24
#: A split is feature (-1: leaf), last bin that goes left, threshold, weight of the node.
TREE = "array<struct<feature:int,bin:int,threshold:double,weight:double>>"


def quantile_bins(df: DataFrame, values: str, max_bins: int, accuracy: int = 10_000) -> list[list[float]]:
    """For each place of an array column the distinct upper bounds of its bins, the last left open."""
    shares = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins + 1)])
    rows = (
        df.select(F.posexplode(values).alias("feature", "value")).groupBy("feature")
        .agg(F.array_sort(F.array_distinct(F.percentile_approx("value", shares, accuracy))).alias("bounds"))
        .orderBy("feature").collect()
    )
    return [[b for b in r["bounds"][:-1] if math.isfinite(b)] for r in rows]


def binned(values: Column, bounds: list[list[float]]) -> Column:
    """Bin numbers of an array of values: how many bounds lie below each."""
    table = F.from_json(F.lit(json.dumps(bounds)), "array<array<double>>")
    return F.zip_with(values, table, lambda v, below: F.size(F.filter(below, lambda b: b < v)))


def _softmax(margins: Column) -> Column:
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp(m - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def _walk(trees: Column, steps: int, goes_left) -> Column:
    """The node that a row reaches in each tree of an array, children of node n being 2n + 1 and 2n + 2."""

    def step(tree, node):
        split = F.get(tree, node)
        here = split["feature"]
        return F.when(here.isNull() | (here < 0), node).otherwise(2 * node + F.when(goes_left(split), 1).otherwise(2))

    def walk(tree):
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), lambda node, _: step(tree, node)) if steps else F.lit(0)

    return F.transform(trees, walk)


def _literal(trees: list[list[dict]]) -> Column:
    return F.from_json(F.lit(json.dumps(trees)), f"array<{TREE}>")


def gradients(margins: Column, label: Column) -> tuple[Column, Column]:
    """Gradient and curvature of the softmax loss for each class, as fixed-point numbers."""
    p = _softmax(margins)
    first = F.transform(p, lambda x, k: F.round((x - F.when(k == label, 1.0).otherwise(0.0)) * UNIT).cast("long"))
    second = F.transform(p, lambda x: F.round(F.greatest(2.0 * x * (1.0 - x), F.lit(1e-6)) * UNIT).cast("long"))
    return first, second


def histogram(rows: DataFrame, nodes: Column) -> DataFrame:
    """(class, node, feature, bin, g, h): sums over rows of (bins, g, h); nodes is a node number a class, -1 for none."""
    classes = rows.select(F.col("bins"), F.arrays_zip(nodes.alias("node"), "g", "h").alias("classes"))
    each = classes.select("bins", F.posexplode("classes").alias("class", "of")).where("of.node >= 0")
    cells = each.select("class", F.col("of.node").alias("node"), F.col("of.g").alias("g"), F.col("of.h").alias("h"), F.posexplode("bins").alias("feature", "bin"))
    return cells.groupBy("class", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("rows"))


def best_splits(cells: DataFrame, ridge: float, least_weight: float, least_gain: float) -> DataFrame:
    """(class, node, rows, weight, feature, bin, gain, left, right): the best split of each node.

    ``weight`` is that of the node itself, ``left`` and ``right`` those of its children; the
    feature is -1 where no split gains enough.
    """
    place = Window.partitionBy("class", "node", "feature")
    left = place.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select(
        "class", "node", "feature", "bin", (F.sum("g").over(left) / UNIT).alias("gl"), (F.sum("h").over(left) / UNIT).alias("hl"),
        (F.sum("g").over(place) / UNIT).alias("gt"), (F.sum("h").over(place) / UNIT).alias("ht"), F.sum("rows").over(place).alias("rows"),
        F.lead("bin").over(place.orderBy("bin")).alias("next"))
    gr, hr = F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")
    score = lambda g, h: g * g / (h + ridge)
    weight = lambda g, h: -g / (h + ridge)
    gain = F.round(score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("gt"), F.col("ht")), 6)
    allowed = F.col("next").isNotNull() & (F.col("hl") >= least_weight) & (hr >= least_weight) & (gain > least_gain)
    best = F.struct(
        gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), weight(F.col("gl"), F.col("hl")).alias("left"), weight(gr, hr).alias("right"))
    found = sums.groupBy("class", "node").agg(
        F.max(F.when(allowed, best)).alias("best"), F.max("rows").alias("rows"), F.max(weight(F.col("gt"), F.col("ht"))).alias("weight"))
    return found.select(
        "class", "node", "rows", "weight", F.coalesce(-F.col("best.f"), F.lit(-1)).alias("feature"), F.coalesce(-F.col("best.b"), F.lit(-1)).alias("bin"),
        "best.gain", "best.left", "best.right")


def grow_round(rows: DataFrame, classes: int, bounds: list[list[float]], depth: int, ridge: float, least_weight: float, least_gain: float) -> list[list[dict]]:
    """One tree a class over rows of (bins, g, h); a tree is a list of nodes in heap order."""
    trees: list[list[dict]] = [[_node() for _ in range((2 << depth) - 1)] for _ in range(classes)]
    for level in range(depth):
        first = (1 << level) - 1
        nodes = _walk(_literal(trees), level, _by_bin)
        # rows that rest in a leaf above this level take no part
        at = F.transform(nodes, lambda n: F.when(n >= first, n).otherwise(-1))
        splits = best_splits(histogram(rows, at), ridge, least_weight, least_gain).collect()
        for s in splits:
            tree, node = trees[s["class"]], s["node"]
            if s["feature"] < 0:
                tree[node] = _node(s["weight"])
                continue
            tree[node] = _node(s["weight"], s["feature"], s["bin"], bounds[s["feature"]][s["bin"]], s["gain"], s["rows"])
            tree[2 * node + 1], tree[2 * node + 2] = _node(s["left"]), _node(s["right"])
        if all(s["feature"] < 0 for s in splits):
            break
    return trees


def _node(weight=None, feature=-1, bin=None, threshold=None, gain=None, rows=None) -> dict:
    return {"feature": feature, "bin": bin, "threshold": threshold, "weight": weight, "gain": gain, "rows": rows}


def _by_bin(split: Column) -> Column:
    return F.get(F.col("bins"), split["feature"]) <= split["bin"]


def margins_added(trees: list[list[dict]], steps: int, step_size: float, goes_left) -> Column:
    """What one round adds to the margin of each class."""
    table = _literal(trees)
    nodes = _walk(table, steps, goes_left)
    return F.zip_with(table, nodes, lambda tree, node: F.coalesce(F.get(tree, node)["weight"], F.lit(0.0)) * step_size)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


class _Boosting(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasMaxIter, HasStepSize):
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree below its root", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    numClasses = Param(Params._dummy(), "numClasses", "classes; 0 for one more than the largest label", TypeConverters.toInt)
    ridge = Param(Params._dummy(), "ridge", "added to the curvature of a node", TypeConverters.toFloat)
    minWeight = Param(Params._dummy(), "minWeight", "least curvature of a child", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "gain that a split must exceed", TypeConverters.toFloat)


class SoftmaxBoosting(Estimator, _Boosting, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees on the softmax loss; labels are 0, 1, ... as integers or doubles."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability", rawPredictionCol="rawPrediction",
                 maxIter=10, maxDepth=6, maxBins=32, stepSize=0.3, numClasses=0, ridge=1.0, minWeight=1.0, minGain=0.0):
        super().__init__()
        self._setDefault(maxIter=10, maxDepth=6, maxBins=32, stepSize=0.3, numClasses=0, ridge=1.0, minWeight=1.0, minGain=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        get = self.getOrDefault
        plain = materialise(dataset.select(
            vector_to_array(self.getFeaturesCol()).alias("values"), F.col(self.getLabelCol()).cast("int").alias("label")).where("label >= 0"))
        classes = get("numClasses") or (plain.agg(F.max("label")).first()[0] or 0) + 1
        bounds = quantile_bins(plain, "values", get("maxBins"))
        rows = materialise(plain.select(
            binned(F.col("values"), bounds).alias("bins"), "label", F.array_repeat(F.lit(0.0), classes).alias("margins")))
        rounds: list[list[list[dict]]] = []
        for _ in range(self.getMaxIter()):
            g, h = gradients(F.col("margins"), F.col("label"))
            stored = materialise(rows.select("bins", "label", "margins", g.alias("g"), h.alias("h")))
            trees = grow_round(stored, classes, bounds, get("maxDepth"), get("ridge"), get("minWeight"), get("minGain"))
            rounds.append(trees)
            if all(tree[0]["feature"] < 0 for tree in trees):
                break
            added = margins_added(trees, get("maxDepth"), self.getStepSize(), _by_bin)
            rows = stored.select("bins", "label", _plus(F.col("margins"), added).alias("margins"))
        model = SoftmaxBoostingModel(numClasses=classes, trees=json.dumps(rounds))
        return self._copyValues(model, {model.numClasses: classes})


class SoftmaxBoostingModel(Model, _Boosting, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees, kept as a parameter, so that saving a pipeline saves them."""

    trees = Param(Params._dummy(), "trees", "rounds of trees, one a class, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numClasses=0, trees="[]"):
        super().__init__()
        self._setDefault(maxIter=10, maxDepth=6, maxBins=32, stepSize=0.3, ridge=1.0, minWeight=1.0, minGain=0.0)
        self._set(**self._input_kwargs)

    @property
    def rounds(self) -> list[list[list[dict]]]:
        return json.loads(self.getOrDefault("trees"))

    def splits(self) -> list[tuple]:
        """(round, class, node, feature, threshold, gain, rows) of every split."""
        return [
            (r, k, n, s["feature"], s["threshold"], s["gain"], s["rows"])
            for r, trees in enumerate(self.rounds) for k, tree in enumerate(trees) for n, s in enumerate(tree) if s["feature"] >= 0
        ]

    @property
    def featureImportances(self) -> DenseVector:
        """Share of all gain by feature."""
        gains: dict[int, float] = {}
        for _, _, _, feature, _, gain, _ in self.splits():
            gains[feature] = gains.get(feature, 0.0) + gain
        total = sum(gains.values()) or 1.0
        return Vectors.dense([gains.get(f, 0.0) / total for f in range(max(gains, default=-1) + 1)])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        values = vector_to_array(self.getFeaturesCol())
        margins = F.array_repeat(F.lit(0.0), get("numClasses"))
        for trees in self.rounds:
            margins = _plus(margins, margins_added(trees, get("maxDepth"), self.getStepSize(), lambda split: F.get(values, split["feature"]) <= split["threshold"]))
        raw, p = self.getRawPredictionCol(), self.getProbabilityCol()
        scored = dataset.withColumn(raw, margins)
        best = F.array_position(raw, F.array_max(raw)) - 1
        scored = scored.withColumn(p, array_to_vector(_softmax(F.col(raw)))).withColumn(self.getPredictionCol(), best.cast("double"))
        return scored.withColumn(raw, array_to_vector(F.col(raw)))
