"""Classification level by level: a model for each inner category, and the best path through them.

Every category with children has its own word model over them (multinomial naive Bayes on
token counts); the models of all categories come from one aggregate over (path, token). Rows
that end at a category are one more child, the category itself, so paths may be of any depth.

The weight of a token for a child is ``ln(1 + n / smoothing)``, above what an unseen token
counts, so only (category, token, child) that occur are stored and joined. A row is scored
only among the children of the categories on its beam; the share of each child is normalised
within its category, and a path's score is the sum of the logarithms on the way down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.paths import path_prefixes
from shelfmark.operators.sizing import materialise

ROOT = ""
#: Weights that a task carries, of the tokens that most texts have, about 50 bytes each; all others are joined.
CARRIED = 1 << 20


@dataclass
class LevelModels:
    """``nodes``: (parent, child, target, count, prior, unseen); ``weights``: (parent, token, children of (child, weight))."""

    nodes: DataFrame
    weights: DataFrame


def _steps(path: str):
    """A path's choices from the root down, the last one to stop where it is."""
    parts = path_prefixes(F.col(path))["prefix"]
    down = F.concat(F.array(F.lit(ROOT)), parts)
    return F.arrays_zip(down.alias("parent"), F.concat(parts, F.slice(parts, -1, 1)).alias("child"))


def fit_levels(rows: DataFrame, tokens: str, path: str = "category", smoothing: float = 1.0) -> LevelModels:
    """Models of all categories from labelled rows; rows without a path are left out.

    Children are numbered 0.. by name within their category, as ``index_children`` does;
    a stop has no number.
    """
    known = rows.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.col(tokens).alias("tokens"))
    per_path = materialise(known.groupBy("path").agg(F.count("*").alias("count")))
    per_token = materialise(known.select("path", F.explode("tokens").alias("token")).groupBy("path", "token").agg(F.count("*").alias("n")))

    choices = per_path.select("count", F.inline(_steps("path"))).groupBy("parent", "child").agg(F.sum("count").alias("count"))
    open_ones = materialise(choices.groupBy("parent").agg(F.sum("count").alias("rows"), F.count("*").alias("children")))
    counts = materialise(
        per_token.select("token", "n", F.inline(_steps("path"))).join(open_ones.where("children > 1").select("parent"), "parent", "left_semi")
        .groupBy("parent", "child", "token").agg(F.sum("n").alias("n")))
    sizes = counts.groupBy("parent", "child").agg(F.sum("n").alias("tokens"))
    words = counts.groupBy("parent").agg(F.count_distinct("token").alias("words"))

    number = F.row_number().over(Window.partitionBy("parent").orderBy((F.col("child") == F.col("parent")).cast("int"), "child")) - 1
    mass = F.coalesce("tokens", F.lit(0)) + smoothing * (F.coalesce("words", F.lit(0)) + 1)
    nodes = (
        choices.join(open_ones, "parent").join(sizes, ["parent", "child"], "left").join(words, "parent", "left")
        .select("parent", "child", F.when(F.col("child") != F.col("parent"), number).alias("target"), "count",
                F.log(F.col("count") / F.col("rows")).alias("prior"), F.log(F.lit(smoothing) / mass).alias("unseen"))
    )
    weighed = counts.select("parent", "token", F.struct("child", F.log(1 + F.col("n") / smoothing).alias("weight")).alias("of"))
    weights = weighed.groupBy("parent", "token").agg(F.sort_array(F.collect_list("of")).alias("children"))
    return LevelModels(materialise(nodes), materialise(weights))


def _bags(rows: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """(id, bag of (token, n)), one row per id: texts go to their ids before they are counted, not a row for each token."""
    texts = rows.select(F.col(id_col).alias("id"), F.col(tokens).alias("tokens")).where(F.col("id").isNotNull()).repartition("id")
    counted = texts.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    return counted.groupBy("id").agg(F.collect_list(F.struct("token", "n")).alias("bag"))


def _evidence(asking: DataFrame, bags: DataFrame, nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, number, evidence) for the children of the categories of (id, parent): what the tokens of a row add up to.

    A token travels once for all categories of its row, and the children are numbers from there on:
    what is shuffled is a row for each token of a text and its parts of the sums, without a name.
    """
    of_ids = asking.groupBy("id").agg(F.collect_list("parent").alias("parents"))
    sent = bags.join(of_ids, "id").select("id", "parents", F.inline("bag"))
    known = weights.join(asking.select("parent").distinct(), "parent", "left_semi").repartition("token").select("parent", "token", F.inline("children"))
    known = known.join(nodes.select("parent", "child", "number"), ["parent", "child"])
    known = known.groupBy("token", "parent").agg(F.collect_list(F.struct("number", "weight")).alias("children"))
    known = known.groupBy("token").agg(F.collect_list(F.struct("parent", "children")).alias("known"))
    of_parent = lambda p: F.transform(F.filter("known", lambda k: k["parent"] == p), lambda k: k["children"])
    met = sent.join(known, "token").select("id", "n", F.inline(F.flatten(F.flatten(F.transform("parents", of_parent)))))
    return met.groupBy("id", "number").agg(F.sum(F.col("n") * F.col("weight")).alias("evidence"))


def _carried(weights: DataFrame) -> DataFrame:
    """(token, code): the tokens with the largest weights, as many as have ``CARRIED`` weights in all."""
    largest = F.array_max(F.transform("children", lambda c: c["weight"]))
    sizes = materialise(weights.groupBy("token").agg(F.max(F.floor(64 * largest)).alias("level"), F.sum(F.size("children")).alias("entries")))
    upto = F.sum("entries").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
    levels = sizes.groupBy("level").agg(F.sum("entries").alias("entries")).withColumn("upto", upto)  # weights are logarithms: some hundred rows
    least = levels.where(F.col("upto") <= CARRIED).agg(F.min("level")).first()[0]
    picked = sizes.where(F.col("level") >= F.lit(least)).select("token").coalesce(1)
    return materialise(picked.withColumn("code", F.monotonically_increasing_id().cast("int")))


def _coded(bags: DataFrame, carried: DataFrame) -> DataFrame:
    """(id, codes, counts, bag): the carried tokens of each bag as numbers, and the others."""
    coded = bags.select("id", F.inline("bag")).join(F.broadcast(carried), "token", "left")
    own = F.when(F.col("code").isNotNull(), F.struct("code", F.col("n").cast("int").alias("n")))
    split = coded.groupBy("id").agg(
        F.collect_list(own).alias("own"), F.collect_list(F.when(F.col("code").isNull(), F.struct("token", "n"))).alias("bag"))
    return split.select("id", F.col("own.code").alias("codes"), F.col("own.n").alias("counts"), "bag")


def _carried_evidence(asking: DataFrame, coded: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, number, evidence) of the carried tokens, which meet (family, code, children) and are summed in the task that holds the row."""
    of_ids = asking.groupBy("id").agg(F.collect_list("family").alias("families"))
    known = F.broadcast(weights.join(asking.select("family").distinct(), "family", "left_semi"))
    sent = coded.select("id", "codes", "counts").join(of_ids, "id")
    sent = sent.select("id", "families", F.inline(F.arrays_zip(F.col("codes").alias("code"), F.col("counts").alias("n"))))
    met = sent.select("id", F.explode("families").alias("family"), "code", "n").join(known, ["family", "code"]).select("id", "n", F.inline("children"))
    return met.groupBy("id", "number").agg(F.sum(F.col("n") * F.col("weight")).alias("evidence"))


def decode_paths(rows: DataFrame, models: LevelModels, id_col: str, tokens: str, beam: int = 4, depth: int = 7) -> DataFrame:
    """(id, prediction, log_probability): the likeliest path of each id.

    Tokens that most texts have meet their weights in the tasks that hold the rows, the others are joined.
    After each level the ``beam`` best ways of a row go on, equals by name; a beam as wide as
    a level has categories makes the search exhaustive. Ids are distinct.
    """
    of_parent = Window.partitionBy("parent")
    nodes = models.nodes.withColumns({"number": F.monotonically_increasing_id(), "siblings": F.count("*").over(of_parent)})
    nodes = materialise(nodes)
    nodes = materialise(nodes.withColumn("family", F.min("number").over(of_parent)))
    carried = _carried(models.weights)
    bags = materialise(_coded(_bags(rows, id_col, tokens), carried))
    of_child = models.weights.join(F.broadcast(carried), "token").select("parent", "code", F.inline("children")).join(nodes, ["parent", "child"])
    known = materialise(of_child.groupBy("family", "code").agg(F.collect_list(F.struct("number", "weight")).alias("children")))
    others = materialise(models.weights.join(F.broadcast(carried), "token", "left_anti"))
    open_ones = nodes.where("siblings > 1").select("parent", "family").distinct()  # the only child of a category needs no evidence
    start = rows.select(
        F.col(id_col).alias("id"), F.coalesce(F.size(tokens), F.lit(0)).alias("length"), F.lit(ROOT).alias("node"),
        F.lit(0.0).alias("score"), F.lit(False).alias("ended"))
    way = materialise(start)
    within = Window.partitionBy("id", "parent")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "node", "ended")
    for _ in range(depth + 1):
        open_ways = way.where("not ended").select("id", "length", F.col("node").alias("parent"), "score")
        asking = open_ways.select("id", "parent").join(open_ones, "parent")
        asked = open_ways.join(nodes, "parent")
        if asking.isEmpty():  # no bag is read where nobody has a choice
            asked = asked.withColumn("evidence", F.lit(0.0))
        else:
            evidence = _carried_evidence(asking, bags, known).unionByName(_evidence(asking, bags, nodes, others))
            asked = asked.join(evidence.groupBy("id", "number").agg(F.sum("evidence").alias("evidence")), ["id", "number"], "left")
        local = F.col("prior") + F.col("length") * F.col("unseen") + F.coalesce("evidence", F.lit(0.0))
        scored = asked.withColumn("local", local).withColumn("top", F.max("local").over(within))
        share = F.col("local") - F.col("top") - F.log(F.sum(F.exp(F.col("local") - F.col("top"))).over(within))
        stepped = scored.withColumn("share", share).select(
            "id", "length", F.col("child").alias("node"), (F.col("score") + F.col("share")).alias("score"), (F.col("child") == F.col("parent")).alias("ended"))
        pool = stepped.unionByName(way.where("ended").select(*stepped.columns))
        way = materialise(pool.withColumn("at", F.row_number().over(best)).where(F.col("at") <= beam).drop("at"))
        if way.where("not ended").isEmpty():
            break
    first = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "node"))
    found = way.where("ended").withColumn("at", first).where("at = 1")
    return found.select(F.col("id").alias(id_col), F.col("node").alias("prediction"), F.col("score").alias("log_probability"))
