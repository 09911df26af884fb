"""Taxonomies numbered as nested sets: totals, leaves and ancestors without expanding paths.

Nodes are numbered from 1 in the order of a walk down the tree; a node's subtree is the
numbers ``first`` to ``last``. A subtree's total is then the difference of two prefix sums, and
an ancestor the last node of its depth met so far. A taxonomy is small (one window holds
it) and has every prefix of its paths; rows are counted once, by their own category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.paths import SEPARATOR
from shelfmark.operators.sizing import materialise


def nested_sets(taxonomy: DataFrame) -> DataFrame:
    """(id, path, depth, first, last, ancestors): numbers computed once, and stored."""
    numbered = materialise(taxonomy.select(
        "id", "path", "depth", F.row_number().over(Window.orderBy(F.split("path", SEPARATOR))).alias("first")))
    size, deepest = numbered.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).first()
    levels = range(1, deepest + 1)
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy(F.desc("first")).rowsBetween(Window.unboundedPreceding, -1)
    at_level = lambda columns: F.element_at(F.array(*columns), F.col("depth"))
    following = at_level([F.min(F.when(F.col("depth") <= d, F.col("first"))).over(after) for d in levels]) if size else F.lit(None)
    way = F.array(*[F.last(F.when(F.col("depth") == d, F.col("id")), ignorenulls=True).over(before) for d in levels]) if size else F.array()
    return materialise(numbered.select(
        "id", "path", "depth", "first", (F.coalesce(following, F.lit(size + 1)) - 1).cast("int").alias("last"),
        F.slice(way, 1, F.col("depth")).cast("array<int>").alias("ancestors")))


def subtree_totals(nested: DataFrame, counts: DataFrame, category: str = "category", count: str = "count") -> DataFrame:
    """(id, path, depth, count) over each node's subtree; ``counts`` are rows by their own category.

    Categories that the taxonomy does not have count nowhere.
    """
    own = counts.select(F.col(category).alias("path"), F.col(count).alias("own"))
    placed = nested.join(own, "path", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    upto = F.sum("own").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, 0))
    sums = materialise(placed.select("id", "path", "depth", "first", "last", "own", upto.alias("upto")))
    ends = sums.select(F.col("first").alias("last"), F.col("upto").alias("end"))
    return sums.join(ends, "last").select("id", "path", "depth", (F.col("end") - F.col("upto") + F.col("own")).alias("count"))


def leaf_totals(nested: DataFrame) -> DataFrame:
    """(id, path, depth, leaves); a leaf counts itself."""
    leaves = nested.where("first = last").select(F.col("path").alias("category"), F.lit(1).cast("long").alias("count"))
    return subtree_totals(nested, leaves).withColumnRenamed("count", "leaves")


def ancestor_ids(nested: DataFrame) -> DataFrame:
    """(id, path, ancestors): ids from level 1 down to the node."""
    return nested.select("id", "path", "ancestors")

