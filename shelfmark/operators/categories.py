"""Taxonomy tables, category counts and class indices.

A taxonomy is a table ``(id int, path string, depth int)``. It has thousands of
rows, not billions, so ranking it in one window is fine; product rows are never
ranked that way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.paths import (
    MAX_DEPTH,
    label_path,
    level_names,
    parent_path,
    path_depth,
    path_leaf,
    path_prefix,
    path_prefixes,
)
from shelfmark.operators.sizing import materialise


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def taxonomy_from_paths(df: DataFrame, path: str = "category") -> DataFrame:
    """Every node on the given paths, numbered by depth and name."""
    nodes = (
        distinct_values(df, path)
        .select(F.inline(path_prefixes(F.col(path))))
        .distinct()
        .select(F.col("prefix").alias("path"), "depth")
    )
    return nodes.select(
        F.row_number().over(Window.orderBy("depth", "path")).alias("id"), "path", "depth"
    )


def root_names(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.where("depth = 1").select(F.col("path").alias("root"))


def label_counts(df: DataFrame, levels: Sequence[str | Column] | None = None) -> DataFrame:
    """Rows per full label path."""
    path = label_path(levels if levels is not None else level_names())
    return df.groupBy(path.alias("label")).agg(F.count(F.lit(1)).alias("count"))


def category_counts(labels: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Counts for every category at every level, from counts per label."""
    parts = F.slice(path_prefixes(F.col("label")), 1, depth)
    return (
        labels.select("count", F.inline(parts))
        .groupBy(F.col("prefix").alias("category"))
        .agg(F.sum("count").alias("count"))
    )


def capped_frequencies(df: DataFrame, key: str, depth: int, cap: int) -> DataFrame:
    """Frequency table up to a depth, each count capped, then summed by key."""
    count = F.least(F.col("count").cast("bigint"), F.lit(cap).cast("bigint"))
    return (
        df.where(path_depth(F.col(key)) <= depth)
        .groupBy(F.col(key).alias("category"))
        .agg(F.sum(count).alias("count"))
    )


def taxonomy_counts(counts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Every taxonomy node with its row count, zero where nothing falls under it."""
    return taxonomy.join(
        counts.select(F.col("category").alias("path"), "count"), "path", "left"
    ).select("id", "path", "depth", F.coalesce("count", F.lit(0)).alias("count"))


def level_totals(node_counts: DataFrame) -> DataFrame:
    """Rows that reach each level of the taxonomy."""
    return node_counts.groupBy("depth").agg(F.sum("count").alias("count"))


def leaf_counts(taxonomy: DataFrame) -> DataFrame:
    """Leaf descendants of every node; a leaf counts itself."""
    parents = taxonomy.select(parent_path(F.col("path")).alias("path")).distinct()
    leaves = taxonomy.join(parents, "path", "left_anti")
    under = leaves.select(F.inline(path_prefixes(F.col("path"))))
    totals = under.groupBy(F.col("prefix").alias("path")).agg(F.count(F.lit(1)).alias("leaves"))
    return taxonomy.join(totals, "path").select("id", "path", "depth", "leaves")


def level_sizes(taxonomy: DataFrame) -> DataFrame:
    """Nodes per level."""
    return taxonomy.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


def taxonomy_ancestors(taxonomy: DataFrame) -> DataFrame:
    """Ids on the way from level 1 down to each node, as an array."""
    steps = taxonomy.select("id", "path", F.inline(path_prefixes(F.col("path"))))
    named = taxonomy.select(F.col("path").alias("prefix"), F.col("id").alias("step_id"))
    return (
        steps.join(named, "prefix")
        .groupBy("id", "path")
        .agg(F.sort_array(F.collect_list(F.struct("depth", "step_id"))).alias("steps"))
        .select("id", "path", F.col("steps.step_id").alias("ancestors"))
    )


def attach_category_ids(
    df: DataFrame, taxonomy: DataFrame, depth: int, path: str = "category"
) -> DataFrame:
    """Add ``cat{i}_id``: the id of the first i levels of each row's path.

    The ids of all levels are looked up for distinct categories, and joined to the
    rows once. Rows without a category take no part in the join.
    """
    ids = taxonomy.select(F.col("path").alias("prefix"), F.col("id").alias("__id"))
    steps = df.select(F.col(path).alias("__path")).where("__path is not null").distinct()
    levels = [F.struct(F.lit(i).alias("level"), path_prefix(F.col("__path"), i).alias("prefix")) for i in range(1, depth + 1)]
    named = (
        steps.select("__path", F.inline(F.array(*levels))).join(ids, "prefix")
        .groupBy("__path").agg(*[F.max(F.when(F.col("level") == i, F.col("__id"))).alias(f"cat{i}_id") for i in range(1, depth + 1)])
    )
    names = [f"cat{i}_id" for i in range(1, depth + 1)]
    none = [F.lit(None).cast(taxonomy.schema["id"].dataType).alias(c) for c in names]
    known = df.where(F.col(path).isNotNull()).join(materialise(named), F.col(path) == F.col("__path"), "left").drop("__path")
    return known.select(*df.columns, *names).unionByName(df.where(F.col(path).isNull()).select("*", *none))


def class_index(frequencies: DataFrame, min_count: int, taxonomy: DataFrame | None = None) -> DataFrame:
    """Labels with enough examples (and in the taxonomy), numbered 0.. by name."""
    labels = frequencies.where(F.col("count") >= min_count).select("category")
    if taxonomy is not None:
        labels = labels.join(taxonomy.select(F.col("path").alias("category")), "category", "left_semi")
    rank = F.row_number().over(Window.orderBy("category")) - 1
    return labels.select("category", rank.cast("int").alias("target"))


def index_labels(
    df: DataFrame, frequencies: DataFrame, min_count: int, taxonomy: DataFrame | None = None,
    num_classes: int | None = None,
) -> DataFrame:
    """Add the class index of ``category``; rows without a class are dropped.

    The index column carries nominal metadata, which the tree classifiers need beyond
    100 classes: ``num_classes`` values, by default as many as there are classes.
    """
    classes = materialise(class_index(frequencies, min_count, taxonomy))
    out = df.join(classes, "category")
    if num_classes is None:
        num_classes = max(1, classes.count())
    nominal = {"ml_attr": {"type": "nominal", "name": "target", "num_vals": num_classes}}
    return out.withColumn("target", F.col("target").alias("target", metadata=nominal))


def index_children(df: DataFrame, taxonomy: DataFrame, parent: str | None, level_col: str) -> DataFrame:
    """Add the index of a level's name among the children of one category."""
    path = F.col("path")
    under = taxonomy.where(parent_path(path) == (parent or "")).select(path_leaf(path).alias("__name"))
    rank = F.row_number().over(Window.orderBy("__name")) - 1
    children = materialise(under.distinct().select("__name", rank.cast("int").alias("target")))
    return df.join(children, F.col(level_col) == F.col("__name"), "left").drop("__name")


def min_support(df: DataFrame, frequencies: DataFrame, n: int, path: str = "category") -> DataFrame:
    """Rows whose label has at least ``n`` examples."""
    enough = materialise(frequencies.where(F.col("count") >= n).select(F.col("category").alias(path)))
    return df.join(enough, path, "left_semi")


def roll_up_rare(frequencies: DataFrame, min_count: int) -> DataFrame:
    """Where each label goes: itself, or its nearest ancestor with enough examples.

    A label with no such ancestor goes to its level-1 category.
    """
    frequencies = materialise(frequencies)
    steps = frequencies.select("category", F.inline(path_prefixes(F.col("category"))))
    enough = frequencies.where(F.col("count") >= min_count).select(
        F.col("category").alias("prefix"), F.lit(True).alias("enough")
    )
    return (
        steps.join(enough, "prefix", "left")
        .groupBy("category")
        .agg(
            F.max_by("prefix", F.when(F.col("enough"), F.col("depth"))).alias("kept"),
            F.min_by("prefix", "depth").alias("top"),
        )
        .select("category", F.coalesce("kept", "top").alias("rolled_up"))
    )
