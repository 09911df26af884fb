"""Source-to-target category mapping by longest mapped prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import path_prefixes
from shelfmark.functions.text import strip_marks
from shelfmark.operators.sizing import materialise

STEP = ">"


def _trimmed(path):
    """A path without empty levels at its end."""
    return F.rtrim(path, F.lit(STEP))


def checked_mapping(mapping: DataFrame) -> DataFrame:
    """One target per source path; two different ones raise an error."""
    low, high = F.min("target_path"), F.max("target_path")
    message = F.concat(F.col("source_path"), F.lit(" is mapped to both "), F.col("low"), F.lit(" and "), F.col("high"))
    return (
        mapping.select(_trimmed(F.col("source_path")).alias("source_path"), "target_path")
        .groupBy("source_path")
        .agg(low.alias("low"), high.alias("high"))
        .select("source_path", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(message)).alias("target_path"))
    )


def category_targets(categories: DataFrame, mapping: DataFrame, col: str = "category") -> DataFrame:
    """For each distinct category the target of its deepest mapped prefix."""
    steps = categories.select(col).distinct().select(
        F.col(col), F.inline(path_prefixes(_trimmed(F.col(col)), STEP))
    )
    rules = checked_mapping(mapping)
    return (
        steps.join(rules, steps["prefix"] == rules["source_path"])
        .groupBy(col)
        .agg(F.max_by("target_path", "depth").alias("mapped"))
    )


def map_categories(df: DataFrame, mapping: DataFrame, col: str = "category", out: str = "mapped") -> DataFrame:
    """Add the mapped category, NULL where no prefix is mapped.

    Prefixes are made for distinct categories only; the resulting small table is
    written out, so the join back to the product rows has a known size.
    """
    targets = materialise(category_targets(df, mapping, col)).withColumnRenamed("mapped", out)
    # rows without a category would all meet on one key
    known = df.where(F.col(col).isNotNull()).join(targets, col, "left")
    return known.unionByName(df.where(F.col(col).isNull()).withColumn(out, F.lit(None).cast(targets.schema[out].dataType)))


def mapping_sets(mapping: DataFrame) -> DataFrame:
    """Targets named for each source category, punctuation ignored."""
    plain = mapping.select(*[strip_marks(F.col(c)).alias(c) for c in ("source_path", "target_path")])
    return plain.groupBy("source_path").agg(F.sort_array(F.collect_set("target_path")).alias("targets"))
