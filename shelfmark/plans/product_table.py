"""Build the product table: parse records, harmonise categories, split levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import MAX_DEPTH, label_path, level_names
from shelfmark.operators.attributes import parse_attributes, split_levels, standardise
from shelfmark.operators.categories import category_counts, label_counts
from shelfmark.operators.mapping import map_categories
from shelfmark.operators.sizing import materialise


def product_table(
    dump: DataFrame, mapping: DataFrame, mapped_campaign: int, dedupe: bool = False, depth: int = MAX_DEPTH
) -> DataFrame:
    """Raw dump to products with one category path and its levels.

    A row takes its own category, and a row of the mapped campaign also its mapped
    one; with both it appears twice unless ``dedupe`` keeps only its own. Both cases
    come out of one pass over the dump.
    """
    rows = parse_attributes(standardise(dump))
    of_campaign = F.when(F.col("campaignId") == mapped_campaign, F.col("category"))
    rows = map_categories(rows.withColumn("category", of_campaign), mapping)
    own = F.when(F.length("filterCategory") >= 3, F.col("filterCategory"))
    found = F.array_compact(F.array(F.coalesce(own, "mapped")) if dedupe else F.array(own, F.col("mapped")))
    # a row with neither category has nothing to explode and drops out here
    out = rows.withColumn("category", F.explode(found)).drop("filterCategory", "mapped")
    return split_levels(out, "category", depth)


def frequency_tables(products: DataFrame, depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Label counts and category counts at all levels; the products are read once."""
    labels = materialise(label_counts(products, level_names(depth)))
    return labels, category_counts(labels, depth)


def map_retailer_catalog(df: DataFrame, mapping: DataFrame, category: str = "gmcCategory") -> DataFrame:
    """A retailer's catalogue with its categories replaced; unmapped rows are dropped."""
    lowered = df.withColumn(category, F.lower(category))
    mapped = map_categories(lowered, mapping, category)
    order = [F.col("mapped").alias(c) if c == category else F.col(c) for c in df.columns]
    return mapped.where("mapped is not null").select(*order)


def with_label(products: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Products with empty levels filled and the full label path as ``category``."""
    levels = level_names(depth)
    return products.na.fill("", levels).withColumn("category", label_path(levels))
