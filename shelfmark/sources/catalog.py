"""Extracts from a product catalogue table.

On a real store the table comes from ``spark.read.jdbc`` or Parquet; the filters
below are plain predicates and reach either scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_json_category(
    df: DataFrame, attributes: str = "attributes", marker: str = "filterCategory",
    json_path: str = "$.taxonomy.filterCategory", name: str = "name",
) -> DataFrame:
    """Named rows whose attributes mention the marker, with the category taken from there.

    Rows where the category is then missing are dropped.
    """
    marked = df.where(F.col(name).isNotNull() & F.col(attributes).contains(marker))
    return marked.withColumn("category", F.get_json_object(attributes, json_path)).where("category is not null")


def extract_catalogs(df: DataFrame, ids: Sequence[int], catalog: str = "catalogId", **json) -> DataFrame:
    """All usable rows of some catalogues; Spark needs no paging loop."""
    return with_json_category(df.where(F.col(catalog).isin(*ids)), **json)


def catalog_page(
    df: DataFrame, catalog_id: int, after_key: str, size: int,
    catalog: str = "catalogId", key: str = "catalogItemId", **json,
) -> DataFrame:
    """One page of a catalogue: the next ``size`` rows by key."""
    rows = df.where((F.col(catalog) == catalog_id) & (F.col(key) > after_key))
    return with_json_category(rows, **json).orderBy(key).limit(size)


def filter_categories(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), sentinel: str | None = None,
    category: str = "category", name: str = "name",
) -> DataFrame:
    """Rows whose category matches every include pattern and no exclude pattern."""
    lowered = F.lower(category)
    keep = F.col(name).isNotNull() & F.col(category).isNotNull()
    if sentinel is not None:
        keep = keep & (F.col(category) != sentinel)
    for pattern in include:
        keep = keep & lowered.like(pattern)
    for pattern in exclude:
        keep = keep & ~lowered.like(pattern)
    return df.where(keep)


def refresh_by_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], category: str | None = None) -> DataFrame:
    """Current rows for a table of keys; rows without the category, if one is named, are dropped."""
    rows = df if category is None else df.where(F.col(category).isNotNull())
    return rows.join(keys.select(*on), list(on), "left_semi")
