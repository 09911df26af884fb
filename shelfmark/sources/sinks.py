"""Writing product tables, frequency tables, delimited files and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import level_names, path_depth
from shelfmark.sources.tables import NULL_FIELD, PRODUCT_FIELDS, escape_breaks


def write_by_category(df: DataFrame, path: str, levels: int = 3, mode: str = "error") -> None:
    """Parquet partitioned by the first category levels, few files per partition.

    ``rebalance`` gathers a category like a repartition would, but Spark splits a
    category that outgrows the advisory partition size instead of giving it to one task.
    """
    cols = level_names(levels)
    df.hint("rebalance", *cols).write.mode(mode).partitionBy(*cols).parquet(path)


def write_split(train: DataFrame, test: DataFrame, path: str, levels: int = 3, mode: str = "error") -> None:
    write_by_category(train, f"{path}/train", levels, mode)
    write_by_category(test, f"{path}/test", levels, mode)


def write_frequencies(df: DataFrame, path: str, key: str) -> None:
    """A frequency table as one ``;`` file, shallow categories first."""
    ordered = df.select(key, "count").sort(path_depth(F.col(key)), key)
    ordered.coalesce(1).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_delimited(
    df: DataFrame, path: str, compression: str | None = None, mode: str = "overwrite", sep: str = ";", escaped: bool = False
) -> None:
    """Delimited text with a header; quotes inside fields are doubled.

    With ``escaped`` any text comes back as it was from ``read_delimited(escaped=True)``:
    line breaks and backslashes are escaped, so that each record is one line, and missing
    fields differ from empty ones.
    """
    writer = df.write.mode(mode).option("sep", sep).option("header", True).option("escape", '"')
    if escaped:
        texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
        df = df.withColumns({c: escape_breaks(F.col(f"`{c}`")) for c in texts})
        writer = df.write.mode(mode).option("sep", sep).option("header", True).option("escape", '"')
        writer = writer.option("nullValue", NULL_FIELD).option("emptyValue", '""').option("quoteAll", True)
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if compression:
        writer = writer.option("compression", compression)
    writer.csv(path)


def export_columns(df: DataFrame, fields: Sequence[str] = tuple(PRODUCT_FIELDS)) -> DataFrame:
    """Products in file layout: nested groups and lists as JSON text, missing fields empty."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}

    def column(name: str):
        if name not in types:
            return F.lit(None).cast("string").alias(name)
        if types[name] in ("struct", "array", "map"):
            return F.to_json(name).alias(name)
        return F.col(name)

    return df.select(*[column(f) for f in fields])


def export_products(df: DataFrame, path: str, compression: str | None = None) -> None:
    write_delimited(export_columns(df), path, compression)


def save_model(model, path: str) -> None:
    """Save a fitted model or pipeline, replacing an older one."""
    model.write().overwrite().save(path)
