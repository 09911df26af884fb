"""Product tables and delimited files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.attributes import expand_groups, preprocess

# The columns of an exported product, in file order.
PRODUCT_FIELDS = (
    "catalogId catalogItemId name isParent parentName parentSku manufacturer labels description "
    "pricing shipping physicalAttributes targetDemographics mediaAttributes softwareAttributes "
    "cellAttributes watchAttributes bookAttributes financialAttributes gmcCategory"
).split()


#: How a missing field is written where empty ones must stay empty.
NULL_FIELD = "\\N"


def read_products(spark: SparkSession, path: str, *cols: str | Column) -> DataFrame:
    """A Parquet product table; without columns, all of them."""
    table = spark.read.parquet(path)
    return table.select(*cols) if cols else table


#: Tasks for each split of a scan that is dealt out.
SPLIT_TASKS = 4


def spread(scan: DataFrame, partitions: int | None = None) -> DataFrame:
    """A scan dealt out to ``partitions`` tasks, where the caller asks for it; else as it is.

    Meant before heavy work on texts that sit in a few large row groups. It shuffles
    whole rows, so it is never decided here. A scan of many splits is dealt out to ``SPLIT_TASKS``
    for each, so that a task's share does not grow with the input.
    """
    return scan if partitions is None else scan.repartition(max(partitions, SPLIT_TASKS * scan.rdd.getNumPartitions()))


def read_dump(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder whose names match a pattern."""
    return spark.read.option("pathGlobFilter", glob).parquet(path)


#: Written in place of line breaks, NUL and of itself, so that a record is one line and files can be split.
ESCAPES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\x00", "\\0"))


def escape_breaks(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def _replaced(pieces: Column, old: str, new: str) -> Column:
    return F.transform(pieces, lambda piece: F.replace(piece, F.lit(old), F.lit(new)))


def unescape_breaks(text: Column) -> Column:
    """The inverse of ``escape_breaks``: between doubled backslashes the other pairs are put back."""
    pieces = F.split(text, r"\\\\")
    for plain, escaped in ESCAPES[1:]:
        pieces = _replaced(pieces, escaped, plain)
    return F.array_join(pieces, "\\")


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], sep: str = ";", schema: str | None = None, multiline: bool = False, escaped: bool = False,
) -> DataFrame:
    """Delimited text with a header, all columns strings; gzip is told by the suffix.

    Quotes inside fields are doubled. Line breaks in fields are read with ``multiline``
    (such a file is one split) or, from files of ``write_delimited``, with ``escaped``.
    Give ``schema`` to skip the pass that reads the header.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("escape", '"').option("multiLine", multiline)
    if escaped:  # blanks and empty fields count there
        reader = reader.option("nullValue", NULL_FIELD).option("emptyValue", "")
    if schema:
        reader = reader.schema(schema)
    table = reader.csv(paths if isinstance(paths, str) else list(paths))
    if not escaped:
        return table
    texts = [f.name for f in table.schema.fields if f.dataType.typeName() == "string"]
    return table.withColumns({c: unescape_breaks(F.col(f"`{c}`")) for c in texts})


def read_training(
    spark: SparkSession, plain: str | Sequence[str], roots: DataFrame, gz: str | Sequence[str] | None = None
) -> DataFrame:
    """Downloaded product files, plain and optionally gzip, preprocessed as one table."""
    raw = read_delimited(spark, plain)
    if gz is not None:
        raw = union_all(raw, read_delimited(spark, gz))
    return preprocess(raw, roots)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = first
    for df in others:
        out = out.unionByName(df)
    return out


def read_frequencies(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A stored frequency table: ``category`` and ``count``."""
    table = read_delimited(spark, path, schema=f"{key} string, count bigint")
    return table.select(F.col(key).alias("category"), "count")


def read_mapping(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """A category mapping file with its two columns renamed."""
    return read_delimited(spark, path).select(
        F.col(source).alias("source_path"), F.col(target).alias("target_path")
    )


def read_aggregated(spark: SparkSession, path: str, *cols: str | Column) -> DataFrame:
    """The aggregated table; attribute groups are parsed only for the columns asked for."""
    table = spark.read.parquet(path)
    return expand_groups(table).select(*cols) if cols else table


def read_eval(spark: SparkSession, path: str, rename: Mapping[str, str], constants: Mapping[str, str]) -> DataFrame:
    """An evaluation file: columns picked and renamed, constant columns added."""
    return read_delimited(spark, path).select(
        *[F.col(old).alias(new) for new, old in rename.items()],
        *[F.lit(value).alias(name) for name, value in constants.items()],
    )
