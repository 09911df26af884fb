"""Product records: attribute JSON, standard columns, preprocessing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import MAX_DEPTH, path_levels
from shelfmark.functions.text import clean_json, text_of
from shelfmark.operators.sizing import materialise

# The attribute groups and fields of a product record.
PHYSICAL = "struct<color array<string>, material string, apparelSizeSystem string, apparelSizeType string>"
DEMOGRAPHICS = "struct<gender string, ageGroup string, adult boolean>"
PRICING = "struct<dollarPrice decimal(30,15), unitOfMeasure string>"
TAXONOMY = "struct<filterCategory string>"
ATTRIBUTES = (
    f"struct<physicalAttributes {PHYSICAL}, targetDemographics {DEMOGRAPHICS}, "
    f"pricing {PRICING}, taxonomy {TAXONOMY}>"
)
GROUPS = {
    "physicalAttributes": (PHYSICAL, ("color", "material", "apparelSizeSystem", "apparelSizeType")),
    "targetDemographics": (DEMOGRAPHICS, ("gender", "ageGroup", "adult")),
    "pricing": (PRICING, ("dollarPrice", "unitOfMeasure")),
}
CATEGORICAL = ("material", "apparelSizeSystem", "apparelSizeType", "gender", "ageGroup", "unitOfMeasure")
DUMP_COLUMNS = {
    "campaignId": "CampaignId", "catalogId": "CatalogId", "catalogItemId": "CatalogItemId",
    "manufacturer": "Manufacturer",
}


def fill_missing(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    return df.na.fill(value, list(cols))


def standardise(df: DataFrame) -> DataFrame:
    """Raw dump columns to the product schema; attributes stay JSON text."""
    return df.select(
        *[F.col(raw).alias(name) for name, raw in DUMP_COLUMNS.items()],
        text_of("Name", "ParentName").alias("name"),
        text_of("Description", "Labels").alias("description"),
        F.lower("Category").alias("category"),
        F.col("Attributes").alias("attributes"),
    )


def parse_attributes(df: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Replace the attribute JSON by one column per field, NULL categoricals filled."""
    others = [c for c in df.columns if c != attributes]
    # one parse per row: Spark does not copy a parse into several uses of its result
    doc = df.select(*others, F.from_json(clean_json(F.col(attributes)), ATTRIBUTES).alias("__doc"))
    fields = [
        F.col(f"__doc.{group}.{field}").alias(field) for group, (_, names) in GROUPS.items() for field in names
    ]
    category = F.lower("__doc.taxonomy.filterCategory").alias("filterCategory")
    return fill_missing(doc.select(*others, *fields, category), CATEGORICAL, "null")


def expand_groups(df: DataFrame) -> DataFrame:
    """One JSON text column per group to one column per field.

    All groups are declared; Catalyst drops the parse of any group that no later
    step reads.
    """
    present = {g: spec for g, spec in GROUPS.items() if g in df.columns}
    parsed = df.select("*", *[
        F.from_json(clean_json(F.col(g)), schema).alias(f"__{g}") for g, (schema, _) in present.items()
    ])
    fields = [F.col(f"__{g}.{field}").alias(field) for g, (_, names) in present.items() for field in names]
    wide = parsed.select(*df.columns, *fields)
    return fill_missing(wide, [c for c in CATEGORICAL if c in wide.columns], "null")


def has_category_or_source(source: int | str, category: str = "filterCategory", campaign: str = "campaignId") -> Column:
    """Rows with a usable category of their own, or from one special campaign."""
    return (F.length(category) >= 3) | (F.col(campaign) == source)


def split_levels(df: DataFrame, path: str = "category", depth: int = MAX_DEPTH) -> DataFrame:
    return df.select("*", *path_levels(F.col(path), depth))


def preprocess(
    df: DataFrame, roots: DataFrame, root: str = "root", category: str = "gmcCategory", depth: int = MAX_DEPTH
) -> DataFrame:
    """Training records: texts composed, category lower-cased and split, unknown roots dropped.

    ``roots`` is a one-column table of level-1 names, a few dozen rows of the taxonomy.
    """
    merged = ("name", "parentName", "description", "labels")
    others = [c for c in df.columns if c not in (*merged, category)]
    filled = fill_missing(df, [c for c in (*merged, "manufacturer") if c in df.columns], "")
    records = filled.select(
        text_of("name", "parentName").alias("name"),
        text_of("description", "labels").alias("description"),
        F.lower(category).alias("category"),
        *others,
    )
    levelled = split_levels(records, "category", depth)
    known = materialise(roots.select(F.col(root).alias("__root")).distinct())
    return levelled.join(known, levelled["cat1"] == known["__root"], "left_semi")


def explode_clean(df: DataFrame, col: str, out: str = "word") -> DataFrame:
    """One row per array element, trimmed and lower-cased; other columns stay."""
    rest = [c for c in df.columns if c != col]
    items = df.where(F.size(col) >= 1).select(*rest, F.explode(col).alias(out))
    return items.withColumn(out, F.lower(F.trim(out)))


def partition_by_language(df: DataFrame, keep: Sequence[str], lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Rows in the wanted languages, and all the others (unlabelled rows included)."""
    wanted = F.coalesce(F.col(lang).isin(*keep), F.lit(False))
    return df.where(wanted), df.where(~wanted)
