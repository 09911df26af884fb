"""The test tables seen as product records, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import order_key
from shelfmark.operators.categories import taxonomy_from_paths
from shelfmark.sources.tables import spread

SEED = "s1"
#: Tasks that texts are dealt out to; the test tables are single row groups.
TEXT_TASKS = 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as products: three-level category, manufacturer and price."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("manufacturer"),
        F.col("p_retailprice").alias("price"),
        F.lower(F.concat_ws(" > ", "p_type", "p_brand", F.col("p_size").cast("string"))).alias("category"),
    )


PARTS = """parts AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS manufacturer, p_retailprice AS price,
         lower(concat_ws(' > ', p_type, p_brand, CAST(p_size AS VARCHAR))) AS category
  FROM part)"""


def geo(spark: SparkSession, sf: str) -> DataFrame:
    """Customers under region > nation > segment."""
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
            F.lower("r_name").alias("cat1"), F.lower("n_name").alias("cat2"), F.lower("c_mktsegment").alias("cat3"),
            F.lower(F.concat_ws(" > ", "r_name", "n_name", "c_mktsegment")).alias("category"),
        )
    )


GEO = """geo AS (
  SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance,
         lower(r_name) AS cat1, lower(n_name) AS cat2, lower(c_mktsegment) AS cat3,
         lower(concat_ws(' > ', r_name, n_name, c_mktsegment)) AS category
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def ragged(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose category is missing its lower levels where the balance is low."""
    low = F.col("balance")
    return geo(spark, sf).select(
        "id", "name", "balance", "cat1",
        F.when(low >= 0, F.col("cat2")).otherwise("").alias("cat2"),
        F.when(low >= 3000, F.col("cat3")).when(low >= 0, "").alias("cat3"),
    )


RAGGED_ONLY = """ragged AS (
  SELECT id, name, balance, cat1, CASE WHEN balance >= 0 THEN cat2 ELSE '' END AS cat2,
         CASE WHEN balance >= 3000 THEN cat3 WHEN balance >= 0 THEN '' END AS cat3
  FROM geo)"""
RAGGED = f"{GEO}, {RAGGED_ONLY}"

# a label path from cat1..cat3, trailing empty levels removed
LABEL = r"regexp_replace(concat_ws(' > ', cat1, cat2, cat3), '(?: > )* > \z', '')"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents under lang > source."""
    rows = spread(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), TEXT_TASKS)
    return rows.select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("cat1"), F.col("source").alias("cat2"),
        F.concat_ws(" > ", "lang", "source").alias("category"),
    )


DOCS = """docs AS (
  SELECT doc_id AS id, text, lang AS cat1, source AS cat2, concat_ws(' > ', lang, source) AS category
  FROM documents)"""


def geo_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy_from_paths(geo(spark, sf))


def prefixes_sql(source: str, path: str, name: str = "prefixes", carry: str = "", sep: str = " > ") -> str:
    """A CTE with one row per prefix of a path."""
    more = f"{carry}, " if carry else ""
    return f"""{name} AS (
  SELECT {more}depth, array_to_string(list_slice(string_split({path}, '{sep}'), 1, depth), '{sep}') AS prefix
  FROM (SELECT *, unnest(range(1, len(string_split({path}, '{sep}')) + 1)) AS depth FROM {source}))"""


TAXONOMY = GEO + ", " + prefixes_sql("geo", "category", "tax_prefixes") + """, taxonomy AS (
  SELECT CAST(row_number() OVER (ORDER BY depth, prefix) AS INTEGER) AS id, prefix AS path, CAST(depth AS INTEGER) AS depth
  FROM (SELECT DISTINCT depth, prefix FROM tax_prefixes))"""


def keyed(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.withColumn("key", order_key(id_col, SEED))


def key_sql(id_col: str = "id") -> str:
    return f"md5(concat(CAST({id_col} AS VARCHAR), ':{SEED}'))"


def event_products(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw product records: attribute groups as CSV-quoted JSON text."""
    e = spread(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"), TEXT_TASKS)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.pmod("user_id", F.lit(3))
    gender = F.when(kind == 0, "male").when(kind == 1, "female")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    physical = F.struct(
        F.array(F.concat(F.lit(" "), F.initcap("event_type")), F.lit("Blue")).alias("color"),
        F.when(k >= 50, F.concat(k.cast("string"), F.lit("% "), F.col("event_type"))).alias("material"),
    )
    people = F.struct(gender.alias("gender"), F.when(k < 30, "kids").otherwise("adult").alias("ageGroup"), (k >= 30).alias("adult"))
    price = F.struct(F.col("value").alias("dollarPrice"), F.when(kind == 2, "each").alias("unitOfMeasure"))
    tax = F.struct(F.when(k < 80, F.concat(F.lit("Shop > "), F.initcap("event_type"))).alias("filterCategory"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("campaign"), "event_type",
        quoted(F.to_json(physical)).alias("physicalAttributes"),
        quoted(F.to_json(people)).alias("targetDemographics"),
        quoted(F.to_json(price)).alias("pricing"),
        quoted(F.to_json(F.struct(
            physical.alias("physicalAttributes"), people.alias("targetDemographics"),
            price.alias("pricing"), tax.alias("taxonomy"),
        ))).alias("attributes"),
    )


EVENT_PRODUCTS = """ev AS (
  SELECT event_id AS id, user_id AS campaign, event_type, value AS price, CAST(props->>'$.k' AS INTEGER) AS k, user_id % 3 AS kind
  FROM events), flat AS (
  SELECT id, campaign, event_type, price, ' ' || upper(event_type[1]) || event_type[2:] || '|Blue' AS color,
         coalesce(CASE WHEN k >= 50 THEN CAST(k AS VARCHAR) || '% ' || event_type END, 'null') AS material,
         coalesce(CASE kind WHEN 0 THEN 'male' WHEN 1 THEN 'female' END, 'null') AS gender,
         CASE WHEN k < 30 THEN 'kids' ELSE 'adult' END AS age_group, k >= 30 AS adult,
         coalesce(CASE WHEN kind = 2 THEN 'each' END, 'null') AS unit,
         CASE WHEN k < 80 THEN 'shop > ' || event_type END AS filter_category
  FROM ev)"""
