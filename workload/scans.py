"""Sources and sinks on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.paths import SEPARATOR
from shelfmark.operators.attributes import expand_groups, parse_attributes, split_levels
from shelfmark.operators.categories import capped_frequencies, category_counts, label_counts
from shelfmark.operators.evaluation import join_curated
from shelfmark.operators.sampling import stratified_cap, stratified_split
from shelfmark.session import scratch_path
from shelfmark.sources import catalog, sinks, tables, taxonomy
from workload.bindings import (
    EVENT_PRODUCTS, GEO, LABEL, PARTS, RAGGED, TAXONOMY, event_products, geo, geo_taxonomy, key_sql, keyed,
    parts, prefixes_sql, ragged, table,
)
from workload.registry import query


@query("product_scan", "SELECT p_name, p_brand FROM part")
def product_scan(spark, sf):
    return tables.read_products(spark, f"{sf}/part.parquet", "p_name", "p_brand")


@query("product_scan_all_columns", "SELECT * FROM part")
def product_scan_all_columns(spark, sf):
    return tables.read_products(spark, f"{sf}/part.parquet")


@query("dump_scan", "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand")
def dump_scan(spark, sf):
    return tables.read_dump(spark, sf, "part*.parquet").groupBy("p_brand").count()


RAW_PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size")
RAW_PART_SQL = "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in RAW_PART) + " FROM part"


def _delimited(spark, sf, compression=None):
    path = scratch_path(spark)
    sinks.write_delimited(table(spark, sf, "part").select(*RAW_PART), path, compression)
    return tables.read_delimited(spark, [path])


@query("delimited_scan", RAW_PART_SQL)
def delimited_scan(spark, sf):
    return _delimited(spark, sf)


@query("delimited_scan_gzip", RAW_PART_SQL)
def delimited_scan_gzip(spark, sf):
    return _delimited(spark, sf, "gzip")


def _training_raw(spark, sf):
    """Parts in the layout of downloaded product files."""
    return table(spark, sf, "part").select(
        F.col("p_size").alias("catalogId"), F.col("p_partkey").alias("catalogItemId"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("parentName"), F.col("p_brand").alias("manufacturer"),
        F.col("p_type").alias("description"), F.when(F.col("p_size") < 10, "small, light").alias("labels"),
        F.concat_ws(SEPARATOR, "p_type", "p_brand", F.col("p_size").cast("string")).alias("gmcCategory"),
    )


TRAINING = """raw AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_type ELSE '' END) AS name,
         concat_ws(' ', p_type, CASE WHEN p_size < 10 THEN 'small, light' ELSE '' END) AS description,
         p_brand AS manufacturer, lower(p_type) AS cat1, lower(p_brand) AS cat2, CAST(p_size AS VARCHAR) AS cat3
  FROM part), known AS (SELECT * FROM raw WHERE cat1 <> 'promo')"""
TRAINING_COLUMNS = "id, name, description, manufacturer, concat_ws(' > ', cat1, cat2, cat3) AS category, cat1, cat2, cat3"


def _roots(spark, sf):
    names = table(spark, sf, "part").select(F.lower("p_type").alias("root")).distinct()
    return names.where("root <> 'promo'")


def _training(spark, sf, with_gz):
    plain, gz = scratch_path(spark), scratch_path(spark)
    raw = _training_raw(spark, sf)
    sinks.write_delimited(raw, plain)
    if with_gz:
        sinks.write_delimited(raw, gz, "gzip")
    rows = tables.read_training(spark, plain, _roots(spark, sf), gz if with_gz else None)
    return rows.select(F.col("catalogItemId").alias("id"), "name", "description", "manufacturer", "category", "cat1", "cat2", "cat3")


@query("training_read", f"WITH {TRAINING} SELECT {TRAINING_COLUMNS} FROM known UNION ALL SELECT {TRAINING_COLUMNS} FROM known")
def training_read(spark, sf):
    return _training(spark, sf, True)


@query("training_read_plain", f"WITH {TRAINING} SELECT {TRAINING_COLUMNS} FROM known")
def training_read_plain(spark, sf):
    return _training(spark, sf, False)


COUNTS = f"""{RAGGED}, labels_ AS (SELECT {LABEL} AS label, count(*) AS count FROM ragged GROUP BY 1),
{prefixes_sql('labels_', 'label', carry='count')},
counts AS (SELECT prefix AS category, CAST(sum(count) AS BIGINT) AS count FROM prefixes GROUP BY 1)"""


@query(
    "capped_frequency_read",
    f"""WITH {COUNTS} SELECT category, CAST(sum(least(count, 40)) AS BIGINT) AS count
    FROM counts WHERE len(string_split(category, ' > ')) <= 2 GROUP BY category""",
)
def capped_frequency_read(spark, sf):
    """Category counts written as the stored table, read back, capped."""
    path = scratch_path(spark)
    counts = category_counts(label_counts(ragged(spark, sf), ["cat1", "cat2", "cat3"]), 3)
    sinks.write_frequencies(counts, path, "category")
    return capped_frequencies(tables.read_frequencies(spark, path, "category"), "category", 2, 40)


def part_mapping(spark, sf):
    """A mapping of part categories: all brands of two levels, small sizes one level deeper."""
    p = table(spark, sf, "part")
    brand = F.lower(F.concat(F.col("p_type"), F.lit(">"), "p_brand"))
    target = F.lower(F.concat(F.col("p_type"), F.lit(" goods > "), "p_brand"))
    wide = p.where("p_brand <> 'Brand#7'").select(brand.alias("source_path"), target.alias("target_path"))
    deep = p.where("p_size <= 10").select(
        F.concat(brand, F.lit(">"), F.col("p_size").cast("string")).alias("source_path"),
        F.concat(target, F.lit(" > small")).alias("target_path"),
    )
    return wide.union(deep).distinct()


MAPPING = """mapping AS (
  SELECT DISTINCT lower(p_type || '>' || p_brand) AS source_path, lower(p_type || ' goods > ' || p_brand) AS target_path
  FROM part WHERE p_brand <> 'Brand#7'
  UNION SELECT DISTINCT lower(p_type || '>' || p_brand || '>' || p_size), lower(p_type || ' goods > ' || p_brand || ' > small')
  FROM part WHERE p_size <= 10)"""


@query("mapping_read", f"WITH {MAPPING} SELECT source_path, target_path FROM mapping")
def mapping_read(spark, sf):
    path = scratch_path(spark)
    named = part_mapping(spark, sf).select(F.col("source_path").alias("Shop Category"), F.col("target_path").alias("Target Category"))
    sinks.write_delimited(named, path)
    return tables.read_mapping(spark, path, "Shop Category", "Target Category")


@query("category_mapping_read", f"WITH {MAPPING} SELECT source_path, target_path FROM mapping WHERE target_path LIKE '% > %'")
def category_mapping_read(spark, sf):
    """Mapping lines with some shallow pairs, which the reader leaves out."""
    path = scratch_path(spark)
    deep = part_mapping(spark, sf).select(F.upper("source_path").alias("s"), "target_path")
    shallow = table(spark, sf, "part").select(F.col("p_type").alias("s"), F.lit("all goods").alias("target_path")).distinct()
    lines = deep.union(shallow).select(F.concat_ws(";", "s", "target_path").alias("source;target"))
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return taxonomy.read_category_mapping(spark, path)


@query("taxonomy_read", f"WITH {TAXONOMY} SELECT id, path, depth FROM taxonomy")
def taxonomy_read(spark, sf):
    path = scratch_path(spark)
    lines = geo_taxonomy(spark, sf).select(
        F.concat_ws(";", F.col("id").cast("string"), F.replace("path", F.lit(" > "), F.lit(";"))).alias("id;levels")
    )
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return taxonomy.read_taxonomy(spark, path)


@query(
    "aggregated_scan",
    f"WITH {EVENT_PRODUCTS} SELECT id, material, gender, unit, round(price, 6) AS price FROM flat",
)
def aggregated_scan(spark, sf):
    """Only the groups of the fields asked for are parsed."""
    path = scratch_path(spark)
    event_products(spark, sf).drop("attributes").write.parquet(path)
    return tables.read_aggregated(
        spark, path, "id", "material", "gender", F.col("unitOfMeasure").alias("unit"),
        F.round(F.col("dollarPrice").cast("double"), 6).alias("price"),
    )


@query(
    "attributes_parsed",
    f"""WITH {EVENT_PRODUCTS} SELECT id, color, material, 'null' AS size_system, gender, age_group, adult, unit,
    round(price, 6) AS price, filter_category FROM flat""",
)
def attributes_parsed(spark, sf):
    flat = parse_attributes(event_products(spark, sf).select("id", "attributes"))
    return flat.select(
        "id", F.array_join("color", "|").alias("color"), "material", F.col("apparelSizeSystem").alias("size_system"),
        "gender", F.col("ageGroup").alias("age_group"), "adult", F.col("unitOfMeasure").alias("unit"),
        F.round(F.col("dollarPrice").cast("double"), 6).alias("price"), F.col("filterCategory").alias("filter_category"),
    )


def _catalog(spark, sf):
    """Orders as a catalogue: one per priority, JSON attributes on most rows."""
    o = table(spark, sf, "orders")
    doc = F.concat(F.lit('{"taxonomy": {"filterCategory": "'), F.col("o_orderpriority"), F.lit('"}}'))
    return o.select(
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("catalogId"),
        F.format_string("%010d", "o_orderkey").alias("catalogItemId"),
        F.when(F.col("o_totalprice") > 5000, F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))).alias("name"),
        F.when(F.col("o_orderstatus") != "P", doc).otherwise('{"taxonomy": {}}').alias("attributes"),
    )


CATALOG = """cat AS (
  SELECT CAST(left(o_orderpriority, 1) AS BIGINT) AS "catalogId", lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS "catalogItemId",
         CASE WHEN o_totalprice > 5000 THEN 'order ' || o_orderkey END AS name,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS category FROM orders)"""


@query(
    "catalog_page",
    f"""WITH {CATALOG} SELECT "catalogId", "catalogItemId", name, category FROM cat
    WHERE "catalogId" = 2 AND "catalogItemId" > '0000000500' AND name IS NOT NULL AND category IS NOT NULL
    ORDER BY "catalogItemId" LIMIT 750""",
)
def catalog_page(spark, sf):
    return catalog.catalog_page(_catalog(spark, sf), 2, "0000000500", 750).drop("attributes")


@query(
    "catalog_extract",
    f"""WITH {CATALOG} SELECT "catalogId", "catalogItemId", name, category FROM cat
    WHERE "catalogId" IN (1, 3, 5) AND name IS NOT NULL AND category IS NOT NULL""",
)
def catalog_extract(spark, sf):
    return catalog.extract_catalogs(_catalog(spark, sf), [1, 3, 5]).drop("attributes")


@query(
    "category_pattern_filter",
    f"""WITH {PARTS} SELECT id, name, category FROM parts
    WHERE category LIKE '%brand#1%' AND category LIKE '%o%' AND category NOT LIKE 'promo%' AND category NOT LIKE '%> 7'
    AND category <> 'economy > brand#1 > 1' AND name IS NOT NULL""",
)
def category_pattern_filter(spark, sf):
    rows = parts(spark, sf).select("id", "name", "category")
    return catalog.filter_categories(rows, ["%brand#1%", "%o%"], ["promo%", "%> 7"], "economy > brand#1 > 1")


@query(
    "refresh_by_keys",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
)
def refresh_by_keys(spark, sf):
    keys = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.refresh_by_keys(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), keys, ["o_orderkey"])


@query(
    "evaluation_join",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, 'null' AS gender, p_brand AS suggested, p_type AS "advCategory",
    p_size > 25 AS correct FROM part""",
)
def evaluation_join(spark, sf):
    """Two evaluation files, constants added, joined by id."""
    first, second = scratch_path(spark), scratch_path(spark)
    p = table(spark, sf, "part")
    sinks.write_delimited(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category")), first)
    sinks.write_delimited(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("opt"), (F.col("p_size") > 25).alias("correct")), second)
    shown = tables.read_eval(spark, first, {"id": "id", "name": "name", "advCategory": "category"}, {"gender": "null"})
    curated = tables.read_eval(spark, second, {"id": "id", "suggested": "opt", "correct": "correct"}, {})
    joined = join_curated(shown, curated)
    return joined.withColumn("correct", F.col("correct").cast("boolean"))


@query("write_by_category", f"WITH {GEO} SELECT cat1, cat2, cat3, count(*) AS count, CAST(sum(id) AS BIGINT) AS ids FROM geo GROUP BY ALL")
def write_by_category(spark, sf):
    path = scratch_path(spark)
    sinks.write_by_category(geo(spark, sf), path)
    back = tables.read_products(spark, path)
    return back.groupBy("cat1", "cat2", "cat3").agg(F.count(F.lit(1)).alias("count"), F.sum("id").alias("ids"))


@query(
    "write_split",
    f"""WITH {GEO}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY category ORDER BY {key_sql()}) AS rn, count(*) OVER (PARTITION BY category) AS size
      FROM geo), parts_ AS (
      SELECT id, cat1, CASE WHEN rn < round(size * 0.9) THEN 'train' ELSE 'test' END AS part FROM ranked)
    SELECT id, cat1, part FROM parts_""",
)
def write_split(spark, sf):
    path = scratch_path(spark)
    rows = keyed(geo(spark, sf))
    train, test = stratified_split(rows, ["cat1", "cat2", "cat3"], 2**31 - 1, 0.9, "key")
    sinks.write_split(train.drop("key"), test.drop("key"), path)
    both = tables.read_products(spark, f"{path}/train").withColumn("part", F.lit("train")).unionByName(
        tables.read_products(spark, f"{path}/test").withColumn("part", F.lit("test")))
    return both.select("id", "cat1", "part")


@query("delimited_lossless", "SELECT doc_id, md5(text) AS digest FROM documents UNION ALL SELECT -1 - page_id, md5(html) FROM pages")
def delimited_lossless(spark, sf):
    """Whole texts and pages written as delimited files and read back, line breaks and quotes included."""
    path = scratch_path(spark)
    texts = table(spark, sf, "documents").select("doc_id", "text").unionByName(
        table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text")))
    sinks.write_delimited(texts, path, escaped=True)
    back = tables.read_delimited(spark, path, schema="doc_id long, text string", escaped=True)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "capped_sample_ties",
    """WITH r AS (SELECT l_returnflag, l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat(CAST(l_orderkey AS VARCHAR), ':s1'))) AS rn
      FROM lineitem)
    SELECT l_returnflag, l_orderkey, count(*) AS rows FROM r WHERE rn <= 1001 GROUP BY ALL""",
)
def capped_sample_ties(spark, sf):
    """Line items keyed by their order alone: several share a key, and the cap is exact all the same."""
    rows = keyed(table(spark, sf, "lineitem"), "l_orderkey")
    return stratified_cap(rows, ["l_returnflag"], 1001, "key").groupBy("l_returnflag", "l_orderkey").agg(F.count(F.lit(1)).alias("rows"))

@query("write_frequencies", f"WITH {COUNTS} SELECT category, CAST(count AS VARCHAR) AS count FROM counts")
def write_frequencies(spark, sf):
    path = scratch_path(spark)
    sinks.write_frequencies(category_counts(label_counts(ragged(spark, sf), ["cat1", "cat2", "cat3"]), 3), path, "category")
    return tables.read_delimited(spark, path)


@query(
    "export_products",
    """SELECT CAST(event_id AS VARCHAR) AS "catalogItemId", event_type AS name,
    CASE WHEN user_id % 3 < 2 THEN CASE user_id % 3 WHEN 0 THEN 'male' ELSE 'female' END ELSE 'null' END AS gender,
    round(value, 6) AS price FROM events""",
)
def export_products(spark, sf):
    """Nested groups written as JSON fields of a delimited file, read back and parsed."""
    path = scratch_path(spark)
    nested = expand_groups(event_products(spark, sf)).select(
        F.col("id").alias("catalogItemId"), F.col("event_type").alias("name"),
        F.struct("gender", "ageGroup").alias("targetDemographics"),
        F.struct("dollarPrice").alias("pricing"),
    )
    sinks.export_products(nested, path)
    back = expand_groups(tables.read_delimited(spark, path))
    return back.select("catalogItemId", "name", "gender", F.round(F.col("dollarPrice").cast("double"), 6).alias("price"))
