"""Taxonomy, mapping and count operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import categories as C
from shelfmark.operators.attributes import preprocess
from shelfmark.operators.mapping import map_categories, mapping_sets
from shelfmark.sources.tables import union_all
from workload.bindings import (
    DOCS, GEO, LABEL, PARTS, RAGGED, RAGGED_ONLY, TAXONOMY, docs, geo, geo_taxonomy, parts, prefixes_sql, ragged, table,
)
from workload.registry import query
from workload.scans import COUNTS, MAPPING, TRAINING, TRAINING_COLUMNS, _roots, _training_raw, part_mapping

LEVELS = ["cat1", "cat2", "cat3"]


@query("label_counts", f"WITH {RAGGED} SELECT {LABEL} AS label, count(*) AS count FROM ragged GROUP BY 1")
def label_counts(spark, sf):
    return C.label_counts(ragged(spark, sf), LEVELS)


@query("category_rollup", f"WITH {COUNTS} SELECT category, count FROM counts")
def category_rollup(spark, sf):
    return C.category_counts(C.label_counts(ragged(spark, sf), LEVELS), 3)


PART_COUNTS = f"""{PARTS}, {prefixes_sql('parts', 'category')},
counts AS (SELECT prefix AS category, count(*) AS count FROM prefixes GROUP BY 1)"""


@query("category_rollup_parts", f"WITH {PART_COUNTS} SELECT category, count FROM counts")
def category_rollup_parts(spark, sf):
    labels = C.label_counts(parts(spark, sf).select("category"), ["category"])
    return C.category_counts(labels, 3)


@query(
    "taxonomy_node_counts",
    f"""WITH {TAXONOMY}, {RAGGED_ONLY}, rows_ AS (SELECT {LABEL} AS category FROM ragged), {prefixes_sql('rows_', 'category')}
    SELECT id, path, t.depth, count(p.prefix) AS count FROM taxonomy t LEFT JOIN prefixes p ON p.prefix = t.path GROUP BY ALL""",
)
def taxonomy_node_counts(spark, sf):
    counts = C.category_counts(C.label_counts(ragged(spark, sf), LEVELS), 3)
    return C.taxonomy_counts(counts, geo_taxonomy(spark, sf))


@query(
    "taxonomy_level_totals",
    f"WITH {RAGGED}, labels_ AS (SELECT {LABEL} AS label FROM ragged), {prefixes_sql('labels_', 'label')} SELECT CAST(depth AS INTEGER) AS depth, count(*) AS count FROM prefixes GROUP BY 1",
)
def taxonomy_level_totals(spark, sf):
    counts = C.category_counts(C.label_counts(ragged(spark, sf), LEVELS), 3)
    return C.level_totals(C.taxonomy_counts(counts, geo_taxonomy(spark, sf)))


@query("taxonomy_level_sizes", f"WITH {TAXONOMY} SELECT depth, count(*) AS nodes FROM taxonomy GROUP BY depth")
def taxonomy_level_sizes(spark, sf):
    return C.level_sizes(geo_taxonomy(spark, sf))


@query(
    "taxonomy_leaf_counts",
    f"""WITH {TAXONOMY}, leaves AS (
      SELECT path FROM taxonomy t WHERE NOT EXISTS (SELECT 1 FROM taxonomy c WHERE starts_with(c.path, t.path || ' > ')))
    SELECT t.id, t.path, t.depth, count(*) AS leaves FROM taxonomy t
    JOIN leaves l ON l.path = t.path OR starts_with(l.path, t.path || ' > ') GROUP BY ALL""",
)
def taxonomy_leaf_counts(spark, sf):
    return C.leaf_counts(geo_taxonomy(spark, sf))


@query(
    "taxonomy_ancestors",
    f"""WITH {TAXONOMY} SELECT t.id, t.path, string_agg(CAST(a.id AS VARCHAR), '>' ORDER BY a.depth) AS ancestors
    FROM taxonomy t JOIN taxonomy a ON a.path = t.path OR starts_with(t.path, a.path || ' > ') GROUP BY ALL""",
)
def taxonomy_ancestors(spark, sf):
    steps = C.taxonomy_ancestors(geo_taxonomy(spark, sf))
    return steps.withColumn("ancestors", F.array_join("ancestors", ">"))


@query("records_preprocessed", f"WITH {TRAINING} SELECT {TRAINING_COLUMNS} FROM known")
def records_preprocessed(spark, sf):
    rows = preprocess(_training_raw(spark, sf), _roots(spark, sf))
    return rows.select(F.col("catalogItemId").cast("string").alias("id"), "name", "description", "manufacturer", "category", *LEVELS)


@query(
    "category_ids",
    f"""WITH {TAXONOMY}, g AS (SELECT geo.id AS row_id, cat1 AS p1, cat1 || ' > ' || cat2 AS p2, category AS p3 FROM geo)
    SELECT row_id AS id, a.id AS cat1_id, b.id AS cat2_id, c.id AS cat3_id FROM g
    LEFT JOIN taxonomy a ON a.path = p1 LEFT JOIN taxonomy b ON b.path = p2 LEFT JOIN taxonomy c ON c.path = p3""",
)
def category_ids(spark, sf):
    rows = geo(spark, sf).select("id", "category")
    return C.attach_category_ids(rows, geo_taxonomy(spark, sf), 3).drop("category")


def _part_frequencies(spark, sf):
    rows = parts(spark, sf).select(F.substring_index("category", " > ", 2).alias("category"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


BRANDS = f"""{PARTS}, brands AS (SELECT id, array_to_string(string_split(category, ' > ')[1:2], ' > ') AS category FROM parts),
freq AS (SELECT category, count(*) AS count FROM brands GROUP BY 1)"""
MIN_ROWS = 13


@query(
    "labels_indexed",
    f"""WITH {BRANDS}, classes AS (
      SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS target FROM freq WHERE count >= {MIN_ROWS})
    SELECT id, category, target FROM brands JOIN classes USING (category)""",
)
def labels_indexed(spark, sf):
    rows = parts(spark, sf).select("id", F.substring_index("category", " > ", 2).alias("category"))
    return C.index_labels(rows, _part_frequencies(spark, sf), MIN_ROWS).select("id", "category", "target")


@query(
    "children_indexed",
    f"""WITH {GEO}, kids AS (SELECT cat2, CAST(row_number() OVER (ORDER BY cat2) - 1 AS INTEGER) AS target
      FROM (SELECT DISTINCT cat2 FROM geo WHERE cat1 = 'asia'))
    SELECT id, geo.cat2, target FROM geo LEFT JOIN kids ON kids.cat2 = geo.cat2""",
)
def children_indexed(spark, sf):
    rows = geo(spark, sf).select("id", "cat2")
    return C.index_children(rows, geo_taxonomy(spark, sf), "asia", "cat2")


@query(
    "min_support",
    f"WITH {BRANDS} SELECT id, category FROM brands WHERE category IN (SELECT category FROM freq WHERE count >= {MIN_ROWS})",
)
def min_support(spark, sf):
    rows = parts(spark, sf).select("id", F.substring_index("category", " > ", 2).alias("category"))
    return C.min_support(rows, _part_frequencies(spark, sf), MIN_ROWS)


ROLL_MIN = 12


@query(
    "rare_labels_rolled_up",
    f"""WITH {RAGGED}, freq AS (SELECT {LABEL} AS category, count(*) AS count FROM ragged GROUP BY 1),
    {prefixes_sql('freq', 'category', carry='category')},
    kept AS (SELECT p.category, arg_max(p.prefix, p.depth) AS prefix FROM prefixes p JOIN freq f ON f.category = p.prefix AND f.count >= {ROLL_MIN} GROUP BY 1)
    SELECT freq.category, coalesce(kept.prefix, string_split(freq.category, ' > ')[1]) AS rolled_up
    FROM freq LEFT JOIN kept ON kept.category = freq.category""",
)
def rare_labels_rolled_up(spark, sf):
    labels = C.label_counts(ragged(spark, sf), LEVELS).withColumnRenamed("label", "category")
    return C.roll_up_rare(labels, ROLL_MIN)


SOURCE_PARTS = """src AS (SELECT p_partkey AS id, lower(p_type || '>' || p_brand || '>' || p_size || '>x') AS category FROM part)"""


def source_parts(spark, sf):
    p = table(spark, sf, "part")
    path = F.lower(F.concat_ws(">", "p_type", "p_brand", F.col("p_size").cast("string"), F.lit("x")))
    return p.select(F.col("p_partkey").alias("id"), path.alias("category"))


@query(
    "categories_mapped",
    f"""WITH {MAPPING}, {SOURCE_PARTS}, {prefixes_sql('src', 'category', carry='id', sep='>')},
    best AS (SELECT id, arg_max(target_path, depth) AS mapped FROM prefixes JOIN mapping ON source_path = prefix GROUP BY id)
    SELECT src.id, category, mapped FROM src LEFT JOIN best ON best.id = src.id""",
)
def categories_mapped(spark, sf):
    return map_categories(source_parts(spark, sf), part_mapping(spark, sf)).select("id", "category", "mapped")


@query(
    "mapping_target_sets",
    """WITH pairs AS (SELECT DISTINCT p_type || '''s, parts' AS s, replace(p_brand, '#', ',') AS t FROM part)
    SELECT replace(replace(s, ',', ''), '''', '') AS source_path, string_agg(replace(t, ',', ''), '|' ORDER BY replace(t, ',', '')) AS targets
    FROM pairs GROUP BY 1""",
)
def mapping_target_sets(spark, sf):
    pairs = table(spark, sf, "part").select(
        F.concat("p_type", F.lit("'s, parts")).alias("source_path"),
        F.replace("p_brand", F.lit("#"), F.lit(",")).alias("target_path"),
    )
    return mapping_sets(pairs).withColumn("targets", F.array_join("targets", "|"))


@query("distinct_categories", f"WITH {DOCS} SELECT DISTINCT category FROM docs")
def distinct_categories(spark, sf):
    return C.distinct_values(docs(spark, sf), "category")


@query(
    "bag_union",
    "SELECT p_name AS name FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier",
)
def bag_union(spark, sf):
    named = lambda t, c: table(spark, sf, t).select(F.col(c).alias("name"))
    return union_all(named("part", "p_name"), named("customer", "c_name"), named("supplier", "s_name"))
