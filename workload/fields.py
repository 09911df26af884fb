"""Projections, filters and scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.functions.paths import label_path, path_depth
from shelfmark.functions.tokens import tokenize_list, tokenize_words
from shelfmark.operators import attributes
from shelfmark.operators.sampling import with_rank
from workload.bindings import (
    DOCS, EVENT_PRODUCTS, LABEL, PARTS, RAGGED, SEED, docs, event_products, key_sql, keyed, parts, ragged, table,
)
from workload.registry import query


@query("composed_text", "SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_type END, p_brand) AS text FROM part")
def composed_text(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.text_of("p_name", F.when(F.col("p_size") > 25, F.col("p_type")), "p_brand").alias("text"))


@query("json_text_cleaned", "SELECT event_id, replace(props, ': ', ':') AS props, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def json_text_cleaned(spark, sf):
    """Properties as a CSV file holds them, cleaned and parsed."""
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))
    clean = table(spark, sf, "events").select("event_id", text.clean_json(quoted).alias("props"))
    return clean.select(
        "event_id", F.replace("props", F.lit(": "), F.lit(":")).alias("props"), F.from_json("props", "k int")["k"].alias("k")
    )


@query(
    "path_levels",
    f"""WITH {PARTS} SELECT id, string_split(category, ' > ')[1] AS cat1, string_split(category, ' > ')[2] AS cat2,
    string_split(category, ' > ')[3] AS cat3, string_split(category, ' > ')[4] AS cat4 FROM parts""",
)
def path_levels(spark, sf):
    return attributes.split_levels(parts(spark, sf).select("id", "category"), "category", 4).drop("category")


@query("label_paths", f"WITH {RAGGED} SELECT id, {LABEL} AS label FROM ragged")
def label_paths(spark, sf):
    return ragged(spark, sf).select("id", label_path(["cat1", "cat2", "cat3"]).alias("label"))


@query("missing_filled", f"WITH {RAGGED} SELECT id, coalesce(cat2, '') AS cat2, coalesce(cat3, 'null') AS cat3 FROM ragged")
def missing_filled(spark, sf):
    rows = ragged(spark, sf).select("id", "cat2", "cat3")
    return attributes.fill_missing(attributes.fill_missing(rows, ["cat2"], ""), ["cat3"], "null")


@query(
    "records_standardised",
    """SELECT p_size AS "campaignId", p_partkey AS "catalogItemId", p_brand AS manufacturer,
    concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_type END) AS name, p_type || ' red blue' AS description,
    lower(p_type || ' > ' || p_brand) AS category FROM part""",
)
def records_standardised(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_size").alias("CampaignId"), F.lit(1).alias("CatalogId"), F.col("p_partkey").alias("CatalogItemId"),
        F.col("p_name").alias("Name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("ParentName"),
        F.col("p_type").alias("Description"), F.array(F.lit("red"), F.lit("blue")).alias("Labels"),
        F.col("p_brand").alias("Manufacturer"), F.concat_ws(" > ", "p_type", "p_brand").alias("Category"),
        F.lit("{}").alias("Attributes"),
    )
    return attributes.standardise(raw).drop("attributes", "catalogId")


@query(
    "category_or_source",
    f"WITH {EVENT_PRODUCTS} SELECT id, filter_category FROM flat WHERE length(filter_category) >= 3 OR campaign = 7",
)
def category_or_source(spark, sf):
    flat = attributes.parse_attributes(event_products(spark, sf).select("id", "campaign", "attributes"))
    kept = flat.where(attributes.has_category_or_source(7, campaign="campaign"))
    return kept.select("id", F.col("filterCategory").alias("filter_category"))


@query("path_depths", f"WITH {RAGGED} SELECT len(string_split({LABEL}, ' > ')) AS depth, count(*) AS count FROM ragged GROUP BY 1")
def path_depths(spark, sf):
    label = label_path(["cat1", "cat2", "cat3"])
    return ragged(spark, sf).groupBy(path_depth(label).cast("bigint").alias("depth")).count()


BUCKET = """CASE WHEN price IS NULL THEN NULL WHEN price = 0 THEN 0 WHEN price <= 1 THEN 1
  WHEN price <= 20 THEN floor(price / 2 + 0.5) * 2 WHEN price <= 100 THEN floor(price / 10 + 0.5) * 10
  WHEN price <= 1000 THEN floor(price / 100 + 0.5) * 100 WHEN price <= 10000 THEN floor(price / 1000 + 0.5) * 1000
  WHEN price <= 100000 THEN floor(price / 20000 + 0.5) * 20000 WHEN price <= 1000000 THEN 1000000 ELSE price END"""


@query(
    "price_buckets",
    f"SELECT l_orderkey, l_linenumber, l_partkey, price, CAST({BUCKET} AS DOUBLE) AS bucket FROM (SELECT *, l_extendedprice * l_discount AS price FROM lineitem)".replace(
        "l_partkey, price,", "l_partkey, round(price, 6) AS price,"),
)
def price_buckets(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") * F.col("l_discount"))
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("price", 6).alias("price"), text.price_bucket(F.col("price")).alias("bucket")
    )


@query(
    "material_cleaned",
    f"WITH {EVENT_PRODUCTS} SELECT id, trim(regexp_replace(material, '[0-9%]', '', 'g')) AS material FROM flat",
)
def material_cleaned(spark, sf):
    flat = attributes.expand_groups(event_products(spark, sf))
    return flat.select("id", text.clean_material(F.col("material")).alias("material"))


@query(
    "colours_exploded",
    f"WITH {EVENT_PRODUCTS} SELECT id, lower(trim(unnest(string_split(color, '|')))) AS word FROM flat",
)
def colours_exploded(spark, sf):
    flat = attributes.expand_groups(event_products(spark, sf)).select("id", "color")
    return attributes.explode_clean(flat, "color")


@query("marks_stripped", "SELECT doc_id, md5(replace(replace(text, ',', ''), '''', '')) AS digest FROM documents")
def marks_stripped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.strip_marks(F.col("text"))).alias("digest"))


@query("rounded_half_up", "SELECT o_orderkey, round(o_totalprice / 1000, 3) AS thousands FROM orders")
def rounded_half_up(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 1000, 3).alias("thousands"))


EMBEDDED = "emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query(
    "score_arrays",
    f"""WITH {EMBEDDED} SELECT vec_id, array_to_string(list_transform(e, lambda x: printf('%.3f', 1 / (1 + exp(-x)))), ' ') AS logistic
    FROM emb""",
)
def score_arrays(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    shown = F.transform(text.logistic_array(F.col("e")), lambda x: F.format_string("%.3f", x))
    return e.select("vec_id", F.array_join(shown, " ").alias("logistic"))


@query("max_scores", f"WITH {EMBEDDED} SELECT vec_id, round(list_max(e), 6) AS confidence FROM emb")
def max_scores(spark, sf):
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(text.max_probability(e), 6).alias("confidence"))


@query(
    "term_added",
    f"""WITH {DOCS}, toks AS (SELECT id, cat1, regexp_extract_all(lower(text), '\\w+') AS t FROM docs)
    SELECT id, len(list_distinct(list_append(t, cat1))) AS size, cat1 AS first FROM toks""",
)
def term_added(spark, sf):
    tokens = docs(spark, sf).select("id", "cat1", tokenize_words(F.col("text")).alias("t"))
    united = tokens.select("id", text.add_term(F.col("t"), F.col("cat1")).alias("u"))
    return united.select("id", F.size("u").cast("bigint").alias("size"), F.get("u", 0).alias("first"))


@query(
    "random_order",
    f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {key_sql('o_orderkey')}) AS rn FROM orders",
)
def random_order(spark, sf):
    """A repeatable random order inside each group, ranked exactly."""
    rows = keyed(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return with_rank(rows, ["o_orderstatus"], "key").select("o_orderkey", "rn")


@query(
    "languages_partitioned",
    "SELECT lang, lang IN ('en', 'fr') AS kept, count(*) AS count FROM documents GROUP BY ALL",
)
def languages_partitioned(spark, sf):
    kept, others = attributes.partition_by_language(table(spark, sf, "documents").select("lang"), ["en", "fr"])
    count = lambda df, flag: df.groupBy("lang", F.lit(flag).alias("kept")).count()
    return count(kept, True).union(count(others, False))


@query(
    "list_items",
    f"""WITH {EVENT_PRODUCTS}, items AS (
      SELECT id, unnest(list_filter(regexp_split_to_array(lower(event_type || ', ' || color || '/' || material), '[,/|:;]'), lambda t: t <> '')) AS item
      FROM flat) SELECT trim(item) AS item, count(*) AS count FROM items GROUP BY 1""",
)
def list_items(spark, sf):
    flat = attributes.expand_groups(event_products(spark, sf))
    listed = F.concat("event_type", F.lit(", "), F.array_join("color", "|"), F.lit("/"), "material")
    return flat.select(F.explode(tokenize_list(listed)).alias("item")).groupBy("item").count()
