"""Token and vocabulary operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import stopwords, text, tokens as T
from shelfmark.operators import vocabulary as V
from shelfmark.operators.attributes import expand_groups
from shelfmark.operators.sizing import materialise
from shelfmark.plans import profiles as P
from shelfmark.sources.tables import spread
from workload.bindings import DOCS, EVENT_PRODUCTS, PARTS, TEXT_TASKS, docs, event_products, key_sql, keyed, parts, table
from workload.fields import BUCKET
from workload.registry import query
from workload.textsql import NOISE, TOKEN, bands_sql, normalised, without, words_sql

NORM = f"{DOCS}, {normalised('docs', 'text', 'id, cat1, cat2, category')}"
DF = "freq AS (SELECT word, count(*) AS count FROM (SELECT unnest(list_distinct(tokens)) AS word FROM norm) GROUP BY 1)"
TF = "freq AS (SELECT word, count(*) AS count FROM (SELECT unnest(tokens) AS word FROM norm) GROUP BY 1)"
PLAIN = f"{DOCS}, norm AS (SELECT id, cat1, category, {words_sql('text')} AS tokens FROM docs)"


def _norm(spark, sf):
    return docs(spark, sf).select("id", "cat1", "cat2", "category", T.product_tokens(F.col("text")).alias("tokens"))


def _plain(spark, sf):
    return docs(spark, sf).select("id", "cat1", "category", T.tokenize_words(F.col("text")).alias("tokens"))


def _joined(df):
    return df.select("id", F.array_join("tokens", " ").alias("tokens"))


@query("product_tokens", f"SELECT doc_id AS id, array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ') AS tokens FROM documents")
def product_tokens(spark, sf):
    return _joined(docs(spark, sf).select("id", T.tokenize(F.col("text")).alias("tokens")))


@query("word_tokens", f"SELECT doc_id AS id, array_to_string({words_sql('text')}, ' ') AS tokens FROM documents")
def word_tokens(spark, sf):
    return _joined(_plain(spark, sf))


@query("normalised_tokens", f"WITH {NORM} SELECT id, array_to_string(tokens, ' ') AS tokens FROM norm")
def normalised_tokens(spark, sf):
    return _joined(_norm(spark, sf))


PAGES = f"pg AS (SELECT page_id AS id, html AS text FROM pages), {normalised('pg', 'text', 'id')}"


@query("normalised_page_tokens", f"WITH {PAGES} SELECT id, array_to_string(tokens, ' ') AS tokens FROM norm")
def normalised_page_tokens(spark, sf):
    """Raw pages: dense in punctuation, numbers and mixed case."""
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), TEXT_TASKS).select(F.col("page_id").alias("id"), T.product_tokens(F.col("html")).alias("tokens"))
    return _joined(pages)


@query(
    "noise_dropped",
    f"""WITH {DOCS} SELECT id, array_to_string(list_filter(regexp_extract_all(text, '{TOKEN}'),
    lambda t: NOT regexp_matches(lower(t), '{NOISE}')), ' ') AS tokens FROM docs""",
)
def noise_dropped(spark, sf):
    kept = T.drop_noise_tokens(T.tokenize(F.col("text")))
    return _joined(docs(spark, sf).select("id", kept.alias("tokens")))


@query(
    "odd_words",
    f"WITH {PLAIN}, {DF} SELECT NOT regexp_matches(word, '^[a-zA-Z]*$') AS odd, count(*) AS words, CAST(sum(count) AS BIGINT) AS count FROM freq GROUP BY 1",
)
def odd_words(spark, sf):
    freq = V.doc_freq(_plain(spark, sf), "tokens")
    return freq.groupBy(text.is_odd(F.col("word")).alias("odd")).agg(F.count(F.lit(1)).alias("words"), F.sum("count").alias("count"))


@query("document_frequency", f"WITH {NORM}, {DF} SELECT * FROM freq")
def document_frequency(spark, sf):
    return V.doc_freq(_norm(spark, sf), "tokens")


@query("term_frequency", f"WITH {PLAIN}, {TF} SELECT * FROM freq")
def term_frequency(spark, sf):
    return V.term_freq(_plain(spark, sf), "tokens")


@query("counts_by_category", f"WITH {EVENT_PRODUCTS} SELECT filter_category, gender, age_group, adult, count(*) AS count FROM flat GROUP BY ALL")
def counts_by_category(spark, sf):
    flat = expand_groups(event_products(spark, sf))
    category = F.lower(F.get_json_object(text.clean_json(F.col("attributes")), "$.taxonomy.filterCategory"))
    flat = flat.select(category.alias("filter_category"), "gender", F.col("ageGroup").alias("age_group"), "adult")
    return V.counts_by(flat, "filter_category", "gender", "age_group", "adult")


@query("histogram", "SELECT lower(p_brand) AS word, count(*) AS count FROM part GROUP BY 1")
def histogram(spark, sf):
    return V.counts_by(table(spark, sf, "part").select(F.lower("p_brand").alias("word")), "word")


SMALL_BANDS = {"ge": (500, 100, 20, 5), "le": (10, 3, 1)}


@query("vocabulary_bands", f"WITH {NORM}, {DF} {bands_sql('freq', SMALL_BANDS, (10, 100, 1000, 20000), True)}")
def vocabulary_bands(spark, sf):
    return V.vocab_bands(V.doc_freq(_norm(spark, sf), "tokens"), SMALL_BANDS, (10, 100, 1000, 20000))


@query(
    "rank_share",
    f"""WITH {PLAIN}, {TF}, r AS (SELECT count, row_number() OVER (ORDER BY count DESC, word) - 1 AS rk FROM freq),
    blocks AS (SELECT unnest(range(0, 100000, 500)) AS start)
    SELECT start, round(100 * coalesce(sum(count), 0) / (SELECT sum(count) FROM r), 3) AS share
    FROM blocks LEFT JOIN r ON rk >= start AND rk < start + 500 GROUP BY start""",
)
def rank_share(spark, sf):
    return V.rank_share(V.term_freq(_plain(spark, sf), "tokens"), block=500, top=100_000)


GAIN = """pairs AS (SELECT word, category, count(*) AS b FROM (SELECT unnest(list_distinct(tokens)) AS word, category FROM norm) GROUP BY ALL),
cats AS (SELECT category, count(*) AS c FROM norm GROUP BY 1), n AS (SELECT count(*) AS n FROM norm),
words AS (SELECT word, sum(b) AS w FROM pairs GROUP BY 1),
grid AS (SELECT word, w, category, c, n, coalesce(b, 0) AS b FROM words CROSS JOIN cats CROSS JOIN n LEFT JOIN pairs USING (word, category)),
gains AS (SELECT word, CAST(max(w) AS BIGINT) AS count, sum(
    CASE WHEN c > b THEN (c - b) * ln(n * CAST(c - b AS DOUBLE) / ((n - w) * c)) ELSE 0 END +
    CASE WHEN b > 0 THEN b * ln(n * CAST(b AS DOUBLE) / (w * c)) ELSE 0 END) / max(n) AS gain FROM grid GROUP BY word)"""
# languages are the categories here, so that the dense SQL form stays small
BY_LANG = PLAIN.replace("cat1, category,", "cat1, cat1 AS category,")


def _gains(spark, sf):
    return V.information_gain(_plain(spark, sf), "tokens", "cat1")


@query("information_gain", f"WITH {BY_LANG}, {GAIN} SELECT word, count, round(gain, 6) + 0.0 AS gain FROM gains")
def information_gain(spark, sf):
    return _gains(spark, sf).withColumn("gain", F.round("gain", 6) + 0.0)


@query(
    "information_gain_by_path",
    f"WITH {NORM}, {GAIN} SELECT word, count, round(gain, 6) + 0.0 AS gain FROM gains",
)
def information_gain_by_path(spark, sf):
    gains = V.information_gain(_norm(spark, sf), "tokens", "category")
    return gains.withColumn("gain", F.round("gain", 6) + 0.0)


@query("category_totals", f"WITH {DOCS} SELECT category, count(*) AS count FROM docs GROUP BY 1")
def category_totals(spark, sf):
    return V.counts_by(docs(spark, sf), "category")


@query(
    "most_informative_words",
    f"WITH {BY_LANG}, {GAIN} SELECT word, count, round(gain, 9) AS gain FROM gains ORDER BY 3 DESC, word LIMIT 200",
)
def most_informative_words(spark, sf):
    return V.top_k(_gains(spark, sf).withColumn("gain", F.round("gain", 9)), 200, "gain")


@query(
    "least_informative_words",
    f"WITH {BY_LANG}, {GAIN} SELECT word, count, abs(round(gain, 9)) AS gain FROM gains ORDER BY 3, word LIMIT 100",
)
def least_informative_words(spark, sf):
    return V.top_k(_gains(spark, sf).withColumn("gain", F.abs(F.round("gain", 9))), 100, "gain", ascending=True)


@query(
    "top_word_overlap",
    f"""WITH {BY_LANG}, {GAIN}, r AS (
      SELECT row_number() OVER (ORDER BY round(gain, 9) DESC, word) AS g, row_number() OVER (ORDER BY count DESC, word) AS f FROM gains)
    SELECT CAST(k AS INTEGER) AS k, count(*) FILTER (WHERE g <= k AND f <= k) AS overlap FROM r CROSS JOIN (SELECT unnest([100, 1000, 10000]) AS k) GROUP BY k""",
)
def top_word_overlap(spark, sf):
    return V.topk_overlap(materialise(_gains(spark, sf)), (100, 1000, 10000))


@query(
    "common_words_by_category",
    f"""WITH {NORM}, w AS (SELECT cat1, unnest({without('tokens', stopwords.EMPIRICAL)}) AS word FROM norm)
    SELECT cat1, word, count(*) AS count FROM w WHERE regexp_matches(word, '\\A[a-zA-Z]*\\z') GROUP BY ALL
    ORDER BY count DESC, word, cat1 LIMIT 950""",
)
def common_words_by_category(spark, sf):
    kept = stopwords.remove_stop_words(F.col("tokens"), stopwords.EMPIRICAL)
    return V.common_words_by_category(_norm(spark, sf), kept, "cat1")


PRICES = "p AS (SELECT l_returnflag AS cat1, l_extendedprice * l_discount AS price FROM lineitem)"


def _prices(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(F.col("l_returnflag").alias("cat1"), (F.col("l_extendedprice") * F.col("l_discount")).alias("price"))


@query(
    "price_distribution",
    f"""WITH {PRICES} SELECT CAST({BUCKET} AS DOUBLE) AS bucket, round(count(*) / (SELECT count(*) FROM p) * 100, 6) AS fraction
    FROM p GROUP BY 1""",
)
def price_distribution(spark, sf):
    return V.price_distribution(_prices(spark, sf), "price").withColumnRenamed("price", "bucket")


@query(
    "price_distribution_by_category",
    f"""WITH {PRICES} SELECT cat1, CAST({BUCKET} AS DOUBLE) AS bucket, round(count(*) / (SELECT count(*) FROM p) * 100, 6) AS fraction
    FROM p GROUP BY 1, 2""",
)
def price_distribution_by_category(spark, sf):
    return V.price_distribution(_prices(spark, sf), "price", "cat1").withColumnRenamed("price", "bucket")


@query(
    "token_totals",
    f"""WITH {PLAIN} SELECT (SELECT count(*) FROM (SELECT DISTINCT tokens FROM norm)) AS distinct_lists,
    (SELECT CAST(sum(len(tokens)) AS BIGINT) FROM norm) AS tokens,
    (SELECT count(DISTINCT w) FROM (SELECT unnest(tokens) AS w FROM norm)) AS distinct_tokens""",
)
def token_totals(spark, sf):
    return V.token_totals(_plain(spark, sf), "tokens")


@query("most_common_words", f"WITH {NORM}, {DF} SELECT * FROM freq ORDER BY count DESC, word LIMIT 200")
def most_common_words(spark, sf):
    return V.top_k(V.doc_freq(_norm(spark, sf), "tokens"), 200)


@query("least_common_words", f"WITH {NORM}, {DF} SELECT * FROM freq ORDER BY count, word LIMIT 100")
def least_common_words(spark, sf):
    return V.top_k(V.doc_freq(_norm(spark, sf), "tokens"), 100, ascending=True)


@query(
    "odd_outliers",
    f"WITH {PAGES}, {DF} SELECT * FROM freq WHERE NOT regexp_matches(word, '\\A[a-zA-Z]*\\z') AND count BETWEEN 1 AND 5 ORDER BY count DESC, word LIMIT 200",
)
def odd_outliers(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), TEXT_TASKS).select(T.product_tokens(F.col("html")).alias("tokens"))
    return V.top_k(V.odd_tokens(V.doc_freq(pages, "tokens"), 1, 5), 200)


@query(
    "odd_common",
    f"WITH {PAGES}, {DF} SELECT * FROM freq WHERE NOT regexp_matches(word, '\\A[a-zA-Z]*\\z') AND NOT contains(word, '<') ORDER BY count DESC, word LIMIT 100",
)
def odd_common(spark, sf):
    pages = spread(table(spark, sf, "pages").select("page_id", "html"), TEXT_TASKS).select(T.product_tokens(F.col("html")).alias("tokens"))
    return V.top_k(V.odd_tokens(V.doc_freq(pages, "tokens"), 1), 100)


@query("stop_words_removed", f"WITH {NORM} SELECT id, array_to_string({without('tokens', stopwords.TOPIC, False)}, ' ') AS tokens FROM norm")
def stop_words_removed(spark, sf):
    kept = stopwords.remove_stop_words(F.col("tokens"), stopwords.TOPIC, case_sensitive=True)
    return _joined(_norm(spark, sf).withColumn("tokens", kept))


BIGRAMS = f"""{NORM}, kept AS (SELECT id, {without('tokens', stopwords.BIGRAM, False)} AS k FROM norm),
pairs AS (SELECT id, list_transform(range(1, len(k)), lambda i: array_to_string(list_sort([k[i], k[i + 1]]), ' ')) AS tokens FROM kept)"""
BIGRAM_FREQ = "freq AS (SELECT bigram, count(*) AS count FROM (SELECT unnest(tokens) AS bigram FROM pairs) GROUP BY 1)"


@query("sorted_bigrams", f"WITH {BIGRAMS} SELECT id, array_to_string(tokens, '|') AS tokens FROM pairs")
def sorted_bigrams(spark, sf):
    pairs = docs(spark, sf).select("id", P.bigrams(F.col("text")).alias("tokens"))
    return pairs.select("id", F.array_join("tokens", "|").alias("tokens"))


@query(
    "sorted_trigrams",
    f"""WITH {PLAIN} SELECT id, array_to_string(list_transform(range(1, len(tokens) - 1),
    lambda i: array_to_string(list_sort(tokens[i:i + 2]), ' ')), '|') AS tokens FROM norm""",
)
def sorted_trigrams(spark, sf):
    plain = _plain(spark, sf).select("id", T.sorted_ngrams(F.col("tokens"), 3).alias("tokens"))
    return plain.select("id", F.array_join("tokens", "|").alias("tokens"))


@query("bigram_profile_common", f"WITH {BIGRAMS}, {BIGRAM_FREQ} SELECT * FROM freq ORDER BY count DESC, bigram LIMIT 1000")
def bigram_profile_common(spark, sf):
    return P.bigram_profile(docs(spark, sf), "text")["most_common"]


@query("bigram_profile_bands", f"WITH {BIGRAMS}, {BIGRAM_FREQ} {bands_sql('freq', V.WORD_BANDS, V.WORD_TOPS, True, 'bigram')}")
def bigram_profile_bands(spark, sf):
    return P.bigram_profile(docs(spark, sf), "text")["bands"]


@query("word_profile_bands", f"WITH {NORM}, {DF} {bands_sql('freq', V.WORD_BANDS, V.WORD_TOPS, True)}")
def word_profile_bands(spark, sf):
    return P.word_profile(docs(spark, sf), "text")["bands"]


@query("word_profile_common", f"WITH {NORM}, {DF} SELECT * FROM freq ORDER BY count DESC, word LIMIT 200")
def word_profile_common(spark, sf):
    return P.word_profile(docs(spark, sf), "text")["most_common"]


@query("word_profile_odd", f"WITH {NORM}, {DF} SELECT * FROM freq WHERE NOT regexp_matches(word, '\\A[a-zA-Z]*\\z') AND NOT contains(word, '<')")
def word_profile_odd(spark, sf):
    """All odd words: a report without a length."""
    return P.word_profile(docs(spark, sf), "text", k=None)["odd_common"]


DICTIONARY_FREQ = f"""WITH d AS (SELECT doc_id AS id, lang AS cat1, concat_ws(' ', source, text) AS text FROM documents),
    {normalised('d', 'text', 'id')},
    kept AS (SELECT list_filter({without('tokens', stopwords.DICTIONARY)}, lambda t: NOT regexp_matches(lower(t), '{NOISE}')) AS tokens FROM norm),
    freq AS (SELECT word, count(*) AS count FROM (SELECT unnest(tokens) AS word FROM kept) GROUP BY 1)"""


@query("dictionary", f"{DICTIONARY_FREQ} SELECT * FROM freq")
def dictionary(spark, sf):
    return P.dictionary(docs(spark, sf), ["cat2", "text"])


@query("dictionary_bands", f"{DICTIONARY_FREQ} {bands_sql('freq', V.WORD_BANDS, (), True)}")
def dictionary_bands(spark, sf):
    return P.dictionary_profile(docs(spark, sf), ["cat2", "text"])["bands"]


@query("dictionary_measurements", f"{DICTIONARY_FREQ} SELECT * FROM freq WHERE regexp_matches(word, '\\A<.*>\\z')")
def dictionary_measurements(spark, sf):
    return P.dictionary_profile(docs(spark, sf), ["cat2", "text"], k=None)["measurements"]


@query("manufacturer_profile", f"WITH {PARTS}, freq AS (SELECT lower(manufacturer) AS word, count(*) AS count FROM parts GROUP BY 1) {bands_sql('freq', V.MAKER_BANDS, (), False)}")
def manufacturer_profile(spark, sf):
    rows = parts(spark, sf).withColumn("cat1", F.substring_index("category", " > ", 1))
    return P.manufacturer_profile(rows)["bands"]


@query(
    "manufacturer_by_category",
    f"""WITH {PARTS} SELECT string_split(category, ' > ')[1] AS cat1, lower(manufacturer) AS word, count(*) AS count FROM parts
    GROUP BY ALL ORDER BY count DESC, cat1, word LIMIT 200""",
)
def manufacturer_by_category(spark, sf):
    rows = parts(spark, sf).withColumn("cat1", F.substring_index("category", " > ", 1))
    return P.manufacturer_profile(rows)["by_category"]


MATERIALS = f"""{EVENT_PRODUCTS}, freq AS (SELECT trim(unnest(list_filter(regexp_split_to_array(
  lower(trim(regexp_replace(material, '[0-9%]', '', 'g'))), '[,/|:;]'), lambda t: t <> ''))) AS word, event_type AS cat1 FROM flat)"""


@query("material_profile", f"WITH {MATERIALS} SELECT cat1, word, count(*) AS count FROM freq GROUP BY ALL ORDER BY count DESC, cat1, word LIMIT 200")
def material_profile(spark, sf):
    flat = expand_groups(event_products(spark, sf)).withColumnRenamed("event_type", "cat1")
    return P.material_profile(flat)["by_category"]


@query(
    "colour_profile",
    f"""WITH {EVENT_PRODUCTS}, w AS (SELECT lower(trim(unnest(string_split(color, '|')))) AS word FROM flat),
    freq AS (SELECT word, count(*) AS count FROM w GROUP BY 1) {bands_sql('freq', V.VALUE_BANDS, V.VALUE_TOPS, False)}""",
)
def colour_profile(spark, sf):
    flat = expand_groups(event_products(spark, sf)).withColumnRenamed("event_type", "cat1")
    return P.colour_profile(flat)["bands"]


@query("demographics_profile", f"WITH {EVENT_PRODUCTS} SELECT event_type AS cat1, adult, count(*) AS count FROM flat GROUP BY ALL")
def demographics_profile(spark, sf):
    flat = expand_groups(event_products(spark, sf)).withColumnRenamed("event_type", "cat1")
    return P.demographics_profile(flat)["adult_by_category"]


@query(
    "price_profile",
    f"""WITH {EVENT_PRODUCTS} SELECT event_type AS cat1, CAST({BUCKET} AS DOUBLE) AS bucket,
    round(count(*) / (SELECT count(*) FROM flat) * 100, 6) AS fraction FROM flat GROUP BY 1, 2""",
)
def price_profile(spark, sf):
    flat = expand_groups(event_products(spark, sf)).withColumnRenamed("event_type", "cat1")
    return P.price_profile(flat)["by_category"].withColumnRenamed("price", "bucket")


@query("plain_word_profile", f"""WITH {PLAIN}, kept AS (SELECT {without('tokens', stopwords.EMPIRICAL)} AS tokens FROM norm)
    SELECT word, count(*) AS count FROM (SELECT unnest(tokens) AS word FROM kept) GROUP BY 1 ORDER BY count DESC, word LIMIT 900""")
def plain_word_profile(spark, sf):
    return P.plain_word_profile(docs(spark, sf), F.col("text"), stopwords.EMPIRICAL)["most_common"]


DIMENSIONS = """CASE l_linenumber % 4 WHEN 0 THEN '<3d_float_cm>' WHEN 1 THEN '<2d_int_inch>' WHEN 2 THEN '<3d_int_cm>' ELSE '<2d_float_cm>' END"""


def _dimensions(spark, sf):
    """Quantities written the way product texts write dimensions."""
    q = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_linenumber") % 4
    token = (
        F.when(kind == 0, F.concat(q, F.lit(".5x"), q, F.lit(".25x4.75cm"))).when(kind == 1, F.concat(q, F.lit("*"), q, F.lit("in")))
        .when(kind == 2, F.concat(q, F.lit("x2x"), q, F.lit("cm"))).otherwise(F.concat(q, F.lit(".5x"), q, F.lit(".25cm")))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", token.alias("token"))


@query("dimensions", f"SELECT l_orderkey, l_linenumber, l_partkey, {DIMENSIONS} AS shown FROM lineitem")
def dimensions(spark, sf):
    from shelfmark.functions.measures import measurement

    return _dimensions(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", measurement(F.col("token")).alias("shown"))


@query("placeholder_tokens", "SELECT CASE l_linenumber % 2 WHEN 1 THEN '<2d_int_inch>' ELSE '<int_cm>' END AS word, count(*) AS count FROM lineitem GROUP BY 1")
def placeholder_tokens(spark, sf):
    """Placeholders that follow the measurements of a text, counted as dictionary words."""
    q = F.col("l_quantity").cast("int").cast("string")
    size = F.when(F.col("l_linenumber") % 2 == 1, F.concat(q, F.lit("*"), q, F.lit("in"))).otherwise(F.concat(q, F.lit("cm")))
    texts = table(spark, sf, "lineitem").select(T.product_tokens(F.concat(F.lit("size "), size), emit="placeholder").alias("tokens"))
    return V.placeholder_tokens(V.term_freq(texts, "tokens"))


@query(
    "information_gain_missing",
    f"""WITH {NORM}, c AS (SELECT n.id, n.tokens, CASE WHEN n.id % 5 > 0 THEN d.lang END AS category FROM norm n JOIN documents d ON d.doc_id = n.id)
    SELECT word, count(*) AS count FROM (SELECT unnest(list_distinct(tokens)) AS word FROM c WHERE category IS NOT NULL) GROUP BY 1""",
)
def information_gain_missing(spark, sf):
    """Every fifth document lacks its category: it counts in no sum."""
    rows = docs(spark, sf).select(F.when(F.col("id") % 5 > 0, F.col("cat1")).alias("category"), T.product_tokens(F.col("text")).alias("tokens"))
    return V.information_gain(rows, "tokens").select("word", "count")


@query(
    "measurements",
    """SELECT l_orderkey, l_linenumber, l_partkey, '<' || CASE WHEN l_linenumber IN (1, 4) THEN 'float' ELSE 'int' END
    || CASE WHEN l_linenumber = 2 THEN '_range' ELSE '' END
    || CASE l_linenumber WHEN 1 THEN '_kg' WHEN 2 THEN '_oz' WHEN 3 THEN '_inch' WHEN 4 THEN '_watt_hour' WHEN 5 THEN '_' WHEN 6 THEN '_%' ELSE '_cm' END || '>' AS shown
    FROM lineitem""",
)
def measurements(spark, sf):
    """Quantities written the way product texts write measurements."""
    from shelfmark.functions.measures import measurement

    q = F.col("l_quantity").cast("int").cast("string")
    n = F.col("l_linenumber")
    token = (
        F.when(n == 1, F.concat(q, F.lit(".5kgs"))).when(n == 2, F.concat(q, F.lit("-99oz")))
        .when(n == 3, F.concat(q, F.lit('"W'))).when(n == 4, F.concat(q, F.lit(".25wh")))
        .when(n == 5, F.concat(q, F.lit(",000"))).when(n == 6, F.concat(q, F.lit("percent")))
        .otherwise(F.concat(q, F.lit("cmwide")))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", measurement(token).alias("shown"))
