"""Models that SQL can follow, nested sets, paged and refreshed tables, frequent words."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from shelfmark.functions.tokens import tokenize
from shelfmark.models import factors, topic_rounds
from shelfmark.models.boosting import UNIT, SoftmaxBoosting
from shelfmark.models.levels import decode_paths, fit_levels
from shelfmark.operators import categories as C
from shelfmark.operators import frequent
from shelfmark.operators import languages as L
from shelfmark.operators import nested as N
from shelfmark.operators.evaluation import level_accuracy
from shelfmark.operators.sizing import materialise
from shelfmark.session import scratch_path
from shelfmark.sources import pages, sinks, stored
from workload.bindings import GEO, LABEL, RAGGED_ONLY, TAXONOMY, docs, geo, geo_taxonomy, prefixes_sql, ragged, table
from workload.registry import query
from workload.textsql import TOKEN

FEATURES = {
    "line": "CAST(l_linenumber AS INTEGER)", "discount": "CAST(round(l_discount * 100) AS INTEGER)",
    "tax": "CAST(round(l_tax * 100) AS INTEGER)", "month": "CAST(month(l_shipdate) AS INTEGER)",
}
FLAGS = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"

BASE = f"""base AS (SELECT {FLAGS} AS label, [{', '.join(FEATURES.values())}] AS v FROM lineitem),
rows_ AS (SELECT row_number() OVER () AS id, label, v FROM base),
graded AS (SELECT id, class, v, CAST(round((CAST(1 AS DOUBLE) / 3 - CASE WHEN class = label THEN 1 ELSE 0 END) * {UNIT}) AS BIGINT) AS g,
  CAST(round(2 * (CAST(1 AS DOUBLE) / 3) * (1 - CAST(1 AS DOUBLE) / 3) * {UNIT}) AS BIGINT) AS h FROM rows_, (SELECT unnest([0, 1, 2]) AS class))"""


def _level_sql(name: str, source: str) -> str:
    """The best split of each node, from rows with (class, node, v, g, h)."""
    return f"""{name}_cells AS (SELECT class, node, f AS feature, v[f + 1] AS x, sum(g) AS g, sum(h) AS h, count(*) AS n
  FROM {source}, (SELECT unnest([0, 1, 2, 3]) AS f) GROUP BY ALL),
{name}_sums AS (SELECT class, node, feature, x, sum(g) OVER l / {UNIT} AS gl, sum(h) OVER l / {UNIT} AS hl, sum(g) OVER t / {UNIT} AS gt,
  sum(h) OVER t / {UNIT} AS ht, sum(n) OVER t AS rows_in, lead(x) OVER l AS next FROM {name}_cells
  WINDOW l AS (PARTITION BY class, node, feature ORDER BY x), t AS (PARTITION BY class, node, feature)),
{name}_gains AS (SELECT *, round(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1), 6) AS gain FROM {name}_sums
  WHERE next IS NOT NULL AND hl >= 1 AND ht - hl >= 1),
{name} AS (SELECT class, node, feature, x, rows_in FROM (SELECT *, row_number() OVER (PARTITION BY class, node ORDER BY gain DESC, feature, x) AS rn
  FROM {name}_gains WHERE gain > 0) WHERE rn = 1)"""


@query(
    "boosted_splits",
    f"""WITH {BASE}, top_rows AS (SELECT *, 0 AS node FROM graded), {_level_sql('top', 'top_rows')},
    low_rows AS (SELECT r.class, r.v, r.g, r.h, CASE WHEN r.v[t.feature + 1] <= t.x THEN 1 ELSE 2 END AS node FROM graded r JOIN top t USING (class)),
    {_level_sql('low', 'low_rows')}
    SELECT CAST(class AS INTEGER) AS class, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, CAST(x AS DOUBLE) AS threshold, CAST(rows_in AS BIGINT) AS rows
    FROM (SELECT * FROM top UNION ALL SELECT * FROM low)""",
)
def boosted_splits(spark, sf):
    """Return flags learnt from whole numbers: the splits of the first trees, all three classes at once."""
    values = [F.expr(v).cast("double").alias(k) for k, v in FEATURES.items()]
    rows = table(spark, sf, "lineitem").select(F.expr(FLAGS).alias("label"), *values)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = SoftmaxBoosting(maxIter=1, maxDepth=2, maxBins=64, numClasses=3).fit(rows)
    return spark.createDataFrame(
        [(k, n, f, t, rows) for _, k, n, f, t, _, rows in model.splits()], "class int, node int, feature int, threshold double, rows long")


TOKENS = f"toks AS (SELECT doc_id AS id, lang || ' > ' || source AS category, lang, regexp_extract_all(text, '{TOKEN}') AS tokens FROM documents)"
CHOICES = f"""{TOKENS}, steps AS (
  SELECT id, unnest([{{'parent': '', 'child': lang}}, {{'parent': lang, 'child': category}}, {{'parent': category, 'child': category}}], recursive := true) FROM toks),
choices AS (SELECT parent, child, count(*) AS count FROM steps GROUP BY ALL),
parents AS (SELECT parent, sum(count) AS rows_in, count(*) AS children FROM choices GROUP BY 1),
words AS (SELECT id, unnest(tokens) AS token FROM toks), bags AS MATERIALIZED (SELECT id, token, count(*) AS n FROM words GROUP BY ALL),
cells AS MATERIALIZED (SELECT s.parent, s.child, b.token, sum(n) AS n FROM bags b JOIN steps s USING (id) JOIN parents p ON p.parent = s.parent AND children > 1 GROUP BY ALL),
nodes AS (SELECT c.parent, c.child, c.count, ln(c.count / p.rows_in) AS prior,
    ln(1 / (coalesce(t.tokens, 0) + coalesce(w.words, 0) + 1)) AS unseen
  FROM choices c JOIN parents p USING (parent) LEFT JOIN (SELECT parent, child, sum(n) AS tokens FROM cells GROUP BY ALL) t USING (parent, child)
  LEFT JOIN (SELECT parent, count(DISTINCT token) AS words FROM cells GROUP BY 1) w USING (parent))"""


def _tokenised(spark, sf):
    return docs(spark, sf).select("id", "category", tokenize(F.col("text")).alias("tokens"))


@query(
    "level_models",
    f"""WITH {CHOICES} SELECT parent, child, CASE WHEN parent <> child THEN CAST(row_number() OVER (PARTITION BY parent ORDER BY parent = child, child) - 1 AS INTEGER) END AS target,
    CAST(count AS BIGINT) AS count, round(prior, 6) AS prior, round(unseen, 6) AS unseen FROM nodes""",
)
def level_models(spark, sf):
    """What the models of the inner categories know of their children, without the words."""
    nodes = fit_levels(_tokenised(spark, sf), "tokens").nodes
    return nodes.withColumns({c: F.round(c, 6) for c in ("prior", "unseen")})


SEARCH = f"""{CHOICES}, evidence AS (SELECT b.id, c.parent, c.child, sum(b.n * ln(1 + c.n)) AS seen FROM bags b JOIN cells c USING (token) GROUP BY ALL),
local AS (SELECT t.id, n.parent, n.child, n.prior + len(t.tokens) * n.unseen + coalesce(e.seen, 0) AS s
  FROM toks t CROSS JOIN nodes n LEFT JOIN evidence e ON e.id = t.id AND e.parent = n.parent AND e.child = n.child),
shares AS (SELECT l.id, l.parent, l.child, s - top - ln(sum(exp(s - top)) OVER (PARTITION BY l.id, l.parent)) AS share
  FROM (SELECT *, max(s) OVER (PARTITION BY id, parent) AS top FROM local) l),
every_path AS (SELECT a.id, b.child AS path, a.share + b.share AS score FROM shares a JOIN shares b ON a.id = b.id AND a.parent = '' AND b.parent = a.child),
found AS (SELECT id, path AS prediction, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, path) AS rn FROM every_path) WHERE rn = 1)"""


@query("paths_decoded", f"WITH {SEARCH} SELECT id, prediction, round(score, 4) + 0 AS log_probability FROM found")
def paths_decoded(spark, sf):
    """The likeliest path of each document; the SQL scores every path."""
    rows = materialise(_tokenised(spark, sf))
    found = decode_paths(rows, fit_levels(rows, "tokens"), "id", "tokens", beam=4, depth=2)
    return found.withColumn("log_probability", F.round("log_probability", 4) + 0.0)


@query(
    "path_accuracy",
    f"""WITH {SEARCH}, hits AS (SELECT string_split(t.category, ' > ')[1] = string_split(f.prediction, ' > ')[1] AS l1, t.category = f.prediction AS l2 FROM toks t JOIN found f USING (id))
    SELECT level, round(100.0 * n / total, 6) AS accuracy FROM (SELECT 1 AS level, count(*) FILTER (l1) AS n, count(*) AS total FROM hits
    UNION ALL SELECT 2, count(*) FILTER (l2), count(*) FROM hits)""",
)
def path_accuracy(spark, sf):
    """Percent of documents whose decoded path is right down to each level."""
    rows = materialise(_tokenised(spark, sf))
    found = decode_paths(rows, fit_levels(rows, "tokens"), "id", "tokens", beam=4, depth=2)
    return level_accuracy(rows.join(found, "id"), "category", "prediction", 2)


PROFILES = r"""marked AS (SELECT doc_id AS id, lang, '_' || unnest(regexp_extract_all(lower(text), '\p{L}+')) || '_' AS w FROM documents),
places AS (SELECT id, lang, w, unnest(range(1, len(w) + 1)) AS i FROM marked),
grams AS MATERIALIZED (SELECT id, lang, substring(w, i, k) AS gram, count(*) AS n FROM places, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
profiles AS (SELECT lang, gram, rn FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rn
  FROM (SELECT lang, gram, sum(n) AS n FROM grams GROUP BY ALL)) WHERE rn <= 300)"""


def _marked(spark, sf):
    return docs(spark, sf).select("id", "text", F.col("cat1").alias("lang"))


@query("language_profiles", f"WITH {PROFILES} SELECT lang AS language, CAST(rn AS INTEGER) AS rank, gram FROM profiles")
def language_profiles(spark, sf):
    return L.language_profiles(_marked(spark, sf), "text", "lang")


@query(
    "languages_detected",
    f"""WITH {PROFILES}, own AS (SELECT id, gram, rn FROM (SELECT id, gram, row_number() OVER (PARTITION BY id ORDER BY n DESC, gram) AS rn FROM grams) WHERE rn <= 300),
    far AS (SELECT o.id, l.lang, sum(coalesce(abs(o.rn - p.rn), 300)) AS distance FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profiles) l
      LEFT JOIN profiles p ON p.lang = l.lang AND p.gram = o.gram GROUP BY ALL)
    SELECT id, arg_min(lang, (distance, lang)) AS language, CAST(min(distance) AS BIGINT) AS distance FROM far GROUP BY id""",
)
def languages_detected(spark, sf):
    """The language of every document, told from its text alone."""
    rows = _marked(spark, sf)
    profiles = materialise(L.language_profiles(rows, "text", "lang"))
    return L.detect_language(rows, "id", "text", profiles).where("language is not null")


@query(
    "nested_node_counts",
    f"""WITH {TAXONOMY}, {RAGGED_ONLY}, rows_ AS (SELECT {LABEL} AS category FROM ragged), {prefixes_sql('rows_', 'category')}
    SELECT id, path, t.depth, count(p.prefix) AS count FROM taxonomy t LEFT JOIN prefixes p ON p.prefix = t.path GROUP BY ALL""",
)
def nested_node_counts(spark, sf):
    """Rows under every node, by prefix sums over nested sets."""
    counts = C.label_counts(ragged(spark, sf), ["cat1", "cat2", "cat3"]).withColumnRenamed("label", "category")
    return N.subtree_totals(N.nested_sets(geo_taxonomy(spark, sf)), counts)


@query(
    "nested_leaf_counts",
    f"""WITH {TAXONOMY}, leaves AS (
      SELECT path FROM taxonomy t WHERE NOT EXISTS (SELECT 1 FROM taxonomy c WHERE starts_with(c.path, t.path || ' > ')))
    SELECT t.id, t.path, t.depth, count(*) AS leaves FROM taxonomy t
    JOIN leaves l ON l.path = t.path OR starts_with(l.path, t.path || ' > ') GROUP BY ALL""",
)
def nested_leaf_counts(spark, sf):
    return N.leaf_totals(N.nested_sets(geo_taxonomy(spark, sf)))


@query(
    "nested_ancestors",
    f"""WITH {TAXONOMY} SELECT t.id, t.path, string_agg(CAST(a.id AS VARCHAR), '>' ORDER BY a.depth) AS ancestors
    FROM taxonomy t JOIN taxonomy a ON a.path = t.path OR starts_with(t.path, a.path || ' > ') GROUP BY ALL""",
)
def nested_ancestors(spark, sf):
    steps = N.ancestor_ids(N.nested_sets(geo_taxonomy(spark, sf)))
    return steps.withColumn("ancestors", F.array_join("ancestors", ">"))


CATALOGUE = """cat AS (SELECT CAST(left(o_orderpriority, 1) AS BIGINT) AS "catalogId", lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS "catalogItemId", o_totalprice AS price FROM orders)"""


def _paged(spark, sf):
    """Orders stored as a catalogue of pages."""
    rows = table(spark, sf, "orders").select(
        F.substring("o_orderpriority", 1, 1).cast("long").alias("catalogId"),
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("catalogItemId"), F.col("o_totalprice").alias("price"))
    path = scratch_path(spark)
    pages.write_pages(rows, path, size=1_000)
    return path


@query("catalog_pages", f"""WITH {CATALOGUE} SELECT * FROM cat WHERE "catalogId" IN (1, 4) AND "catalogItemId" > '0000000500'""")
def catalog_pages(spark, sf):
    """Two catalogues from a key on, read as pages."""
    return pages.read_pages(spark, _paged(spark, sf), [1, 4], after="0000000500")


UPDATED = f"""{GEO}, changed AS (
  SELECT id, name || ' moved' AS name, balance, 'moved' AS cat1, cat2, cat3 FROM geo WHERE balance < 0
  UNION ALL SELECT -id, name, balance, cat1, 'new', cat3 FROM geo WHERE balance > 9000)"""


@query(
    "table_refreshed",
    f"WITH {UPDATED} SELECT id, name, cat1, cat2, cat3 FROM changed UNION ALL SELECT id, name, cat1, cat2, cat3 FROM geo WHERE id NOT IN (SELECT id FROM changed)",
)
def table_refreshed(spark, sf):
    """A stored table after an update that moves rows, adds rows and leaves rows alone, run twice."""
    path = scratch_path(spark)
    rows = geo(spark, sf).select("id", "name", "balance", "cat1", "cat2", "cat3")
    sinks.write_by_category(rows, path)
    moved = rows.where("balance < 0").withColumn("name", F.concat("name", F.lit(" moved"))).withColumn("cat1", F.lit("moved"))
    added = rows.where("balance > 9000").withColumn("id", -F.col("id")).withColumn("cat2", F.lit("new"))
    changed = materialise(moved.unionByName(added))
    for _ in range(2):
        stored.upsert(spark, path, changed, ["id"])
    return spark.read.schema(rows.schema).parquet(path).select("id", "name", "cat1", "cat2", "cat3")


FREQUENT = f"""toks AS (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM documents),
freq AS (SELECT word, count(*) AS count FROM toks GROUP BY 1)"""


@query("frequent_words", f"WITH {FREQUENT} SELECT word, count FROM freq ORDER BY count DESC, word LIMIT 300")
def frequent_words(spark, sf):
    """The 300 commonest tokens, by a sketch of fixed size and an exact recount."""
    return frequent.frequent_words(docs(spark, sf).select(tokenize(F.col("text")).alias("tokens")), "tokens", 300, size=20_000)


NEAR = f"""near_toks AS (SELECT doc_id AS id, regexp_extract_all(text, '{TOKEN}') AS t FROM documents),
placed AS MATERIALIZED (SELECT id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM near_toks),
common AS (SELECT w FROM placed GROUP BY w HAVING count(*) >= 20),
known AS MATERIALIZED (SELECT * FROM placed WHERE w IN (SELECT w FROM common)),
ordered AS (SELECT x.w AS a, y.w AS b, count(*) AS n FROM known x JOIN known y ON x.id = y.id AND y.i BETWEEN x.i + 1 AND x.i + 3 GROUP BY ALL),
pairs AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM ordered UNION ALL SELECT b, a, n FROM ordered) GROUP BY ALL),
ofs AS (SELECT a, sum(n) AS s FROM pairs GROUP BY a),
valued AS (SELECT p.a, p.b, p.n, ln(p.n * (SELECT CAST(sum(s) AS DOUBLE) FROM ofs) / (CAST(x.s AS DOUBLE) * y.s)) AS value FROM pairs p JOIN ofs x ON x.a = p.a JOIN ofs y ON y.a = p.b)"""


def _associations(spark, sf):
    rows = materialise(docs(spark, sf).select(tokenize(F.col("text")).alias("tokens")))
    return factors.word_associations(rows, "tokens", window=3, min_count=20)


@query("word_associations", f"WITH {NEAR} SELECT a, b, CAST(n AS BIGINT) AS n, round(value, 6) AS value FROM valued WHERE value > 0.001")
def word_associations(spark, sf):
    """Words that stand near each other more often than by chance."""
    return _associations(spark, sf).where("value > 0.001").withColumn("value", F.round("value", 6))


@query("vector_words", f"WITH {NEAR} SELECT DISTINCT a AS word, 16 AS size FROM valued WHERE value > 0.001")
def vector_words(spark, sf):
    """The words that get a vector, with its size; factors stay in the executors."""
    vectors = factors.fit_vectors(_associations(spark, sf).where("value > 0.001"), size=16, rounds=3)
    return vectors.select("word", F.size("vector").alias("size"))


@query("topics_resumed", f"""WITH bagged AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM documents)
    SELECT 3 AS last_round, count(DISTINCT id) AS documents, count(DISTINCT word) AS words, true AS same FROM bagged""")
def topics_resumed(spark, sf):
    """Topics of all documents fitted in one go and in two: rounds, rows, and whether both give the same table."""
    bags = docs(spark, sf).select("id", F.explode(tokenize(F.col("text"))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    bags, whole, parts = materialise(bags), scratch_path(spark), scratch_path(spark)
    topic_rounds.fit_topic_rounds(bags, whole, 4, 3)
    topic_rounds.fit_topic_rounds(bags, parts, 4, 1)
    at = topic_rounds.fit_topic_rounds(bags, parts, 4, 3)
    (terms, documents), (again, _) = (topic_rounds.read_round(spark, p, at) for p in (whole, parts))
    sizes = documents.agg(F.count("*").alias("documents"))
    joined = terms.join(again.withColumnRenamed("shares", "again"), "word", "full")
    words = joined.agg(F.count("*").alias("words"), F.bool_and(F.col("shares").eqNullSafe(F.col("again"))).alias("same")).first()
    return sizes.select(F.lit(at).alias("last_round"), "documents", F.lit(words["words"]).cast("long").alias("words"), F.lit(words["same"]).alias("same"))
