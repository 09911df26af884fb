"""Evaluation reports on deterministic predictions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.text import max_probability
from shelfmark.operators import evaluation as E
from shelfmark.operators.categories import class_index, label_counts
from workload.bindings import GEO, geo, table
from workload.registry import query

# customers predicted down to fewer levels, or to another segment, as the balance falls
PREDICTED = GEO + """, pred AS (SELECT id, name, category AS target, round((balance + 1000) / 11000, 4) AS max_probability,
  CASE WHEN balance < 0 THEN cat1 WHEN balance < 1500 THEN cat1 || ' > ' || cat2
       WHEN balance < 4000 THEN cat1 || ' > ' || cat2 || ' > building' WHEN balance < 4500 THEN 'europe' ELSE category END AS prediction FROM geo)"""


def predicted(spark, sf):
    b = F.col("balance")
    path = (
        F.when(b < 0, F.col("cat1")).when(b < 1500, F.concat_ws(" > ", "cat1", "cat2"))
        .when(b < 4000, F.concat_ws(" > ", "cat1", "cat2", F.lit("building"))).when(b < 4500, "europe")
        .otherwise(F.col("category"))
    )
    return geo(spark, sf).select(
        "id", "name", F.col("category").alias("target"), path.alias("prediction"),
        F.round((b + 1000) / 11000, 4).alias("max_probability"),
    )


@query(
    "accuracy",
    """SELECT lang, round(avg(CASE WHEN quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS rows
    FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
)
def accuracy(spark, sf):
    """Long documents predicted to be good ones, per language."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    guess = rows.withColumn("guess", F.when(F.col("n_chars") > 1000, 1).otherwise(0))
    return E.accuracy(guess, "quality", "guess", "lang").withColumn("accuracy", F.round("accuracy", 6))


@query("confusion", f"WITH {PREDICTED} SELECT target AS actual, prediction AS predicted, count(*) AS count FROM pred GROUP BY ALL")
def confusion(spark, sf):
    return E.confusion(predicted(spark, sf))


SIZED = f"""{PREDICTED}, pairs AS (SELECT target AS actual, prediction AS predicted, count(*) AS count FROM pred GROUP BY ALL),
sizes AS (SELECT target AS cls, count(*) AS size FROM pred GROUP BY 1),
wrong AS (SELECT p.*, a.size AS actual_size, coalesce(b.size, 0) AS predicted_size FROM pairs p JOIN sizes a ON a.cls = actual
  LEFT JOIN sizes b ON b.cls = predicted WHERE actual <> predicted)"""


@query("confused_by_count", f"WITH {SIZED} SELECT * FROM wrong WHERE count >= 3 ORDER BY count DESC, actual, predicted LIMIT 50")
def confused_by_count(spark, sf):
    return E.confused_by_count(E.confusion(predicted(spark, sf)), 50, 3)


@query(
    "confused_by_rate",
    f"""WITH {SIZED} SELECT actual, predicted, round(100 * count / actual_size, 3) AS rate, actual_size, predicted_size FROM wrong
    ORDER BY rate DESC, actual, predicted LIMIT 50""",
)
def confused_by_rate(spark, sf):
    return E.confused_by_rate(E.confusion(predicted(spark, sf)), 50)


LEVEL = """SELECT CAST({0} AS INTEGER) AS level, round(100.0 * count(*) FILTER (WHERE string_split(target, ' > ')[1:{0}] = string_split(prediction, ' > ')[1:{0}])
  / count(*), 6) AS accuracy FROM pred"""


@query("level_accuracy", f"WITH {PREDICTED} " + " UNION ALL ".join(LEVEL.format(i) for i in range(1, 5)))
def level_accuracy(spark, sf):
    return E.level_accuracy(predicted(spark, sf), "target", "prediction", 4)


@query(
    "confidence_sweep",
    f"""WITH {PREDICTED}, t AS (SELECT unnest([0.0, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99]) AS threshold)
    SELECT CAST(threshold AS DOUBLE) AS threshold,
      round(100.0 * count(*) FILTER (WHERE max_probability >= threshold AND target = prediction) / (count(*) FILTER (WHERE max_probability >= threshold) + 1), 3) AS accuracy,
      round(100.0 * count(*) FILTER (WHERE max_probability >= threshold) / count(*), 3) AS coverage
    FROM pred CROSS JOIN t GROUP BY threshold""",
)
def confidence_sweep(spark, sf):
    return E.confidence_sweep(predicted(spark, sf))


SCORED = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS raw FROM embeddings),
s AS (SELECT *, CAST(list_position(raw[1:10], list_max(raw[1:10])) - 1 AS INTEGER) AS prediction,
  list_sum(list_transform(raw[1:10], lambda x: exp(x))) AS z FROM e)"""


def scored(spark, sf):
    """The first ten embedding values read as raw scores of ten classes."""
    raw = F.slice(F.col("embedding").cast("array<double>"), 1, 10)
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("target"), raw.alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + F.exp(x))
    best = (F.array_position("raw", F.array_max("raw")) - 1).cast("int")
    e = e.withColumns({"z": total, "prediction": best})
    return e.withColumn("probability", F.transform("raw", lambda x: F.exp(x) / F.col("z")))


@query(
    "misclassified",
    f"""WITH {SCORED} SELECT vec_id, label AS target, prediction,
    array_to_string(list_transform(raw[1:10], lambda x: printf('%.3f', exp(x) / z)), ' ') AS softmax,
    array_to_string(list_transform(raw[1:10], lambda x: printf('%.3f', 1 / (1 + exp(-x)))), ' ') AS raw_probability
    FROM s WHERE label <> prediction""",
)
def misclassified(spark, sf):
    wrong = E.misclassified(scored(spark, sf), "target", "prediction", "probability", "raw", "vec_id")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.3f", x)), " ").alias(c)
    return wrong.select("vec_id", "target", "prediction", shown("softmax"), shown("raw_probability"))


@query("score_confidence", f"WITH {SCORED} SELECT vec_id, round(exp(list_max(raw[1:10])) / z, 6) AS confidence FROM s")
def score_confidence(spark, sf):
    rows = scored(spark, sf)
    return rows.select("vec_id", F.round(max_probability(F.col("probability")), 6).alias("confidence"))


@query("class_inventory", f"WITH {PREDICTED} SELECT DISTINCT target AS category FROM pred")
def class_inventory(spark, sf):
    return predicted(spark, sf).select(F.col("target").alias("category")).distinct()


@query("prediction_sample", f"WITH {PREDICTED} SELECT name, target, prediction FROM pred ORDER BY name, target, prediction LIMIT 100")
def prediction_sample(spark, sf):
    return E.prediction_sample(predicted(spark, sf), "name", "target", "prediction")


@query(
    "index_to_label",
    f"""WITH {PREDICTED}, freq AS (SELECT target AS category, count(*) AS count FROM pred GROUP BY 1),
    classes AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS i FROM freq WHERE count >= 10)
    SELECT id, category AS label FROM pred LEFT JOIN classes ON i = id % 100""",
)
def index_to_label(spark, sf):
    frequencies = label_counts(geo(spark, sf), ["category"]).withColumnRenamed("label", "category")
    names = E.class_names(class_index(frequencies, 10))
    rows = geo(spark, sf).select("id", (F.col("id") % 100).cast("double").alias("prediction"))
    return E.index_to_label(rows, names, "prediction", "label").select("id", "label")
