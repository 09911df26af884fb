"""Samples on repeated and missing ids, lossless files, class counts, missing categories, plans."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions.text import order_key
from shelfmark.models.estimators import make_estimator
from shelfmark.operators import sampling as S
from shelfmark.operators.categories import attach_category_ids, index_labels
from shelfmark.operators.mapping import map_categories
from shelfmark.operators.vocabulary import information_gain
from shelfmark.plans.profiles import demographics_profile
from shelfmark.sources.catalog import refresh_by_keys
from shelfmark.sources.sinks import write_delimited
from shelfmark.sources.tables import read_delimited


@pytest.fixture(scope="module")
def repeated(spark):
    """Ids repeated, missing, and rows that are equal altogether."""
    rows = [(i // 2, "a") for i in range(20)] + [(None if i % 4 == 0 else i, "b") for i in range(20)] + [(7, "c")] * 9 + [(None, None)] * 6
    return spark.createDataFrame(rows, "id long, cat1 string").withColumn("key", order_key("id", "t"))


def sizes(df):
    return {r["cat1"]: r["count"] for r in df.groupBy("cat1").count().collect()}


@pytest.mark.parametrize("n", [1, 4, 5, 8, 100])
def test_cap_is_exact(repeated, n):
    whole = {"a": 20, "b": 20, "c": 9, None: 6}
    assert sizes(S.stratified_cap(repeated, ["cat1"], n, "key")) == {k: min(n, v) for k, v in whole.items()}


def test_split_parts_make_the_whole(repeated):
    train, test = S.stratified_split(repeated, ["cat1"], 15, 0.6, "key")
    assert sizes(train) == {"a": 8, "b": 8, "c": 4, None: 3} and sizes(test) == {"a": 7, "b": 7, "c": 5, None: 3}
    train, test = S.split_by_top_category(repeated, 15, 0.6, "key")
    assert sizes(train) == {"a": 9, "b": 9, "c": 5, None: 4} and sizes(test) == {"a": 6, "b": 6, "c": 4, None: 2}


def test_folds_and_hierarchy_lose_no_row(repeated):
    assert sizes(S.stratified_folds(repeated, "cat1", 3, "key")) == {"a": 20, "b": 20, "c": 9, None: 6}
    assert sizes(S.hierarchical_cap(repeated, 5, 1, "key")) == {"a": 5, "b": 5, "c": 5, None: 5}


def test_order_key_of_several_columns(spark):
    keys = spark.createDataFrame([(1, None), (None, 1), (1, 1), (11, None), (None, None)], "a int, b int").select(order_key(["a", "b"], 3).alias("k"))
    found = [r["k"] for r in keys.collect()]
    assert len(set(found)) == 5 and found[-1] is None


def test_delimited_text_comes_back(spark, tmp_path):
    texts = ['12" "pipe" kit', "a;b", "line\nbreak", "cr\r\nlf", "back\\slash \\n \\\\", "", None, " blanks ", '"', '\\"', "é;\"\n\\N", "\\N", "a\x00b\\\x01\x0b", "\\\\\nn", "\\r\r"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    write_delimited(df, f"{tmp_path}/a", escaped=True)
    back = read_delimited(spark, f"{tmp_path}/a", schema="id int, text string", escaped=True)
    assert [r["text"] for r in back.orderBy("id").collect()] == texts
    plain = df.where("id in (0, 1, 2, 4)")
    write_delimited(plain, f"{tmp_path}/b")
    back = read_delimited(spark, f"{tmp_path}/b", multiline=True)
    assert [r["text"] for r in back.orderBy(F.col("id").cast("int")).collect()] == [texts[i] for i in (0, 1, 2, 4)]


@pytest.mark.parametrize("kind", ["tree", "forest"])
def test_more_than_a_hundred_classes(spark, kind):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(480).select(F.concat(F.lit("c"), (F.col("id") % 120)).alias("category"), array_to_vector(F.array((F.col("id") % 120).cast("double"))).alias("features"))
    indexed = index_labels(rows, rows.groupBy("category").count(), 1)
    assert indexed.schema["target"].metadata["ml_attr"]["num_vals"] == 120
    model = make_estimator(kind, maxDepth=2).fit(indexed)
    assert model.numClasses == 120


def test_boosted_trees_take_parallelism():
    assert make_estimator("boosted_apart", parallelism=3).getParallelism() == 3


def test_rows_without_category_count_nowhere(spark):
    rows = spark.createDataFrame([("a", ["x", "b"]), ("a", ["x"]), ("c", ["b"]), (None, ["b", "x"]), (None, [])], "category string, tokens array<string>")
    with_, without = (sorted(map(tuple, information_gain(df, "tokens").collect())) for df in (rows, rows.where("category is not null")))
    assert with_ == without
    keys = spark.createDataFrame([("a",), (None,)], "category string")
    assert refresh_by_keys(rows.withColumn("id", F.lit(1)), keys.select(F.lit(1).alias("id")), ["id"], "category").count() == 3


def test_plans_join_and_scan_once(spark):
    rows = spark.createDataFrame([("a > b > c",), ("a > x",), (None,), ("q",)], "category string")
    taxonomy = spark.createDataFrame([(1, "a"), (2, "a > b"), (3, "a > b > c")], "id int, path string")
    out = attach_category_ids(rows, taxonomy, 3)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted([("a > b > c", 1, 2, 3), ("a > x", 1, None, None), (None, None, None, None), ("q", None, None, None)], key=repr)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    mapped = map_categories(rows, spark.createDataFrame([("a", "t")], "source_path string, target_path string"))
    assert mapped.where("category is null").count() == 1
    people = spark.createDataFrame([("a", "m", 1, True), ("a", "f", 1, False), ("b", "m", 2, True)], "cat1 string, gender string, ageGroup int, adult boolean")
    reports = demographics_profile(people)
    assert {tuple(r) for r in reports["gender"].collect()} == {("m", 2), ("f", 1)}
