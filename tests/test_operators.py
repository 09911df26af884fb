"""Operators on small fixtures against brute force and against their invariants."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.text import order_key
from shelfmark.operators import categories as C
from shelfmark.operators import evaluation as E
from shelfmark.operators import sampling as S
from shelfmark.operators import vocabulary as V
from shelfmark.operators.mapping import map_categories
from shelfmark.operators.sizing import materialise
from shelfmark.sources import tables


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def skewed(spark):
    """One category holds well over a third of the rows; some levels are missing."""
    hot = F.when(F.col("id") % 5 < 3, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 17).cast("string")))
    return (
        spark.range(6000)
        .select("id", hot.alias("cat1"), (F.col("id") % 4).cast("string").alias("cat2"),
                F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("cat3"))
        .withColumn("key", order_key("id", "t"))
        .cache()
    )


def ranked(df, keys):
    group = Window.partitionBy(*keys)
    return df.withColumn("rn", F.row_number().over(group.orderBy("key"))).withColumn("size", F.count("*").over(group))


@pytest.mark.parametrize("n", [1, 7, 900, 10**6])
def test_cap_is_exact(skewed, n):
    keys = ["cat1", "cat2", "cat3"]
    expected = ranked(skewed, keys).where(F.col("rn") <= n).drop("rn", "size")
    assert same(S.stratified_cap(skewed, keys, n, "key"), expected)


@pytest.mark.parametrize("n,frac", [(10, 0.75), (1, 0.5), (10**6, 0.9), (100, 0.0), (100, 1.0)])
def test_split_is_exact_and_disjoint(skewed, n, frac):
    train, test = S.stratified_split(skewed, ["cat1", "cat2"], n, frac, "key")
    rows = ranked(skewed, ["cat1", "cat2"])
    size = F.least("size", F.lit(n))
    cut = F.round(size * frac)
    assert same(train, rows.where(F.col("rn") < cut).drop("rn", "size"))
    assert same(test, rows.where((F.col("rn") >= cut) & (F.col("rn") <= size)).drop("rn", "size"))
    assert train.join(test, "id", "left_semi").isEmpty()


def test_ten_rows_split_into_seven_and_three(spark):
    rows = spark.range(10).withColumn("k", F.lit("a")).withColumn("key", order_key("id"))
    train, test = S.stratified_split(rows, ["k"], 1000, 0.75, "key")
    assert (train.count(), test.count()) == (7, 3)


def test_split_without_a_cap_takes_whole_groups(spark, skewed):
    train, test = S.stratified_split(skewed, ["cat1"], None, 0.75, "key")
    rows = ranked(skewed, ["cat1"])
    cut = F.round(F.col("size") * 0.75)
    assert same(train, rows.where(F.col("rn") < cut).drop("rn", "size"))
    assert same(test, rows.where(F.col("rn") >= cut).drop("rn", "size"))


def test_listed_sizes_cap_and_select(spark, skewed):
    sizes = spark.createDataFrame([("hot", 5), ("c1", 10**6)], "cat1 string, count bigint")
    got = S.stratified_cap(skewed, ["cat1"], 50, "key", sizes).groupBy("cat1").count().collect()
    assert {r.cat1: r["count"] for r in got} == {"hot": 5, "c1": 50}
    train, test = S.stratified_split(skewed, ["cat1"], 50, 0.5, "key", sizes)
    assert {r.cat1: r["count"] for r in train.groupBy("cat1").count().collect()} == {"hot": 2, "c1": 24}
    assert {r.cat1: r["count"] for r in test.groupBy("cat1").count().collect()} == {"hot": 3, "c1": 26}


@pytest.mark.parametrize("n", [2, 60, 10**6])
def test_hierarchical_cap_equals_the_chain(skewed, n):
    expected = skewed
    for depth in (3, 2, 1):
        keys = [f"cat{i}" for i in range(1, depth + 1)]
        expected = ranked(expected, keys).where(F.col("rn") <= n).drop("rn", "size")
    assert same(S.hierarchical_cap(skewed, n, 3, "key"), expected)


def test_rank_and_folds(skewed):
    assert same(S.with_rank(skewed, ["cat1"], "key"), ranked(skewed, ["cat1"]).drop("size").withColumn("rn", F.col("rn").cast("bigint")))
    folds = S.stratified_folds(skewed, "cat1", 4, "key").groupBy("cat1", "fold").count()
    spread = folds.groupBy("cat1").agg((F.max("count") - F.min("count")).alias("gap"), F.count("*").alias("folds"))
    assert spread.where("gap > 1 or folds <> 4").isEmpty()
    assert folds.agg(F.sum("count")).first()[0] == skewed.count()


def test_samples_do_not_shuffle_the_rows(skewed):
    plan = S.stratified_cap(skewed, ["cat1"], 10, "key")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan


def mapping(spark, pairs):
    return spark.createDataFrame(pairs, "source_path string, target_path string")


def test_longest_prefix(spark):
    rules = mapping(spark, [("a>b", "T1"), ("a>b>c", "T2"), ("a>b", "T1")])
    rows = spark.createDataFrame([("a>b>c>d",), ("a>b>x",), ("z",), ("a",), ("a>b>c>",), (None,)], "category string")
    got = {r.category: r.mapped for r in map_categories(rows, rules).collect()}
    assert got == {"a>b>c>d": "T2", "a>b>x": "T1", "z": None, "a": None, "a>b>c>": "T2", None: None}


def test_conflicting_mapping_is_an_error(spark):
    rules = mapping(spark, [("a>b", "T1"), ("a>b", "T2")])
    rows = spark.createDataFrame([("a>b",)], "category string")
    with pytest.raises(Exception, match="mapped to both T1 and T2"):
        map_categories(rows, rules).collect()


def test_rollup_level_one_sums_to_all_rows(skewed):
    counts = C.category_counts(C.label_counts(skewed, ["cat1", "cat2", "cat3"]), 3)
    assert counts.where("not contains(category, ' > ')").agg(F.sum("count")).first()[0] == skewed.count()


def test_roll_up_rare(spark):
    freq = spark.createDataFrame(
        [("a", 50), ("a > b", 3), ("a > b > c", 1), ("a > d", 20), ("a > d > e", 2), ("z > y", 1)], "category string, count bigint"
    )
    got = {r.category: r.rolled_up for r in C.roll_up_rare(freq, 10).collect()}
    assert got == {"a": "a", "a > b": "a", "a > b > c": "a", "a > d": "a > d", "a > d > e": "a > d", "z > y": "z"}


def test_class_metadata(spark):
    freq = spark.createDataFrame([("a", 5), ("b", 1)], "category string, count bigint")
    rows = spark.createDataFrame([("a",), ("b",)], "category string")
    out = C.index_labels(rows, freq, 2, num_classes=1)
    assert out.schema["target"].metadata["ml_attr"]["num_vals"] == 1
    assert [tuple(r) for r in out.collect()] == [("a", 0)]


DOCS = [("x", ["a", "b", "b"]), ("x", ["a"]), ("y", ["b", "c"]), ("y", ["a", "c"]), ("z", ["a"])]


def test_information_gain_equals_the_dense_sum(spark):
    docs = spark.createDataFrame(DOCS, "category string, tokens array<string>")
    got = {r.word: r.gain for r in V.information_gain(docs, "tokens").collect()}
    n = len(DOCS)
    for word in "abc":
        w = sum(word in t for _, t in DOCS)
        total = 0.0
        for c in "xyz":
            size = sum(k == c for k, _ in DOCS)
            both = sum(k == c and word in t for k, t in DOCS)
            if size > both:
                total += (size - both) * math.log(n * (size - both) / ((n - w) * size))
            if both:
                total += both * math.log(n * both / (w * size))
        assert got[word] == pytest.approx(total / n, abs=1e-12)
        assert got[word] >= 0


def test_band_and_rank_reports_equal_a_full_ranking(spark):
    counts = [("w%d" % i, 1 + (i * i) % 23) for i in range(400)] + [("x1", 500)]
    freq = spark.createDataFrame(counts, "word string, count bigint")
    ordered = sorted((c for _, c in counts), reverse=True)
    bands = V.vocab_bands(freq, {"ge": (20,), "le": (2,)}, (1, 10, 399, 5000)).first().asDict()
    assert bands["total"] == sum(ordered) and bands["distinct"] == 401
    assert [bands[f"top_{k}"] for k in (1, 10, 399, 5000)] == [sum(ordered[:k]) for k in (1, 10, 399, 5000)]
    assert bands["ge_20"] == sum(c >= 20 for c in ordered) and bands["odd_le_2"] == sum(c <= 2 for c in ordered)
    shares = {r.start: r.share for r in V.rank_share(freq, 50, 500).collect()}
    assert shares == {s: pytest.approx(round(100 * sum(ordered[s:s + 50]) / sum(ordered), 3)) for s in range(0, 500, 50)}


def test_confusion_with_a_class_that_has_no_rows(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "b")], "target string, prediction string")
    assert [tuple(r) for r in E.confused_by_count(E.confusion(rows), 5, 1).collect()] == [("a", "b", 2, 3, 0)]


def test_sweep_without_smoothing_and_empty_coverage(spark):
    rows = spark.createDataFrame([(1, 1, 0.4), (1, 0, 0.6)], "target int, prediction int, max_probability double")
    got = [tuple(r) for r in E.confidence_sweep(rows, (0.0, 0.5, 0.9), smoothing=0).collect()]
    assert got == [(0.0, 50.0, 100.0), (0.5, 0.0, 50.0), (0.9, None, 0.0)]
    coverage = [r.coverage for r in E.confidence_sweep(rows).collect()]
    assert coverage == sorted(coverage, reverse=True)


def test_materialised_table_keeps_rows_and_schema(spark):
    df = spark.range(5).withColumn("v", F.array(F.lit("a")))
    again = materialise(df)
    # files make every column nullable; names, types and rows stay
    assert again.dtypes == df.dtypes and same(again, df)


def test_spread_grows_with_the_splits_of_the_scan(spark, tmp_path):
    spark.range(400).repartition(8).write.parquet(f"{tmp_path}/rows")
    scan = spark.read.parquet(f"{tmp_path}/rows")
    splits = scan.rdd.getNumPartitions()
    assert tables.spread(scan, 2).rdd.getNumPartitions() == tables.SPLIT_TASKS * splits
    assert tables.spread(scan, 100).rdd.getNumPartitions() == 100
    assert tables.spread(scan).rdd.getNumPartitions() == splits
