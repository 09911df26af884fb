"""Stored tables refreshed in place, paged sources and frequent items."""

import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.frequent import ERROR, frequent_items, frequent_words, sketched_items
from shelfmark.sources.pages import read_pages, write_pages
from shelfmark.sources.stored import upsert

SCHEMA = "id int, v string, cat1 string, cat2 string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, path):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).collect()), key=repr)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, f"old {i}", f"c{i % 3}", f"d{i % 2}") for i in range(24)] + [(100, "null", None, "x y=z"), (101, "alone", "lone", "1")]
    spark.createDataFrame(rows, SCHEMA).write.partitionBy("cat1", "cat2").parquet(path)
    return path, {r[0]: r for r in rows}


def test_upsert_rewrites_only_touched_partitions(spark, stored):
    path, rows = stored
    before = files(path)
    new = [(1, "new 1", "c1", "d1"), (2, "moved", "c9", "d9"), (500, "added", "c0", "d0"), (100, "null moved", None, "other"), (101, "left", "c9", "d9")]
    time.sleep(0.01)
    for turn in range(2):  # the second run finds everything in place and changes no row
        upsert(spark, path, spark.createDataFrame(new, SCHEMA), ["id"], ["cat1", "cat2"])
        assert table(spark, path) == sorted((rows | {r[0]: r for r in new}).values(), key=repr), turn
    touched = ("cat1=c1/cat2=d1", "cat1=c2/cat2=d0", "cat1=c0/cat2=d0")
    left = {f for f in before if not any(t in f for t in touched) and "lone" not in f and "HIVE" not in f}
    after = files(path)
    assert left and all(after.get(f) == before[f] for f in left)
    assert not any("lone" in f for f in after) and not any("cat2=x" in f for f in after)


def test_upsert_of_repeated_keys_and_of_nothing(spark, stored):
    path, rows = stored
    twice = spark.createDataFrame([(1, "a", "c1", "d1"), (1, "b", "c2", "d1")], SCHEMA)
    with pytest.raises(ValueError):
        upsert(spark, path, twice, ["id"], ["cat1", "cat2"])
    upsert(spark, path, twice, ["id"], ["cat1", "cat2"], newest="v")
    assert [r for r in table(spark, path) if r[0] == 1] == [(1, "b", "c2", "d1")]
    before = files(path)
    upsert(spark, path, twice.limit(0), ["id"], ["cat1", "cat2"])
    assert files(path) == before


def test_pages_hold_their_keys(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 7]), f"{i:05d}", rng.choice([None, "x"])) for i in range(1_000)]
    df = spark.createDataFrame([*rows, (None, "1", "x"), (3, None, "x")], "catalogId int, catalogItemId string, name string")
    path = str(tmp_path / "pages")
    write_pages(df.repartition(3), path, size=64)
    everything = read_pages(spark, path)
    assert sorted(map(tuple, everything.collect()), key=repr) == sorted(rows, key=repr)
    one, part = read_pages(spark, path, [2]), read_pages(spark, path, [1, 7], after="00100", upto="00400")
    assert one.rdd.getNumPartitions() < everything.rdd.getNumPartitions()
    assert sorted(map(tuple, part.collect()), key=repr) == sorted((r for r in rows if r[0] in (1, 7) and "00100" < r[1] <= "00400"), key=repr)
    # several scans in one query keep their own ranges
    assert one.unionAll(part).unionAll(everything).count() == one.count() + part.count() + 1_000
    assert read_pages(spark, path, [99]).count() == 0
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            assert spark.read.parquet(f"{path}/{name}").agg(F.count_distinct("catalogId"), F.count("*") <= 64).first() == (1, True)


@pytest.mark.parametrize("size", [16, 1_000, 20_000])
def test_frequent_items_are_exact_at_any_sketch_size(spark, size):
    rng = random.Random(size)
    items = [f"w{int(rng.paretovariate(0.6)) % 5_000}" for _ in range(30_000)] + [None] * 50
    df = spark.createDataFrame([(x,) for x in items], "item string").repartition(6)
    want = sorted(Counter(x for x in items if x).items(), key=lambda x: (-x[1], x[0]))
    for k in (3, 40):
        assert [tuple(r) for r in frequent_items(df, k, size=size).collect()] == want[:k]
    assert frequent_items(df.limit(0), 5, size=size).count() == 0


def test_sketch_keeps_what_is_above_its_bound(spark):
    rng = random.Random(2)
    items = [f"w{int(rng.paretovariate(0.7))}" for _ in range(40_000)]
    df = spark.createDataFrame([(x,) for x in items], "item string").repartition(9)
    kept = {r["item"] for r in sketched_items(df, size=128).collect()}
    assert len(kept) < 400
    assert {x for x, n in Counter(items).items() if n > ERROR * len(items) / 128} <= kept


def test_frequent_words_by_rows(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), (["b"],), ([],), (None,)], "t array<string>")
    assert [tuple(r) for r in frequent_words(df, "t", 2).collect()] == [("a", 2), ("b", 2)]
    assert [tuple(r) for r in frequent_words(df, "t", 2, distinct=True).collect()] == [("b", 2), ("a", 1)]
