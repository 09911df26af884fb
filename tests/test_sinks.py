"""Files as the sinks leave them."""

import glob

from pyspark.sql import functions as F

from shelfmark.session import scratch_path
from shelfmark.sources import sinks, tables
from shelfmark.sources.taxonomy import read_category_mapping, read_taxonomy


def test_one_file_per_small_category(spark):
    rows = spark.range(2000).select(
        "id", *[(F.col("id") % (i + 2)).cast("string").alias(f"cat{i}") for i in (1, 2, 3)]
    )
    path = scratch_path(spark)
    sinks.write_by_category(rows, path)
    folders = glob.glob(f"{path.removeprefix('file:')}/*/*/*")
    files = glob.glob(f"{path.removeprefix('file:')}/*/*/*/*.parquet")
    assert len(files) == len(folders) == 60
    back = tables.read_products(spark, path).where("cat1 = 2 and cat2 = 1")
    assert "PartitionFilters: [isnotnull(cat1" in back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == rows.where("cat1 = '2' and cat2 = '1'").count()


def test_frequencies_are_one_file_shallow_first(spark):
    rows = spark.createDataFrame([("b > a", 1), ("b", 3), ("a > z", 2), ("a", 9)], "category string, count bigint")
    path = scratch_path(spark)
    sinks.write_frequencies(rows, path, "category")
    (name,) = glob.glob(f"{path.removeprefix('file:')}/*.csv")
    assert open(name).read().split("\n")[:5] == ["category;count", "a;9", "b;3", "a > z;2", "b > a;1"]


def test_missing_export_fields_are_empty(spark):
    rows = spark.createDataFrame([(1, "x")], "catalogId long, name string")
    out = sinks.export_columns(rows)
    assert out.columns == tables.PRODUCT_FIELDS and out.first().pricing is None


def write_lines(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines))


def test_taxonomy_and_mapping_files(spark, tmp_path):
    write_lines(tmp_path / "t.csv", ["id;levels", "1;Animals;;", "22;Animals;Live \"Pets\";Cats"])
    got = sorted(tuple(r) for r in read_taxonomy(spark, str(tmp_path / "t.csv")).collect())
    assert got == [(1, "animals", 1), (22, 'animals > live "pets" > cats', 3)]
    write_lines(tmp_path / "m.csv", ["source;target", "Pets>Cats;Animals > Cats", "Pets;Animals > Pets", "Pets>Dogs;Animals"])
    assert [tuple(r) for r in read_category_mapping(spark, str(tmp_path / "m.csv")).collect()] == [("pets>cats", "animals > cats")]
