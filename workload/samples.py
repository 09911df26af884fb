"""Capped samples, splits and folds on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import sampling as S
from workload.bindings import DOCS, GEO, PARTS, docs, geo, key_sql, keyed, parts, table
from workload.registry import query

KEYS = ["cat1", "cat2", "cat3"]


def _ranked(source: str, by: str, where: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key_sql()}) AS rn,
      count(*) OVER (PARTITION BY {by}) AS size FROM {source}), picked AS (SELECT * FROM ranked WHERE {where})"""


@query("capped_sample", f"WITH {DOCS}, {_ranked('docs', 'cat1, cat2', 'rn <= 8')} SELECT id, category FROM picked")
def capped_sample(spark, sf):
    rows = keyed(docs(spark, sf).select("id", "cat1", "cat2", "category"))
    return S.stratified_cap(rows, ["cat1", "cat2"], 8, "key").select("id", "category")


@query(
    "capped_sample_lines",
    """WITH l AS (SELECT *, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-', CAST(l_suppkey AS VARCHAR)) AS id FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(concat(id, ':s1'))) AS rn FROM l)
    SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 2) AS quantity FROM r WHERE rn <= 5000 GROUP BY 1""",
)
def capped_sample_lines(spark, sf):
    """Three huge groups: no group is ever sorted as a whole."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    ident = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    sample = S.stratified_cap(keyed(line.withColumn("id", ident)), ["l_returnflag"], 5000, "key")
    return sample.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "capped_sample_listed",
    f"""WITH {PARTS}, p AS (SELECT *, string_split(category, ' > ')[1] AS cat1 FROM parts),
    sizes AS (SELECT cat1, count(*) // 3 AS cap FROM p GROUP BY 1 HAVING count(*) > 330),
    {_ranked('p JOIN sizes USING (cat1)', 'cat1', 'rn <= least(cap, 110)')} SELECT id, category FROM picked""",
)
def capped_sample_listed(spark, sf):
    """Caps from a stored frequency table; categories it does not list are dropped."""
    rows = keyed(parts(spark, sf).select("id", "category", F.substring_index("category", " > ", 1).alias("cat1")))
    sizes = rows.groupBy("cat1").agg(F.count(F.lit(1)).alias("n")).where("n > 330").selectExpr("cat1", "n div 3 AS count")
    return S.stratified_cap(rows, ["cat1"], 110, "key", sizes).select("id", "category")


def _chain(n: int) -> str:
    steps = []
    for source, name, by in (("geo", "s3", "cat1, cat2, cat3"), ("s3", "s2", "cat1, cat2"), ("s2", "s1", "cat1")):
        steps.append(f"""{name} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key_sql()}) AS rn
          FROM {source}) WHERE rn <= {n})""")
    return ", ".join(steps)


@query("hierarchical_cap", f"WITH {GEO}, {_chain(6)} SELECT id, category FROM s1")
def hierarchical_cap(spark, sf):
    rows = keyed(geo(spark, sf).select("id", "category", *KEYS))
    return S.hierarchical_cap(rows, 6, 3, "key").select("id", "category")


@query(
    "stratified_split",
    f"""WITH {GEO}, {_ranked('geo', 'cat1, cat2', 'rn <= least(size, 40)')}
    SELECT id, CASE WHEN rn < round(least(size, 40) * 0.75) THEN 'train' ELSE 'test' END AS part FROM picked""",
)
def stratified_split(spark, sf):
    rows = keyed(geo(spark, sf).select("id", "cat1", "cat2"))
    train, test = S.stratified_split(rows, ["cat1", "cat2"], 40, 0.75, "key")
    return train.select("id", F.lit("train").alias("part")).union(test.select("id", F.lit("test").alias("part")))


@query(
    "top_category_split",
    f"""WITH {DOCS}, {_ranked('docs', 'cat1', 'rn <= 200')}
    SELECT id, CASE WHEN rn <= round(least(size, 200) * 0.8) THEN 'train' ELSE 'test' END AS part FROM picked""",
)
def top_category_split(spark, sf):
    rows = keyed(docs(spark, sf).select("id", "cat1"))
    train, test = S.split_by_top_category(rows, 200, 0.8, "key")
    return train.select("id", F.lit("train").alias("part")).union(test.select("id", F.lit("test").alias("part")))


@query("folds", f"WITH {DOCS}, {_ranked('docs', 'cat1', 'true')} SELECT id, CAST((rn - 1) % 3 AS INTEGER) AS fold FROM picked")
def folds(spark, sf):
    rows = keyed(docs(spark, sf).select("id", "cat1"))
    return S.stratified_folds(rows, "cat1", 3, "key").select("id", "fold")
