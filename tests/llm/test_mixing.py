"""Mixing against plain Python and against its SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest

from shelfmark.llm.mixing import LIMIT, MIXED_SQL, WEIGHTS, mix, mixed_sizes

SF = "/root/testdata/sf0.01"


def targets(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(LIMIT * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if weight[s] * level > LIMIT * sizes[s] + 1e-9}
        if not above:
            return {s: LIMIT * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= above


def test_targets_and_copies(spark):
    rows = [(i, "a b c " * (i % 7), ["x", "y", "z", None, "é", "w"][min(i % 11, 5)]) for i in range(400)]
    rows += [(None, "some text", "y"), (None, None, None), (3, "", "lonely"), (500, "one", "small")]
    found = mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    expected = targets(sizes)
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= LIMIT and r.taken == r.size * r.copies
    assert sum({r.source: r.target for r in found}.values()) == pytest.approx(sum(sizes.values()))


def test_equals_sql(spark):
    df = mixed_sizes(spark.read.parquet(f"{SF}/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(tuple(r) for r in df.collect()) == sorted(con.execute(MIXED_SQL).fetchall())


def test_mix_repeats_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as copy", "2 as mix_rate")
    out = mix(docs)
    assert out.columns == [*docs.columns, "_copy"]
    want = {r.doc_id: r.copies for r in mixed_sizes(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in out.collect()) == want
    assert mix(docs.limit(0)).count() == 0


def test_an_id_that_is_repeated_is_taken_at_its_rate(spark, tmp_path):
    rows = [(1, "one two three", "a", "x")] * 3_000 + [(None, "four words are here", "a", "x")] * 2_000 + [(i, "w " * 40, "b", "x") for i in range(2, 600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, place string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = mixed_sizes(docs).groupBy("source", "target").agg({"taken": "sum"}).collect()
    assert all(abs(r["sum(taken)"] - r["target"]) < 0.05 * r["target"] for r in got)
    again = [sorted(map(repr, mixed_sizes(docs).collect())) for _ in range(2)]
    assert again[0] == again[1]
    mixed = mix(docs)
    assert mixed.columns == ["doc_id", "text", "source", "place", "copy"]
    taken = {r["source"]: r["n"] for r in mixed.selectExpr("source", "size(split(trim(text), ' ')) n").groupBy("source").agg({"n": "sum"}).toDF("source", "n").collect()}
    assert taken == {r["source"]: r["sum(taken)"] for r in got}
