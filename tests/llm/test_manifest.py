"""The manifest against plain trees, block layout, edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import manifest as M
from shelfmark.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        first = i - i % 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def plain_manifest(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["source"]].append((row["doc_id"], leaf(row, row["text"]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for group in groups.values():
        group.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: levels_of([x[1] for x in groups[s]]) for s in names}
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (doc_id, own, row) in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            node = own
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0 and row["text"] is not None:
                node = leaf(row, row["text"].translate(LOWER))
            for left, right in steps:
                node = digest(*left, node, *right)
            root = top[-1][0]
            out.append((doc_id, own, trees[s][-1][0], root, digest(*(x for a, b in steps for x in a + b)), node, node == root))
    return out


def same(got, want):
    return sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_query_equals_plain_trees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()
    assert same(QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.1").collect(), plain_manifest(docs))


@pytest.mark.parametrize("height", [1, 2, 3])
def test_several_rounds_nulls_ties_and_hot_group(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, rng.randint(-3, 900)]), rng.choice(["A b", "É x", None, ""]), None, rng.choice([None, "", "z"]), None) for _ in range(300)]
    rows += [(i, f"Text {i}", "en", "hot", 6) for i in range(4_500)] + [(i, "t", "en", "16", 1) for i in range(16)] + [(i, "t", "en", "17", 1) for i in range(17)]
    rows += [(7, "Same Row", "de", "copies", 8)] * 300 + [(1, "L" * 300_000, "en", "long", 300_000)] + [(i, "w", None, f"é{i}", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("tree", F.lit(1)).withColumn("root", F.lit("x"))
    lowered = F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.translate("text", "TSREALÉ", "tsrealÉ"))
    got = M.document_proofs(docs.repartition(7), lowered, height=height).collect()
    assert same(got, plain_manifest(docs.collect()))


def test_empty_table_and_single_row(spark):
    docs = spark.createDataFrame([(1, "T", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert M.document_proofs(docs.limit(0)).count() == 0
    (row,) = M.document_proofs(docs).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == digest()


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_layout_by_halves(levels):
    slots = [M.address(levels, d, np.arange(M.FAN**d)) for d in range(levels)]
    flat = np.concatenate(slots)
    assert sorted(flat.tolist()) == list(range(M.nodes_in(levels)))
    upper = levels // 2
    if upper:
        assert np.concatenate(slots[:upper]).max() == M.nodes_in(upper) - 1  # the upper half comes first
        below = slots[upper]
        assert np.diff(below).tolist() == [M.nodes_in(levels - upper)] * (len(below) - 1)  # then equal subtrees, one after the other
