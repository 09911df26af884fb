"""The quality classifier: its update against a plain one, held-out accuracy, edges."""

import math
import zlib

import numpy as np
import pyarrow as pa

from shelfmark.llm import ftrl
from shelfmark.llm import words as W
from shelfmark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_update_equals_plain_ftrl():
    rng, rates, bits = np.random.default_rng(3), ftrl.Rates(alpha=0.7, beta=1.5, l1=0.1, l2=0.3), 4
    state, z, n = ftrl.State.empty(bits), [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= rates.l1:
            return 0.0
        return -(z[i] - math.copysign(rates.l1, z[i])) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2)

    for _ in range(60):
        places, y = np.sort(rng.choice(16, rng.integers(0, 6), replace=False)), int(rng.integers(0, 2))
        state.learn(places, y, rates)
        x = {int(p): 1 / math.sqrt(len(places)) for p in places} | {16: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
        for i in x:
            g = (p - y) * x[i]
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rates.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(state.z, z) and np.allclose(state.n, n)
    assert np.allclose(state.weights(rates), [weight(i) for i in range(17)])


def test_places_are_distinct_grams_of_one_text():
    texts = ["a b a b", "", "b", "a b\na b c"]
    ((_, _, words),) = W.slices_of_words(pa.array(texts))
    text, place = ftrl.places_of(words, 30, 2)
    of = [set(place[text == i].tolist()) for i in range(4)]
    assert [len(s) for s in of] == [4, 0, 1, 6]  # a, b, a b, b a / / b / a, b, c, a b, b a, b c
    assert of[0] < of[3] and of[2] < of[0]


def test_held_out_rows(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op12_quality_classifier"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(rows[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r["held_out"] for r, _ in held) and all(r["predicted"] == (r["score"] >= 0.7) for r in rows.values())
    assert np.mean([r["predicted"] for r, y in held if y]) > 0.95
    assert np.mean([r["predicted"] for r, y in held if not y]) < 0.1


def test_labels_of_held_out_rows_are_not_learnt(spark, tmp_path):
    """Turning the labels of held-out rows round changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = []
    for name, flip in (("a", "quality"), ("b", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality)")):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.selectExpr("doc_id", f"{flip} as quality", "toxic").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        scores.append(sorted(tuple(r) for r in QUERIES["op12_quality_classifier"](spark, f"{tmp_path}/{name}").collect()))
    assert scores[0] == scores[1]


def test_edges(spark):
    schema = "doc_id long, text string, score double, id int"
    rows = [(1, "good words here", 0.5, 1), (1, "good words here", 0.5, 1), (2, "bad bad bad", None, 2), (3, None, None, None), (None, "", 0.1, 3), (4, "w " * 300_000, 0.0, 4)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None)], "doc_id long, quality int")
    scored, name = ftrl.score_quality(docs, labels, rounds=30)
    assert scored.columns == ["doc_id", "text", "score", "id", "_score"] and name == "_score"
    got = {(r["doc_id"], r["text"][:4] if r["text"] else r["text"]): r[name] for r in scored.collect()}
    assert scored.count() == len(rows)
    assert got[1, "good"] > 0.5 > got[2, "bad "] and got[3, None] == got[None, ""]
    none, name = ftrl.score_quality(docs, labels.limit(0))
    assert {r[name] for r in none.collect()} == {0.5}
    assert ftrl.score_quality(docs.limit(0), labels)[0].count() == 0


def test_one_id_repeated_thousands_of_times_is_one_training_row(spark):
    docs = spark.range(20_000).selectExpr("if(id < 19990, 0, id) doc_id", "concat('text number ', if(id % 2 = 0, 'a', 'b')) text")
    labels = spark.range(20_000).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    rows = ftrl.training_rows(docs, labels, "doc_id", "text", "quality", ftrl.SAMPLE, 10, 2).collect()
    assert sorted(r["id"] for r in rows) == [0, *range(19_990, 20_000)]
