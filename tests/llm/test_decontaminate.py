"""Benchmark items in documents: recall and precision against shared word sequences in plain Python."""

import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest

from shelfmark.llm import words as W
from shelfmark.llm.decontaminate import (
    BUCKETS,
    EXTRA,
    HALF,
    LEADING,
    RANK,
    Item,
    _added,
    _orthonormal,
    _product,
    _step,
    _weighed,
    benchmark_matches,
    decontaminated,
    distinct_texts,
    latent_space,
)

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fives(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])  # the sample is the whole of the first table and a tenth of the second
def test_items_in_documents(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    own = {i: fives(t) for i, t in con.execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()}
    wanted = [(i, fives(t)) for i, t in con.execute(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall()]
    truth = {(d, i) for i, five in wanted for d, s in own.items() if len(s & five) >= 0.5 * len(five)}
    got = {(r["doc_id"], r["item_id"]) for r in benchmark_matches(docs, items).collect()}
    assert len(truth) > 15 and len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 1 + len(truth) // 50
    kept = {r["doc_id"] for r in decontaminated(docs, items).select("doc_id").collect()}
    assert kept == set(own) - {d for d, _ in got}


def test_paraphrases_need_the_answer(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(vocab, k=150))) for i in range(120)]
    item = rng.choices(vocab, k=40)

    def changed(words, share):
        return [rng.choice(vocab) if rng.random() < share else w for w in words]

    def within(words):
        return " ".join(rng.choices(vocab, k=50) + words + rng.choices(vocab, k=50))

    docs += [(200, within(item)), (201, within(changed(item[:34], 0.25) + item[34:])), (202, within(changed(item[:26], 0.05) + rng.choices(vocab, k=14)))]
    docs += [(None, None), (203, ""), (204, within(item)), (204, within(item))]
    items = [(1, " ".join(item)), (2, None), (3, "too short"), (4, "w1 unheard"), (None, " ".join(rng.choices(vocab, k=30)))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["doc_id"] for r in benchmark_matches(d, b).collect()) == [200, 201, 204, 204]
    assert decontaminated(d.selectExpr("*", "1 as item_id"), b).columns == ["doc_id", "text", "item_id"]
    assert benchmark_matches(d.limit(0), b).count() == benchmark_matches(d, b.limit(0)).count() == 0
    answered = b.withColumn("answer", b["text"].substr(1, 0))
    assert benchmark_matches(d, answered, answer_col="answer").count() == 4


def test_common_subsequence():
    import numpy as np

    item = Item(1, np.array([5, 6, 7, 5]), {5: 0b1001, 6: 0b10, 7: 0b100}, set())
    assert item.common([5, 7, 6, 5]) == 3 and item.common([]) == 0 and item.common([9, 5, 6, 9, 7, 5, 5]) == 4


def test_one_text_copied_more_often_than_the_sample_is_large(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(6_000)]
    item = rng.choices(vocab, k=40)
    texts = [" ".join(rng.choices(vocab, k=60) + (item if i % 15 == 0 else []) + rng.choices(vocab, k=60)) for i in range(300)]
    copies = " ".join(rng.choices(vocab, k=120))
    rows = list(enumerate(texts)) + [(1_000 + i, copies) for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(rng.choices(vocab, k=40)))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in benchmark_matches(docs, items, sample=100).collect()} == {(i, 1) for i in range(0, 300, 15)}


def test_short_items_by_their_exact_words(spark):
    docs = spark.createDataFrame([(1, "What is the Capital of Peru ?"), (2, "what is the capital"), (3, "of peru ? what is the capital"), (4, "w " * 200_000 + "why not"), (5, "why"), (6, "why\nNOT")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "is the capital of peru"), (2, "why not"), (3, " \n"), (3, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["first_word"], r["n_words"]) for r in benchmark_matches(docs, items).collect())
    assert got == [(1, 1, 1, 5), (4, 2, 200_000, 2), (6, 2, 0, 2)]
    assert sorted(r["doc_id"] for r in decontaminated(docs, items).collect()) == [2, 3, 5]


def test_basis_in_the_place_of_its_table():
    """Orthonormal, of the same columns, also where some are missing, without further copies of the table."""
    draw = np.random.default_rng(3).standard_normal
    for rows, rank in ((40_000, 80), (40_000, 20), (100, 80), (8_200, 80)):
        table = (draw((rows, rank)) @ draw((rank, 80))).astype(np.float32)
        own = table.copy()
        tracemalloc.start()
        basis = _orthonormal(own)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert basis is own and np.allclose(basis.T @ basis, np.eye(80), atol=1e-5)
        assert np.allclose(basis @ (basis.T @ table), table, atol=1e-3)
        assert rows < 40_000 or peak < 1.5 * table.nbytes  # numpy's own takes more than 4 times the table


def test_a_task_holds_one_weighed_copy_of_the_basis():
    rng = np.random.default_rng(4)
    rows, weights = rng.standard_normal((2_500, 7)).astype(np.float16), rng.random(2_500, np.float32)
    weighed = _weighed(rows, weights)
    assert weighed.dtype == np.float32 and not weighed[-1].any()
    assert np.array_equal(weighed[:-1], rows.astype(np.float32) * weights[:, None])
    idf = np.ones(BUCKETS, np.float32)
    tracemalloc.start()
    assert not list(_step(None, idf, True)([]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * 4 * BUCKETS * (RANK + EXTRA)  # the random start and its weighed copy


def test_the_space_is_fitted_on_all_texts(spark):
    """Its first directions are those of all texts in plain numpy, whichever texts a bounded number of them would be."""
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocab[40 * (i % 10) : 40 * (i % 10) + 40], k=rng.choice((9, 24, 60)))) for i in range(2_600)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:50], None, "", " "]], "text string").repartition(5)
    assert distinct_texts(docs).count() == len(texts) and distinct_texts(docs, sample=7).count() == 7
    idf = np.zeros(BUCKETS, np.float32)
    hashed = [W.split_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).hashes() & np.uint64(BUCKETS - 1) for t in texts]
    idf[np.unique(np.concatenate(hashed)).astype(int)] = 1.0
    words = np.flatnonzero(idf)
    rows = []
    for h in hashed:
        halves = [np.isin(words, h[k : k + HALF]).astype(float) for k in range(0, len(h), HALF)]
        rows += [halves[k] + halves[k + 1] for k in range(len(halves) - 1)] if len(halves) > 1 else halves
    rows = np.array([r / np.sqrt((r**2).sum() if r.max() == 1 else (r > 0).sum() + (r > 1).sum()) for r in rows])
    values, vectors = np.linalg.eigh(rows.T @ rows)
    space = latent_space(docs, idf)
    assert not space[idf == 0].any()
    first = space[words][:, 0]  # the one after those left out
    own = vectors[:, ::-1][:, LEADING]
    assert values[::-1][LEADING] > 1.5 * values[::-1][LEADING + 2]
    share = vectors[:, ::-1][:, LEADING - 8 : LEADING + 2].T @ (first / np.linalg.norm(first))
    assert (share**2).sum() > 0.98 and abs(own @ first) > 0


def test_words_of_every_text_have_a_place_in_the_space(spark):
    """Also those of one text only, however many texts there are."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(400)]
    texts = [" ".join([f"own{i}", *rng.choices(vocab, k=30)]) for i in range(1_500)]
    hashed = np.concatenate([W.split_words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).hashes() & np.uint64(BUCKETS - 1) for t in texts]).astype(int)
    space = latent_space(spark.createDataFrame([(t,) for t in texts], "text string"), np.ones(BUCKETS, np.float32))
    assert space[np.unique(hashed)].any(1).all()


def test_products_of_many_tasks_add_up(spark, monkeypatch):
    """However texts are dealt and products merged, the space is the same but for what half precision rounds."""
    rng = random.Random(10)
    vocab = [f"v{i}" for i in range(300)]
    docs = spark.createDataFrame([(" ".join(rng.choices(vocab, k=30)),) for _ in range(200)], "text string")
    idf = np.ones(BUCKETS, np.float32)
    texts = distinct_texts(docs)
    whole, parts = (_product(texts.repartition(n), None, idf) for n in (1, 7))
    monkeypatch.setattr("shelfmark.llm.decontaminate.MERGED", 2)
    again = _product(texts.repartition(7), None, idf)
    for other in (parts, again):
        assert np.abs(whole - other).max() < 0.01 * np.abs(whole).max()


def test_rows_are_added_to_their_words():
    rng = np.random.default_rng(5)
    for n, vocab in ((0, 10), (1, 10), (300, 40), (300, BUCKETS)):
        words = np.sort(rng.integers(0, vocab, (n, HALF)), 1)
        words[rng.random((n, HALF)) < 0.2] = BUCKETS
        rows = rng.integers(-9, 9, (n, 8)).astype(np.float32)
        out, plain = np.ones((BUCKETS, 8), np.float32), np.ones((BUCKETS + 1, 8), np.float32)
        _added(out, words, rows)
        np.add.at(plain, words.ravel(), np.repeat(rows, HALF, 0))
        assert np.array_equal(out, plain[:-1])
