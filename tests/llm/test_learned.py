"""Toxicity, line quality and language model: held-out accuracy and plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import language_model as lm
from shelfmark.llm.quality import text_quality, viterbi
from shelfmark.llm.tables import training_texts
from shelfmark.llm.toxicity import CUT, FOLDS, HELD_OUT, score_toxicity, toxic_windows

SF = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored, name = score_toxicity(docs, labels)
    rows = scored.select("doc_id", name).join(labels, "doc_id").collect()
    held = [(r[name] >= CUT, r["toxic"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % FOLDS == HELD_OUT]
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    wrong = sum(p for p, y in held if not y) / sum(not y for _, y in held)
    assert caught > 0.45 and wrong < 0.015


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "x" * 100_000, None), (2, "x" * 100_000, None)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    scored, name = score_toxicity(docs, labels)
    assert scored.columns == ["doc_id", "text", "toxicity", "_toxicity"]
    assert [r[name] for r in scored.collect()] == [0.0] * 4
    assert score_toxicity(docs.limit(0), labels.limit(0))[0].count() == 0


def base_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(repeated), failed


def test_quality_base_rules_and_edges(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b a b a b a", "x\nx\n x\n\nx", "é 𝄞|<>\n" * 30, "word " * 50_000]
    texts += ["".join(rng.choice("ab #\n\t") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = text_quality(docs, labels).collect()
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(((i, *base_quality(t)) for i, t in rows), key=repr)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert text_quality(docs.limit(0), labels).count() == 0


def test_quality_keeps_good_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = text_quality(docs, labels).where("not base_failed").join(labels, "doc_id").collect()
    kept = {y: [r["kept"] for r in rows if r["quality"] == y] for y in (0, 1)}
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.15


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    first = np.array([0, 0, 4, 5, 12, 12])
    emission, moves = rng.normal(size=12), rng.normal(size=(2, 2))
    got = viterbi(emission, first, moves)
    for a, b in zip(first[:-1], first[1:], strict=True):
        def score(path, a=a):
            return sum(emission[a + i] * s for i, s in enumerate(path)) + sum(moves[p, q] for p, q in zip(path, path[1:], strict=False))
        paths = [[n >> i & 1 for i in range(b - a)] for n in range(1 << (b - a))]
        assert math.isclose(score(got[a:b].astype(int).tolist()), max(map(score, paths)))


def plain_model(texts, limit):
    """Probability of each next word by the same smoothing, from dictionaries of counts."""
    words = [[*WORD.findall((t or "").translate(LOWER)), "</s>"] for t in texts]
    one = Counter(w for ws in words for w in ws)
    total, size = sum(one.values()), len(one)
    two = Counter((a, b) for ws in words for a, b in zip(["<s>", *ws], ws))
    three = Counter((a, b, c) for ws in words for a, b, c in zip(["<s>", *ws], ws, ws[1:]))
    grams = {g: n for g, n in (two | three).items() if n >= limit}
    context = Counter({(w,): n for w, n in one.items()}) + Counter({("<s>",): len(texts)}) + Counter({g: n for g, n in grams.items() if len(g) == 2})

    def p(w, history):
        if not history:
            return (one[w] + 1) / (total + size + 1)
        arcs = {g[-1]: (n - lm.DISCOUNT) / context[history] for g, n in grams.items() if g[:-1] == history}
        if w in arcs:
            return arcs[w]
        if not arcs:
            return p(w, history[1:])
        return p(w, history[1:]) * (1 - sum(arcs.values())) / (1 - sum(p(x, history[1:]) for x in arcs))

    return one, total, size, p


@pytest.mark.parametrize(("vocabulary", "carried"), [(12, 1 << 17), (12, 3), (3_000, 50)])
def test_language_model_equals_plain_version(spark, vocabulary, carried):
    """Weights that a task carries and weights that are joined add up to the same score."""
    rng = random.Random(vocabulary)
    vocab = [f"W{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    texts = [" ".join(rng.choices(vocab, weights=weights, k=rng.randint(0, 60))) for i in range(150)]
    rows = [(i, t + (f" rare{i}" if i % 4 == 0 else "")) for i, t in enumerate(texts)] + [(1_000 + i, " ".join(t.split()[5:25])) for i, t in enumerate(texts)]
    rows += [(None, None), (7, None), (610, "rare2 unheard"), (610, "rare2 unheard"), (611, "\n ")]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % lm.FOLDS
    one, total, size, p = plain_model([t for i, t in rows if fold(i) != lm.HELD_OUT], lm.LEAST_COUNT)
    got = sorted((tuple(r) for r in lm.text_scores(spark.createDataFrame(rows, "doc_id long, text string"), frequent=carried, arcs=carried).collect()), key=repr)
    want = []
    for i, t in rows:
        words = [*WORD.findall((t or "").translate(LOWER)), "</s>"]
        base = sum(math.log10((one[w] + 1) / (total + size + 1)) for w in words)
        history, score = ("<s>",), 0.0
        for w in words:
            score += math.log10(p(w, history))
            history = (*history, w)[-2:]
        want.append((i, fold(i) == lm.HELD_OUT, len(words), sum(one[w] > 0 for w in words), total, base, score))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])
    assert lm.text_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_model_grows_with_its_input(spark):
    """Twice the corpus, twice the arcs; nothing is cut at a fixed number of words."""
    rng = random.Random(1)
    texts = [" ".join(f"v{rng.randrange(20_000)}" for _ in range(30)) for _ in range(2_000)]
    arcs = [lm.weights_of(spark.createDataFrame([(t,) for t in texts[:n] * 2], "text string")).arcs.count() for n in (1_000, 2_000)]
    assert arcs[0] > 50_000 and arcs[1] > 1.9 * arcs[0]


def test_one_labelled_id_repeated_thousands_of_times(spark):
    """Training reads one text an id, within its bytes."""
    docs = spark.range(30_000).selectExpr("if(id < 29000, 7, id) doc_id", "concat('some text ', id % 100) text")
    ids = spark.createDataFrame([(7, 0, 5), (29_001, 1, 3), (29_002, 1, 4)], "id long, y int, order long")
    rows = training_texts(docs, ids, "doc_id", "text")
    assert sorted(rows["id"]) == [7, 29_001, 29_002]
    assert len(training_texts(docs, ids, "doc_id", "text", limit=25)) == 2
    labels = spark.range(29_000, 30_000).selectExpr("id doc_id", "cast(id % 2 as int) quality").unionAll(spark.createDataFrame([(7, 1)], "doc_id long, quality int"))
    assert text_quality(docs, labels).count() == 30_000


def test_dictionaries_do_not_depend_on_the_order_of_words():
    ordinary = [" ".join(random.Random(i).choices([f"w{k}" for k in range(300)], k=60)) for i in range(200)]
    toxic = [f"{t} vile{i % 3} vile{i % 2}" for i, t in enumerate(ordinary[:120])]
    windows = toxic_windows(ordinary, toxic)
    assert {w for window in windows for w in window.split()} == {b"vile0", b"vile1", b"vile2"}
    assert windows == toxic_windows(ordinary, toxic)
