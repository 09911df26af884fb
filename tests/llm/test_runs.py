"""Periodic runs against a plain search over all periods, and the query against its contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from shelfmark.llm import words as W
from shelfmark.llm.queries import QUERIES
from shelfmark.llm.runs import periodic_runs, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, shortest=24, times=3):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, times * q):
                piece = words[i : i + length]
                if all(any(piece[k] != piece[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def random_text(rng):
    letters, words = rng.choice([1, 2, 3, 5, 16]), []
    for _ in range(rng.randint(0, 12)):
        if rng.random() < 0.5:
            words += [rng.choice("abcdefghijklmnop"[:letters]) for _ in range(rng.randint(1, 10))]
        else:
            period = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
            words += (period * 8)[: int(len(period) * rng.uniform(1, 7))]
    return rng.choice([" ", "\n", " \t "]).join(words)


@pytest.mark.parametrize(("shortest", "times"), [(24, 3), (2, 3), (7, 4), (33, 3)])
def test_runs_equal_plain_search(shortest, times):
    rng = random.Random(shortest)
    texts = [random_text(rng) for _ in range(250)]
    for row, stop, words in W.slices_of_words(pa.array(texts), limit=3_000):
        found = list(zip(*(c.tolist() for c in runs_of(words, shortest, times)), strict=True))
        for i in range(stop - row):
            assert [r[1:] for r in found if r[0] == i] == plain_runs(texts[row + i].split(), shortest, times)


def test_query_equals_plain_rows(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \n", "a " * 400, "é 𝄞 " * 40, "ab " * 23, "x y z " * 8] + [random_text(rng) for _ in range(300)]
    rows = [(i, t, "s", "start") for i, t in enumerate(texts)] + [(None, "a b " * 20, None, None), (5, "ab " * 23, "s", "start")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, best string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()]
    want = [plain_row(r[0], r[1]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(r[1] > 1 for r in want) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)


def test_long_text_other_names_and_empty_table(spark):
    words = [str(i) for i in range(200_000)] + ["p", "q", "r"] * 50_000 + ["p"]
    docs = spark.createDataFrame([("k", " ".join(words), 1)], "id string, body string, runs int")
    (row,) = periodic_runs(docs, "id", "body").collect()
    assert row["id"] == "k" and [tuple(r) for r in row["runs"]] == [(200_000, 150_001, 3)] and tuple(row["best"]) == (200_000, 150_001, 3)
    assert row["collapsed"] == " ".join(words[:200_003])
    assert periodic_runs(docs.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, "id", "body", times=2)
