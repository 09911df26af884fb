"""Text quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is the set of its word n-grams (one to ``longest`` words, exact case), hashed to
2^``bits`` places, as a vector of length one. Training is FTRL-proximal with L1 and L2
terms. The labelled rows are dealt to ``shards`` by a hash of their id; in each of
``rounds`` every shard runs over its rows once, from the mean state of the round before
(iterative parameter mixing). States (two floats a place) are all the driver ever holds.

Trained on at most ``sample`` labelled ids, the least by a hash of the id, one text an id
(the one of least hash); a text gives at most 2^``bits`` numbers however long it is.
Scoring reads every text once, whole, as a sparse dot product in the task that reads it.

Null and blank texts have no n-grams: the score is that of the intercept. Without labelled
rows every score is 0.5. Null ids and null labels are unlabelled; of an id with both labels
the lower counts. Repeated rows get equal scores; empty tables give empty results; columns
keep their names, the score takes ``score`` with underscores before it while that is taken.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import words as W
from shelfmark.llm.tables import free_name, materialise

SAMPLE, BITS, LONGEST, SHARDS, ROUNDS = 20_000, 18, 2, 4, 4
CUT, FOLDS, HELD_OUT = 0.7, 4, 2


@dataclass(frozen=True)
class Rates:
    """Settings of the FTRL-proximal update."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01


@dataclass
class State:
    """Per place: the adjusted gradient sum z and the sum of squared gradients n. The last place is the intercept."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def empty(cls, bits: int) -> State:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1))

    def weights(self, rates: Rates, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * rates.l1) / ((rates.beta + np.sqrt(n)) / rates.alpha + rates.l2)
        return np.where(np.abs(z) > rates.l1, w, 0.0)

    def learn(self, places: np.ndarray, y: int, rates: Rates) -> None:
        """One update with a text; ``places`` are distinct."""
        at = np.append(places, len(self.z) - 1)
        x = np.full(len(at), 1.0 / np.sqrt(max(len(places), 1)))
        x[-1] = 1.0
        w = self.weights(rates, at)
        g = (_sigmoid(w @ x) - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / rates.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def places_of(words: W.Words, bits: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each distinct hashed n-gram of each text, sorted."""
    hashes = words.hashes(lower=False)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    keys = []
    for width in range(1, longest + 1):
        grams = W.windows_hashed(hashes, width)
        inside = text[: len(grams)] == text[width - 1 :]
        place = (grams >> np.uint64(64 - bits)).astype(np.int64)
        keys.append((text[: len(grams)] << bits | place)[inside])
    key = np.unique(np.concatenate(keys))
    return key >> bits, key & ((1 << bits) - 1)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, bits: int, longest: int) -> DataFrame:
    """(id, y, places) of the labelled sample, one row an id."""
    known = materialise(
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")

    def hashed(batches):
        for batch in batches:
            for row, stop, words in W.slices_of_words(batch.column(3)):
                text, place = places_of(words, bits, longest)
                places = W.list_array(place.astype(np.int32), np.bincount(text, minlength=stop - row), pa.int32())
                yield pa.record_batch([*(batch.column(k).slice(row, stop - row) for k in range(3)), places], names=["id", "y", "key", "places"])

    keyed = texts.select("id", "y", F.xxhash64("text").alias("key"), "text")
    rows = keyed.mapInArrow(hashed, f"id {keyed.schema['id'].dataType.simpleString()}, y int, key long, places array<int>")
    return rows.groupBy("id").agg(F.min_by(F.struct("y", "places"), F.struct("key", "places")).alias("row")).select("id", "row.*")


def _shard(shared, turn: int, rates: Rates):
    """One run over a shard's rows, in an order that depends on ids and turn alone."""

    def run(group: pa.Table) -> pa.Table:
        z, n = shared.value
        own = State(z.copy(), n.copy())
        group = group.sort_by("id")
        ids, y = group.column("id").to_pylist(), group.column("y").to_pylist()
        places = group.column("places").combine_chunks()
        for i in sorted(range(len(ids)), key=lambda i: zlib.crc32(f"{turn} {ids[i]}".encode())):
            own.learn(places[i].values.to_numpy(), y[i], rates)
        return pa.table({
            "shard": group.column("shard")[:1], "rows": pa.array([len(ids)], pa.int64()),
            **{c: pa.array([getattr(own, c).astype(np.float32).tobytes()]) for c in "zn"},
        })

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE,
          bits: int = BITS, longest: int = LONGEST, shards: int = SHARDS, rounds: int = ROUNDS, rates: Rates = Rates()) -> np.ndarray:
    """The weights, the intercept last."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, sample, bits, longest)
    dealt = materialise(rows.select("id", "y", "places", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")))
    state, spark = State.empty(bits), docs.sparkSession
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((state.z, state.n))
        done = dealt.groupBy("shard").applyInArrow(_shard(shared, turn, rates), "shard int, rows long, z binary, n binary").orderBy("shard").collect()
        shared.unpersist()
        if not done:
            break
        share = np.array([r["rows"] for r in done], float)
        share /= share.sum()
        state = State(*(sum(s * np.frombuffer(r[c], np.float32).astype(float) for s, r in zip(share, done, strict=True)) for c in "zn"))
    return state.weights(rates)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *,
                  bits: int = BITS, longest: int = LONGEST, **settings) -> tuple[DataFrame, str]:
    """``docs`` with a probability of label 1, and that column's name; ``settings`` as for ``train``."""
    name = free_name(docs, "score")
    weights = train(docs, labels, id_col, text_col, label_col, bits=bits, longest=longest, **settings)
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    names, text_at = [*docs.columns, name], [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        model = shared.value
        for batch in batches:
            for row, stop, words in W.slices_of_words(batch.column(text_at)):
                text, place = places_of(words, bits, longest)
                size = np.bincount(text, minlength=stop - row)
                dot = np.bincount(text, model[place], minlength=stop - row)
                found = _sigmoid(dot / np.sqrt(np.maximum(size, 1)) + model[-1])
                yield pa.record_batch([*(c.slice(row, stop - row) for c in batch.columns), pa.array(found, pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name
