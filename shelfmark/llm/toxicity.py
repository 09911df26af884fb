"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary labelled texts, one on
windows of toxic ones, from which the words are left out that toxic texts do not have far
more often: what both kinds of text share costs the same in either, as the toxic dictionary
is followed by the ordinary one. A text is cut into windows of whole words, each window is
compressed with both, and the bytes that the toxic dictionary saves are the window's gain.
Windows with a gain over each of a few thresholds, per text and per word, are the inputs of
a logistic curve fitted on labelled texts that trained neither dictionary. Toxic dictionaries
of a few sizes are trained, and the one whose curve fits those texts best is taken.

Only labelled rows whose fold (crc32 of the id, modulo 3) is not the held-out one are
learnt from, at most ``sample`` per label for the dictionaries and ``calibrate`` for the
curve, picked by a hash of the id, one text an id and ``TRAIN_BYTES`` of text in all; this
bound keeps training independent of the input's size. Every text is scored whole, in the
task that reads it: no shuffle, and the only broadcast is the model (two dictionaries of
fixed size and some weights).

Null and empty texts have no window and get the score of a text without gains. With no
labelled rows of either kind every score is 0. Null labels and ids count as unlabelled;
an id that is labelled toxic once is toxic. Repeated rows get equal scores, and the same
rows the same model, in whatever order they come.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import words as W
from shelfmark.llm.tables import fold, free_name, training_texts

FOLDS, HELD_OUT = 3, 1
CUT = 0.7
WINDOW_WORDS = 16
SAMPLE, CALIBRATE = 2_000, 4_000
DICTIONARY_BYTES = 4 << 10
GAINS = (1, 2, 3, 4, 5, 7)
LEVEL = 3
#: Size, segment and match length of the toxic dictionaries that are tried.
TOXIC_DICTIONARIES = ((512, 16, 6), (1024, 16, 6), (1024, 32, 8))
#: When a word sets toxic texts apart: in so many of them, so many times as often as in ordinary ones, and by chance with a
#: probability of e^-EVIDENCE at most.
LEAST_TEXTS, TIMES, EVIDENCE = 3, 5, 12.0


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    made = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    parameters = zstd.ZstdCompressionParameters.from_level(
        LEVEL, source_size=128, dict_size=len(content), min_match=4, strategy=zstd.STRATEGY_GREEDY,
        write_content_size=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    made.precompute_compress(compression_params=parameters)
    return zstd.ZstdCompressor(dict_data=made, compression_params=parameters)


def _windows(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length, text) of windows of whole words; the last of a text may be shorter."""
    counts = words.counts()
    per_text = -(-counts // WINDOW_WORDS)
    text = np.repeat(np.arange(len(counts)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    a = words.first[:-1][text] + nth * WINDOW_WORDS
    b = np.minimum(a + WINDOW_WORDS, words.first[1:][text])
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), text
    return words.start[a], words.end[b - 1] - words.start[a], text


def _lowered(data: np.ndarray) -> bytes:
    return data.tobytes().lower()


def features(column: pa.Array, model: Model) -> np.ndarray:
    """One row for each text: windows over each gain, as log counts and as shares of the words."""
    ordinary, toxic = _compressor(model.ordinary), _compressor(model.toxic)
    out = np.zeros((len(column), 2 * len(GAINS)))
    for row, stop, words in W.slices_of_words(column):
        start, length, text = _windows(words)
        if not len(start):
            continue
        data = _lowered(words.data)
        parts = [data[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]
        gain = np.fromiter((len(ordinary.compress(p)) - len(toxic.compress(p)) for p in parts), np.int64, len(parts))
        size = np.maximum(words.counts(), WINDOW_WORDS)
        for k, least in enumerate(GAINS):
            hits = np.bincount(text[gain >= least], minlength=stop - row)
            out[row:stop, k] = np.log1p(hits)
            out[row:stop, len(GAINS) + k] = hits * WINDOW_WORDS / size
    return out


def _dictionary(samples: list[bytes], size: int, k: int = 32, d: int = 6) -> bytes:
    """A dictionary trained on samples; the samples themselves if they are too few to train on."""
    try:
        return zstd.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstd.ZstdError:
        return b" ".join(dict.fromkeys(samples))[:size]


def _window_bytes(texts: list[str]) -> list[bytes]:
    out = []
    for _, _, words in W.slices_of_words(pa.array(texts, pa.string())):
        start, length, _ = _windows(words)
        data = _lowered(words.data)
        out += [data[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]
    return out


def different(texts: list[str], most_seen: float = 0.2) -> list[str]:
    """The texts without those that mostly repeat earlier ones: copies are no further evidence.

    Shingles seen are marks in a table of fixed size, as this runs on the driver.
    """
    seen = np.zeros(1 << 24, bool)
    out = []
    for row, _, words in W.slices_of_words(pa.array(texts, pa.string())):
        hashes = words.hashes()
        windows = W.windows_hashed(hashes, W.SHINGLE)
        for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
            own = (W.shingle_set(hashes, windows, a, b) >> np.uint64(40)).astype(np.int64)
            if seen[own].sum() <= most_seen * len(own):
                out.append(texts[row + i])
            seen[own] = True
    return out


def _words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def toxic_windows(ordinary: list[str], toxic: list[str]) -> list[bytes]:
    """Windows of the toxic texts, without the words that are about as common in ordinary ones; counted once a text."""
    here: Counter[bytes] = Counter()
    for t in toxic:
        here.update(set(_words_of(t)))
    here = Counter({w: n for w, n in here.items() if n >= LEAST_TEXTS})
    usual: Counter[bytes] = Counter()
    for t in ordinary:
        usual.update(here.keys() & set(_words_of(t)))

    def tells(word: bytes) -> bool:
        n, expected = here[word], (usual[word] + 0.5) * len(toxic) / len(ordinary)
        return n >= max(LEAST_TEXTS, TIMES * expected) and n * math.log(n / expected) - (n - expected) >= EVIDENCE

    telling = {w for w in here if tells(w)}
    out = []
    for t in toxic:
        words = [w for w in _words_of(t) if w in telling]
        out += [b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)]
    return out


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * len(x))
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scores(x: np.ndarray, model: Model) -> np.ndarray:
    if model.weights is None:
        return np.zeros(len(x))
    z = (x - model.centre) / model.scale
    return 1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          *, sample: int = SAMPLE, calibrate: int = CALIBRATE, dictionary_bytes: int = DICTIONARY_BYTES) -> Model | None:
    """The model, or None without labelled texts of both kinds."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col, FOLDS) != HELD_OUT))
        .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
        .withColumn("order", F.xxhash64("id"))
    )
    # three fifths for the dictionaries, the rest for the curve
    part = F.pmod(F.col("order"), F.lit(5)) < 3
    picked = [known.where(part & (F.col("y") == y)).orderBy("order").limit(sample) for y in (0, 1)]
    picked.append(known.where(~part).orderBy("order").limit(calibrate))
    ids = picked[0].unionByName(picked[1]).unionByName(picked[2]).withColumn("trains", part)
    rows = training_texts(docs, ids, id_col, text_col)
    trained = rows["trains"].to_numpy(bool)
    ordinary, toxic = (different(rows["text"][trained & (rows["y"] == y).to_numpy()].tolist()) for y in (0, 1))
    if not ordinary or not toxic:
        return None
    shared = _dictionary(_window_bytes(ordinary), dictionary_bytes)
    samples = toxic_windows(ordinary, toxic)
    # texts that trained no dictionary; with few labels there may be none of them
    curve = ~trained if len(set(rows["y"][~trained])) == 2 and (~trained).sum() >= 100 else np.ones(len(rows), bool)
    texts, y = pa.array(rows["text"][curve].tolist(), pa.string()), rows["y"][curve].to_numpy(float)
    tried = []
    for size, k, d in TOXIC_DICTIONARIES:
        model = Model(shared, _dictionary(samples, size, k, d) + shared)
        x = features(texts, model)
        model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
        model.weights = _fit_curve((x - model.centre) / model.scale, y)
        p = np.clip(_scores(x, model), 1e-9, 1 - 1e-9)
        tried.append((-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), len(tried), model))
    return min(tried)[2]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, str]:
    """The documents with a score from 0 to 1 in a further column, and that column's name."""
    model = train(docs, labels, id_col, text_col, **options)
    name = free_name(docs, "toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows) if model is None else _scores(features(batch.column(at), model), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*docs_columns, name])

    docs_columns = docs.columns
    return docs.mapInArrow(run, schema), name
