"""Line quality by a linear-chain conditional random field.

Each line with a word has a few yes-or-no features; a two-state chain over the lines
of a text, decoded by Viterbi, marks them content or boilerplate. A text is kept if at
least ``share`` of its words stand in content lines and the base rules do not fail it.

The chain is trained on at most ``sample`` labelled ids, picked by a hash, one text an id.
Lines have no labels of their own: lines of good texts are content, and of the lines
of bad ones those that a logistic curve on single lines calls likelier bad. Every text
is measured whole in the task that reads it; the model is a few dozen numbers.

Null and blank texts have no words, fail the base rules and are not kept. Without
labelled texts of both kinds every line is content. Null ids and null labels are
unlabelled; an id labelled bad once is bad. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.tables import training_texts

SAMPLE, SHARE, PIECE = 3_000, 0.5, 64
MIN_WORDS, REPEATED_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_MARK[list(b"!?=_~^/\\{}[]@")] = True
_LETTER = np.ones(256, bool)  # first byte of a character of a word
_LETTER[128:192] = False
_LETTER &= W.IN_WORD


@dataclass
class Chain:
    weights: np.ndarray  # of the features, for content
    moves: np.ndarray  # 2 x 2


@dataclass
class Measured:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_first: np.ndarray  # n + 1 offsets of each text's lines that have a word
    line_words: np.ndarray
    features: np.ndarray


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _repeats(key: np.ndarray) -> np.ndarray:
    """Whether an equal key comes before."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    return same


def measure(words: W.Words) -> Measured:
    data, texts, n = words.data, words.texts, len(words.texts) - 1
    letters, symbols = _sums(_LETTER[data]), _sums(_SYMBOL[data])
    of_word = np.repeat(np.arange(n, dtype=np.uint64), words.counts())
    exact = words.hashes(lower=False)

    windows = W.windows_hashed(exact, 3)
    inside = of_word[2:] == of_word[:-2] if len(windows) else np.zeros(0, bool)
    key = W.mix(windows + of_word[: len(windows)] * np.uint64(0x9E3779B97F4A7C15))[inside]
    at = np.flatnonzero(inside)
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    covered = np.zeros(len(exact), bool)
    for k in range(3):
        covered[at[twice] + k] = True

    # lines: from each text's start and each line break to the next
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([texts[:-1], breaks + 1])
    end = np.concatenate([breaks, texts[1:]])
    text = np.concatenate([np.arange(n), np.searchsorted(texts, breaks, "right") - 1])
    end_text = np.concatenate([np.searchsorted(texts, breaks, "right") - 1, np.arange(n)])
    start, end = start[np.lexsort((start, text))], end[np.lexsort((end, end_text))]
    text = np.sort(text, kind="stable")
    a, b = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = b > a
    start, end, text, a, b = start[full], end[full], text[full], a[full], b[full]
    line_key = W.mix(words.span_hashes(start, end, lower=False) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = _repeats(line_key)

    upper, digit, mark = (_sums(t[data]) for t in (_UPPER, _DIGIT, _MARK))
    twin = np.zeros(len(exact), bool)
    twin[1:] = exact[1:] == exact[:-1]
    twins, repeated = _sums(twin), _sums(covered)
    chars = np.maximum(letters[end] - letters[start], 1)
    count = b - a
    share = lambda s: (s[end] - s[start]) / chars
    last = data[words.end[b - 1] - 1] if len(b) else np.zeros(0, np.uint8)
    features = np.column_stack([
        np.ones(len(a)), share(symbols) > 0.02, share(symbols) > 0.1, share(upper) > 0.15, share(upper) > 0.5, share(digit) > 0.1, share(digit) > 0.3,
        share(mark) > 0.03, share(mark) > 0.15, (twins[b] - twins[a]) > 0.1 * count, (repeated[b] - repeated[a]) > 0.3 * count, again,
        count < 4, count < 10, count > 60, np.isin(last, list(b".!?\"')")), chars > 9 * count, chars < 3 * count,
    ]).astype(np.float64)
    dups = np.bincount(text[again], minlength=n)
    return Measured(
        words.counts(), letters[texts[1:]] - letters[texts[:-1]], symbols[texts[1:]] - symbols[texts[:-1]], dups,
        repeated[words.first[1:]] - repeated[words.first[:-1]], np.searchsorted(text, np.arange(n + 1)), count, features,
    )


def viterbi(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest states of all sequences, step by step over those that still go on.

    ``emission`` scores state 1 against state 0; ``first`` has n + 1 offsets.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    sorted_length = length[order]
    came = np.zeros((len(emission), 2), bool)
    score = np.zeros((len(order), 2))
    for k in range(int(sorted_length[0]) if len(order) else 0):
        live = np.searchsorted(-sorted_length, -k)  # sequences longer than k
        at = first[:-1][order[:live]] + k
        if k:
            step = score[:live, :, None] + moves[None]
            came[at] = step[:, 1] > step[:, 0]
            score[:live] = step.max(1)
        score[:live, 1] += emission[at]
    state = np.zeros(len(emission), bool)
    now = score[:, 1] >= score[:, 0]
    for k in range(int(sorted_length[0]) - 1 if len(order) else -1, -1, -1):
        live = np.searchsorted(-sorted_length, -k)
        at = first[:-1][order[:live]] + k
        state[at] = now[:live]
        now[:live] = came[at, now[:live].astype(int)]
    return state


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def fit_chain(features: np.ndarray, states: np.ndarray, first: np.ndarray, steps: int = 200, ridge: float = 1.0) -> Chain:
    """Likelihood ascent (Adam) with forward and backward sums over all sequences at once."""
    length = np.diff(first)
    at = first[:-1, None] + np.arange(length.max())[None]
    inside = np.arange(length.max())[None] < length[:, None]
    at = np.where(inside, at, 0)
    x, y = features[at] * inside[..., None], np.where(inside, states[at], 0).astype(int)
    observed = np.einsum("st,stf->f", y * inside, x)
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (y[:, :-1][inside[:, 1:]], y[:, 1:][inside[:, 1:]]), 1)
    theta = np.concatenate([_logistic(features, states.astype(float)), np.zeros(4)])
    f, first_moment, second_moment = features.shape[1], np.zeros(features.shape[1] + 4), np.zeros(features.shape[1] + 4)
    for step in range(1, steps + 1):
        emit, moves = x @ theta[:f], theta[f:].reshape(2, 2)
        node = np.stack([np.zeros_like(emit), emit], -1)
        alpha, beta = np.zeros_like(node), np.zeros_like(node)
        alpha[:, 0] = node[:, 0]
        for t in range(1, node.shape[1]):
            ahead = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + node[:, t]
            alpha[:, t] = np.where(inside[:, t, None], ahead, alpha[:, t - 1])
        for t in range(node.shape[1] - 2, -1, -1):
            back = node[:, t + 1] + beta[:, t + 1]
            back = np.logaddexp(moves[:, 0] + back[:, 0, None], moves[:, 1] + back[:, 1, None])
            beta[:, t] = np.where(inside[:, t + 1, None], back, 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        content = np.exp(alpha[..., 1] + beta[..., 1] - total[:, None]) * inside
        joint = alpha[:, :-1, :, None] + moves[None, None] + (node + beta)[:, 1:, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * inside[:, 1:, None, None]).sum((0, 1))
        gradient = np.concatenate([observed - np.einsum("st,stf->f", content, x), (pairs - expected).ravel()]) - ridge * theta
        gradient /= len(states)
        first_moment = 0.9 * first_moment + 0.1 * gradient
        second_moment = 0.99 * second_moment + 0.01 * gradient**2
        theta = theta + 0.05 * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-9)
    return Chain(theta[:f], theta[f:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Chain | None:
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("y")).withColumn("order", F.xxhash64("id")).orderBy("order").limit(sample)
    )
    rows = training_texts(docs, known, id_col, text_col)
    if len(set(rows["y"])) < 2:
        return None
    x, y, lengths = [], [], []
    for row, _, words in W.slices_of_words(pa.array(rows["text"].tolist(), pa.string())):
        seen = measure(words)
        counts = np.diff(seen.line_first)
        x.append(seen.features)
        y.append(np.repeat(rows["y"].to_numpy()[row : row + len(counts)], counts))
        lengths += [min(PIECE, n - k) for n in counts.tolist() for k in range(0, n, PIECE)]
    x, y = np.concatenate(x), np.concatenate(y).astype(bool)
    alone = x @ _logistic(x, y.astype(float)) > 0
    return fit_chain(x, y | alone, np.concatenate([[0], np.cumsum(lengths)]).astype(int))


def text_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                 *, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, content_lines, content_words)."""
    chain = train(docs, labels, id_col, text_col, label_col, sample)

    def run(batches):
        for batch in batches:
            for row, stop, words in W.slices_of_words(batch.column(1)):
                seen = measure(words)
                content = np.ones(len(seen.line_words), bool)
                if chain is not None:
                    content = viterbi(seen.features @ chain.weights, seen.line_first, chain.moves)
                kept_words, kept_lines = _sums(content * seen.line_words), _sums(content)
                of = lambda s, seen=seen: s[seen.line_first[1:]] - s[seen.line_first[:-1]]
                failed = (seen.n_words < MIN_WORDS) | (100 * seen.n_repeat_words > REPEATED_PERCENT * seen.n_words)
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(row, stop - row),
                    **{c: pa.array(getattr(seen, c), pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
                    "base_failed": pa.array(failed), "kept": pa.array(~failed & (of(kept_words) >= share * seen.n_words)),
                    "n_lines": pa.array(np.diff(seen.line_first), pa.int64()), "content_lines": pa.array(of(kept_lines), pa.int64()),
                    "content_words": pa.array(of(kept_words), pa.int64()),
                })

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = f"doc_id long, {counts}, base_failed boolean, kept boolean, n_lines long, content_lines long, content_words long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
