"""Stretches of words that repeat with a period, found and collapsed.

A run is a maximal stretch of words with smallest period q that has at least ``shortest``
words and at least ``times`` periods. Every word of a run occurs ``times`` times or more
within it, so a word rarer than that in its segment (at first: the text) is in no run of
the segment: it splits the segment, the pieces are counted anew, and so on until no
segment changes. Pieces shorter than ``shortest`` are dropped.

What survives is scanned by lags. For g = 8, 16, 32 and so on each window of g words is
named by the pair of names of its halves, and its lag is the distance to the next equal
window. A lag q of at most g means that the window overlaps or touches its copy, so
consecutive windows of equal lag q are exactly one maximal stretch with smallest period
q and at least q + g words. Lags above g/2 are taken at width g (all of them at the first
width), at which every qualifying run shows. A text of n words takes O(n log² n) steps.

Words are named by their bytes, not by hashes: results are exact. Null and blank texts
have no runs and collapse to empty text. A text of any length is searched whole, by the
task that reads it, in memory proportional to it. Equal runs in several places are
reported each; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import words as W

SHORTEST, TIMES = 24, 3

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _spread(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places lies in one of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def word_names(words: W.Words) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    if not len(words.start):
        return np.zeros(0, np.int64)
    inside = _spread(words.start, words.end, len(words.data))
    offsets = np.zeros(len(words.start) + 1, np.int64)
    np.cumsum(words.end - words.start, out=offsets[1:])
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(offsets), pa.py_buffer(words.data[inside])])
    return packed.dictionary_encode().indices.to_numpy().astype(np.int64)


def split_by_frequency(names: np.ndarray, text: np.ndarray, shortest: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that survive, ascending, and the segment of each."""
    place, segment = np.arange(len(names)), text
    stable_places, stable_segments, used = [], [], 0
    while len(place):
        _, key, count = np.unique(segment * (names.max() + 1) + names[place], return_inverse=True, return_counts=True)
        frequent = count[key] >= times
        rare_in = np.bincount(segment[~frequent], minlength=segment[-1] + 1) > 0
        size = np.bincount(segment, minlength=segment[-1] + 1)
        done = ~rare_in[segment] & (size[segment] >= shortest)
        if done.any():
            stable_places.append(place[done])
            stable_segments.append(segment[done] + used)
            used += int(segment[-1]) + 1
        rest = frequent & ~done & (size[segment] >= shortest)
        place, old = place[rest], segment[rest]
        segment = np.zeros(len(place), np.int64)
        np.cumsum((np.diff(place) != 1) | (np.diff(old) != 0), out=segment[1:])
    if not stable_places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, segment = np.concatenate(stable_places), np.concatenate(stable_segments)
    order = np.argsort(place)
    return place[order], segment[order]


def scan_lags(names: np.ndarray, place: np.ndarray, segment: np.ndarray, shortest: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run; starts are places."""
    found: list[tuple[np.ndarray, ...]] = []
    ends = np.flatnonzero(np.diff(segment, append=-1) != 0)
    longest = int(np.diff(ends, prepend=-1).max()) if len(ends) else 0
    # a mark of its own ends each segment, so no window over an end has an equal
    place = np.insert(place, ends + 1, -1)
    name = np.where(place < 0, 0, names[place] if len(names) else 0)
    name[place < 0] = name.max(initial=0) + 1 + np.arange(len(ends))
    first_width, width, least_lag = 1 << max(shortest // 2, 1).bit_length() - 1, 1, 0
    while times * (least_lag + 1) <= longest and len(name):
        if width >= first_width:
            order = np.argsort(name, kind="stable")
            equal = name[order[1:]] == name[order[:-1]]
            if not equal.any():
                break
            lag = np.zeros(len(name), np.int64)
            lag[order[:-1][equal]] = np.diff(order)[equal]
            at = np.flatnonzero((lag > least_lag) & (lag <= width))
            if len(at):
                opens = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(lag[at]) != 0)])
                first = np.flatnonzero(opens)
                period = lag[at[first]]
                length = np.diff(first, append=len(at)) - 1 + period + width
                enough = length >= np.maximum(shortest, times * period)
                found.append((place[at[first]][enough], length[enough], period[enough]))
            least_lag = width
        halves = np.stack([name[: max(len(name) - width, 0)], name[width:]])
        _, name = np.unique(halves[0] * (name.max() + 1) + halves[1], return_inverse=True)
        width *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def runs_of(words: W.Words, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period), sorted; starts are word numbers within the text."""
    names = word_names(words)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    start, length, period = scan_lags(names, *split_by_frequency(names, text, shortest, times), shortest, times)
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = text[start] if len(start) else start
    return of, start - words.first[of], length, period


def collapsed(words: W.Words, dropped: np.ndarray) -> pa.LargeStringArray:
    """The texts without the dropped words, one space between words."""
    kept = np.flatnonzero(~dropped)
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())[kept]
    more = np.zeros(len(kept), bool)  # another kept word follows in the text, so a blank follows the word
    more[:-1] = text[1:] == text[:-1]
    begin, end = words.start[kept], words.end[kept]
    data = words.data.copy()
    data[end[more]] = 32
    data = data[_spread(begin, end + more, len(data))]
    lengths = np.bincount(text, end + more - begin, minlength=len(words.first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """(id, runs, best, collapsed) of each row.

    ``runs`` are (start, length, period) by start and period; ``best`` is the one with the
    greatest length over period, the first of equals, null without runs; ``collapsed`` keeps
    of each run its first period only.
    """
    if times < 3 or shortest < 2:
        raise ValueError("a run has three periods and two words at least")

    def search(batches):
        for batch in batches:
            for row, stop, words in W.slices_of_words(batch.column(1)):
                text, start, length, period = runs_of(words, shortest, times)
                at = words.first[text] + start
                dropped = _spread(at + period, at + length, len(words.start))
                first = np.searchsorted(text, np.arange(stop - row + 1))
                best: list[dict | None] = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    spans = zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)
                    top = max(spans, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                spans = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], fields=list(RUN))
                yield pa.record_batch([
                    batch.column(0).slice(row, stop - row), pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans),
                    pa.array(best, RUN), collapsed(words, dropped).cast(pa.string()),
                ], names=["id", "runs", "best", "collapsed"])

    run = "struct<start:long,length:long,period:long>"
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([chosen.schema["id"], *T._parse_datatype_string(f"runs array<{run}>, best {run}, collapsed string").fields])
    return chosen.mapInArrow(search, schema).withColumnRenamed("id", id_col)
