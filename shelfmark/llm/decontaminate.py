"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to a fixed vocabulary. Their document frequencies are counted over
all documents; a randomised SVD of the TF-IDF passages of all different texts (two power
steps, whose products with the passages are summed by Spark) gives a latent space, whitened
so that common directions do not make all passages look alike. Then, in one pass without a shuffle,
every window of every document is projected and compared by cosine with the benchmark
items, leaving out the leading directions that whole languages share; around each window
that is near an item, or has ``WIDTH`` words in a row in common with it, the longest common
subsequence of words decides: most of the item in order is a copy; a smaller part is a
paraphrase if the answer, the item's last words or a column of its own, is there as well.
Items of fewer than ``MIN_WORDS`` words are found by their exact sequence of words.

The SVD is fitted on all texts, each once however often it occurs, unless a number of texts
(``sample``, by a hash) is asked for; they are stored as two bytes a word, which its passes
read. A task sums its own products over ``TASK_WORDS`` words, so that what is exchanged is in
proportion to the texts. All documents are counted and searched. The latent space has a fixed size and
is broadcast once, as are the items of a pass: ``BLOCK`` of them, about 5 KB each, so that a
longer benchmark is a series of passes.

Null and blank texts and items match nothing; null item ids and document ids are kept
as they are. Repeated rows are searched like any other and give repeated results; of equal
places the last in the text is reported. Texts of any length are searched whole by the task
that reads them. Without documents or without items nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.tables import materialise

BUCKETS, RANK, EXTRA = 1 << 16, 64, 16
LEADING = 8  # directions left out: what all passages of a language share
HALF = 12  # words; a window is two halves
COSINE = 0.45
OVERLAP = 0.4  # of a near window's or the item's words, by their weights, that both must have to be compared in order
TARGET = 36  # words of an item looked for at once
COPY, PARAPHRASE, ANSWER = 0.75, 0.6, 0.75
ANSWER_WORDS, MIN_WORDS = 6, 8
BLOCK = 20_000
WIDTH = 6  # words in a row that an item and a text share to be compared in order
MARKS = 1 << 12  # places of an item's word signature
TEXT_SLICE = 512 << 10
_ROWS = 1024  # vocabulary rows in one summed piece
_BLOCK_ROWS = 4096  # vocabulary rows that the driver takes in double precision at once
SEED = 7  # of the random start
TASK_WORDS = 4 << 20  # that a task sums into a product of its own, about 10 MB as it is sent
FEW = 4  # occurrences of a word in a step that are added one after the other
STEP_WORDS = 64 << 10  # handled at once in a step
MERGED = 64  # products that a task adds up at once


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _frequencies(batches):
    counts, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        rows += batch.num_rows
        for _, _, words in W.slices_of_words(batch.column(0)):
            bucket = _buckets(words.hashes())
            for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                counts[np.unique(bucket[a:b])] += 1
    yield pa.record_batch({"rows": pa.array([rows]), "counts": pa.array([counts], pa.list_(pa.int64()))})


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """One weight for each hashed word; only BUCKETS sums reach the driver."""
    found = materialise(docs.select(text_col).mapInArrow(_frequencies, "rows long, counts array<long>"))
    total = found.agg(F.sum("rows")).first()[0] or 0
    counts = np.zeros(BUCKETS)
    sums = found.select(F.posexplode("counts").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    counts[sums["k"].to_numpy()] = sums["c"].to_numpy()
    return np.log((total + 1) / (counts + 1)).astype(np.float32)


@dataclass
class _Texts:
    """Where the words of consecutive texts start."""

    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _stored(batches):
    """The hashed words of each text, two bytes a word; texts without words are left out."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for row, stop, words in W.slices_of_words(batch.column("text")):
            bucket = _buckets(words.hashes()).astype("<u2")
            data = pa.Array.from_buffers(pa.large_binary(), stop - row, [None, pa.py_buffer(2 * words.first.astype(np.int64)), pa.py_buffer(bucket)])
            there = pa.array(words.counts() > 0)
            yield pa.record_batch({"key": pa.array(keys[row:stop]).filter(there), "words": data.cast(pa.binary()).filter(there)})


def _read_back(column: pa.Array) -> Iterator[tuple[_Texts, np.ndarray]]:
    """Stored texts, some at a time, and their hashed words."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, row = np.frombuffer(column.buffers()[2], np.uint8), 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 2 * STEP_WORDS, "right")) - 1)
        yield _Texts((offsets[row : stop + 1] - offsets[row]) // 2), data[offsets[row] : offsets[stop]].view("<u2").astype(np.int64)
        row = stop


def _halves(words: W.Words | _Texts) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of each half window."""
    per_text = -(-words.counts() // HALF)
    text = np.repeat(np.arange(len(per_text)), per_text)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return words.first[:-1][text] + nth * HALF, text


def _half_words(bucket: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The different words of each half window, filled up with BUCKETS, which stands for none."""
    at = start[:, None] + np.arange(HALF)
    words = np.where(at < end[:, None], bucket[np.minimum(at, len(bucket) - 1)], BUCKETS)
    words.sort(1)
    words[:, 1:][words[:, 1:] == words[:, :-1]] = BUCKETS
    return words


def _with_none(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.zeros((1, *rows.shape[1:]), rows.dtype)])


def _weighed(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``rows`` times ``weights`` in single precision, and a last row of zeros: one copy, made a block at a time."""
    out = np.zeros((len(rows) + 1, rows.shape[1]), np.float32)
    for k in range(0, len(rows), _ROWS):
        out[k : min(k + _ROWS, len(rows))] = rows[k : k + _ROWS].astype(np.float32) * weights[k : k + _ROWS, None]
    return out


def _sums_of(vectors: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty((len(words), vectors.shape[1]), np.float32)
    for k in range(0, len(words), 256):  # as much as fits in a cache
        vectors[words[k : k + 256]].sum(1, out=out[k : k + 256])
    return out


@dataclass
class _Windows:
    """The windows of some texts: a window starts with each half but a text's last, unless that is its only one."""

    halves: np.ndarray  # the words of each half
    start: np.ndarray  # first word of each window
    text: np.ndarray
    follows: np.ndarray  # whether a half has another one of its text behind it
    keep: np.ndarray  # whether a window starts with a half

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """Sums of vectors over each window: one row for each hashed word and a last one of zeros.

        A word counts once in each half, so that a word said over and over is no topic.
        """
        sums = _sums_of(vectors, self.halves)
        joined = self.follows[:-1]
        sums[:-1][joined] += sums[1:][joined]
        return sums[self.keep]

    def of_halves(self, of_windows: np.ndarray) -> np.ndarray:
        """Sums over the windows that each half is in: the one that starts with it and the one before."""
        out = np.zeros((len(self.keep), of_windows.shape[1]), of_windows.dtype)
        out[self.keep] = of_windows
        joined = np.flatnonzero(self.follows[:-1])
        out[joined + 1] += out[joined]  # taken as they were before
        return out


def _windows(words: W.Words | _Texts, bucket: np.ndarray) -> _Windows:
    start, text = _halves(words)
    halves = _half_words(bucket, start, words.first[1:][text])
    follows = np.zeros(len(start), bool)
    follows[:-1] = text[1:] == text[:-1]
    only = ~follows
    only[1:] &= text[1:] != text[:-1]
    keep = follows | only
    return _Windows(halves, start[keep], text[keep], follows, keep)


def _added(out: np.ndarray, words: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to those of its words."""
    there = words != BUCKETS
    word, row = words[there].astype(np.uint16), np.repeat(np.arange(len(words)), there.sum(1))
    order = np.argsort(word, kind="stable")
    word, row = word[order], row[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(word)))
    for nth in range(FEW):
        at = first[(times > nth) & (times <= FEW)] + nth
        out[word[at]] += rows[row[at]]
    many = np.flatnonzero(times > FEW)
    if len(many):
        left = np.repeat(times > FEW, times)
        row, first = row[left], np.cumsum(times[many]) - times[many]
        pairs, sums = rows.view(np.complex64), np.empty((len(many), rows.shape[1] // 2), np.complex64)
        word = word[left][first]
        for k, column in enumerate(np.ascontiguousarray(pairs.T)):
            sums[:, k] = np.add.reduceat(column.take(row), first)
        out[word] += sums.view(np.float32)


def _packed(rows: np.ndarray) -> tuple[bytes, float]:
    """Half-precision rows and what to multiply them with."""
    scale = float(np.abs(rows).max(initial=0.0)) or 1.0
    return (rows / scale).astype(np.float16).tobytes(), scale


def _unpacked(data: bytes, scale: float) -> np.ndarray:
    return np.frombuffer(data, np.float16).astype(np.float32) * np.float32(scale)


def _step(basis, idf: np.ndarray, gram: bool):
    """A task's part of A'(A basis), or of (A basis)'(A basis); without a basis from a random one."""

    def run(batches):
        width = RANK + EXTRA
        q = np.random.default_rng(SEED).standard_normal((BUCKETS, width), np.float32) if basis is None else basis.value
        q = _weighed(q, idf)
        squares = _with_none(idf[:, None] ** 2)
        out = np.zeros((width, width) if gram else (BUCKETS, width), np.float32)
        for batch in batches:
            for words, bucket in _read_back(batch.column(0)):
                windows = _windows(words, bucket)
                size = np.sqrt(windows.sums(squares)) + np.float32(1e-6)
                y = windows.sums(q) / size  # passages of length one
                if gram:
                    out += y.T @ y
                else:
                    _added(out, windows.halves, windows.of_halves(y / size))
        if not gram:
            out *= idf[:, None]
        for k in range(0, len(out), _ROWS):
            if out[k : k + _ROWS].any():
                data, scale = _packed(out[k : k + _ROWS])
                yield pa.record_batch({
                    "piece": pa.array([k // _ROWS]), "part": pa.array([TaskContext.get().partitionId() // MERGED]), "data": pa.array([data], pa.binary()), "scale": pa.array([scale])})

    return run


def _sent(texts: DataFrame, basis: np.ndarray):
    return texts.sparkSession.sparkContext.broadcast(basis.astype(np.float16))


def _product(texts: DataFrame, shared, idf: np.ndarray, gram: bool = False) -> np.ndarray:
    """The sum over all tasks for a basis that was sent, or a random one; tasks and driver exchange half-precision rows."""

    def add(key, parts):
        piece, part = (k.as_py() for k in key)
        data, scale = _packed(sum(_unpacked(x.as_buffer(), s.as_py()) for x, s in zip(parts["data"], parts["scale"], strict=True)))
        return pa.table({"piece": [piece], "part": [part // MERGED], "data": pa.array([data], pa.binary()), "scale": [scale]})

    schema = "piece long, part long, data binary, scale double"
    pieces, tasks = texts.mapInArrow(_step(shared, idf, gram), schema), texts.rdd.getNumPartitions()
    while tasks > 0:  # at most MERGED of them at once
        pieces, tasks = pieces.groupBy("piece", "part").applyInArrow(add, schema), (tasks - 1) // MERGED
    pieces = pieces.collect()
    if shared is not None:
        shared.destroy()
    out = np.zeros((RANK + EXTRA if gram else BUCKETS, RANK + EXTRA), np.float32)
    for r in pieces:
        part = _unpacked(bytes(r["data"]), r["scale"]).reshape(-1, RANK + EXTRA)
        out[r["piece"] * _ROWS : r["piece"] * _ROWS + len(part)] = part
    return out


def _blocks(a: np.ndarray) -> list[np.ndarray]:
    return [a[k : k + _BLOCK_ROWS] for k in range(0, len(a), _BLOCK_ROWS)]


def _orthonormal(a: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, written over them: only a block at a time is in double precision, not several copies of the table."""
    tops = [np.linalg.qr(block.astype(np.float64), "r") for block in _blocks(a)]
    turns = np.split(np.linalg.qr(np.concatenate(tops))[0], np.cumsum([len(top) for top in tops])[:-1])
    for block, turn in zip(_blocks(a), turns, strict=True):
        block[:] = np.linalg.qr(block.astype(np.float64))[0] @ turn
    return a


def distinct_texts(docs: DataFrame, text_col: str = "text", sample: int | None = None) -> DataFrame:
    """(words): the hashed words of all different texts that have any, or of ``sample`` of them, the same ones however often each occurs."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_stored, "key long, words binary").distinct()
    return (rows if sample is None else rows.orderBy("key", "words").limit(sample)).select("words")


def latent_space(docs: DataFrame, idf: np.ndarray, text_col: str = "text", sample: int | None = None) -> np.ndarray | None:
    """BUCKETS x RANK: what each hashed word adds to a passage's whitened coordinates."""
    picked = materialise(distinct_texts(docs, text_col, sample))
    size = picked.agg(F.sum(F.octet_length("words"))).first()[0]
    if not size:
        return None
    picked = picked.coalesce(-(-size // (2 * TASK_WORDS)))
    basis = None
    for _ in range(2):
        shared = None if basis is None else _sent(picked, basis)
        basis = None  # the driver holds one such table at a time
        basis = _orthonormal(_product(picked, shared, idf))
    values, vectors = np.linalg.eigh(_product(picked, _sent(picked, basis), idf, gram=True).astype(np.float64))
    best = np.argsort(values)[::-1][LEADING : LEADING + RANK]
    scale = 1 / np.sqrt(np.maximum(values[best], values.max() * 1e-6 + 1e-12))
    turn, out = vectors[:, best] * scale, np.empty((BUCKETS, len(best)), np.float32)
    for place, w, block in zip(_blocks(out), _blocks(idf), _blocks(basis), strict=True):
        place[:] = w[:, None] * (block @ turn)
    return out


@dataclass
class Item:
    item_id: object
    words: np.ndarray
    masks: dict[int, int]
    answer: set[int]

    def common(self, region: list[int]) -> int:
        """Length of the longest common subsequence, by bit-parallel steps over the item's words."""
        full = (1 << len(self.words)) - 1
        row = full
        for word in region:
            mask = self.masks.get(word)
            if mask:
                hit = row & mask
                row = ((row + hit) | (row - hit)) & full
        return len(self.words) - row.bit_count()


def _items(rows: list, answers: bool) -> list[Item]:
    def hashes(texts):
        for _, _, words in W.slices_of_words(pa.array(texts, pa.string())):
            h = words.hashes().view(np.int64)
            yield from (h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True))

    out = []
    own = hashes([r["answer"] for r in rows]) if answers else iter([])
    for row, words in zip(rows, hashes([r["text"] for r in rows]), strict=True):
        answer = next(own, None)
        if not len(words):
            continue
        masks: dict[int, int] = {}
        for k, word in enumerate(words.tolist()):
            masks[word] = masks.get(word, 0) | 1 << k
        out.append(Item(row["item_id"], words, masks, set((answer if answer is not None and len(answer) else words[-ANSWER_WORDS:]).tolist())))
    return out


def _part_starts(n: int) -> list[int]:
    """Where an item's parts of at most TARGET words start; the last one ends with the item."""
    return [*range(0, n - TARGET, TARGET), max(0, n - TARGET)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def _flat(keys: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """All keys, sorted, with the item of each."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, owner = np.concatenate(keys), np.repeat(owners, [len(k) for k in keys])
    order = np.argsort(key, kind="stable")
    return key[order], owner[order]


def _met(keys: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, item) of every key that an item has."""
    first, last = (np.searchsorted(known[0], keys, side) for side in ("left", "right"))
    n = last - first
    place = np.repeat(np.arange(len(keys)), n)
    nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
    return place, known[1][np.repeat(first, n) + nth]


class Targets:
    """The items of a pass, as the search needs them."""

    def __init__(self, items: list[Item], space: np.ndarray, idf: np.ndarray):
        self.items = items
        long = [(j, item) for j, item in enumerate(items) if len(item.words) >= MIN_WORDS]
        parts = [(j, item.words[k : k + TARGET]) for j, item in long for k in _part_starts(len(item.words))]
        self.owner = np.array([j for j, _ in parts], np.int64)
        sums = [space[np.unique(_buckets(w.view(np.uint64)))].sum(0) for _, w in parts]
        self.vectors = _unit(np.stack(sums)).T if parts else np.zeros((space.shape[1], 0), np.float32)
        self.marks, self.weight = np.zeros((len(items), MARKS), bool), np.zeros(len(items), np.float32)
        for j, item in long:
            bucket = np.unique(_buckets(item.words.view(np.uint64)))
            self.marks[j, bucket % MARKS] = True
            self.weight[j] = idf[bucket].sum()
        runs = [W.windows_hashed(item.words.view(np.uint64), WIDTH) for _, item in long]
        self.runs = _flat(runs, [j for j, _ in long])
        self.short = {}
        for n in range(1, MIN_WORDS):
            of = [(j, W.windows_hashed(item.words.view(np.uint64), n)) for j, item in enumerate(items) if len(item.words) == n]
            if of:
                self.short[n] = _flat([k for _, k in of], [j for j, _ in of])


def _near_places(words: W.Words, bucket: np.ndarray, padded: np.ndarray, idf: np.ndarray, targets: Targets, cosine: float):
    """(word, item, cosine) of the windows near an item that also have enough of its words."""
    windows = _windows(words, bucket)
    vectors, start, text = windows.sums(padded), windows.start, windows.text
    worth_of = np.append(idf, np.float32(0))  # BUCKETS stands for no word
    marks = targets.marks.ravel()
    for k in range(0, len(start), 4096):
        unit = _unit(vectors[k : k + 4096])
        places = start[k : k + 4096, None] + np.arange(2 * HALF)
        inside = places < words.first[1:][text[k : k + 4096]][:, None]
        here = np.where(inside, bucket[np.minimum(places, len(bucket) - 1)], BUCKETS)
        worth, here = worth_of[here], here % MARKS
        total = worth.sum(1)
        for c in range(0, len(targets.owner), 1024):
            near = unit @ targets.vectors[:, c : c + 1024]
            w, part = np.nonzero(near >= cosine)
            j = targets.owner[c + part]
            common = (marks[(j * MARKS)[:, None] + here[w]] * worth[w]).sum(1)
            both = common >= OVERLAP * np.minimum(total[w], targets.weight[j])
            yield from zip(start[k + w[both]].tolist(), j[both].tolist(), near[w[both], part[both]].tolist(), strict=True)


def _found(column: pa.Array, targets: Targets, padded: np.ndarray, idf: np.ndarray, cosine: float):
    """(row, item, first word, words, cosine, share in common, share of the answer) of the best place of each item in each text."""
    items = targets.items
    for row, _, words in W.slices_of_words(column, TEXT_SLICE):
        if not len(words.start):
            continue
        hashes = words.hashes()
        text = np.repeat(np.arange(len(words.first) - 1), words.counts())
        best: dict[tuple[int, int], tuple] = {}
        for n, known in targets.short.items():
            place, j = _met(W.windows_hashed(hashes, n), known)
            for at, item in zip(place.tolist(), j.tolist(), strict=True):
                t = int(text[at])
                if text[at + n - 1] == t:
                    best[t, item] = (1.0, 1.0, int(at - words.first[t]), n, 1.0)
        asked: dict[tuple[int, int], float] = {}
        for at, item, near in _near_places(words, _buckets(hashes), padded, idf, targets, cosine):
            asked[at, item] = max(near, asked.get((at, item), near))
        place, j = _met(W.windows_hashed(hashes, WIDTH), targets.runs)
        same = text[place] == text[np.minimum(place + WIDTH - 1, len(text) - 1)]
        place, j = place[same], j[same]
        place -= (place - words.first[text[place]]) % HALF  # the window in which the run begins
        for at, item in set(zip(place.tolist(), j.tolist(), strict=True)):
            asked.setdefault((at, item), 0.0)
        for (at, k), near in sorted(asked.items()):
            t, item = int(text[at]), items[k]
            a = max(words.first[t], at - len(item.words))
            b = min(words.first[t + 1], at + 2 * HALF + len(item.words))
            region = hashes[a:b].view(np.int64).tolist()
            share = item.common(region) / len(item.words)
            if share < PARAPHRASE:
                continue
            answer = len(item.answer.intersection(region)) / len(item.answer)
            if share >= COPY or answer >= ANSWER:
                now = (share, near, int(a - words.first[t]), int(b - a), answer)
                best[t, k] = max(best.get((t, k), now), now)
        for (t, k), (share, near, a, n, answer) in sorted(best.items()):
            yield row + t, k, a, n, near, share, answer


def _passes(docs, benchmark, text_col, item_col, item_text_col, answer_col, sample):
    """What each pass over the documents needs, broadcast: (targets, space, frequencies)."""
    rows = benchmark.where(F.col(item_text_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"), F.col(answer_col or item_text_col).alias("answer"))
    n = -(-rows.count() // BLOCK)
    idf = inverse_frequencies(docs, text_col)
    space = latent_space(docs, idf, text_col, sample) if n else None
    for k in range(n if space is not None else 0):
        items = _items(rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect(), bool(answer_col))
        if items:
            yield docs.sparkSession.sparkContext.broadcast((Targets(items, space, idf), space.astype(np.float16), idf))


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    answer_col: str | None = None, *, cosine: float = COSINE, sample: int | None = None,
) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, cosine, common_share, answer_share): the benchmark items found in documents."""
    schema = "doc_id long, item_id long, first_word long, n_words long, cosine double, common_share double, answer_share double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def search(shared):
        def run(batches):
            targets, half, idf = shared.value
            space = _weighed(half, np.ones(len(half), np.float32))
            for batch in batches:
                found = list(_found(batch.column(1), targets, space, idf, cosine))
                if found:
                    row, j, *rest = zip(*found, strict=True)
                    names = ("first_word", "n_words", "cosine", "common_share", "answer_share")
                    yield pa.record_batch({
                        "doc_id": batch.column(0).take(pa.array(row)), "item_id": pa.array([targets.items[k].item_id for k in j], pa.int64()),
                    } | {c: pa.array(v) for c, v in zip(names, rest, strict=True)})

        return run

    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _passes(docs, benchmark, text_col, item_col, item_text_col, answer_col, sample):
        out = out.unionByName(rows.mapInArrow(search(shared), schema))
    return out


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    answer_col: str | None = None, *, cosine: float = COSINE, sample: int | None = None,
) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns."""
    at, schema = [c.lower() for c in docs.columns].index(text_col.lower()), docs.schema

    def without(shared):
        def run(batches):
            targets, half, idf = shared.value
            space = _weighed(half, np.ones(len(half), np.float32))
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in _found(batch.column(at), targets, space, idf, cosine)]] = False
                yield batch.filter(pa.array(clean))

        return run

    left = docs
    for shared in _passes(docs, benchmark, text_col, item_col, item_text_col, answer_col, sample):
        left = left.mapInArrow(without(shared), schema)
    return left
