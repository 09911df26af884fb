"""N-gram Jaccard join: documents whose shingle sets overlap enough, exactly.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of
distinct word shingles. No pair is missed and no link is guessed:

* Documents with equal sets are one class; everything below runs on classes, so a
  text copied a million times is compared once.
* Shingles have one global order, rare ones first (by a fixed-size table of bucket
  counts over all documents; the order only affects speed). Linked sets share a
  shingle among the first ``|A| - ceil(t |A|) + 1`` of each, so only those are dealt out.
* Star pairs first: each shingle's holders are compared with one of them, which is
  linear in the holders; shingles differ in whom they pick, so that a group of near
  copies meets several. Linked classes are joined to components; a second turn picks
  others, where holders still are in different components.
* Then, only where holders of a shingle still are in different components: tiles of
  bounded blocks in one size band, whose members meet with hashed bitmaps. Shingles
  that span the same components are one set of tiles, so that a pair meets once. A bit set
  in A and not in B stands for a shingle of A that B lacks, so bit counts bound the
  overlap from above; pairs that pass are intersected as sorted arrays.

Null, empty and blank texts have empty sets, which link with nothing; a text shorter
than a shingle is one shingle. Null ids count as larger than any id; a component of
null ids alone has a null component_id. Repeated rows and repeated ids give one row
each. Further columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import words as W
from shelfmark.llm.filters import key_filter, may_hold
from shelfmark.llm.graph import components
from shelfmark.llm.tables import materialise

PERCENT = 75
#: Counters of the order table; members of a block within a tile; bits of the candidate filter.
BUCKETS, BLOCK, FILTER_BITS = 1 << 16, 512, 1 << 24
#: Different holders that one group of near copies is compared with, by shingle.
PIVOTS = 8


def _class_of(shingles: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        total = W.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
        return W.mix(np.array([total ^ np.bitwise_xor.reduce(W.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64))[0]


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every row."""
    for row, stop, words in W.slices_of_words(batch.column("text")):
        hashes = words.hashes()
        windows = W.windows_hashed(hashes, width)
        for i in range(stop - row):
            yield row + i, W.shingle_set(hashes, windows, words.first[i], words.first[i + 1], width)


def _describe(width: int):
    def run(batches):
        counters = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            sizes, classes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64)
            for i, shingles in _sets(batch, width):
                sizes[i] = len(shingles)
                if len(shingles):
                    classes[i] = _class_of(shingles)
                    counters += np.bincount((shingles & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "text_key": batch.column("text_key"), "n": pa.array(sizes),
                "class": pa.array(W.signed(classes), mask=sizes == 0), "counters": pa.nulls(batch.num_rows, pa.list_(pa.int64())),
            })
        none = pa.nulls(1, pa.int64())
        yield pa.record_batch({"doc_id": none, "text_key": none, "n": pa.array([-1]), "class": none, "counters": pa.array([counters], pa.list_(pa.int64()))})

    return run


def _bits(n: int) -> int:
    """Bits of a set's bitmap: four to eight a shingle, so that few differences hide behind shared bits."""
    return max(256, 4 << max(0, n - 1).bit_length())


def _bitmap(shingles: np.ndarray) -> bytes:
    bits = _bits(len(shingles))
    flags = np.zeros(bits, bool)
    flags[(shingles >> np.uint64(16)) & np.uint64(bits - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A bitmap brought down to ``size`` bytes."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] | bitmap[half:]
    return bitmap


def _prefixes(width: int, percent: int, counts: np.ndarray):
    def run(batches):
        for batch in batches:
            classes, sizes, tokens, bitmaps = [], [], [], []
            for _, shingles in _sets(batch, width):
                n = len(shingles)
                if n:
                    order = np.lexsort((shingles, counts[(shingles & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                    classes.append(_class_of(shingles))
                    sizes.append(n)
                    tokens.append(shingles[order[: n - -(-percent * n // 100) + 1]])
                    bitmaps.append(_bitmap(shingles))
            if sizes:
                yield pa.record_batch({
                    "class": pa.array(W.signed(np.array(classes, np.uint64))), "n": pa.array(sizes, pa.int64()),
                    "tokens": W.list_array(W.signed(np.concatenate(tokens)), np.array([len(t) for t in tokens]), pa.int64()),
                    "bitmap": pa.array(bitmaps, pa.binary()),
                })

    return run


def _thinned(several):
    """The postings of the shingles that the filter may hold."""

    def run(batches):
        table = several.value
        for batch in batches:
            lists = batch.column(1)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            keep = may_hold(table, tokens)
            classes = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            yield pa.record_batch({"class": pa.array(classes[keep]), "token": pa.array(tokens[keep])})

    return run


def _enough(common, n_a, n_b, percent: int):
    return common * (100 + percent) >= percent * (n_a + n_b)


def _may_link(percent: int):
    """Pairs with two bitmaps, to the pairs whose bit counts allow a link."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            for i, (a, b) in enumerate(zip(batch.column("bitmap_a"), batch.column("bitmap_b"), strict=True)):
                x, y = np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)
                x, y = _folded(x, len(y)), _folded(y, len(x))
                both = x & y
                bound = min(n_a[i] - int(np.bitwise_count(x ^ both).sum()), n_b[i] - int(np.bitwise_count(y ^ both).sum()))
                keep[i] = _enough(bound, n_a[i], n_b[i], percent)
            yield pa.record_batch({c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")})

    return run


def _tile_pairs(percent: int):
    """Members sorted by tile, to the pairs within tiles whose bit counts allow a link."""

    def pairs(of: dict[str, np.ndarray], bitmaps: list[np.ndarray]):
        size = min(len(x) for x in bitmaps)
        bits = np.stack([_folded(x, size) for x in bitmaps]).view(np.uint64)
        n, role, side, comp, ids = of["n"], of["small"], of["side"], of["comp"], of["class"]
        for i in range(len(n) - 1):
            rest = slice(i + 1, None)
            both = bits[i] & bits[rest]
            bound = np.minimum(
                n[i] - np.bitwise_count(bits[i] ^ both).sum(1).astype(np.int64), n[rest] - np.bitwise_count(bits[rest] ^ both).sum(1).astype(np.int64)
            )
            ok = _enough(bound, n[i], n[rest], percent) & (comp[rest] != comp[i]) & ~(role[i] & role[rest])
            ok &= (side[i] == 2) | (side[rest] != side[i])
            for j in np.flatnonzero(ok) + i + 1:
                yield min(ids[i], ids[j]), max(ids[i], ids[j])

    def run(batches):
        held = None
        for batch in _with_end(batches):
            now = pa.Table.from_batches([x for x in (held, batch) if x is not None]).combine_chunks() if (held is not None or batch is not None) else None
            if now is None or not now.num_rows:
                continue
            tiles = now["tile"].to_numpy()
            cuts = np.flatnonzero(np.diff(tiles)) + 1
            if batch is not None:  # the last tile may go on in the next batch
                whole = int(cuts[-1]) if len(cuts) else 0
                held = now.slice(whole).combine_chunks().to_batches()[0]
                now, cuts = now.slice(0, whole), cuts[:-1]
            bounds = [0, *cuts.tolist(), now.num_rows]
            of = {c: now[c].to_numpy() for c in ("class", "n", "small", "side", "comp")}
            maps = [np.frombuffer(x.as_buffer(), np.uint8) for x in now["bitmap"]]
            found = {
                pair for lo, hi in zip(bounds, bounds[1:], strict=False) if hi - lo > 1
                for pair in pairs({c: v[lo:hi] for c, v in of.items()}, maps[lo:hi])
            }
            if found:
                a, b = zip(*found, strict=True)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with_end(batches):
    yield from batches
    yield None


def _arrays(width: int, wanted: np.ndarray):
    """The whole sets of the classes whose bit is set in ``wanted``."""

    def run(batches):
        for batch in batches:
            classes, sets = [], []
            for _, shingles in _sets(batch, width):
                if len(shingles):
                    key = _class_of(shingles)
                    bit = int(key) % FILTER_BITS
                    if wanted[bit >> 3] >> (bit & 7) & 1:
                        classes.append(key)
                        sets.append(shingles)
            if sets:
                yield pa.record_batch({
                    "class": pa.array(W.signed(np.array(classes, np.uint64))),
                    "shingles": W.list_array(W.signed(np.concatenate(sets)), np.array([len(s) for s in sets]), pa.int64()),
                })

    return run


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("shingles_a"), batch.column("shingles_b")
            for i in range(batch.num_rows):
                x, y = (c[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (left, right))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep[i] = _enough(common, len(x), len(y), percent)
            yield pa.record_batch({c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")})

    return run


def _pivot(value: Column, token: Column, turn: int) -> Column:
    """A class to its rank among a shingle's holders, and back; one of PIVOTS orders, by the shingle."""
    return value.bitwiseXOR(F.xxhash64(F.pmod(token, F.lit(PIVOTS)), F.lit(turn)))


def _filter_of(pairs: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with the classes of ``pairs``, made by Spark."""
    bit = F.pmod(F.col("class"), F.lit(FILTER_BITS))
    words = (
        pairs.select(F.explode(F.array("a", "b")).alias("class"))
        .groupBy(F.floor(bit / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int"))).alias("bits"))
    )
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for row in words.collect():  # at most FILTER_BITS / 32 rows
        out[row["word"]] = row["bits"]
    return out.view(np.uint8)


def _verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that truly link."""
    sets = docs.select("text").mapInArrow(_arrays(width, _filter_of(pairs)), "class long, shingles array<long>")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = materialise(sets.join(ends, "class", "left_semi").dropDuplicates(["class"]))
    joined = pairs.join(sets.toDF("a", "shingles_a"), "a").join(sets.toDF("b", "shingles_b"), "b")
    return materialise(joined.mapInArrow(_linked(percent), "a long, b long"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = W.SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, text_key, n_shingles, class, component, component_id), one row per document.

    ``class`` names equal sets and ``component`` linked classes (null for empty sets);
    ``component_id`` is the least id in the component, or the document's own if it is
    alone; ``text_key`` is a hash of the text, which tells apart rows with one id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = materialise(
        docs.withColumn("text_key", F.xxhash64("text"))
        .mapInArrow(_describe(width), "doc_id long, text_key long, n long, class long, counters array<long>")
    )
    counts = np.zeros(BUCKETS, np.int64)
    for row in described.where("n < 0").select(F.posexplode("counters").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).collect():
        counts[row["k"]] = row["c"]  # BUCKETS rows, whatever the input
    rows = described.where("n >= 0").drop("counters")

    prefixes = docs.select("text").mapInArrow(_prefixes(width, percent, counts), "class long, n long, tokens array<long>, bitmap binary")
    sets = materialise(prefixes.groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "bitmap"))))
    # most shingles have one holder: the others are found by two numbers each, and only their postings go on
    spans = sets.select("class", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    several = docs.sparkSession.sparkContext.broadcast(key_filter(materialise(spans.where("lo < hi").select("token"))))
    postings = materialise(sets.select("class", "tokens").mapInArrow(_thinned(several), "class long, token long"))
    several.destroy()
    pivot = _pivot(F.col("class"), F.col("token"), 0)
    shared = materialise(postings.groupBy("token").agg(
        F.count("*").alias("holders"), F.min(pivot).alias("pivot"), F.min("class").alias("x"), F.max("class").alias("y")).where("holders > 1"))
    members = materialise(postings.join(shared.where("holders > 2").select("token", "pivot"), "token"))
    maps = sets.select("class", "n", "bitmap")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        sizes = maps.select("class", "n")
        sized = materialise(pairs).join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
        sized = materialise(sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent))
        bitmaps = maps.select("class", "bitmap")
        sized = sized.join(bitmaps.toDF("a", "bitmap_a"), "a").join(bitmaps.toDF("b", "bitmap_b"), "b")
        return _verified(docs, materialise(sized.mapInArrow(_may_link(percent), "a long, b long")), width, percent)

    def placed(roots: DataFrame) -> DataFrame:
        """The holders of the shingles whose holders are in different components."""
        named = members.select("token", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").select(
            "token", "class", F.coalesce("root", "class").alias("comp"))
        mixed = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
        return materialise(named.join(mixed, "token"))

    first = members.select(_pivot(F.col("pivot"), F.col("token"), 0).alias("x"), F.col("class").alias("y"))
    links = linked(first.unionByName(shared.where("holders = 2").select("x", "y")))
    apart = placed(components(links))
    # once more with other pivots, across components
    own = _pivot(F.col("class"), F.col("token"), 1)
    again = apart.join(apart.groupBy("token").agg(F.min(own).alias("pivot")), "token")
    again = again.select("token", "comp", _pivot(F.col("pivot"), F.col("token"), 1).alias("x"), F.col("class").alias("y"))
    other = again.select(F.col("x").alias("class"), "token").distinct().join(apart, ["class", "token"]).select("token", F.col("comp").alias("other"))
    links = links.unionByName(linked(again.join(other, "token").where("comp <> other")))
    roots = components(links)

    # what the stars left apart: shingles whose holders span the same components are one group
    apart = materialise(placed(roots).select("lo", "hi", "class", "comp").distinct())
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    blocks = apart.groupBy("lo", "hi").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed_in = (
        apart.join(blocks, ["lo", "hi"]).join(maps.select("class", "n"), "class")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("small", F.explode(F.array(F.lit(False), F.lit(True))))
        .select(
            F.xxhash64("lo", "hi", band + F.col("small").cast("int"), F.least("block", "other"), F.greatest("block", "other")).alias("tile"),
            "class", "n", "comp", "small",
            F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    # bitmaps travel only to tiles in which two components meet, one of them in the band itself
    placed_in = materialise(placed_in)
    meet = placed_in.groupBy("tile").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.bool_and("small").alias("none"))
    dealt = placed_in.join(materialise(meet.where("first < last and not none").select("tile")), "tile", "left_semi").join(maps.select("class", "bitmap"), "class")
    late = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_pairs(percent), "a long, b long")
    late = materialise(late.distinct())
    if not late.isEmpty():
        roots = components(links.unionByName(_verified(docs, late, width, percent)))

    named = rows.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("component", F.coalesce("root", "class"))
    named = materialise(named.select("doc_id", "text_key", "n", "class", "component"))
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "class", "component",
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, one of each component: the least id, then the least hash of the text.

    Repeated rows of the one that stays are one row. Documents with empty sets all
    stay. All columns are kept, and the order of columns.
    """
    found = materialise(jaccard_components(docs, id_col, text_col, **options).where("component is not null"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))
    first = found.groupBy("component").agg(F.min(rank).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    grouped = materialise(
        found.join(first, "component").groupBy("doc_id", "text_key")
        .agg(F.max(rank == F.col("first")).alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1")
    ).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("stays").alias("__stays"))
    keyed = docs.withColumn("__text_key", F.xxhash64(text_col))
    # most documents are in no group: a bitmap of fixed size tells which ones need to be looked up
    bit = lambda doc_id, key: F.pmod(F.xxhash64(doc_id, key), F.lit(FILTER_BITS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("__bit") % 32).cast("int"))
    bits = (
        grouped.withColumn("__bit", bit("__id", "__key")).groupBy(F.floor(F.col("__bit") / 32).alias("__word")).agg(F.bit_or(mask).alias("__bits"))
    )
    looked_at = keyed.withColumn("__bit", bit(F.col(id_col).cast("long"), F.col("__text_key"))).withColumn("__of", F.floor(F.col("__bit") / 32))
    looked_at = looked_at.join(F.broadcast(materialise(bits)), F.col("__of") == F.col("__word"), "left")  # at most FILTER_BITS / 32 rows
    marked = F.coalesce(F.col("__bits").bitwiseAND(mask) != 0, F.lit(False))
    suspects = looked_at.where(marked).select(*docs.columns, "__text_key")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    alone = suspects.join(grouped, same, "left_anti")
    repeated = suspects.join(grouped.where("__stays"), same, "left_semi").dropDuplicates([id_col, "__text_key"])
    return looked_at.where(~marked).select(*docs.columns).unionByName(alone.unionByName(repeated).drop("__text_key"))
