"""Near-duplicates by the exact Jaccard similarity of word shingles.

The shingles of a text are put in one global order. Texts of similarity t share one of their first
n - ceil(t * n) + 1 shingles (prefix filter), so an equality join on these finds every pair; no fingerprint
distance does, as a pair at 0.8 may be any number of bits apart. The order decides how long buckets are, not what
is found: first a share CHOSEN of all shingles, by hash, rarest first; then the others by hash; last those that a
sample shows to be common. Three in ten are more than a prefix holds, so a text's prefix is as a rule its rarest
chosen shingles, whose exact number of texts comes out of one shuffle: a passage that many texts share gives no
long bucket at any size of the corpus, and shingles of one text only give no key at all.

Candidates must be near enough in size and in the parities of their shingles' counts by slot, which differ in
no more slots than the sets in shingles (bitmap filter), first in few slots, then in about as many as there are
shingles; what is left is verified on the whole texts, and only these are shuffled. Sets, not documents, are
joined: equal ones are one. A bucket is first tied to its set with the fewest shingles of its own; only those in different
components after that are compared with each other.

Shingles are compared by 64-bit hashes. Defined results: texts without words have the empty set and are one
group; a text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparloom.llm import tokens
from sparloom.llm.common import by_shuffle, hashed_share, materialize, with_keys
from sparloom.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Texts that tell which shingles are common, in how many of them one must stand, and how many are told, at most.
SAMPLE, COMMON, TOLD = 4_000, 5, 100_000
#: Of 1024, the shingles whose texts are counted.
CHOSEN = 307
SLOTS = 512
_STEP = 0xD1342543DE82EF95


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text's word hashes, ascending."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = tokens.mix(total * np.uint64(_STEP) + words[k : len(words) - size + 1 + k])
    return np.unique(total)


def _each(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for rows, offsets, hashes in tokens.rows_of(texts, tokens.SPACE):
        for k, row in enumerate(rows):
            yield int(row), shingles(hashes[offsets[k] : offsets[k + 1]], size)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) for v in values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def _listed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(_each(batch.column("text"), size))
        yield pa.RecordBatch.from_arrays([_lists([s.view(np.int64) for _, s in found])], names=["shingles"])


def _verified(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (_each(batch.column(c), size) for c in ("x_text", "y_text"))
        near = []
        for (row, s), (_, t) in zip(a, b, strict=True):
            shared = len(np.intersect1d(s, t, assume_unique=True))
            if shared >= similarity * (len(s) + len(t) - shared) - 1e-9:
                near.append(row)
        yield batch.select(["x", "y"]).take(pa.array(near, pa.int64()))


def _odd(s: np.ndarray, slots: int) -> np.ndarray:
    """The parities of the shingles' counts in a power of two of slots."""
    return np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1


def _packed(odd: np.ndarray) -> np.ndarray:
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _described(batches: Iterator[pa.RecordBatch], size: int, similarity: float, common: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        rows, names, sizes, needs, prefixes, slots, wide, half = [], [], [], [], [], [], [], []
        for row, s in _each(batch.column("text"), size):
            often = np.zeros(len(s), np.int64)
            if len(common) and len(s):
                at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                often = np.where(common[at] == s, counts[at], 0)
            n = len(s)
            length = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
            odd = _odd(s, 1 << (n - 1).bit_length()) if n > SLOTS else np.zeros(0, np.int64)
            folded = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
            rows.append(row)
            names.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
            rank = np.where(often > 0, 2, ((s >> np.uint64(40)) & np.uint64(1023)) >= CHOSEN)
            sizes.append(n)
            needs.append(length)
            prefixes.append(s[np.lexsort((s, often, rank))[: max(length, int((rank == 0).sum()))]].view(np.int64))
            slots.append(_packed(_odd(s, SLOTS)))
            wide.append(_packed(odd))
            half.append(_packed(folded))
        own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("key", "doc_id", "th")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), _lists(prefixes), _lists(slots), _lists(wide), _lists(half)], names=["key", "doc_id", "th", "set", "n", "need", "prefix", "slots", "wide", "half"])


def common_shingles(docs: DataFrame, size: int = SHINGLE, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and counts) of shingles that stand in several of at most ``sample`` distinct texts."""
    texts = docs.filter(hashed_share(F.col("th"), 0.9 * sample / max(1, docs.count()))).select("th", "text").dropDuplicates(["th"]).limit(sample).select("text")
    counted = texts.mapInArrow(lambda it: _listed(it, size), "shingles array<bigint>").select(F.explode("shingles").alias("s")).groupBy("s").count()
    found = counted.filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "s").limit(TOLD).toArrow()
    hashes, counts = (found.column(c).to_numpy() for c in ("s", "count"))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order]


def _room(similarity: float) -> Column:
    """How many shingles x and y may differ in at most, given their sizes."""
    return (F.col("x_n") + F.col("y_n")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-9


def _possible(similarity: float) -> Column:
    """Whether sizes and slots leave room for the similarity of x and y."""
    apart = sum((F.bit_count(F.get("x_slots", F.lit(k)).bitwiseXOR(F.get("y_slots", F.lit(k)))) for k in range(SLOTS // 64)), F.lit(0))
    near = F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * F.lit(similarity) - 1e-9
    return near & (apart <= _room(similarity))


def _possible_in_wide(similarity: float) -> Column:
    """The same in the wide slots of large sets: of x and y as many, or the larger one's folded in half."""
    bits = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)
    x, y = F.size("x_wide"), F.size("y_wide")
    apart = F.when((x == 0) | (y == 0), 0).when(x == y, bits("x_wide", "y_wide")).when(x == 2 * y, bits("x_half", "y_wide")).when(y == 2 * x, bits("x_wide", "y_half")).otherwise(0)
    return apart <= _room(similarity)


def texts_of(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(th, text), once each, of the texts of pairs (x_th, y_th); of the rows (th, text) only these are shuffled."""
    wanted = materialize(pairs.select(F.col("x_th").alias("wanted")).union(pairs.select("y_th")).distinct(), "sets-wanted")
    return materialize(with_keys(own.select("th", "text"), "th", wanted, "wanted").groupBy("th").agg(F.first("text").alias("text")), "sets-texts")


def links_by_texts(pairs: DataFrame, own: DataFrame, size: int, similarity: float) -> DataFrame:
    """(x, y) of the pairs (x, y, x_th, y_th, x_n, y_n) that are similar enough, from both texts side by side."""
    texts = texts_of(pairs, own)
    side = lambda name: by_shuffle(texts.select(F.col("th").alias(f"{name}_th"), F.col("text").alias(f"{name}_text")))
    both = pairs.join(side("x"), "x_th").join(side("y"), "y_th")
    return both.select("x", "y", "x_text", "y_text").mapInArrow(lambda it: _verified(it, size, similarity), "x bigint, y bigint")


def groups(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, links: Callable[[DataFrame, DataFrame, int, float], DataFrame] = links_by_texts, near: DataFrame | None = None) -> DataFrame:
    """(key, doc_id, n, root) of every row of (key, doc_id, text): the size of its set, and one root a group of
    near-duplicates. ``links`` verifies candidates; ``near``: pairs (x_th, y_th) of XXH64 of texts that are candidates
    beside those of the buckets. Sets that are in no bucket with others are near to none."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity lies above 0 and is 1 at most")
    own = docs.select("key", "doc_id", F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    common, counts = common_shingles(own, size)
    kinds = {c: own.schema[c].dataType.simpleString() for c in ("key", "doc_id")}
    rows = materialize(own.mapInArrow(lambda it: _described(it, size, similarity, common, counts), f"key {kinds['key']}, doc_id {kinds['doc_id']}, th bigint, set bigint, n int, need int, prefix array<bigint>, slots array<bigint>, wide array<bigint>, half array<bigint>"), "sets")
    keyed = rows.select("set", F.explode("prefix").alias("at"))
    # copies of a set stand side by side in its buckets; what is left are the texts of a shingle, where there are several
    bucket = Window.partitionBy("at")
    once = keyed.withColumn("first", F.coalesce(F.lag("set").over(bucket.orderBy("set")) != F.col("set"), F.lit(True)))
    shared = once.withColumn("m", F.count_if("first").over(bucket)).filter("first and m > 1").select("set", "at", "m")
    # of these, the rarest that a set's prefix has room for beside the shingles that are its own alone
    whole = Window.partitionBy("set")
    alone = F.col("given") - F.count("*").over(whole)
    sizes = rows.select("set", "need", F.size("prefix").alias("given")).dropDuplicates(["set"])
    placed = shared.join(sizes, "set").withColumns({"alone": alone, "place": F.row_number().over(whole.orderBy("m", "at"))})
    # a bucket is tied to the set with the smallest share of shingles of its own, which is nearest to the most others
    ends = placed.filter("place <= need - alone").select("set", "at", F.struct((F.col("alone") / F.col("given")).alias("share"), "set").alias("r")).withColumns({"rep": F.min("r").over(bucket)["set"], "low": F.min("set").over(bucket), "top": F.max("set").over(bucket)})
    met = materialize(ends.filter("low <> top").select("set", "at", "rep"), "sets-met")
    known = materialize(rows.select("set", "n", "slots", "wide", "half", "th").join(met.select("set").distinct(), "set", "left_semi").groupBy("set").agg(F.min("th").alias("th"), *[F.first(c).alias(c) for c in ("n", "slots", "wide", "half")]), "sets-known")

    def side(name: str, *columns: str) -> DataFrame:
        return known.select(F.col("set").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) of sets that are similar enough."""
        pairs = pairs.select("x", "y").distinct().join(side("x", "n", "wide", "half", "th"), "x").join(side("y", "n", "wide", "half", "th"), "y")
        pairs = materialize(pairs.filter(_possible_in_wide(similarity)).select("x", "y", "x_th", "y_th", "x_n", "y_n"), "sets-pairs")
        return materialize(links(pairs, own, size, similarity).select("x", "y"), "sets-links")

    ties = met.filter("set <> rep").select(F.col("set").alias("x"), F.col("rep").alias("y"))
    if near is not None:
        of_text = rows.select("th", "set").distinct()
        named = lambda c: of_text.select(F.col("th").alias(f"{c}_th"), F.col("set").alias(c))
        ties = ties.union(near.join(named("x"), "x_th").join(named("y"), "y_th").filter("x <> y").select("x", "y"))
    ties = ties.distinct()
    first = components(verified(ties.join(side("x", "n", "slots"), "x").join(side("y", "n", "slots"), "y").filter(_possible(similarity))).select(F.col("x").alias("a"), F.col("y").alias("b")))
    labelled = met.select("at", "set").join(first, F.col("set") == F.col("a"), "left").select("at", "set", F.coalesce("b", "set").alias("c"))
    mixed = labelled.groupBy("at").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("at")
    rest = materialize(labelled.join(mixed, "at").join(known.select("set", "n", "slots"), "set"), "sets-rest")
    half = lambda name: rest.select("at", *[F.col(c).alias(a) for c, a in (("set", name), ("c", f"{name}_c"), ("n", f"{name}_n"), ("slots", f"{name}_slots"))])
    more = half("x").join(by_shuffle(half("y")), "at").filter("x < y and x_c <> y_c").filter(_possible(similarity))
    root = lambda name: labelled.select(F.col("set").alias(name), F.col("c").alias(f"{name}_c")).distinct()
    met_later = verified(more).join(root("x"), "x").join(root("y"), "y")
    second = components(met_later.select(F.col("x_c").alias("a"), F.col("y_c").alias("b")))
    moved = first.join(second.select(F.col("a").alias("b"), F.col("b").alias("root")), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    linked = moved.union(second.select("a", "b")).distinct()
    return rows.select("key", "doc_id", "set", "n").join(linked, F.col("set") == F.col("a"), "left").select("key", "doc_id", "n", F.coalesce("b", "set").alias("root"))
