"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32: of three differing bits, one segment has at most
one. Each segment is indexed under its 32 variants with one bit left out, so that two segments a bit apart
meet under exactly one variant and equal ones meet under all; an equality join finds the candidates and
the number of differing bits verifies them.

Fingerprints, not documents, are joined: equal ones are grouped first. A bucket is first tied to its
smallest fingerprint (a linear number of pairs); only fingerprints of a bucket that are in different
components after that are compared with each other, cut once more by the bytes of the other segment, of which
one must agree. So no link that could change a component is missed, a large group of near copies does not
give all its pairs, and a crowded bucket is many small ones.

Defined results: null and blank texts have no shingles and the fingerprint zero, which links like any
other; a text of fewer words than a shingle is one shingle; a null id takes part, gets its group's
smallest id, and is null if the group has no other; repeated ids are rows of their own; an empty table
gives an empty result; other columns are left out. keep_one and keep_similar_once keep all columns and one
row of each group: that of the smallest id, null ids last; among rows of equal id and text, of the smallest
hash of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm import similar_sets
from sparloom.llm.common import by_shuffle, fresh_name, materialize, without_keys
from sparloom.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
SEGMENT_BITS = 32
#: Bytes of keys that one task makes of fingerprints.
KEY_BYTES = 64 << 20
#: Words of one text that are hashed at a time.
BLOCK = 1 << 15
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if over half the shingles' XXH64 have it."""
    import xxhash

    ws = text.translate(LOWER).split()
    n = max(1, len(ws) - size + 1) if ws else 0
    bits, digest, join = np.zeros(64, np.int64), xxhash.xxh64_digest, b" ".join
    for at in range(0, n, BLOCK):
        block = ws[at : at + BLOCK + size - 1]
        shingles = zip(*[block[k:] for k in range(size)], strict=False) if len(ws) >= size else [ws]
        raw = b"".join([digest(join(x), seed) for x in shingles])
        bits += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > n).tobytes(), "big", signed=True) if n else 0


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = pa.array((fingerprint(x.as_py() or b"", size, seed) for x in texts), pa.int64(), size=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _fingerprints(it, size, seed), f"doc_id {kind}, fp bigint")


def _variants() -> Column:
    """Keys of a fingerprint ``fp``: segment, bit left out, and the segment's other bits in one long."""
    low = (1 << SEGMENT_BITS) - 1
    keys = []
    for segment in (0, 1):
        part = F.col("fp").bitwiseAND(F.lit(low)) if segment == 0 else F.shiftrightunsigned("fp", SEGMENT_BITS)
        keys += [part.bitwiseAND(F.lit(low ^ (1 << bit))).bitwiseOR(F.lit((segment * SEGMENT_BITS + bit) << SEGMENT_BITS)) for bit in range(SEGMENT_BITS)]
    return F.array(*keys)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): each fingerprint ``a`` of the distinct column ``fp`` that is reached from a smaller one, with
    the smallest ``b`` of its component. Links: ``max_bits`` (at most 3) or fewer differing bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments find at most three differing bits")
    # a few bytes a fingerprint become 64 keys: as many tasks as keep each one's keys near KEY_BYTES
    fps = materialize(fps.select("fp"), "simhash-fps")
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() * 64 * 24 // KEY_BYTES + 1)
    keyed = fps.repartition(tasks).select("fp", F.explode(_variants()).alias("key"))
    shared = keyed.groupBy("key").agg(F.min("fp").alias("rep"), F.max("fp").alias("top")).filter("rep <> top").drop("top")
    met = materialize(keyed.join(by_shuffle(shared), "key"), "simhash-buckets")
    ties = met.filter((F.col("fp") != F.col("rep")) & (_apart("fp", "rep") <= max_bits)).select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    first = components(ties)
    labelled = met.select("key", "fp").join(first, F.col("fp") == F.col("a"), "left").select("key", "fp", F.coalesce("b", "fp").alias("c"))
    mixed = labelled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    rest = materialize(labelled.join(mixed, "key"), "simhash-rest")
    # three bits leave one of the four bytes of the other segment as it is: a crowded bucket is cut by these
    at = F.shiftright("key", SEGMENT_BITS).cast("int")
    other = lambda c: F.when(at < SEGMENT_BITS, F.shiftrightunsigned(c, SEGMENT_BITS)).otherwise(c.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))
    byte = lambda c, k: F.shiftright(c, 8 * k).bitwiseAND(F.lit(255))
    cut = rest.select("key", "fp", "c", other(F.col("fp")).alias("o")).select("key", "fp", "c", F.inline(F.array(*[F.struct(F.lit(k).alias("part"), byte(F.col("o"), k).alias("byte")) for k in range(SEGMENT_BITS // 8)])))
    left, right = cut.select("key", "part", "byte", F.col("fp").alias("x"), F.col("c").alias("cx")), cut.select("key", "part", "byte", F.col("fp").alias("y"), F.col("c").alias("cy"))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    segment = F.when(at < SEGMENT_BITS, differ.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).otherwise(F.shiftrightunsigned(differ, SEGMENT_BITS))
    earlier = reduce(lambda a, k: a | ((F.col("part") > k) & (byte(other(differ), k) == 0)), range(SEGMENT_BITS // 8 - 1), F.lit(False))
    meets_here = ((segment != 0) | (at % SEGMENT_BITS == 0)) & ~earlier
    more = left.join(by_shuffle(right), ["key", "part", "byte"]).filter((F.col("x") < F.col("y")) & (F.col("cx") != F.col("cy")) & (F.bit_count(differ) <= max_bits) & meets_here)
    second = components(more.select(F.col("cx").alias("a"), F.col("cy").alias("b")))
    moved = first.join(second.select(F.col("a").alias("b"), F.col("b").alias("root")), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    return moved.union(second.select("a", "b")).distinct()


def _roots(own: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first, root) of the fingerprints of rows (doc_id, fp): the smallest id, and one name a component."""
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = link(firsts.select("fp"), max_bits)
    return materialize(firsts.join(linked, F.col("fp") == F.col("a"), "left").select("fp", "first", F.coalesce("b", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; the component is named by its smallest id."""
    own = materialize(fingerprints(docs, id_col, text_col, size, seed), "simhash-docs")
    rooted = _roots(own, max_bits)
    named = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-names")
    classes = rooted.join(named, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _first_rows(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of ``found`` (key, doc_id, root): that of the smallest id, ids that
    are null last."""
    found = materialize(found.groupBy("root", "key").agg(F.count("*").alias("n"), F.first("doc_id").alias("doc_id")), "classes")
    firsts = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("first"))
    kept_key = fresh_name(docs, "_kept_key")
    told = materialize(found.join(firsts, "root").select("key", "n", (F.col("key") == F.col("first")).alias("kept")), "classes-told")
    gone = told.filter("n > 1 or not kept").select("key")
    once = materialize(told.filter("n > 1 and kept").select(F.col("key").alias(kept_key)), "classes-once")
    own = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    several = docs.join(once, F.col(f"`{key}`") == F.col(kept_key), "left_semi")
    one = several.groupBy(F.col(f"`{key}`").alias(kept_key)).agg(F.min_by(F.struct(*own), F.xxhash64(*plain)).alias("row")).select("row.*")
    return without_keys(docs, key, gone, "key").unionAll(one)


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text, and its name."""
    key = fresh_name(docs, "_row_key")
    return docs.withColumn(key, F.concat_ws("/", F.coalesce(F.concat(F.lit("+"), F.col(f"`{id_col}`").cast("string")), F.lit("-")), F.xxhash64(F.col(f"`{text_col}`")))), key


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group of linked fingerprints; all columns stay."""
    keyed, key = _with_key(docs, id_col, text_col)
    rows = keyed.select(F.struct(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("doc_id")).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    own = materialize(fingerprints(rows, size=size, seed=seed), "simhash-docs")
    found = own.join(_roots(own, max_bits), "fp").select("doc_id.key", "doc_id.doc_id", "root")
    return _first_rows(keyed, key, found).drop(key)


def proposed(docs: DataFrame, size: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(x_th, y_th): the hash of each text (th, text) whose fingerprint is linked with others, or equal to theirs, and
    the smallest hash among these."""
    own = materialize(fingerprints(docs, "th", "text", size), "simhash-docs")
    rooted = _roots(own, max_bits)
    named = rooted.groupBy("root").agg(F.min("first").alias("y_th"))
    return own.join(rooted, "fp").join(named, "root").select(F.col("doc_id").alias("x_th"), "y_th").filter("x_th <> y_th").distinct()


def keep_similar_once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = similar_sets.SHINGLE, similarity: float = similar_sets.SIMILARITY) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group that is linked by a Jaccard similarity of
    ``size``-word shingles of ``similarity`` or more; all columns stay. Linked fingerprints of these shingles are
    candidates, which an exact check follows; pairs at ``similarity`` may differ in any number of bits, so those that
    fingerprints do not propose come from the prefix filter."""
    keyed, key = _with_key(docs, id_col, text_col)
    rows = keyed.select(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    near = proposed(rows.select(F.xxhash64("text").alias("th"), "text"), size)
    return _first_rows(keyed, key, similar_sets.groups(rows, size, similarity, near=near)).drop(key)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
