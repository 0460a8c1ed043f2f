"""Exact and near duplicates of hashes, and groups of one signature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.functions.similarity import differing_bits
from sparloom.operators.basics import global_place

BITS, MAX_DISTANCE = 64, 5


def exact_groups(df: DataFrame, hash_col: str, order: str) -> DataFrame:
    """Rows of hashes that several rows have, with group_size and group_first (the first row's order), which
    names the group. One aggregate and a join back; a common hash is no single sort."""
    groups = df.groupBy(hash_col).agg(F.count("*").alias("group_size"), F.min(order).alias("group_first")).filter("group_size > 1")
    return df.join(groups, hash_col)


def group_numbers(groups: DataFrame) -> DataFrame:
    """Dense numbers of groups by first appearance, one row a group, placed by ranges."""
    return global_place(groups.select("group_first").distinct(), [F.col("group_first")]).select("group_first", (F.col("_place") + 1).alias("group_id"))


def _segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments of a hash, of which one differs by at most one bit if the hash differs by
    ``distance`` bits."""
    n = distance // 2 + 1
    edges = [round(k * BITS / n) for k in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def near_pairs(df: DataFrame, id_col: str, hash_col: str, distance: int = MAX_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): each row with the first id of its hash; pairs of first ids whose hashes differ by
    ``distance`` bits or fewer.

    Multi-index hashing: hashes are indexed by segments of 21 or 22 bits (for five bits), and each looks up its own
    segments and all that are one bit away; of three segments, one is within that. So a bucket holds about one
    hash in two million, and a pair comes out once: where the smaller id looks it up, at the first segment that is
    near enough."""
    members = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("hash"))
    first = members.groupBy("hash").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    cut = _segments(distance)
    part = lambda h, lo, n: F.shiftrightunsigned(h, lo).bitwiseAND(F.lit((1 << n) - 1 if n < BITS else -1))
    own = F.array(*[F.struct(F.lit(k).alias("segment"), part(F.col("hash"), lo, n).alias("part")) for k, (lo, n) in enumerate(cut)])
    bit = lambda i: F.lit((1 << i) - (1 << BITS if i == BITS - 1 else 0)).cast("long")
    near = F.array(*[F.struct(F.lit(k).alias("segment"), part(F.col("hash"), lo, n).bitwiseXOR(flip).alias("part")) for k, (lo, n) in enumerate(cut) for flip in (F.lit(0).cast("long"), *(bit(i) for i in range(n)))])
    index = first.select(F.col("class_id").alias("b"), F.col("hash").alias("y"), F.inline(own))
    asked = first.select(F.col("class_id").alias("a"), F.col("hash").alias("x"), F.inline(near))
    differ = F.col("x").bitwiseXOR(F.col("y"))
    earlier = F.lit(False)
    for k, (lo, n) in enumerate(cut[:-1]):
        earlier = earlier | ((F.col("segment") > k) & (F.bit_count(part(differ, lo, n)) <= 1))
    met = asked.join(index, ["segment", "part"]).filter(F.col("a") < F.col("b"))
    pairs = met.filter((differing_bits(F.col("x"), F.col("y")) <= distance) & ~earlier)
    return members.join(first, "hash").select("id", "hash", "class_id", "class_size"), pairs.select("a", "b", differing_bits(F.col("x"), F.col("y")).cast("int").alias("hamming_distance"))


def report_pairs(pairs: DataFrame, limit: int = 5000) -> DataFrame:
    """The first pairs in order, with whether there are more."""
    total = pairs.count()
    return pairs.orderBy("a", "b").limit(limit).withColumn("truncated", F.lit(total > limit))


def signature_groups(df: DataFrame, kind: str, signature: str, id_col: str, order: str, shown: int = 50, width: int = 0) -> DataFrame:
    """(signature_type, signature, sample_count, sample_ids) of signatures with several rows, largest first. The
    ids shown are the first ``shown``, taken by rank, not out of a list of all."""
    filled = df.filter(F.col(signature) != "")
    counts = filled.groupBy(signature).agg(F.count("*").alias("sample_count")).filter("sample_count > 1")
    ranked = filled.join(counts, signature).withColumn("_n", F.row_number().over(Window.partitionBy(signature).orderBy(order))).filter(F.col("_n") <= shown)
    lists = ranked.groupBy(signature, "sample_count").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(id_col).cast("string").alias("i")))), lambda x: x["i"]), " ").alias("sample_ids"))
    text = F.substring(signature, 1, width) if width else F.col(signature)
    return lists.orderBy(F.desc("sample_count"), signature).select(F.lit(kind).alias("signature_type"), text.alias("signature"), "sample_count", "sample_ids")


def ids_in_sources(df: DataFrame, raw_id: str, source: str) -> DataFrame:
    """Raw ids that several rows have, with the sources in order."""
    return df.groupBy(raw_id).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources")).filter("n > 1")
