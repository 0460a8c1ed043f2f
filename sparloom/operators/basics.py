"""Relational building blocks in which the order of the input counts: every one takes the order explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "_n") -> DataFrame:
    """The place of each row within its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key: min_by over the rows as structs, so it combines before the shuffle and a
    frequent key is no single sort. ``order`` must tell rows apart."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def flag_repeats(df: DataFrame, keys: list[str], order: list, name: str = "is_repeat") -> DataFrame:
    """Whether an earlier row has the same key. Each key's first row is found before the shuffle, so a frequent key
    is no single sort. ``order`` must tell rows apart."""
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.struct(*order)).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(first, same).withColumn(name, F.struct(*order) != F.col("_first")).drop("_first", *[f"_k{i}" for i in range(len(keys))])


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return numbered(df, keys, order, "rank").filter(F.col("rank") <= k)


def ranked_slice(df: DataFrame, keys: list[str], order: list, first: Column, count: int) -> DataFrame:
    """``count`` rows of each key after its own offset ``first``."""
    return numbered(df, keys, order).filter((F.col("_n") > first) & (F.col("_n") <= first + count)).drop("_n")


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, in order of the value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)


def count_where(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Per key, how many rows meet each named condition."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def frequencies(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """How often each value stands, and where first. A report orders them by -n, then first_seen
    (``ordered_report``)."""
    return items.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def summary_over(df: DataFrame, dimension: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """count_where for every row of a dimension, zero where it has none."""
    found = count_where(df, [key], **conditions)
    return dimension.join(found, key, "left").fillna(0, list(conditions))


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values by first appearance."""
    return df.groupBy(column).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def even_quotas(dimension: DataFrame, total: Column, order: str) -> DataFrame:
    """``total`` split evenly over the rows of a dimension; the first rows get the remainder."""
    size = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(order)) - 1
    return dimension.select("*", (F.floor(total / size) + F.when(place < total % size, 1).otherwise(0)).alias("quota"))


def round_robin(df: DataFrame, order: str, names: list[str]) -> DataFrame:
    """Categories in turn over the rows in order. Places come from counts of ranges of the order, so that no
    task sorts all rows."""
    placed = global_place(df, [F.col(order)])
    return placed.withColumn("category", F.element_at(F.array(*map(F.lit, names)), (F.col("_place") % len(names) + 1).cast("int"))).drop("_place")


def global_place(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with _place, from 0, in a total order: ranges are sorted apart and numbered as they are written, and counts
    of the ranges before (one row a partition) give each its start; rows are shuffled once. ``order`` must tell rows
    apart."""
    from sparloom.operators.shared import materialize

    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    starts = materialize(sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start")), "starts")
    return parts.withColumn("_part", part).join(starts, "_part").withColumn("_place", F.col("_start") + inside).drop("_part", "_at", "_start")


def without(df: DataFrame, done: DataFrame, key: str, limit: int = 0, order: str | None = None) -> DataFrame:
    """Rows whose key is not done yet; a limit of 0 is none."""
    left = df.join(done.select(key).distinct(), key, "left_anti")
    return left.orderBy(order or key).limit(limit) if limit else left


def reference_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def lookup(df: DataFrame, table: DataFrame, exact: list[str], fallback: list[str], value: str, order: str | None = None) -> DataFrame:
    """``value`` by the exact key, else by the fallback key (rows of the table with a blank first key). A key that
    stands in several rows of the table has the last one by ``order``, without it the largest value; rows of
    ``df`` are never multiplied."""
    one = F.max_by(value, order) if order else F.max(value)
    narrow = [c for c in exact if c not in fallback]
    by_exact = table.groupBy(*exact).agg(one.alias("_exact"))
    loose = table.filter(F.lit(True) if not narrow else F.col(narrow[0]) == "").groupBy(*fallback).agg(one.alias("_loose"))
    return df.join(by_exact, exact, "left").join(loose, fallback, "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")
