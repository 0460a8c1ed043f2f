"""Curation of posts: the cascade of rejections, keep-first acceptance over several keys, quotas of new rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions.tags import character_signature, has_any, hits, literals, single_subject, tag_set
from sparloom.functions.text import first_filled
from sparloom.operators.graph import components
from sparloom.operators.shared import materialize


def _listed(prefix: str, found: Column) -> Column:
    return F.when(F.size(found) > 0, F.concat(F.lit(prefix), F.array_join(found, ",")))


def cascade(posts: DataFrame) -> DataFrame:
    """Posts (id, tags, rating, sample_width, sample_height, width, height, source, crawl_label, raw_tags) with
    ``signature`` and ``reason``: the first of the gates that need no memory which they fail, else
    prefilter_pass with the features that mark a character. Repeats are for accept_first."""
    posts = posts.withColumns({"_tags": tag_set(F.col("tags")), "_raw": tag_set(F.col("raw_tags"))})
    tags, raw = F.col("_tags"), F.col("_raw")
    label = F.coalesce("crawl_label", F.lit(""))
    asks_art = F.contains(label, F.lit("official_full_body")) | F.array_contains(raw, "official_art")
    loose = F.contains(label, F.lit("official_full_body")) | F.contains(label, F.lit("full_body_")) | (F.array_contains(raw, "official_art") & F.array_contains(raw, "full_body"))
    size = lambda c: F.coalesce(first_filled(F.col(f"sample_{c}"), F.col(c)).try_cast("int"), F.lit(0))
    wanted = F.filter(raw, lambda t: ~F.startswith(t, F.lit("-")) & ~F.startswith(t, F.lit("rating:")) & ~t.isin("solo", "full_body", "multiple_views", "official_art", "1girl", "1boy", *V.SHEET_TAGS))
    has = lambda t: F.array_contains(tags, t)
    early = F.coalesce(
        F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", "duplicate_post_id"),
        F.when(F.lower(F.coalesce("rating", F.lit(""))) != "safe", "not_safe"),
        F.when(loose & ~has("full_body"), "missing_full_body"),
        F.when(loose & asks_art & ~has("official_art"), "missing_official_art"),
        F.when(~loose & ~has_any(tags, V.SHEET_TAGS), "missing_sheet_tag"),
        F.when(~loose, _listed("missing_required_tags:", F.array_sort(F.array_except(literals(V.REQUIRED_TAGS), tags)))),
        F.when(~single_subject(tags), "not_single_human_subject"),
        _listed("negative_tags:", hits(tags, V.NEGATIVE_TAGS)),
        _listed("non_human_tags:", hits(tags, V.NON_HUMAN_TAGS)),
        _listed("partial_view_tags:", hits(tags, V.PARTIAL_VIEW_TAGS)),
        F.when((size("width") < V.MIN_PIXELS) | (size("height") < V.MIN_PIXELS), "too_small"),
    )
    late = F.coalesce(
        F.when(~loose & ~has_any(tags, ("official_art", "turnaround", "character_sheet")), "weak_sheet_signal"),
        F.when((F.size(wanted) > 0) & ~F.arrays_overlap(tags, wanted), "missing_positive_series_tag"),
    )
    features = hits(tags, V.SIGNATURE_FEATURES)
    passed = F.when(F.size(features) > 0, F.concat(F.lit("prefilter_pass;signature_features:"), F.array_join(features, ","))).otherwise("prefilter_pass")
    d = posts.withColumns({"_early": early, "_late": late, "_passed": passed})
    signature = F.when(F.col("_early").isNull(), character_signature(tags, F.col("source"), F.col("id"))).otherwise("")
    return d.withColumns({"signature": signature, "reason": F.coalesce("_early", "_late", "_passed"), "accepted": F.col("_early").isNull() & F.col("_late").isNull(), "_before_signature": F.col("_early").isNull()}).drop("_early", "_late", "_passed", "_tags", "_raw")


def _settled(left: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, left) after a round: rows that come first under all their keys are kept, those that share a key with
    one are not, and the others are left."""
    d = left
    for n in names:
        d = d.join(left.groupBy(n).agg(F.min("_o").alias(f"_m{n}")), n, "left")
    first = F.lit(True)
    for n in names:
        first = first & (F.col(n).isNull() | (F.col(f"_m{n}") == F.col("_o")))
    new = materialize(d.filter(first).select("_o", *names), "kept")
    return new, _unhit(left.join(new.select("_o"), "_o", "left_anti"), new, names)


def _unhit(left: DataFrame, kept: DataFrame, names: list[str]) -> DataFrame:
    """Rows that share no key with a kept one."""
    for n in names:
        left = left.join(kept.select(n).filter(F.col(n).isNotNull()).distinct(), n, "left_anti")
    return materialize(left.select("_o", *names), "open")


def _folded(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept rows of groups ``_c`` that come one after the other, each in order: what the rule says, row by row,
    with the keys of one group in memory."""
    group, seen = None, [set() for _ in names]
    for batch in batches:
        keep = []
        for i, (c, *row) in enumerate(zip(*[batch.column(n).to_pylist() for n in ("_c", *names)], strict=True)):
            if c != group:
                group, seen = c, [set() for _ in names]
            if not any(k is not None and k in s for k, s in zip(row, seen, strict=True)):
                keep.append(i)
                for k, s in zip(row, seen, strict=True):
                    s.add(k)
        yield batch.select(["_o", *names]).take(pa.array(keep, pa.int64()))


def _in_place(grouped: DataFrame, names: list[str]) -> DataFrame:
    """The kept rows of groups ``_c``, each group by one task."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.select("_o", *names).schema)
    placed = grouped.repartition("_c").sortWithinPartitions("_c", "_o")
    return materialize(placed.select("_c", "_o", *names).mapInArrow(lambda it: _folded(it, names), schema), "kept")


def _grouped(left: DataFrame, names: list[str]) -> DataFrame:
    """With ``_c``, the first row of the connected component: rows hang together that share a key."""
    edges = None
    for n in names:
        firsts = left.filter(F.col(n).isNotNull()).groupBy(n).agg(F.min("_o").alias("b"))
        tied = left.join(firsts, n).filter("_o <> b").select(F.col("_o").alias("a"), "b")
        edges = tied if edges is None else edges.union(tied)
    return materialize(left.join(components(edges).withColumnRenamed("a", "_o"), "_o", "left").select("_o", *names, F.coalesce("b", "_o").alias("_c")), "grouped")


#: Rows that one task folds in place, and how many times as many are taken in blocks without a look at components.
IN_PLACE, BLOCKS = 1_000_000, 8


def accept_first(df: DataFrame, order: str, keys: list[str], seen: DataFrame | None = None, in_place: int = IN_PLACE, rounds: int = 3) -> DataFrame:
    """``df`` with ``kept``: in order (a unique number), a row is kept unless a kept row before it, or a row of
    ``seen``, has one of its keys; blank keys match nothing.

    A few rounds of aggregates settle what does not hang on much. What is left is cut into connected components,
    found in a number of rounds that grows with the logarithm of a chain's length, and each is folded in place, in
    order, by one task. What is left of a few times more than one task folds, or a component of more, is taken in blocks
    of that many rows in order: one task folds a block, and what it keeps takes its rows out of later blocks."""
    names = [f"_k{i}" for i in range(len(keys))]
    own = df.select(F.col(order).alias("_o"), *[F.nullif(F.col(k).cast("string"), F.lit("")).alias(n) for k, n in zip(keys, names, strict=True)])
    if seen is not None:
        for k, n in zip(keys, names, strict=True):
            own = own.join(seen.select(F.col(k).cast("string").alias(n)).distinct(), n, "left_anti")
    left = materialize(own.select("_o", *names), "open")
    kept: list[DataFrame] = []
    for _ in range(rounds):
        if left.count() <= in_place:
            break
        new, left = _settled(left, names)
        kept.append(new)
    if left.count() > BLOCKS * in_place:
        grouped = _grouped(left, names)
        large = grouped.groupBy("_c").count().filter(F.col("count") > in_place).select("_c")
        kept.append(_in_place(grouped.join(large, "_c", "left_anti"), names))
        left = materialize(grouped.join(large, "_c", "left_semi").select("_o", *names), "open")
    while n_left := left.count():
        if n_left > in_place:
            end = left.approxQuantile("_o", [in_place / n_left], 1e-4)[0]
            block, later = left.filter(F.col("_o") <= end), left.filter(F.col("_o") > end)
            kept.append(_in_place(block.withColumn("_c", F.lit(0).cast("long")), names))
            left = _unhit(later, kept[-1], names)
        else:
            kept.append(_in_place(left.withColumn("_c", F.lit(0).cast("long")), names))
            break
    flags = reduce(DataFrame.unionByName, [k.select("_o") for k in kept]) if kept else own.limit(0).select("_o")
    return df.join(flags.select(F.col("_o").alias(order), F.lit(True).alias("kept")), order, "left").fillna(False, ["kept"])


def new_rows(existing: DataFrame, found: DataFrame, wanted: int, order: str) -> DataFrame:
    """Existing rows and as many new ones, in order, as are missing to the number wanted."""
    return existing.unionByName(found.orderBy(order).limit(max(0, wanted - existing.count())), allowMissingColumns=True)


def colored(posts: DataFrame) -> DataFrame:
    """Posts that pass the colour gate."""
    return posts.filter("likely_color")


def query_groups(presets: dict[str, dict[str, list[str]]], spark) -> DataFrame:
    """(preset, label, priority, query) of query variants, in order."""
    rows = [(p, label, k, q) for p, groups in presets.items() for label, queries in groups.items() for k, q in enumerate(queries)]
    return spark.createDataFrame(rows, "preset string, label string, priority int, query string")
