"""Mixing sources to target weights by systematic sampling.

Each source gets a share of all words by its weight, at most ``cap`` times its own words; what is
cut off goes to the other sources by weight. A document's expected copies are target / source words;
prefix sums of these within the source, plus one random offset, cross as many integers as copies are
emitted. Documents are put in order of size (two leading digits) and then of a hash, so that the words
taken stay within about one long document of the target.

Defined results: a null text has size 0; a null source is a source of its own, last in order; null and
repeated ids are kept as rows of their own; a source without words has target 0 and nothing is taken;
an empty table gives an empty result; other columns are not read. Ties (same size and id) may exchange
their copies, which leaves the rows of the result the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparloom.llm.common import by_shuffle, fresh_name, materialize, words
from sparloom.operators.basics import global_place

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: Hex digits of the order hash that split one size class of a source into windows: 4096 of them.
SALT_DIGITS = 3
#: Of these, the digits of the level above.
HALF_DIGITS = 2


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source_size, target) of each source, from rows (key, size), by rounds of aggregates over one row a
    source: every round caps the sources whose share of what is left is above ``cap`` times their words, until
    none is. Sources are placed, for their weights, by ranges of their names, so no task sorts them all."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    w, top = cycle[(F.col("_place") % len(weights)).cast("int")], F.col("source_size") * cap
    ranked = materialize(global_place(per, [F.col("key")]).select("key", "source_size", w.cast("long").alias("w"), top.alias("top")), "mix-sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, n = F.lit(False), -1
    while True:
        full = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("top"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0)), F.count_if(capped)).first()
        rest, open_w = float(total - full[0]), float(full[1])
        share = F.col("w").cast("double") * F.lit(rest) / F.lit(open_w) if open_w else F.lit(0.0)
        if full[2] == n or not open_w:
            break
        n = full[2]
        # capped once, capped for good: what is left for the others only grows
        capped = F.lit(rest) * F.col("w").cast("double") > F.col("top").cast("double") * F.lit(open_w)
    return ranked.select("key", "source_size", F.when(capped, F.col("top").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every document, and columns to carry."""
    source = F.col(source_col).cast("string")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("key"), F.size(words(F.col(text_col))).cast("long").alias("size"), *carry)
    sized = materialize(sized, "mix-sizes")
    digits = F.col("size").cast("string")
    keyed = sized.select("doc_id", "key", "size", *carry, F.rpad(F.substring(digits, 1, 2), F.length(digits), "0").cast("long").alias("class"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"))
    keyed = keyed.withColumn("salt", F.substring("h", 1, SALT_DIGITS))
    groups = ["key", "class", "half", "salt"]
    counts = keyed.withColumn("half", F.substring("salt", 1, HALF_DIGITS)).groupBy(*groups).agg(F.count("*").alias("n"))
    start = counts.select(*groups, F.lit(0).cast("long").alias("start"))
    # the rows before a group: those of earlier groups of its parent, level by level, each of a few hundred rows at most
    for depth in range(len(groups), 1, -1):
        level = counts.groupBy(*groups[:depth]).agg(F.sum("n").alias("n"))
        before = Window.partitionBy(*groups[: depth - 1]).orderBy(groups[depth - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*groups[:depth], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        # the lower levels have nearly a row a document, the first one a row a class
        start = start.join(by_shuffle(level) if depth > 2 else level, groups[:depth]).select(*groups, (F.col("start") + F.col("before")).alias("start"))
    start = start.drop("half")
    targets = source_targets(sized.select("key", "size"), weights, cap)
    place = F.row_number().over(Window.partitionBy("key", "class", "salt").orderBy("h", "size", "doc_id"))
    placed = keyed.withColumn("place", place).join(by_shuffle(start), ["key", "class", "salt"]).join(targets, "key")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    upto = lambda k: F.floor(offset + share * k.cast("double"))
    k = F.col("start") + F.col("place")
    copies = F.least(F.lit(cap).cast("long"), upto(k) - upto(k - 1))
    out = placed.select("doc_id", F.when(F.col("key") != "1", F.expr("substring(key, 2)")).alias("source"), "size", "source_size", "target", copies.alias("copies"), *carry)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: each document's row once per copy, with copy (from 1), size, source_size, target and
    taken (the words of this copy) beside its own columns; of these, a name that a column has already gets
    underscores before it."""
    row = fresh_name(docs, "_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    found = mix(numbered, id_col, text_col, source_col, carry=(row,), **settings).filter("copies > 0")
    name = {c: fresh_name(docs, c) for c in ("copy", "size", "source_size", "target", "taken")}
    emitted = found.select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name["copy"]), *[F.col(c).alias(name[c]) for c in ("size", "source_size", "target")], F.col("size").alias(name["taken"]))
    return numbered.join(emitted, row).drop(row)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY key),
ranked AS (SELECT *, 1 + (row_number() OVER (ORDER BY key) - 1) % 3 AS w FROM per),
state AS (
  SELECT *, 3 * source_size AS top, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(3 * source_size) OVER before, 0) AS top_before, coalesce(sum(w) OVER before, 0) AS w_before
  FROM ranked
  WINDOW before AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (
  SELECT *, CAST(total - top_before AS DOUBLE) * w > CAST(top AS DOUBLE) * CAST(all_w - w_before AS DOUBLE) AS capped FROM state),
targets AS (
  SELECT key, source_size, CASE WHEN capped THEN CAST(top AS DOUBLE) ELSE CAST(w AS DOUBLE)
    * CAST(total - coalesce(sum(CASE WHEN capped THEN top END) OVER (), 0) AS DOUBLE)
    / CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS DOUBLE) END AS target
  FROM flagged),
placed AS (
  SELECT doc_id, key, size, row_number() OVER (PARTITION BY key
    ORDER BY CAST(rpad(substr(CAST(size AS VARCHAR), 1, 2), CAST(length(CAST(size AS VARCHAR)) AS INTEGER), '0') AS BIGINT),
      md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), size, doc_id) AS k
  FROM sized),
steps AS (
  SELECT doc_id, size, source_size, target, k,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share,
    CAST(CAST('0x' || substr(md5('mix-1/' || key), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS offs
  FROM placed JOIN targets USING (key))
SELECT doc_id, size, source_size, target,
  size * least(3, CAST(floor(offs + share * k) - floor(offs + share * (k - 1)) AS BIGINT)) AS taken
FROM steps
"""
