"""Jaccard join of word n-grams by vertical partitioning.

All n-grams have one global order, that of their 64-bit hashes. It is cut into fragments, ranges of the order, and
so is the set of every document: a fragment's n-grams of a document are one row. The overlap of two documents is
counted in each fragment on its own and the counts are summed up per pair, so that no task ever holds a whole
large set. A pair is cut into as many fragments as keep about FRAGMENT n-grams of its larger set in each; a set
is kept in the cuts that it may need, its own and that of a set as much larger as a link allows.

Pairs to be counted come from ``similar_sets``: linked sets share one of the rarest n-grams of their prefix, and
sizes and bitmaps must leave room for the similarity. Sets, not documents, are joined, so copies are one; a
bucket is first tied to one of its sets, and only sets of a bucket that are in different components after that
are compared with each other. Whole counts decide: links are exact but for equal hashes of different n-grams.

Defined results: a text of fewer words than an n-gram is one n-gram; a null, empty or blank text has the empty
set and is linked with nothing, not even with its like; a null id takes part, gets its group's smallest id, and
is null if the group has no other; repeated rows are rows of their own; other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm import similar_sets, tokens
from sparloom.llm.common import materialize

NGRAM, SIMILARITY = 4, 0.85
#: n-grams of a fragment, about.
FRAGMENT = 2048


def cut_bits(n: int, fragment: int) -> int:
    """A set of n n-grams is cut into 2 to this power of fragments."""
    return ((n - 1) // fragment).bit_length() if n else 0


def _cut_bits(n: Column, fragment: int) -> Column:
    over = F.floor((n - 1) / fragment)
    return F.when(over > 0, F.length(F.bin(over))).otherwise(0).cast("int")


def _fragments(batches: Iterator[pa.RecordBatch], size: int, similarity: float, each: int) -> Iterator[pa.RecordBatch]:
    """(th, bits, fragment, part) of the texts' sets, in each of the cuts that they may need."""
    for batch in batches:
        of = batch.column("th")
        for rows, offsets, hashes in tokens.rows_of(batch.column("text")):
            row, bits, fragment, parts = [], [], [], []
            for k, r in enumerate(rows):
                s = similar_sets.shingles(hashes[offsets[k] : offsets[k + 1]], size)
                for b in range(cut_bits(len(s), each), cut_bits(int(len(s) / similarity + 1e-9), each) + 1):
                    edges = np.searchsorted(s, np.arange(1 << b, dtype=np.uint64) << np.uint64(64 - b)) if b else np.zeros(1, np.int64)
                    for f, (lo, hi) in enumerate(zip(edges, [*edges[1:], len(s)], strict=True)):
                        if hi > lo:
                            row.append(int(r))
                            bits.append(b)
                            fragment.append(f)
                            parts.append(s[lo:hi].view(np.int64))
            ends = np.cumsum([0, *(len(p) for p in parts)], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays([of.take(pa.array(row, pa.int64())), pa.array(bits, pa.int32()), pa.array(fragment, pa.int32()), listed], names=["th", "bits", "fragment", "part"])


def overlaps(pairs: DataFrame, texts: DataFrame, size: int = NGRAM, similarity: float = SIMILARITY, fragment: int | None = None) -> DataFrame:
    """(x, y, x_n, y_n, shared) of the pairs (x, y, x_th, y_th, x_n, y_n) that share an n-gram: the partial counts
    of all fragments, summed up. ``texts``: (th, text). Sizes of a pair must allow the similarity."""
    each = fragment or FRAGMENT
    cut = texts.mapInArrow(lambda it: _fragments(it, size, similarity, each), "th bigint, bits int, fragment int, part array<bigint>")
    cut = materialize(cut, "ngram-fragments")
    side = lambda name: cut.select(F.col("th").alias(f"{name}_th"), "bits", "fragment", F.col("part").alias(f"{name}_part"))
    asked = pairs.withColumn("bits", _cut_bits(F.greatest("x_n", "y_n"), each))
    met = asked.join(side("x"), ["x_th", "bits"]).join(side("y"), ["y_th", "bits", "fragment"])
    partial = met.select("x", "y", "x_n", "y_n", F.size(F.array_intersect("x_part", "y_part")).alias("partial"))
    return partial.groupBy("x", "y", "x_n", "y_n").agg(F.sum("partial").alias("shared"))


def links_by_fragments(pairs: DataFrame, own: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (x, y) whose overlap is large enough for the similarity, which counts to a millionth."""
    parts = round(similarity * 1_000_000)
    found = overlaps(pairs, similar_sets.texts_of(pairs, own), size, similarity)
    return found.filter(F.col("shared") * 1_000_000 >= parts * (F.col("x_n") + F.col("y_n") - F.col("shared"))).select("x", "y")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = NGRAM, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; a component is named by its smallest id."""
    rows = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = materialize(similar_sets.groups(rows, size, similarity, links_by_fragments).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "root"), "ngram-groups")
    names = found.filter("n_shingles > 0").groupBy("root").agg(F.count("*").alias("members"), F.min("doc_id").alias("component_id")).filter("members > 1").drop("members")
    named = found.join(names, "root", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op13_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH RECURSIVE told AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM told),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
grams AS (SELECT doc_id, n, unnest(s) AS g FROM sized),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM sized UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM sized s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n"""
