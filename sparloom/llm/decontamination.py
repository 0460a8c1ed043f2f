"""Benchmark decontamination by greedy string tiling.

Windows of ``min_match`` words are hashed Karp-Rabin style on both sides and joined on the hash: the seeds.
Runs of seeds on one diagonal, merged before those of a pair are put together, are the common substrings of a
document and a benchmark item; the longest that is not marked yet is marked, again and again, until none of
``min_match`` words is left. The share of the item's words under tiles decides, so passages put in another order
count as well.

Before the join, a bitmap of the benchmark's window hashes drops the windows that cannot match. It has at
most MAX_FILTER_BITS bits (2 MB) whatever the benchmark's size; a denser one lets more windows through, and
the join stays exact. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.

Defined results: only pairs at or above the threshold are rows; null and blank texts have no words; rows of
equal id and text give one row; null ids take part; items of fewer than ``min_match`` words cannot match;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm import tokens
from sparloom.llm.common import fresh_name, materialize, without_keys

MIN_MATCH = 5
THRESHOLD = 0.5
MAX_FILTER_BITS = 1 << 24


def _windows(batches: Iterator[pa.RecordBatch], width: int, bitmap, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (kept columns, hash, pos, words of the text) of the windows whose bit is set, or of all."""
    bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
    for batch in batches:
        for rows, offsets, hashes in tokens.rows_of(batch.column("text"), tokens.PUNCTUATION):
            found = tokens.window_hashes(hashes, width)
            at = np.arange(len(found))
            if bits is not None:
                slot = found & np.uint64(8 * len(bits) - 1)
                at = np.flatnonzero(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            row = np.searchsorted(offsets, at, side="right") - 1
            whole = at + width <= offsets[row + 1]
            at, row = at[whole], row[whole]
            if len(at):
                own = batch.select(keep).take(pa.array(rows[row]))
                made = [pa.array(found[at].view(np.int64)), pa.array((at - offsets[row]).astype(np.int32)), pa.array((offsets[row + 1] - offsets[row]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*keep, "hash", "pos", "n"])


def runs_of(seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Common substrings (start in the document, start in the item, words) that the seeds (starts of common
    windows) of each diagonal make."""
    out: list[tuple[int, int, int]] = []
    for d, i in sorted(seeds, key=lambda s: (s[0] - s[1], s[0])):
        if out and out[-1][0] - out[-1][1] == d - i and d == out[-1][0] + out[-1][2] - width + 1:
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((d, i, width))
    return out


def tile(seeds: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the seeds of all common windows of ``width`` words."""
    return tile_runs(runs_of(seeds, width), width)


def tile_runs(runs: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the common substrings of ``width`` words or more: tiles (document start, item start,
    words), longest first."""
    heap = [(-n, i, d) for d, i, n in runs]
    heapq.heapify(heap)
    done: list[tuple[int, int, int]] = []
    doc_used, item_used = set(), set()
    while heap:
        n, i, d = heapq.heappop(heap)
        free = [k for k in range(-n) if i + k not in item_used and d + k not in doc_used]
        if len(free) == -n:
            done.append((d, i, -n))
            item_used.update(range(i, i - n))
            doc_used.update(range(d, d - n))
            continue
        start = 0
        for k in range(1, len(free) + 1):
            if k == len(free) or free[k] != free[k - 1] + 1:
                if k - start >= width:
                    heapq.heappush(heap, (start - k, i + free[start], d + free[start]))
                start = k
    return done


def _tiled(batches: Iterator[pa.RecordBatch], width: int, threshold: float, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, covered, tiles = [], [], []
        for at, (runs, n) in enumerate(zip(batch.column("runs").to_pylist(), batch.column("n_item").to_pylist(), strict=True)):
            found = tile_runs([(x["d"], x["i"], x["n"]) for x in runs], width)
            total = sum(t[2] for t in found)
            if total >= threshold * n:
                rows.append(at)
                covered.append(total)
                tiles.append(",".join(f"{d}:{i}:{k}" for d, i, k in sorted(found)))
        own = batch.select(keep).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(covered, pa.int32()), pa.array(tiles, pa.string())], names=[*keep, "covered", "tiles"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_item, covered, coverage, tiles) of documents and items that share enough."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    kinds = {c: x.schema[c].dataType.simpleString() for x, c in ((own, "doc_id"), (items, "item_id"))}
    grams = materialize(items.mapInArrow(lambda it: _windows(it, min_match, None, ["item_id"]), f"item_id {kinds['item_id']}, hash bigint, pos int, n int"), "benchmark-windows")
    size = 1 << 16
    while size < min(MAX_FILTER_BITS, 64 * grams.count()):
        size *= 2
    slots = grams.select(F.col("hash").bitwiseAND(F.lit(size - 1)).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bitmap = np.zeros(size // 8, np.uint8)
    np.bitwise_or.at(bitmap, slots >> 3, np.left_shift(1, slots & 7).astype(np.uint8))
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    seeds = own.mapInArrow(lambda it: _windows(it, min_match, shared, ["doc_id", "th"]), f"doc_id {kinds['doc_id']}, th bigint, hash bigint, pos int, n int")
    met = seeds.select("doc_id", "th", "hash", F.col("pos").alias("d")).join(grams.select("item_id", "hash", F.col("pos").alias("i"), F.col("n").alias("n_item")), "hash")
    # seeds become runs diagonal by diagonal, so that no row holds a product of two lengths
    places = met.groupBy("doc_id", "th", "item_id", "n_item", (F.col("d") - F.col("i")).alias("shift")).agg(F.sort_array(F.collect_set("d")).alias("p"))
    lone = lambda at, step: F.coalesce(F.get("p", at + step) != F.get("p", at) + step, F.lit(True))
    ends = lambda step: F.filter("p", lambda _, k: lone(k, step))
    runs = F.zip_with(ends(-1), ends(1), lambda a, b: F.struct(a.alias("d"), (a - F.col("shift")).alias("i"), (b - a + min_match).alias("n")))
    lists = places.groupBy("doc_id", "th", "item_id", "n_item").agg(F.flatten(F.collect_list(runs)).alias("runs"))
    out = lists.mapInArrow(lambda it: _tiled(it, min_match, threshold, ["doc_id", "item_id", "n_item"]), f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_item int, covered int, tiles string")
    return out.select("doc_id", "item_id", "n_item", "covered", (F.col("covered") / F.col("n_item")).alias("coverage"), "tiles")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the contaminated documents; all columns stay. Rows without an id go by their text
    hash alone."""
    mark, key = fresh_name(docs, "_key"), fresh_name(docs, "_row_key")
    keyed = docs.withColumn(key, F.concat_ws("/", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.xxhash64(F.col(f"`{text_col}`"))))
    found = contaminated(keyed, benchmark, key, text_col, **settings).select(F.col("doc_id").alias(mark)).distinct()
    found = materialize(found, "contaminated")
    return without_keys(keyed, key, found, mark).drop(key)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
