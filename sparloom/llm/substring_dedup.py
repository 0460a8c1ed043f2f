"""Repeated passages by content-defined chunking with a gear rolling hash.

The gear hash runs over words: h = (h << 1) + G[word]; its bits GEAR_BITS depend on the last few words
only, so a boundary moves with its text when something is inserted before it. Chunks are held against each
other by digest. A window of ``min_words`` words can only repeat if its whole chunks are repeated ones; an
exact check follows for these windows, by their own digests. A passage is reported where windows repeat in
two documents or more.

Digests are counted without a row a chunk: tasks send sorted arrays of distinct digests to shards (by the
digest's first bits), which keep those of several documents as sorted arrays in the shared folder; workers
map them into memory. Common digests are one entry a task, so a passage that very many documents share
does not burden one shard.

A document here is a row. Repeats inside one document alone do not count. Defined results: null and blank
texts have no words; rows with a null id take part; documents without a repeated passage give no row; an
empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm import tokens
from sparloom.llm.common import materialize, mounted_folder
from sparloom.llm.lm_scoring import Mapped, _bytes, distinct, save

MIN_WORDS = 50
#: A boundary follows a word where these bits of the gear hash are zero: one in four, by the last WINDOW words.
GEAR_BITS = 0b11000
WINDOW = 5
MAX_CHUNK = 32
#: Digests that a task holds before it sends them on.
HELD = 1 << 20


def cuts(hashes: np.ndarray) -> np.ndarray:
    """Whether a boundary stands before each word (and after the last), by the WINDOW words before it: bits of
    the gear hash are zero, or all of them are one word."""
    n = len(hashes)
    gear = np.zeros(n, np.uint64)
    same = np.ones(n, bool)
    for k in range(min(WINDOW, n)):
        gear[k:] += hashes[: n - k] << np.uint64(k)
        same[k:] &= hashes[k:] == hashes[: n - k]
    out = np.zeros(n + 1, bool)
    out[1:] = ((gear & np.uint64(GEAR_BITS)) == 0) | same
    return out


def chunk_starts(cut: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First words of the chunks of some rows: a row starts a chunk, so does each word after a boundary, and
    chunks end after MAX_CHUNK words at the latest."""
    n = len(cut) - 1
    cut = cut.copy()
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    sizes = np.diff(starts, append=n)
    if len(sizes) and sizes.max() > MAX_CHUNK:
        parts = (sizes + MAX_CHUNK - 1) // MAX_CHUNK
        first = np.repeat(starts, parts)
        return first + MAX_CHUNK * (np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts))
    return starts


def spans_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of the word spans [start, end)."""
    power, inverse = tokens._power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return tokens.mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def row_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


@dataclass
class Repeated:
    """Digests of two or more documents, as sorted arrays in shards by their first bits. ``written``: a bit for
    each shard, whether digests came to it, so that it has a file; a file that is gone is an error."""

    folder: str
    name: str
    bits: int
    written: np.ndarray

    def has(self, mapped: Mapped, digests: np.ndarray) -> np.ndarray:
        found, place = distinct(digests)
        part = (found >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(found), np.int64)
        yes = np.zeros(len(found), bool)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            shard = int(part[lo])
            if not self.written[shard >> 3] >> (7 - (shard & 7)) & 1:
                continue
            have = mapped(f"{self.name}-{shard}.hash")
            if len(have):
                at = np.minimum(np.searchsorted(have, found[lo:hi]), len(have) - 1)
                yes[lo:hi] = have[at] == found[lo:hi]
        return yes[place]


def chunk_digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest) of all chunks of some rows."""
    starts = chunk_starts(cuts(hashes), offsets)
    return row_of(offsets, starts), spans_hashes(hashes, starts, np.append(starts[1:], len(hashes)))


def candidate_windows(hashes: np.ndarray, offsets: np.ndarray, chunks: Repeated, mapped: Mapped, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, digest) of the windows that may repeat. Behind its first WINDOW words a window has the same
    boundaries wherever it stands, so from the first of these on all its whole chunks must be repeated ones;
    a window without a whole chunk (one in tens of thousands) may repeat anyway."""
    n = len(hashes)
    at = np.arange(max(0, n - width + 1))
    row = row_of(offsets, at)
    inside = at + width <= offsets[row + 1] if len(at) else np.zeros(0, bool)
    at, row = at[inside], row[inside]
    if not len(at):
        return at, np.zeros(0, np.uint64)
    cut = cuts(hashes)
    starts = chunk_starts(cut, offsets)
    ends = np.append(starts[1:], n)
    fresh = np.concatenate([[0], np.cumsum(~chunks.has(mapped, spans_hashes(hashes, starts, ends)))])
    own = np.append(np.flatnonzero(cut), n + width)
    first = np.searchsorted(starts, own[np.searchsorted(own, at + WINDOW)])
    last = np.searchsorted(ends, at + width, side="right")
    last -= (at + width == offsets[row + 1]) & ~cut[at + width]  # that chunk ends with the row, not with a boundary
    at = at[(first >= last) | (fresh[np.maximum(last, first)] == fresh[np.minimum(first, len(starts))])]
    return at, spans_hashes(hashes, at, at + width)


def _packed(batches: Iterator[pa.RecordBatch], digests_of, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, sorted distinct digests, whether several documents of the task have them)."""

    def send(rows: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
        values, place = distinct(found)
        first, final = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
        final[place] = rows
        first[place[::-1]] = rows[::-1]
        part = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        cut = list(zip(edges[:-1], edges[1:], strict=True))
        several = first != final
        return pa.RecordBatch.from_arrays([pa.array([part[lo] for lo, _ in cut], pa.int32()), pa.array([values[lo:hi].tobytes() for lo, hi in cut], pa.binary()), pa.array([several[lo:hi].astype(np.uint8).tobytes() for lo, hi in cut], pa.binary())], names=["shard", "digests", "several"])

    rows, found, held, seen = [], [], 0, 0
    for batch in batches:
        for own, offsets, hashes in tokens.rows_of(batch.column("text")):
            row, digest = digests_of(hashes, offsets)
            rows.append(row + seen)
            found.append(digest)
            seen += len(own)
            held += len(digest)
            if held >= HELD:
                yield send(np.concatenate(rows), np.concatenate(found))
                rows, found, held = [], [], 0
    if held:
        yield send(np.concatenate(rows), np.concatenate(found))


def repeated(texts: DataFrame, digests_of, folder: str, name: str) -> Repeated:
    """Digests that ``digests_of`` makes of two rows or more of ``texts``."""
    bits = max(0, (texts.rdd.getNumPartitions() - 1).bit_length())

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        digests = _bytes(table, "digests", np.uint64)
        order = np.argsort(digests)
        digests, several = digests[order], _bytes(table, "several", np.uint8)[order]
        starts = np.flatnonzero(np.diff(digests, prepend=digests[:1] - np.uint64(1)))
        times = np.add.reduceat(several.astype(np.int64) + 1, starts)
        kept = digests[starts[times > 1]]
        save(folder, f"{name}-{shard}", hash=kept)
        return pa.table({"shard": pa.array([shard], pa.int32())})

    packed = texts.mapInArrow(lambda it: _packed(it, digests_of, bits), "shard int, digests binary, several binary")
    written = np.zeros(1 << bits, bool)
    written[packed.groupBy("shard").applyInArrow(write, "shard int").toArrow().column("shard").to_numpy()] = True
    return Repeated(folder, name, bits, np.packbits(written))


def _spans(batches: Iterator[pa.RecordBatch], chunks: Repeated, windows: Repeated, width: int) -> Iterator[pa.RecordBatch]:
    mapped = Mapped(chunks.folder)
    for batch in batches:
        for rows, offsets, hashes in tokens.rows_of(batch.column("text")):
            at, digest = candidate_windows(hashes, offsets, chunks, mapped, width)
            keep = windows.has(mapped, digest) if len(at) else np.zeros(0, bool)
            at, digest = at[keep], digest[keep]
            if not len(at):
                continue
            row = row_of(offsets, at)
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + width)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            own = row[first]
            kept = batch.select(["doc_id"]).take(pa.array(rows[own]))
            start, end = at[first] - offsets[own], at[last] + width - offsets[own]
            name = np.minimum.reduceat(digest, first)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(start), pa.array(end), pa.array(name.view(np.int64))], names=["doc_id", "start_word", "end_word", "passage"])


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, passage, n_spans, first_doc_id): the maximal spans of words
    covered by windows of ``min_words`` words that stand in two documents or more. ``passage`` names the
    text of a span (its smallest window digest), with the number of spans and the smallest id that have it."""
    folder = mounted_folder(docs.sparkSession, "passages", "the digests")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = own.select("text")
    chunks = repeated(texts, chunk_digests, folder, "chunks")

    def windows_of(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, digest = candidate_windows(hashes, offsets, chunks, Mapped(folder), min_words)
        return row_of(offsets, at), digest

    windows = repeated(texts, windows_of, folder, "windows")
    kind = own.schema["doc_id"].dataType.simpleString()
    spans = materialize(own.mapInArrow(lambda it: _spans(it, chunks, windows, min_words), f"doc_id {kind}, start_word long, end_word long, passage long"), "spans")
    named = materialize(spans.groupBy("passage").agg(F.count("*").alias("n_spans"), F.min("doc_id").alias("first_doc_id")), "span-names")
    return spans.join(named, "passage").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.lower(F.lpad(F.hex("passage"), 16, "0")).alias("passage"), "n_spans", "first_doc_id")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
