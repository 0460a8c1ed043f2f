"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark in two passes over the training texts. Both count inside a task first and send
packed arrays to shards, never one row a token:

1. words: shards by the hash of the word. A shard is a sorted array of word hashes with running counts; a
   word's place over all shards is its number.
2. word pairs: shards by ranges of (first word, second word) that hold about PAIRS_PER_SHARD tokens each,
   known from the counts of pass 1. A very frequent first word is spread over several shards by its second
   word. A shard is a sorted array of pair keys with counts.

Per word, the number of distinct words before it, and of followers seen once, twice and more often, are
gathered from the pair shards. All arrays are files in the shared folder, which must be mounted on every
worker (``file:`` path); workers map them into memory and search them; a file that is gone is an error. Discounts come from counts of
counts over the whole corpus; nothing is pruned.

A text is its words and one end; the end is also the context of the first word. A pair's probability is
max(c(u,v) - D, 0) / c(u) + g(u) * P(v), where P(v) is the same over numbers of distinct contexts,
interpolated with the uniform 1 / (words + 1), which is also the probability of an unknown word.

Words are compared by 64-bit hashes. Defined results: a null text is empty, so it is one end; null and
repeated ids are rows of their own (a null id belongs to the training part); without training texts every
word is unknown; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.llm import tokens
from sparloom.llm.common import materialize, mounted_folder

END = np.uint64(0x5EED0FE9D0C0FFEE)
#: Tokens of a task counted together before they are sent on.
CHUNK = 1 << 20
PAIRS_PER_SHARD = 4_000_000


def is_training(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 != 2, F.lit(True))


def chunks(batches, size: int | None = None) -> Iterator[tuple[list[tuple[pa.RecordBatch, np.ndarray]], np.ndarray, np.ndarray]]:
    """(parts of batches with the rows taken, offsets of the rows, token hashes with an end after each row)
    for whole rows of about ``size`` tokens."""
    size = size or CHUNK
    parts, lengths, hashes, held = [], [], [], 0

    def ready():
        n = np.concatenate(lengths)
        return parts, np.concatenate([[0], np.cumsum(n)]), np.concatenate(hashes)

    for batch in batches:
        for rows, offsets, found in tokens.rows_of(batch.column("text")):
            parts.append((batch, rows))
            lengths.append(np.diff(offsets) + 1)
            hashes.append(np.insert(found, offsets[1:], END))
            held += len(hashes[-1])
            if held >= size:
                yield ready()
                parts, lengths, hashes, held = [], [], [], 0
    if parts:
        yield ready()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them)."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(found)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[coded.indices.to_numpy(zero_copy_only=False)]


def save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """One file an array, renamed into place, so that a repeated task leaves the same whole files."""
    for key, array in arrays.items():
        path = f"{folder}/{name}.{key}.npy"
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(own, "wb") as f:
            np.save(f, array)
        os.rename(own, path)


class Mapped:
    """Memory-mapped arrays of a folder; the least recently used are let go."""

    def __init__(self, folder: str, most: int = 2048):
        self.folder, self.most, self.held = folder, most, OrderedDict()

    def __call__(self, name: str) -> np.ndarray:
        if name not in self.held:
            path = f"{self.folder}/{name}.npy"
            self.held[name] = np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        self.held.move_to_end(name)
        return self.held[name]


@dataclass
class Vocabulary:
    """Sorted word hashes in shards by their first bits: sizes and counts of the shards."""

    folder: str
    bits: int
    first: np.ndarray  # number of the first word of each shard, and of all words
    tokens: np.ndarray  # training tokens of each shard
    shard: np.ndarray  # first pair shard of each word shard, and of all
    pairs: int

    @property
    def second_bits(self) -> int:
        """Bits of a pair key for the number of the second word; the rest holds the first word within its shard."""
        return max(1, int(self.first[-1]).bit_length())

    def key(self, place: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (place.astype(np.uint64) << np.uint64(self.second_bits)) | second.astype(np.uint64)

    def look_up(self, mapped: Mapped, words: np.ndarray, names: tuple[str, ...]) -> tuple[np.ndarray, ...]:
        """(known, shard, place in the shard, arrays ``names`` there) of sorted distinct hashes."""
        part = (words >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(words), np.int64)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        known, place = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        found = [np.zeros(len(words), np.int64) for _ in names]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            p = part[lo]
            if self.first[p] == self.first[p + 1]:
                continue
            have = mapped(f"words-{p}.hash")
            at = np.minimum(np.searchsorted(have, words[lo:hi]), len(have) - 1)
            known[lo:hi] = have[at] == words[lo:hi]
            place[lo:hi] = at
            for out, name in zip(found, names, strict=True):
                out[lo:hi] = mapped(f"words-{p}.{name}")[at]
        return known, part, place, *found

    def pair_shard(self, part: np.ndarray, before: np.ndarray, count: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The pair shard: where the pair would stand among the tokens of the word shard, were all second
        words alike; in the order of (first word, second word)."""
        share = second.astype(np.float64) / max(1, self.first[-1])
        return self.shard[part] + (before + np.floor(share * count).astype(np.int64)) // self.pairs


def _word_counts(batches, bits: int) -> Iterator[pa.RecordBatch]:
    for _, _, hashes in chunks(batches):
        words, place = distinct(hashes)
        count = np.bincount(place)
        part = (words >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        cut = list(zip(edges[:-1], edges[1:], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([part[lo] for lo, _ in cut], pa.int32()), pa.array([words[lo:hi].tobytes() for lo, hi in cut], pa.binary()), pa.array([count[lo:hi].astype(np.uint32).tobytes() for lo, hi in cut], pa.binary())], names=["shard", "words", "counts"])


def _bytes(table: pa.Table, name: str, kind) -> np.ndarray:
    """The arrays of a binary column, put end to end."""
    return np.concatenate([np.frombuffer(x.as_py() or b"", kind) for x in table.column(name)])


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - keys.dtype.type(1)))
    return keys[starts], np.add.reduceat(counts[order].astype(np.int64), starts)


def count_words(train: DataFrame, folder: str) -> Vocabulary:
    """Pass 1: the word shards, as many as the input has partitions (a power of two)."""
    bits = max(0, (train.rdd.getNumPartitions() - 1).bit_length())

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words, counts = _merge(_bytes(table, "words", np.uint64), _bytes(table, "counts", np.uint32))
        save(folder, f"words-{shard}", hash=words, before=np.cumsum(counts) - counts, count=counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(words)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    packed = train.mapInArrow(lambda it: _word_counts(it, bits), "shard int, words binary, counts binary")
    made = packed.groupBy("shard").applyInArrow(write, "shard int, words long, tokens long").toArrow()
    sizes, held = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    at = made.column("shard").to_numpy()
    sizes[at], held[at] = made.column("words").to_numpy(), made.column("tokens").to_numpy()
    ends = lambda x: np.concatenate([[0], np.cumsum(x)])
    return Vocabulary(folder, bits, ends(sizes), held, ends((held + PAIRS_PER_SHARD - 1) // PAIRS_PER_SHARD), PAIRS_PER_SHARD)


def _pairs(hashes: np.ndarray, vocabulary: Vocabulary, mapped: Mapped, names: tuple[str, ...]):
    """Distinct pairs of neighbours: what is known of the words, places of first and second words among
    them, and the pair of each token."""
    words, place = distinct(np.concatenate([[END], hashes]))
    info = vocabulary.look_up(mapped, words, ("before", "count", *names))
    keys, at = distinct((place[:-1].astype(np.uint64) << np.uint64(32)) | place[1:].astype(np.uint64))
    return info, (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), at, place[1:]


def _pair_counts(batches, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    mapped = Mapped(vocabulary.folder)
    wide = np.uint32 if vocabulary.first[-1] < 1 << 32 else np.uint64
    for _, _, hashes in chunks(batches):
        (_, part, place, before, count), u, v, at, _ = _pairs(hashes, vocabulary, mapped, ())
        n = np.bincount(at)
        second = vocabulary.first[part[v]] + place[v]
        shard = vocabulary.pair_shard(part[u], before[u], count[u], second)
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        rows = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own, c = place[u[lo:hi]], n[lo:hi]
            runs = np.flatnonzero(np.diff(own, prepend=-1))
            rows.append((shard[lo], own[runs].astype(np.uint32).tobytes(), np.diff(runs, append=hi - lo).astype(np.uint32).tobytes(), second[lo:hi].astype(wide).tobytes(), np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].astype(np.uint32).tobytes()))
        kinds = {"shard": pa.int32(), "firsts": pa.binary(), "runs": pa.binary(), "seconds": pa.binary(), "counts": pa.binary(), "large": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _by_word_shard(vocabulary: Vocabulary, numbers: np.ndarray, kind: str, *columns: np.ndarray) -> list[tuple]:
    """Packed rows (word shard, kind, places, columns) of sorted word numbers."""
    part = np.searchsorted(vocabulary.first, numbers, side="right") - 1
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    pack = lambda x: x.astype(np.uint32).tobytes()
    return [(int(part[lo]), kind, pack(numbers[lo:hi] - vocabulary.first[part[lo]]), *[pack(c[lo:hi]) for c in columns], *[b""] * (3 - len(columns)), None) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


STATS = "shard int, kind string, places binary, a binary, b binary, c binary, low array<long>"
_STATS = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("places", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("low", pa.list_(pa.int64()))])


def count_pairs(train: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Pass 2: the pair shards. Returns rows STATS: counts of counts of a shard (kind ``low``), distinct
    words before each word (``cont``), followers of each word seen once, twice, more often (``next``)."""
    wide = np.uint32 if vocabulary.first[-1] < 1 << 32 else np.uint64

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        part = int(np.searchsorted(vocabulary.shard, shard, side="right") - 1)
        first = np.repeat(_bytes(table, "firsts", np.uint32), _bytes(table, "runs", np.uint32))
        keys = vocabulary.key(first, _bytes(table, "seconds", wide))
        del first
        counts = _bytes(table, "counts", np.uint8).astype(np.uint32)
        counts[counts == 255] = _bytes(table, "large", np.uint32)
        keys, counts = _merge(keys, counts)
        large = np.flatnonzero(counts >= 65535)
        save(vocabulary.folder, f"pairs-{shard}", key=keys, count=np.minimum(counts, 65535).astype(np.uint16), large=large, larger=counts[large])
        low = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        rows = [(shard, "low", b"", b"", b"", b"", low)]
        second, n = np.unique(keys & np.uint64((1 << vocabulary.second_bits) - 1), return_counts=True)
        rows += _by_word_shard(vocabulary, second.astype(np.int64), "cont", n)
        own = (keys >> np.uint64(vocabulary.second_bits)).astype(np.int64)
        runs = np.flatnonzero(np.diff(own, prepend=-1))
        seen = [np.add.reduceat(x.astype(np.int64), runs) for x in (counts == 1, counts == 2, counts > 2)]
        rows += _by_word_shard(vocabulary, vocabulary.first[part] + own[runs], "next", *seen)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _STATS, strict=True)], schema=_STATS)

    packed = train.mapInArrow(lambda it: _pair_counts(it, vocabulary), "shard int, firsts binary, runs binary, seconds binary, counts binary, large binary")
    return materialize(packed.groupBy("shard").applyInArrow(write, STATS), "lm-stats")


def gather_stats(stats: DataFrame, vocabulary: Vocabulary) -> list[int]:
    """Per word shard, the arrays cont, once, twice, more beside the words; returns counts of counts of
    ``cont`` (1, 2, 3, 4, more words) and its sum."""

    def write(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        size = int(vocabulary.first[shard + 1] - vocabulary.first[shard])
        out = np.zeros((4, size), np.int64)
        for row in table.to_pylist():
            places = np.frombuffer(row["places"], np.uint32)
            for k, name in ((0, "a"),) if row["kind"] == "cont" else ((1, "a"), (2, "b"), (3, "c")):
                out[k][places] += np.frombuffer(row[name], np.uint32)
        save(vocabulary.folder, f"words-{shard}", cont=out[0], once=out[1], twice=out[2], more=out[3])
        low = [int((out[0] == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"low": pa.array([[*low, int((out[0] > 4).sum()), int(out[0].sum())]], pa.list_(pa.int64()))})

    made = stats.filter("kind <> 'low'").groupBy("shard").applyInArrow(write, "low array<long>").toArrow().column("low").to_pylist()
    return [sum(x) for x in zip(*made, strict=True)] or [0] * 6


def discounts(low: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, from the numbers of items seen 1 to 4
    times; 0.5 times the usual bound where an item is missing."""
    n1, n2, n3, n4 = low
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.75]
    return np.array([0, *[min(max(d, 0.05), k) for k, d in enumerate(found, 1)]])


@dataclass
class Model:
    vocabulary: Vocabulary
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    contexts: int  # distinct pairs
    spare: float  # weight of the uniform distribution
    words: int
    tokens: int
    written: np.ndarray  # a bit for each pair shard: whether it holds a pair and so has files


def train_model(train: DataFrame) -> Model:
    """Counts ``train`` (column text) into a model in the shared folder."""
    folder = mounted_folder(train.sparkSession, "lm", "the model")
    vocabulary = count_words(train, folder)
    stats = count_pairs(train, vocabulary)
    written = np.zeros(int(vocabulary.shard[-1]), bool)
    written[stats.filter("kind = 'low'").select("shard").toArrow().column("shard").to_numpy()] = True
    low = stats.filter("kind = 'low'").agg(*[F.coalesce(F.sum(F.col("low")[k]), F.lit(0)).alias(f"n{k}") for k in range(4)]).first()
    cont = gather_stats(stats, vocabulary)
    by_word = discounts(cont[:4])
    spare = float(by_word[1] * cont[0] + by_word[2] * cont[1] + by_word[3] * (cont[2] + cont[3] + cont[4])) / max(1, cont[5])
    return Model(vocabulary, discounts(list(low)), by_word, cont[5], spare if cont[5] else 1.0, int(vocabulary.first[-1]), int(vocabulary.tokens.sum()), np.packbits(written))


def pair_counts(model: Model, mapped: Mapped, shard: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts of pairs given in the order of (shard, key). A shard that was written and is gone is an error."""
    counts = np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        at = int(shard[lo])
        if not model.written[at >> 3] >> (7 - (at & 7)) & 1:
            continue
        name = f"pairs-{at}"
        have = mapped(f"{name}.key")
        at = np.minimum(np.searchsorted(have, keys[lo:hi]), len(have) - 1)
        got = np.where(have[at] == keys[lo:hi], mapped(f"{name}.count")[at], 0).astype(np.int64)
        over = np.flatnonzero(got == 65535)
        if len(over):
            got[over] = mapped(f"{name}.larger")[np.searchsorted(mapped(f"{name}.large"), at[over])]
        counts[lo:hi] = got
    return counts


def _scored(batches, model: Model) -> Iterator[pa.RecordBatch]:
    vocabulary, mapped = model.vocabulary, Mapped(model.vocabulary.folder)
    uniform = model.spare / (model.words + 1)
    for parts, offsets, hashes in chunks(batches):
        (known, part, place, before, count, cont, once, twice, more), u, v, at, word = _pairs(hashes, vocabulary, mapped, ("cont", "once", "twice", "more"))
        count = np.where(known, count, 0)
        p_word = np.where(known, np.maximum(cont - model.word_discounts[np.minimum(cont, 3)], 0) / max(1, model.contexts), 0) + uniform
        d = model.pair_discounts
        back = np.where(count > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(count, 1), 1.0)
        c = np.zeros(len(u), np.int64)
        both = np.flatnonzero(known[u] & known[v])
        if len(both):
            a, b = u[both], v[both]
            second = vocabulary.first[part[b]] + place[b]
            keys = vocabulary.key(place[a], second)
            c[both] = pair_counts(model, mapped, vocabulary.pair_shard(part[a], before[a], count[a], second), keys)
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(count[u], 1) + back[u] * p_word[v]
        sums = lambda x: np.add.reduceat(x, offsets[:-1])
        base = np.log10((count + 1) / (model.tokens + model.words + 1))
        out = [np.diff(offsets), sums(known[word].astype(np.int64)), sums(base[word]), sums(np.log10(p)[at])]
        done = 0
        for batch, rows in parts:
            own = [pa.array(x[done : done + len(rows)]) for x in out]
            done += len(rows)
            kept = batch.select(["doc_id", "held_out"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, *own], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)."""
    own = docs.select(F.col(id_col).alias("doc_id"), (~is_training(F.col(id_col))).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    found = own.mapInArrow(lambda it: _scored(it, model), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train_model(docs.filter(is_training(F.col("doc_id"))).select(F.col("text"))))
