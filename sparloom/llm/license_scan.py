"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a sentence, which may be wrapped over lines; a line without words ends it. Template words are put in
one global order, rarest in the corpus first (counted over all documents). A template of n words must share ceil(t * n) words with a block; so a block
must hold one of the template's first n - ceil(t * n) + 1 words (prefix filter), have enough words (length
filter), and, from the places of the first shared word in both, be able to reach the overlap (positional
filter). What is left is verified on whole word sets, so the result is exact.

The shared words must stand near each other: within as many words as the template has twice (``SPREAD``). So words that
lie scattered over a long block without stops are no licence, and a block of any length can be met.

Beside it, phrases whose words stand consecutively are found in the whole text; they always count.

The templates are a parameter of a few hundred sentences; their index goes with the tasks. Both passes are
maps over texts; only counts of template words are shuffled.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, compared by 64-bit hashes.
Defined results: a null text is empty; null and repeated ids are rows of their own; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparloom.llm import tokens

THRESHOLD = 0.9
#: The shared words of a template of n words stand within SPREAD * n words of a block.
SPREAD = 2
#: (phrase, label): places where the words stand consecutively.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# The sentences of well-known licences and notices, as (label, sentence). A sentence ends where a
# block does, so what follows a semicolon in the licence is a template of its own.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("apache-2", "See the License for the specific language governing permissions and limitations under the License"),
    ("apache-2", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"),
    ("gpl", "Redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("gpl", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl-2", "either version 2 of the License, or (at your option) any later version"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "Redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("agpl-3", "Redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("agpl-3", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("gnu-warranty", "This program is distributed in the hope that it will be useful, but without any warranty"),
    ("gnu-warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("mpl-2", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd", "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "This software is provided as-is, without any express or implied warranty"),
    ("zlib", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("all-rights-reserved", "All rights reserved"),
)


def hashed(text: str) -> np.ndarray:
    """Word hashes of a short text."""
    data = np.frombuffer(text.encode(), np.uint8)
    return tokens.word_hashes(data, np.zeros(0, np.int64), tokens.PUNCTUATION)[0]


def template_words(templates=TEMPLATES) -> np.ndarray:
    return np.unique(np.concatenate([hashed(t) for _, t in templates])) if templates else np.zeros(0, np.uint64)


def _word_counts(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros(len(words), np.int64)
    for batch in batches:
        for _, found, _, _, _ in tokens.blocks(batch.column("text"), tokens.PUNCTUATION):
            at = np.minimum(np.searchsorted(words, found), len(words) - 1)
            total += np.bincount(at[words[at] == found], minlength=len(words))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)), pa.int32()), pa.array(total)], names=["word", "n"])


def frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[int, int]:
    """How often each template word stands in the corpus, by hash."""
    words = template_words(templates)
    if not len(words):
        return {}
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _word_counts(it, words), "word int, n long")
    return {int(words[r["word"]]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Templates under the words of their prefixes, in the global order."""

    def __init__(self, templates, counts: dict[int, int], threshold: float):
        self.labels, self.sets, self.need, self.width = [], [], [], []
        self.rank = {w: k for k, w in enumerate(sorted((int(w) for w in template_words(templates)), key=lambda w: (counts.get(w, 0), w)))}
        self.prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, (label, text) in enumerate(templates):
            words = hashed(text)
            order = sorted({self.rank[int(w)] for w in words})
            need = max(1, math.ceil(round(threshold * len(order), 9)))
            self.labels.append(label)
            self.sets.append(order)
            self.need.append(need)
            self.width.append(SPREAD * len(words))
            for place, word in enumerate(order[: len(order) - need + 1]):
                self.prefix[word].append((k, place))
        by_hash = {h: r for h, r in self.rank.items()}
        self.first = np.array(sorted(h for h, r in by_hash.items() if r in self.prefix), np.uint64)

    def match(self, words: list[int]) -> Iterator[tuple[int, float]]:
        """(template, containment) of the templates that a block of word hashes, in order, meets."""
        placed = [(at, self.rank[w]) for at, w in enumerate(words) if w in self.rank]
        own = sorted({r for _, r in placed})
        tried: set[int] = set()
        for place, word in enumerate(own):
            for k, at in self.prefix.get(word, ()):
                if k in tried:
                    continue
                tried.add(k)
                need, order = self.need[k], self.sets[k]
                if len(words) < need or 1 + min(len(order) - at - 1, len(own) - place - 1) < need:
                    continue
                shared = len(set(own).intersection(order))
                if shared >= need and len(words) > self.width[k]:
                    shared = self.nearest(placed, k)
                if shared >= need:
                    yield k, shared / len(order)

    def nearest(self, placed: list[tuple[int, int]], k: int) -> int:
        """The most words of a template that stand in one window of its width. Every window that counts holds a word
        of the template's prefix, so only places around those are gone through."""
        order, width = set(self.sets[k]), self.width[k]
        first = set(self.sets[k][: len(order) - self.need[k] + 1])
        held = [(at, r) for at, r in placed if r in order]
        heads = np.array([at for at, r in held if r in first])
        places = np.array([at for at, _ in held])
        near = np.searchsorted(heads, places - width, "right") < np.searchsorted(heads, places + width)
        window: dict[int, int] = defaultdict(int)
        best = lo = 0
        held = [x for x, n in zip(held, near.tolist(), strict=True) if n]
        for at, r in held:
            window[r] += 1
            while held[lo][0] <= at - width:
                window[held[lo][1]] -= 1
                if not window[held[lo][1]]:
                    del window[held[lo][1]]
                lo += 1
            best = max(best, len(window))
        return best


def block_edges(data: np.ndarray) -> np.ndarray:
    """Offsets of the bytes that end a block: line ends before a line without words, and . ! ? or ; before white
    space."""
    stop = np.isin(data, np.frombuffer(b".!?;", np.uint8))
    space = tokens.SPACE[data]
    lines = np.flatnonzero(data == 10)
    seen = np.cumsum(~tokens.PUNCTUATION[data])[lines]
    blank = np.zeros(len(data), bool)
    blank[lines[:-1]] = seen[1:] == seen[:-1]
    return np.flatnonzero(blank | (stop & np.append(space[1:], True)))


def _row(text: bytes, hashes: np.ndarray, phrases, index: Index):
    starts_of = []
    for words, label in phrases:
        at = np.flatnonzero(hashes[: max(0, len(hashes) - len(words) + 1)] == words[0])
        for k in range(1, len(words)):
            at = at[hashes[at + k] == words[k]]
        starts_of += [(int(a), label) for a in at]
    found: dict[int, list[tuple[int, float]]] = {}
    if len(index.first) and len(hashes):
        at = np.minimum(np.searchsorted(index.first, hashes), len(index.first) - 1)
        hits = np.flatnonzero(index.first[at] == hashes)
        if len(hits):
            data = np.frombuffer(text, np.uint8)
            _, starts, _ = tokens.word_hashes(data, np.zeros(0, np.int64), tokens.PUNCTUATION)
            block = np.searchsorted(block_edges(data), starts)
            for b in np.unique(block[hits]):
                lo, hi = np.searchsorted(block, [b, b + 1])
                if met := list(index.match(hashes[lo:hi].tolist())):
                    found[int(lo)] = met
    return starts_of, found


def _scan(batches: Iterator[pa.RecordBatch], phrases, templates, counts: dict[int, int], threshold: float) -> Iterator[pa.RecordBatch]:
    index = Index(templates, counts, threshold)
    phrases = [(hashed(p), label) for p, label in phrases]
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for rows, offsets, hashes in tokens.rows_of(batch.column("text"), tokens.PUNCTUATION):
            out = []
            for k, row in enumerate(rows):
                own = hashes[offsets[k] : offsets[k + 1]]
                places, found = _row(texts[row].as_py() or b"", own, phrases, index)
                base = sorted({x for _, x in places})
                labels = sorted({*base, *(index.labels[t] for met in found.values() for t, _ in met)})
                best = max((s for met in found.values() for _, s in met), default=0.0)
                at = [a for a, _ in places]
                blocks = ",".join(f"{lo}:{index.labels[t]}:{s:.4f}" for lo, met in sorted(found.items()) for t, s in sorted(met))
                out.append((len(own), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), 1.0 if at else best, blocks))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            made = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), *made], names=["doc_id", *OUT])


OUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) of every document;
    blocks: first word, label and containment of each block and template that meet. The score is 1 where a
    phrase stands, else the best containment found, else 0."""
    counts = frequencies(docs, text_col, templates)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _scan(it, phrases, templates, counts, threshold), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


def _sql() -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    spoken = [(label, re.findall("[a-z0-9]+", text.lower())) for label, text in TEMPLATES]
    rows = ", ".join(f"('{label}', {sorted(set(ws))!r}, {max(1, math.ceil(round(THRESHOLD * len(set(ws)), 9)))}, {SPREAD * len(ws)})" for label, ws in spoken)
    phrases = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {low("coalesce(text, '')")} AS low FROM documents),
w AS (SELECT r, regexp_extract_all(low, '{words}') AS ws FROM t),
templates AS (SELECT * FROM (VALUES {rows}) AS x(label, tw, need, width)),
phrases AS (SELECT * FROM (VALUES {phrases}) AS x(phrase, n, label)),
places AS (
  SELECT r, i - 1 AS i, label FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN phrases
  ON list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') = phrase),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS found FROM places GROUP BY r),
blocks AS (
  SELECT r, regexp_extract_all(b, '{words}') AS ws
  FROM (SELECT r, unnest(regexp_split_to_array(low, '\\n[\\x00-\\x09\\x0B-\\x2F\\x3A-\\x60\\x7B-\\x7F]*\\n|[.!?;](?:[\\x20\\x09-\\x0D]|$)')) AS b FROM t)),
able AS (SELECT r, ws, label, tw, need, width FROM (SELECT r, ws, list_distinct(ws) AS own FROM blocks) JOIN templates ON len(own) >= need AND len(list_intersect(own, tw)) >= need),
met AS (
  SELECT r, label, best / len(tw) AS share FROM (
    SELECT *, list_max(list_transform(range(1, greatest(1, len(ws) - width + 1) + 1), lambda i: len(list_intersect(ws[i:i + width - 1], tw)))) AS best FROM able)
  WHERE best >= need),
more AS (SELECT r, list(label) AS found, max(share) AS best FROM met GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(base.found)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.found, more.found))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM t JOIN w USING (r) LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


OP6_SQL = _sql()
