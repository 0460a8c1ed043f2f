"""The pipeline, stage by stage, against plain versions of its rules."""

import re

import corpus_pipeline
from llm_helpers import low, words
from test_brute_force import smallest, spans
from test_similar_sets import near, shingles

from sparloom.llm.common import materialize
from sparloom.llm.decontamination import tile


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(materialize(stage(spark, kept[-1], sf), "test"))
        assert kept[-1].columns == columns
    start, good, one, clean, redacted = ({r.doc_id: r for r in d.collect()} for d in kept)
    plain = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i, r in start.items():
        w = plain(r.text)
        if len(w) < 10:
            assert i not in good
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not [i for i in good if labels.get(i) == 0]
    lost = [i for i in start if labels.get(i) == 1 and i not in good and len(plain(start[i].text)) >= 10]
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    assert all(len(set(g := grams(plain(start[i].text)))) < len(g) for i in lost)
    rows = sorted((i, shingles(r.text)) for i, r in good.items())
    roots = smallest(len(rows), lambda a, b: near(rows[a][1], rows[b][1]))
    assert sorted(one) == sorted({rows[k][0] for k in roots})
    items = [re.findall("[0-9a-z\x80-\U0010ffff]+", low(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, r in one.items():
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", low(r.text))
        mine, hit = set(grams(w)), False
        for item in items:
            if mine & set(grams(item)):
                seeds = [(x, y) for x in range(len(w) - 4) for y in range(len(item) - 4) if w[x : x + 5] == item[y : y + 5]]
                hit |= sum(n for _, _, n in tile(seeds, 5)) >= 0.5 * len(item)
        assert (i in clean) != hit
    for i, r in redacted.items():
        assert not spans(r.text) and r.n_chars == len(r.text)
        assert (r.text == clean[i].text) == (not spans(clean[i].text))
    mixed = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf).collect()
    by = {}
    for r in mixed:
        assert r.text == redacted[r.doc_id].text and r.taken == r.size == len(words(r.text))
        by.setdefault(r.source, []).append(r)
    for group in by.values():
        largest = max(len(words(r.text)) for r in redacted.values() if r.source == group[0].source)
        assert abs(sum(r.taken for r in group) - group[0].target) <= largest + 1


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 0 and {"doc_id", "text", "copy", "taken"} <= set(rows.columns)
