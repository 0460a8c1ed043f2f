"""The near-duplicate stage against brute-force Jaccard."""

import itertools

import corpus_pipeline
from llm_helpers import words
from test_brute_force import smallest

from sparloom.llm import simhash


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def test_stage_finds_every_near_copy(spark, documents, texts, sf):
    w = [f"w{k}" for k in range(300)]
    chain = {9000 + k: " ".join(w[8 * k : 8 * k + 100]) for k in range(12)}
    edited = {9100 + k: " ".join(x if j % (90 + k) else f"new{k}" for j, x in enumerate(w)) for k in range(12)}
    short = {9200: "a b", 9201: "A  b", 9202: "a c", 9203: "", 9204: " "}
    given = texts | chain | edited | short
    d = spark.createDataFrame(list(given.items()), "doc_id long, text string")
    ids, sets = sorted(given), {i: shingles(t) for i, t in given.items()}
    rows = [sets[i] for i in ids]
    pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if near(sets[a], sets[b])]
    assert sum(given[a] != given[b] for a, b in pairs) > 20
    want = sorted({ids[k] for k in smallest(len(ids), lambda a, b: near(rows[a], rows[b]))})
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, sf).collect()) == want


def test_a_row_of_every_group_stays(spark):
    near_copy = " ".join(f"w{k}" for k in range(200))
    other = " ".join(f"v{k}" for k in range(200))
    rows = [(2, near_copy), (5, near_copy + " more"), (5, other), (6, other), (None, "text of no id and some more words"), (None, "text of no id and some more words"), (7, "one id"), (7, "and two texts")]
    kept = simhash.keep_similar_once(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(2, near_copy), (5, other), (0, rows[4][1]), (7, "one id"), (7, "and two texts")])
