"""The n-gram join against brute force, on the small tables and on made families of copies."""

import random

import pytest
from pyspark.sql import functions as F

from llm_helpers import words
from sparloom.llm import ngram_join


def plain_join(texts, size=4, percent=85):
    sets = {i: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if (w := words(t)) else set() for i, t in texts.items()}
    name, ids = {i: i for i in sets}, sorted(sets)

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    by = {}
    for i in ids:
        met = {}
        for g in sets[i]:
            for j in by.setdefault(g, []):
                met[j] = met.get(j, 0) + 1
            by[g].append(i)
        for j, shared in met.items():
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                name[b] = a
    return {(i, len(sets[i]), find(i)) for i in ids}


def rows(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()}


def test_query(spark, sf, texts):
    want = plain_join(texts)
    assert rows(ngram_join.op13_ngram_join(spark, sf)) == want
    assert any(i != c for i, _, c in want)


@pytest.fixture(scope="module")
def made():
    rnd, texts = random.Random(7), {}
    vocabulary = [f"w{k}" for k in range(300)]
    for family in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 20, 60, 400, 3000]))]
        for _ in range(25):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(own) // 25)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            texts[len(texts)] = " ".join(own[: rnd.choice([len(own), len(own) - len(own) // 20])])
    footer = " ".join(vocabulary[:60])
    for k in range(40):
        texts[len(texts)] = " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([8, 100]))) + " " + footer
    texts |= {len(texts) + k: t for k, t in enumerate(["one two", "One  two", "one", "", " \n", footer, footer + " x"])}
    return texts


@pytest.mark.parametrize("fragment", [2048, 16])
def test_families(spark, made, fragment, monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT", fragment)
    assert rows(ngram_join.join(spark.createDataFrame(list(made.items()), "doc_id long, text string"))) == plain_join(made)


def test_partial_counts_add_up(spark):
    a = [f"v{k}" for k in range(500)]
    b = a[:460] + ["x"] + a[461:]
    texts = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "th long, text string")
    pairs = spark.createDataFrame([(1, 2, 1, 2, 497, 497)], "x long, y long, x_th long, y_th long, x_n int, y_n int")
    assert [r.shared for r in ngram_join.overlaps(pairs, texts, fragment=10).collect()] == [493]


def test_odd_rows(spark, odd, none):
    got = ngram_join.join(odd)
    assert got.columns == ["doc_id", "n_shingles", "component_id"] and got.count() == odd.count()
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()}
    assert {(1, 7, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 2, 5), (None, 0, None), (None, 1, None), (7, 1, 7)} <= found
    assert ngram_join.join(none).count() == 0
    linked = spark.createDataFrame([(None, "a b"), (9, "A b"), (8, "a  b")], "doc_id long, text string").withColumn("root", F.lit(1))
    assert {(r.doc_id, r.component_id) for r in ngram_join.join(linked).collect()} == {(None, 8), (9, 8), (8, 8)}
