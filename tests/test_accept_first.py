"""Keep-first acceptance on chains, in place, by components and by blocks."""

import random

import pytest

from sparloom.operators import curation, graph


def plain(rows, n_keys, seen=()):
    held, kept = [{s[i] for s in seen} for i in range(n_keys)], set()
    for o, *keys in sorted(rows):
        if not any(k and k in h for k, h in zip(keys, held, strict=True)):
            kept.add(o)
            for k, h in zip(keys, held, strict=True):
                h.add(k)
    return kept


@pytest.mark.parametrize(("in_place", "rounds"), [(1_000_000, 3), (200, 1), (40, 0), (5, 2)])
def test_same_rows(spark, in_place, rounds):
    rnd = random.Random(in_place)
    rows = [(o, rnd.choice(["", None, *map(str, range(120))]), f"s{rnd.randrange(150)}", f"h{rnd.randrange(400)}") for o in rnd.sample(range(10_000), 500)]
    seen = [("3", "s5", ""), ("7", "s9", "h1")]
    df = spark.createDataFrame(rows, "o long, a string, b string, c string")
    old = spark.createDataFrame(seen, "a string, b string, c string")
    got = curation.accept_first(df, "o", ["a", "b", "c"], old, in_place=in_place, rounds=rounds)
    assert {r.o for r in got.filter("kept").collect()} == plain(rows, 3, seen) and got.count() == 500


def test_a_long_chain(spark, monkeypatch):
    n, written = 100_000, []
    write = curation.materialize
    monkeypatch.setattr(curation, "materialize", lambda df, label: written.append(label) or write(df, label))
    rows = [(i, str(i // 2), str((i + 1) // 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "o long, a string, b string").repartition(4)
    got = curation.accept_first(df, "o", ["a", "b"], rounds=0)
    assert {r.o for r in got.filter("kept").collect()} == plain(rows, 2) and len(written) < 20


def test_components_take_few_rounds(spark, monkeypatch):
    n, written = 20_000, []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(label) or write(df, label))
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i != n // 2]
    found = {r.a: r.b for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = [min(order[: n // 2 + 1]), min(order[n // 2 + 1 :])]
    assert all(found.get(v, v) == low[i > n // 2] for i, v in enumerate(order))
    assert written.count("tied") < 20
