"""The prefix trie against a plain one, with shards of a few rows and conversations of several segments."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparloom.llm import prefix_trie


def plain_trie(convs):
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = lambda k: ",".join(str(c) for c in sorted(members[k]) if len(convs[c]) == len(k))
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in members.items()), key=str)


def plain_rebuilt(convs):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in convs.items()}


def rows(df):
    return sorted(map(tuple, df.select(prefix_trie.RESULT).collect()), key=str)


@pytest.fixture(scope="module")
def made(spark):
    rnd, convs = random.Random(1), {}
    for c in range(150):
        n = rnd.choice([1, 2, 3, 5, 15, 16, 17, 32, 33, 50])
        convs[c] = [("u" if i % 2 else "a", rnd.choice("xyé") if i < 3 else f"same{i}" if rnd.random() < 0.97 else rnd.choice("pq")) for i in range(n)]
    convs |= {c: [("a", "x")] * 40 for c in range(1000, 1060)}
    data = [(c, i, r, x) for c, t in convs.items() for i, (r, x) in enumerate(t)]
    rnd.shuffle(data)
    return convs, spark.createDataFrame(data, "conv_id long, turn int, role string, text string")


@pytest.mark.parametrize(("turns", "segments"), [(500_000, 50_000), (500, 60)])
def test_same_nodes(made, turns, segments, monkeypatch):
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    monkeypatch.setattr(prefix_trie, "SEGMENTS", segments)
    convs, df = made
    assert rows(prefix_trie.prefix_trie(df)) == plain_trie(convs)
    assert rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.placed(df)))) == plain_trie(plain_rebuilt(convs))


def test_query(spark, sf):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r.conv_id].append((r.role or "", r.text or ""))
    assert rows(prefix_trie.op11_prefix_trie(spark, sf)) == plain_trie(plain_rebuilt(convs))


def test_defined_results(spark):
    data = [(3, None, "u", "b"), (3, 0, None, "c"), (3, 0, None, "c"), (4, 1, "u", None), (None, 0, "u", "x"), (-2, 5, "", ""), (7, 1, "u", "b"), (7, 1, "u", "a")]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").withColumns({c: F.lit("x") for c in ("p", "id", "row", "shard", "k", "n", "h1", "kind")})
    tie = sorted([("u", "a"), ("u", "b")], key=lambda t: hashlib.md5(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest())
    convs = {3: [("u", "b"), ("", "c"), ("", "c")], 4: [("u", "")], -2: [("", "")], 7: tie}
    assert rows(prefix_trie.prefix_trie(df)) == plain_trie(convs)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.placed(df.limit(0)))).count() == 0


def test_conversations_without_turns(spark):
    bare = [c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9 > 0]
    df = spark.createDataFrame([(c, 0, "u", "x") for c in bare], "conv_id long, turn int, role string, text string")
    got = rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.placed(df))))
    assert got == plain_trie({c: [] for c in bare}) and len(got) == 1
