"""Multi-index hashing against all pairs."""

import random

import pytest

from sparloom.operators import duplicates


@pytest.mark.parametrize("distance", range(6))
def test_all_pairs(spark, distance):
    rnd = random.Random(distance)
    base = [rnd.getrandbits(64) for _ in range(30)]
    hashes = base + [h ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(8))) for h in base for _ in range(6)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    members, pairs = duplicates.near_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, h long"), "id", "h", distance)
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(i, j, (g ^ h).bit_count()) for g, i in first.items() for h, j in first.items() if i < j and (g ^ h).bit_count() <= distance}
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and (distance < 2 or want)
    assert {r.id: r.class_id for r in members.collect()} == {i: first[h] for i, h in enumerate(hashes)}
