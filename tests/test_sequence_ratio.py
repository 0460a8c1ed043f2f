"""The matching-blocks ratio against the standard library's, also on texts whose frequent characters begin no match."""

import difflib
import random

import pandas as pd
import pytest

from sparloom.functions import similarity


def pairs(seed, n, longest, letters):
    rnd = random.Random(seed)
    for _ in range(n):
        a = "".join(rnd.choice(letters) for _ in range(rnd.randrange(longest)))
        b = list(a) if rnd.random() < 0.5 else [rnd.choice(letters) for _ in range(rnd.randrange(longest))]
        for _ in range(rnd.randrange(12)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(5)] = [rnd.choice(letters) for _ in range(rnd.randrange(5))]
        yield a, "".join(b)


@pytest.mark.parametrize(("n", "longest", "letters"), [(400, 12, "ab"), (300, 60, "abcé红 "), (120, 500, "abcdefgh ij"), (60, 500, "".join(map(chr, range(0x4E00, 0x4E00 + 150))) + "aaab")])
def test_random_pairs(n, longest, letters):
    made = [("", ""), ("a", ""), ("", "b"), ("x" * 300, "x" * 300), ("ab" * 150, "ba" * 150), *pairs(n, n, longest, letters)]
    got = similarity.sequence_ratio.func(pd.Series([a for a, _ in made]), pd.Series([b for _, b in made]))
    assert list(got) == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in made]


def test_small_blocks_of_cells(monkeypatch):
    made = list(pairs(9, 80, 40, "abc"))
    monkeypatch.setattr(similarity, "CELLS", 64)
    got = similarity.sequence_ratio.func(pd.Series([a for a, _ in made]), pd.Series([b for _, b in made]))
    assert list(got) == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in made]


def test_nulls_and_repeats():
    got = similarity.sequence_ratio.func(pd.Series(["ab", None, "ab", None]), pd.Series(["abc", None, "abc", "x"]))
    assert list(got) == [0.8, 1.0, 0.8, 0.0]
