"""Word hashes: equal for equal words wherever they stand, apart for words that are alike in a regular way."""

import random

import numpy as np

from llm_helpers import low
from sparloom.llm import tokens


def hashes(text):
    return tokens.word_hashes(np.frombuffer(text.encode(), np.uint8), np.zeros(0, np.int64))[0].tolist()


def test_a_word_and_its_complement_differ():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
        one, other = hashes(f"{word} {word.translate(str.maketrans('ab', 'ba'))}")
        assert one != other


def test_hashes_tell_words():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abAB1\u00e9") for _ in range(rnd.randrange(1, 40))) for _ in range(20_000)]
    found = dict(zip(map(low, words), hashes(" ".join(words)), strict=True))
    assert len(set(found.values())) == len(found)
    for w in words[:300]:
        assert hashes(w) == [found[low(w)]] and hashes(f"x  {w}\n")[1] == found[low(w)]
    assert hashes("a aa aaaaaaaa aaaaaaaaa") == [hashes(x)[0] for x in ("a", "aa", "a" * 8, "a" * 9)]
