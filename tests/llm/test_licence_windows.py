"""Words of a licence must stand near each other, however long the block is."""

import math
import random

from sparloom.llm import license_scan


def found(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in license_scan.scan(docs, **options).collect()}


def test_scattered_words_are_no_licence(spark):
    rnd = random.Random(3)
    filler = [f"w{k}" for k in range(400)]
    words = rnd.choices(filler, k=2000)
    for n, w in enumerate("released under the mit license all rights reserved".split()):
        words[60 + 220 * n] = w
    text = " ".join(words)
    whole = words[:1000] + "Released under the very good MIT License".split() + words[1000:]
    got = found(spark, [text, " ".join(whole), "x " * 3000 + "all rights reserved" + " y" * 3000])
    assert (got[0].labels, got[0].score) == ("", 0.0)
    assert (got[1].labels, got[1].score) == ("mit", 1.0)
    assert got[2].labels == "all-rights-reserved"


def test_the_same_as_every_window(spark):
    rnd = random.Random(8)
    templates = (("one", "a b c d e f g h i j"), ("two", "k l m a"), ("three", "b b c b d"))
    texts = []
    for _ in range(300):
        some = rnd.choice(("abcdefghij", "klma" * 3 + "xyzw", "bcd" * 2 + "uvwxyz", "abcdefghijklm" + "nopqrst"))
        texts.append(" ".join(rnd.choices(some, k=rnd.choice((3, 8, 20, 60)))))
    got = found(spark, texts, phrases=(), templates=templates)
    labelled = 0
    for i, text in enumerate(texts):
        words, met, best = text.split(), set(), 0.0
        for label, t in templates:
            own, width = set(t.split()), license_scan.SPREAD * len(t.split())
            top = max(len(own & set(words[k : k + width])) for k in range(max(1, len(words) - width + 1)))
            if top >= max(1, math.ceil(round(license_scan.THRESHOLD * len(own), 9))):
                met.add(label)
                best = max(best, top / len(own))
        labelled += bool(met)
        assert (got[i].labels, got[i].score) == (",".join(sorted(met)), best), text
    assert 50 < labelled < 280
