"""Redaction of texts with very many spans, and of spans at the ends of blocks."""

import random
import time

from sparloom.llm import pii


def plain(text, spans):
    """The same, span by span."""
    out, far = [], 0
    for start, end, kind in sorted(spans):
        if start >= far:
            out.append(text[far:start] + f"<{pii.KINDS[kind]}>")
        far = max(far, end)
    return "".join(out) + text[far:]


def test_pieces_as_cut_one_by_one(spark):
    rnd, rows = random.Random(5), []
    for k in range(120):
        words = [rnd.choice(("a@b.co", "10.0.0.1", "x.1.2.3.4.5.6.7.8@x.com", "+49 30 1234567", "word", "\U0001f600é", "\n", "4111 1111 1111 1111")) for _ in range(rnd.choice((1, 5, 300, 900)))]
        rows.append((k, " ".join(words)))
    for at in range(pii.BLOCK - 8, pii.BLOCK + 2):
        rows += [(1000 + at, "é" * at + " a@b.co"), (5000 + at, "x" * (at - 7) + " a@b.co"), (9000 + at, "a@b.co " + "\U0001f600" * at)]
    rows += [(20000, None), (20001, ""), (20002, "a@b.co")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.found] for r in pii.find(docs).collect()}
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {i: t if t is None else plain(t, found[i]) for i, t in rows}
    assert got[20002] == "<email>"


def test_time_does_not_grow_with_the_square(spark):
    docs = spark.createDataFrame([(1, " ".join(f"u{k}@h.co" for k in range(40_000)))], "doc_id long, text string")
    began = time.time()
    assert pii.redact(docs).first().text == " ".join(["<email>"] * 40_000)
    assert time.time() - began < 60
